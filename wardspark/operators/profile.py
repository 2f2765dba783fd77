"""Counts, statistics and null profiles (inventory A2–A4, A6–A10, A13, A15, J6–J8).

Every statistic is an ordinary two-level ``groupBy`` (per key, then per item), so partial aggregation runs
map-side and no group is ever collected whole. Definition tables joined here grow with the vocabulary, not
with the events; they are joined normally and AQE broadcasts them when their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISIT = ["subject_id", "hadm_id"]


def nonnull_count(df: DataFrame, item="itemid", value="valuenum", keys=VISIT) -> DataFrame:
    """A2: COUNT(value) per (item, visit). (The reference orders by count asc, item desc: see ``ordered``.)"""
    return df.groupBy(item, *keys).agg(F.count(value).alias("n"))


def ordered_counts(counts: DataFrame, item="itemid") -> DataFrame:
    """O1 for A2: count ascending, item descending."""
    return counts.orderBy(F.col("n").asc(), F.col(item).desc())


def count_per_visit(df: DataFrame, keys=VISIT) -> DataFrame:
    """A3: rows per visit."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_histogram(counts: DataFrame, n="n") -> DataFrame:
    """A4: number of keys per observation count."""
    return counts.groupBy(n).agg(F.count(F.lit(1)).alias("keys"))


def mean_of_hourly_means(hourly: DataFrame, items=None, item="itemid", average="average") -> DataFrame:
    """Per item, AVG(average) and COUNT(average) over the hourly aggregate (optionally an item list)."""
    h = hourly if items is None else hourly.where(F.col(item).isin(list(items)))
    return h.groupBy(item).agg(F.avg(average).alias("avg_average"), F.count(average).alias("n_average"))


def item_frequency(df: DataFrame, defs: DataFrame, item="itemid", def_item="itemid",
                   def_cols=("label",)) -> DataFrame:
    """A7 + J6: rows per item joined to the item definitions; items without a definition are dropped."""
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("count"))
    d = defs.select(F.col(def_item).alias(item), *def_cols)
    return counts.join(d, on=item, how="inner")


def _stats(counts: DataFrame, item: str, n: str = "n") -> DataFrame:
    # count (total), num (keys), min, avg, max, sd of the per-key counts; sd = -1 with fewer than 2 keys
    return counts.groupBy(item).agg(
        F.sum(n).alias("count"), F.count(F.lit(1)).alias("num"), F.min(n).alias("min"),
        F.avg(n).alias("avg"), F.max(n).alias("max"),
        F.when(F.count(F.lit(1)) >= 2, F.stddev_samp(n)).otherwise(F.lit(-1.0)).alias("sd"))


def frequency_stats(df: DataFrame, item="itemid", by=("subject_id",), min_obs: int = 1000) -> DataFrame:
    """For items with more than ``min_obs`` rows, statistics of the per-``by`` counts:
    item, count, num, min, avg, max, sd (sd -1 when fewer than two keys)."""
    per_key = df.where(F.col(item).isNotNull()).groupBy(item, *by).agg(F.count(F.lit(1)).alias("n"))
    return _stats(per_key, item).where(F.col("count") > min_obs)


def item_statistics(df: DataFrame, defs: DataFrame | None = None, item="itemid", keys=VISIT,
                    def_item="itemid", def_cols=("label",)) -> DataFrame:
    """A9 (+ J6): per item over the per-visit counts: count (total rows), num (visits), avg, min, max, sd."""
    per_visit = df.groupBy(item, *keys).agg(F.count(F.lit(1)).alias("n"))
    out = _stats(per_visit, item)
    if defs is not None:
        out = out.join(defs.select(F.col(def_item).alias(item), *def_cols), on=item, how="inner")
    return out


def distinct_pairs(df: DataFrame, cols=("itemid", "valueuom")) -> DataFrame:
    """A10: SELECT DISTINCT over the given columns."""
    return df.select(*cols).distinct()


def weighted_category_mean(item_means: DataFrame, vocab: DataFrame, item="itemid", mean="avg_average",
                           n="n_average") -> DataFrame:
    """Per chart category, sum(converted mean x n) / sum(n) over its items.

    The conversion is affine, so converting an item's mean equals the mean of its converted values."""
    v = vocab.where(F.col("source") == "chart").select(F.col("itemid").alias(item), "feature", "scale", "shift")
    j = item_means.join(F.broadcast(v), on=item, how="inner") \
        .withColumn("_cm", (F.col(mean) + F.col("shift")) * F.col("scale"))
    return j.groupBy("feature").agg(
        F.try_divide(F.sum(F.col("_cm") * F.col(n)), F.sum(n).cast("double")).alias("category_mean"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, null count and share of rows (one aggregate pass, then stack to long form)."""
    total = F.count(F.lit(1))
    agg = df.agg(total.alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)])
    stack = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(columns))
    return agg.selectExpr("_rows", f"stack({len(columns)}, {stack}) AS (column_name, nulls)") \
        .select("column_name", F.col("nulls").cast("long").alias("nulls"),
                F.try_divide(F.col("nulls").cast("double"), F.col("_rows").cast("double")).alias("share"))


def row_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per row, the number of null columns; returned as a histogram (nulls per row -> rows)."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.select(nulls.alias("nulls_in_row")).groupBy("nulls_in_row").agg(F.count(F.lit(1)).alias("rows"))


def lookup_with_default(df: DataFrame, lookup: DataFrame, key="itemid", value="avg_average",
                        out="mean") -> DataFrame:
    """Append the looked-up value by key; null ('nan' in the reference) when absent."""
    return df.join(lookup.select(key, F.col(value).alias(out)), on=key, how="left")


def units_per_item(items: DataFrame, events: DataFrame, item="itemid", unit="valueuom") -> DataFrame:
    """Each listed item with the sorted set of its distinct units (empty when the item never occurs).

    Distinct (item, unit) pairs first (A10), then one small set per item — the set size is the number of
    distinct units of an item, not its number of events."""
    pairs = distinct_pairs(events.where(F.col(unit).isNotNull()), (item, unit))
    sets = pairs.groupBy(item).agg(F.sort_array(F.collect_list(unit)).alias("units"))
    return items.select(item).join(sets, on=item, how="left") \
        .withColumn("units", F.coalesce(F.col("units"), F.array().cast("array<string>")))
