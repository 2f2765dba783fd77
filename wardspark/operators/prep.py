"""Modelling-table preparation (inventory S2, P10–P13, T1–T15, A16, A18, A19, U2, W7).

Scale notes
-----------
* Positions (splits, resampling draws) and ranks (Kruskal–Wallis, ROC AUC) need a global order. They are
  computed with a *bucketed prefix count*: rows are bucketed by an order-preserving key, bucket totals are
  prefix-summed over the buckets of a group, and positions inside a bucket come from a window over that bucket
  only. The number of buckets follows the row count, and rank buckets are cut at approximate quantiles, so no
  window spans a whole table or class, whatever the distribution of the values.
* Fitted parameters (column means, normal values, L2 norms, Gram matrix) are vectors of one value per
  feature; like Spark ML's estimators they are aggregated in one distributed pass and applied as literals.
* Random choices are hash-based (md5 of the key and a seed) so they are reproducible and identical in SQL.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark import session
from wardspark.session import join_checked, materialize

VISIT = ["subject_id", "hadm_id"]
SPLITS = ("devel", "test", "valid")
ROWS_PER_BUCKET = 100_000
SYNTHETIC_BLOCK = 10_000


# ---- hashing, positions, ranks ------------------------------------------------------------------------------

def _hash(digits: int, cols, seed: int) -> Column:
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                              for c in cols])
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long")


def hash32(*cols, seed: int = 0) -> Column:
    """Unsigned 32-bit hash: the first 8 hex digits of md5('seed|c1|c2...') as a number (same in SQL)."""
    return _hash(8, cols, seed)


def hash60(*cols, seed: int = 0) -> Column:
    """Unsigned 60-bit hash (15 hex digits), for draws modulo a count of any size."""
    return _hash(15, cols, seed)


def positions(df: DataFrame, group: list[str], order: str, tiebreak: list[str], buckets: int | None = None,
              out: str = "pos", size: str = "gsize") -> DataFrame:
    """0-based position of each row within its group in (order, tiebreak) order, plus the group size.

    ``order`` must be a non-negative 32-bit value (e.g. ``hash32``); the bucket is its top bits, so buckets
    are order-preserving and balanced for hashed keys. By default there is a bucket for every
    ``ROWS_PER_BUCKET`` rows."""
    if buckets is None:
        buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    b = F.floor(F.col(order) * F.lit(buckets) / F.lit(4294967296.0)).cast("int")
    x = df.withColumn("_b", b)
    cnt = x.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*group).orderBy("_b")
    offs = cnt.select(*group, "_b",
                      F.coalesce(F.sum("_c").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
                      F.sum("_c").over(Window.partitionBy(*group)).alias(size))
    wr = Window.partitionBy(*group, "_b").orderBy(order, *tiebreak)
    return (x.join(offs, on=[*group, "_b"], how="inner")
            .withColumn(out, F.row_number().over(wr) - 1 + F.col("_o"))
            .drop("_b", "_o"))


def exclusive_prefix_sums(df: DataFrame, group: list[str], order: str, values: list[str], width: float,
                          prefix: str = "pre_") -> DataFrame:
    """For each row, the sums of ``values`` over rows of the same group with a strictly smaller ``order``
    (numeric). Rows are bucketed by ``order // width``: bucket totals are prefix-summed over the buckets of a
    group, and only rows of the same bucket go through a row-level window, so a group with very many rows is
    spread over many window partitions. Nulls count as 0."""
    x = df.withColumn("_pb", F.floor(F.col(order) / F.lit(float(width))))
    bt = x.groupBy(*group, "_pb").agg(*[F.sum(v).alias(f"_bt_{v}") for v in values])
    wb = Window.partitionBy(*group).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    boff = bt.select(*group, "_pb", *[F.coalesce(F.sum(f"_bt_{v}").over(wb), F.lit(0)).alias(f"_bo_{v}")
                                      for v in values])
    wi = Window.partitionBy(*group, "_pb").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    y = x.join(boff, on=[*group, "_pb"], how="inner")
    out = y.select("*", *[(F.coalesce(F.sum(v).over(wi), F.lit(0)) + F.col(f"_bo_{v}")).alias(f"{prefix}{v}")
                          for v in values])
    return out.drop("_pb", *[f"_bo_{v}" for v in values])


def average_ranks(df: DataFrame, group: list[str], value: str, extra: list[str] = (),
                  buckets: int | None = None) -> DataFrame:
    """Tie-averaged ranks of ``value`` within ``group`` from a value histogram.

    Returns one row per (group, value, extra) with ``cnt`` rows and ``rank`` = average rank of that value
    (1-based, ties averaged) and ``t`` = number of rows sharing the value. Null values have no rank and no row;
    infinite values rank at the ends and NaN above all (Spark's order). The histogram is written once. Its
    buckets are cut at approximate quantiles of each group's distinct values, so an outlier leaves the others
    balanced; by default there is a bucket for every ``ROWS_PER_BUCKET`` distinct values."""
    hist = materialize(df.where(F.col(value).isNotNull()).groupBy(*group, value, *extra)
                       .agg(F.count(F.lit(1)).alias("cnt")), "rank-histogram")
    tot = hist.groupBy(*group, value).agg(F.sum("cnt").alias("t"))
    if buckets is None:
        buckets = max(1, -(-hist.count() // ROWS_PER_BUCKET))
    if buckets == 1:
        tb = tot.withColumn("_b", F.lit(0))
    else:
        shares = [i / buckets for i in range(1, buckets)]
        cuts = materialize(tot.groupBy(*group).agg(F.percentile_approx(value, shares, 20 * buckets).alias("_cuts")),
                           "rank-cuts")
        tb = join_checked(tot, cuts, list(group), row_bytes=8 * buckets + 64).withColumn(
            "_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    bt = tb.groupBy(*group, "_b").agg(F.sum("t").alias("_bt"))
    boff = bt.select(*group, "_b", F.coalesce(F.sum("_bt").over(
        Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    win = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (tb.join(boff, on=[*group, "_b"], how="inner")
              .withColumn("_before", F.coalesce(F.sum("t").over(win), F.lit(0)) + F.col("_o"))
              .select(*group, value, "t", (F.col("_before") + (F.col("t") + 1) / 2.0).alias("rank")))
    return hist.join(ranked, on=[*group, value], how="inner")


# ---- S2, P10–P13 ---------------------------------------------------------------------------------------------

def read_snapshot_csv(spark, path: str, id_cols=("subject_id", "hadm_id"), drop_empty: bool = True,
                      label_phrase: str = "stage") -> DataFrame:
    """Read snapshot CSV files with '?' / '!' / '!<value>' sentinels as NULL doubles.

    Every column except ids, demographics and label columns (name contains ``label_phrase``) is a feature;
    rows with all features null are dropped when ``drop_empty``; rows are NOT sorted (order is irrelevant
    to every later operator)."""
    from wardspark.functions.clinical import clear_sentinel
    raw = spark.read.option("header", True).csv(path)
    lower = {c: c.lower().replace(" ", "_") for c in raw.columns}
    df = raw.select(*[F.col(f"`{c}`").alias(lower[c]) for c in raw.columns])
    keep = set(id_cols) | {"age", "gender", "ethnicity", "hour"}
    feats = [c for c in df.columns if c not in keep and label_phrase not in c]
    out = df.select(*[clear_sentinel(c).alias(c) if c in feats else
                      (F.col(c).try_cast("long").alias(c) if c in set(id_cols) | {"hour", "age", "gender"}
                       or label_phrase in c else F.col(c)) for c in df.columns])
    return drop_empty_rows(out, feats) if drop_empty else out


def drop_by_phrase(df: DataFrame, phrases=("pstage", "ptstage"), also=()) -> DataFrame:
    """Drop columns whose name contains any phrase, plus a fixed list."""
    drop = [c for c in df.columns if any(p in c for p in phrases) or c in set(also)]
    return df.drop(*drop)


def model_columns(df: DataFrame, keys=VISIT, hour="hour") -> tuple[DataFrame, list[str]]:
    """P11 on the wide snapshot: (frame without hour, ethnicity, previous labels and the left-out items, its feature
    columns). 226 columns become 192, of which 178 are features (ids and forward labels are not)."""
    from wardspark.functions.vocab import LEFT_OUT_ITEMS, feature_name
    names = [f"{side}_{feature_name(i)}" for side in ("prior", "cur") for i in LEFT_OUT_ITEMS]
    out = drop_by_phrase(df, also=(hour, "ethnicity", *names))
    return out, [c for c in out.columns if c not in keys and "stage" not in c]


def select_columns(df: DataFrame, first: list[str], drop=()) -> DataFrame:
    """P10: move ``first`` to the front, drop ``drop``, keep the rest in order."""
    rest = [c for c in df.columns if c not in set(first) | set(drop)]
    return df.select(*first, *rest)


def drop_empty_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Keep rows with at least one non-null feature."""
    return df.dropna(how="all", subset=list(features))


def nonempty_columns(df: DataFrame, features: list[str]) -> list[str]:
    """Names of features with at least one non-null value (one aggregate pass; one count per column)."""
    if not features:
        return []
    row = df.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if row[c] > 0]


def column_null_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """P13 as a DataFrame: column, non_null (for plans that keep the decision distributed)."""
    stack = ", ".join(f"'{c}', `{c}`" for c in features)
    return df.agg(*[F.count(c).alias(c) for c in features]) \
        .selectExpr(f"stack({len(features)}, {stack}) AS (column_name, non_null)")


# ---- T3–T5 splits --------------------------------------------------------------------------------------------

def split_visits(ids: DataFrame, keys=VISIT, test: float = 0.2, valid: float = 0.25, strata: str | None = None,
                 seed: int = 0, buckets: int | None = None) -> DataFrame:
    """Assign each key to test / valid / devel by position in hash order (within ``strata`` if given):
    test = first ceil(test*n), valid = next ceil(valid*(n - n_test)), devel = the rest."""
    group = [strata] if strata else []
    x = ids.select(*keys, *group).distinct().withColumn("_h", hash32(*keys, seed=seed))
    if not group:
        x = x.withColumn("_g", F.lit(0))
        group = ["_g"]
    p = positions(x, group, "_h", list(keys), buckets)
    n_test = F.ceil(F.col("gsize") * F.lit(test))
    n_valid = F.ceil((F.col("gsize") - n_test) * F.lit(valid))
    split = F.when(F.col("pos") < n_test, "test").when(F.col("pos") < n_test + n_valid, "valid").otherwise("devel")
    out = p.select(*keys, *([strata] if strata else []), split.alias("split"))
    return out


def apply_split(df: DataFrame, splits: DataFrame, keys=VISIT) -> DataFrame:
    """T5: attach the split of each row's visit (pair join on the visit key).

    A wide table of few values has small files, by which Spark would take it for the side to send to all executors
    through the driver. So the splits, written and counted, are that side if they are few, and else rows are merged."""
    found = materialize(splits.select(*keys, "split"), "splits")
    few = found.count() * 128 <= session.BROADCAST_BYTES
    return df.join(F.broadcast(found) if few else found.hint("merge"), on=list(keys), how="inner")


# ---- A16, A18, A19, T6–T9, T11 --------------------------------------------------------------------------------

def class_distribution(df: DataFrame, label: str, split="split", reference: str = "devel") -> DataFrame:
    """Per split and class: count, share of the split, and ratio of that share to the reference split."""
    c = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("count"))
    tot = c.groupBy(split).agg(F.sum("count").alias("_n"))
    s = c.join(tot, on=split).withColumn("share", F.col("count") / F.col("_n")).drop("_n")
    ref = s.where(F.col(split) == reference).select(label, F.col("share").alias("_ref"))
    return s.join(ref, on=label, how="left").withColumn("ratio", F.try_divide(F.col("share"), F.col("_ref"))) \
        .drop("_ref")


def column_means(df: DataFrame, features: list[str]) -> dict:
    """Mean of each feature (one aggregate pass); a fitted parameter vector."""
    if not features:
        return {}
    row = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    return {c: row[c] for c in features}


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replace nulls of each feature by its value (mean or normal); None leaves the column as is."""
    return df.select(*[F.coalesce(F.col(c), F.lit(values[c]).cast("double")).alias(c)
                       if c in values and values[c] is not None else F.col(c) for c in df.columns])


def hierarchical_impute(df: DataFrame, features: list[str], keys=VISIT, normals: dict | None = None) -> DataFrame:
    """Value -> mean of the visit over its hours -> mean over visits of the visit means -> normal value.

    The visit mean is a window over the visit (bounded by its hours); the mean of visit means is one
    aggregate over the visit-level table."""
    w = Window.partitionBy(*keys)
    vm = df.select("*", *[F.avg(c).over(w).alias(f"_vm_{c}") for c in features])
    per_visit = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in features])
    global_means = column_means(per_visit, features)
    normals = normals or {}
    cols = []
    for c in df.columns:
        if c in features:
            cols.append(F.coalesce(F.col(c), F.col(f"_vm_{c}"), F.lit(global_means[c]).cast("double"),
                                   F.lit(normals.get(c)).cast("double")).alias(c))
        else:
            cols.append(F.col(c))
    return vm.select(*cols)


def normals_lookup(normals: DataFrame, category_means: DataFrame | None = None,
                   item_means: DataFrame | None = None) -> DataFrame:
    """Feature -> coalesce(normal, category mean (A13), item mean (A6)).

    ``normals``: feature, normal; ``category_means``: feature, category_mean; ``item_means``: feature,
    item_mean. All three have one row per feature."""
    out = normals
    parts = [F.col("normal")]
    if category_means is not None:
        out = out.join(category_means.select("feature", "category_mean"), on="feature", how="left")
        parts.append(F.col("category_mean"))
    if item_means is not None:
        out = out.join(item_means.select("feature", "item_mean"), on="feature", how="left")
        parts.append(F.col("item_mean"))
    return out.select("feature", F.coalesce(*parts).alias("value"))


def mode_or_mean(df: DataFrame, group: list[str], features: list[str], modal: list[str], ids=VISIT,
                 id_value: int = 99999) -> DataFrame:
    """Per group, the mean of each feature and the mode of each modal column (smallest value on ties);
    id columns are set to ``id_value``."""
    aggs = [F.avg(c).alias(c) for c in features] + [F.mode(c, deterministic=True).alias(c) for c in modal]
    out = df.groupBy(*group).agg(*aggs)
    return out.select(*[F.lit(id_value).cast("long").alias(i) for i in ids], *group, *features, *modal)


def l2_normalize(df: DataFrame, features: list[str], split: str | None = "split") -> DataFrame:
    """Divide each feature by its own L2 norm, per split; one aggregate serves all splits."""
    key = "_split"
    x = df.withColumn(key, F.col(split) if split else F.lit(0))
    norms = materialize(x.groupBy(key).agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"_l2_{c}") for c in features]),
                        "l2-norms")
    out = join_checked(x, norms, key, row_bytes=16 * len(features) + 64)
    return out.select(*[F.try_divide(F.col(c), F.col(f"_l2_{c}")).alias(c) if c in features else F.col(c)
                        for c in df.columns])


# ---- T10 class-ratio resampling --------------------------------------------------------------------------------

def resample_to_reference(df: DataFrame, features: list[str], label: str, modal: list[str], split="split",
                          subsets=("test", "valid"), reference="devel", draws: int = 5, seed: int = 0,
                          keys=VISIT, rid: str = "rid") -> DataFrame:
    """For each subset, every class whose share is below the reference split's share gets
    ceil((1 - ratio) * count) synthetic rows; each synthetic row is A18 (mean / mode) over ``draws`` rows
    drawn with replacement (hash draws) from that class of that subset. Returns ``df`` plus the new rows.

    Work: synthetic ids are expanded in two levels, blocks of ``SYNTHETIC_BLOCK`` and then the ids of a block, so
    their number may grow with the data; each draw is a 60-bit hash modulo the class size, and an equi-join on
    (split, class, position) where positions come from the bucketed prefix count."""
    return df.unionByName(synthetic_rows(df, features, label, modal, split, subsets, reference, draws, seed, keys, rid),
                          allowMissingColumns=True)


def synthetic_rows(df: DataFrame, features: list[str], label: str, modal: list[str], split="split",
                   subsets=("test", "valid"), reference="devel", draws: int = 5, seed: int = 0,
                   keys=VISIT, rid: str = "rid") -> DataFrame:
    """The new rows of ``resample_to_reference``."""
    dist = class_distribution(df, label, split, reference)
    need = (dist.where(F.col(split).isin(list(subsets)) & (F.col("ratio") < 1))
            .select(split, label, "count", F.ceil((1 - F.col("ratio")) * F.col("count")).cast("long").alias("n_syn")))
    size = F.lit(SYNTHETIC_BLOCK).cast("long")
    blocks = need.select(split, label, "count", "n_syn", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_syn") - 1) / size))).alias("_block"))
    syn = blocks.repartition(split, label, "_block").select(split, label, "count", F.explode(F.sequence(
        F.col("_block") * size + 1, F.least((F.col("_block") + 1) * size, F.col("n_syn")))).alias("syn_id"))
    drawn = syn.select(split, label, "syn_id", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), "count")
    drawn = drawn.withColumn("pos", F.pmod(hash60(split, label, "syn_id", "draw", seed=seed), F.col("count")))
    pool = df.where(F.col(split).isin(list(subsets))).withColumn("_h", hash32(rid, seed=seed))
    pool = positions(pool, [split, label], "_h", [rid])
    picked = drawn.join(pool.drop("gsize"), on=[split, label, "pos"], how="inner")
    other_modal = [m for m in modal if m != label]
    synth = picked.groupBy(split, label, "syn_id").agg(
        *[F.avg(c).alias(c) for c in features], *[F.mode(c, deterministic=True).alias(c) for c in other_modal])
    return synth.select(*[F.lit(99999).cast("long").alias(k) for k in keys],
                        F.concat_ws("|", F.lit("syn"), F.lit(label), split, F.col(label).cast("string"),
                                    F.col("syn_id").cast("string")).alias(rid),
                        split, label, *features, *other_modal)


# ---- T12, T13, T15, U2 -----------------------------------------------------------------------------------------

def to_sequences(df: DataFrame, features: list[str], keys=VISIT, hour="hour", label: str | None = None,
                 n_classes: int = 4, last: str | None = None) -> DataFrame:
    """One row per visit: hours in order with their feature vectors (and one-hot label).

    The group is one visit's hours (bounded by the extraction horizon). Where a row stands for all hours from ``hour`` to
    ``last``, which are alike, so does its step: it has ``last`` too, and the vector is held once for them."""
    from wardspark.functions.clinical import one_hot
    item = F.struct(F.col(hour).alias("hour"), *([F.col(last).alias("last")] if last else []),
                    F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                    *( [one_hot(label, n_classes).alias("y")] if label else []))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("steps"))


def step_hours(seq: DataFrame, steps: str = "steps"):
    """The number of hours that a step of ``to_sequences`` stands for, as a function of the step."""
    if "last" not in seq.schema[steps].dataType.elementType.names:
        return lambda s: F.lit(1).cast("long")
    return lambda s: s["last"].cast("long") - s["hour"] + 1


def sequence_non_null(seq: DataFrame, features: list[str], steps: str = "steps") -> DataFrame:
    """P13 over visits x hours: (column_name, non_null) from sequences of ``to_sequences`` with the vectors ``x`` of
    ``features``. NaN counts as no value, as a null does; a visit without hours adds nothing, and a step adds all hours
    that it stands for.

    Steps and then their values become rows, which partial sums add up to one per task and feature before a shuffle."""
    hours = step_hours(seq, steps)
    each = seq.select(F.explode(steps).alias("s")).select(hours(F.col("s")).alias("hours"), F.posexplode("s.x").alias("pos", "v"))
    per = each.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("pos").agg(F.sum("hours").alias("n"))
    names = seq.sparkSession.createDataFrame(list(enumerate(features)), "pos int, column_name string")
    return names.join(per, "pos", "left").select("column_name", F.coalesce("n", F.lit(0)).cast("long").alias("non_null"))


def drop_sequence_columns(seq: DataFrame, features: list[str], keep: list[str] | None = None,
                          steps: str = "steps") -> tuple[DataFrame, list[str]]:
    """P13 over visits x hours: (sequences whose vectors hold the kept features only, these features in order).

    ``keep`` takes the features that another set of visits has kept, so that test vectors match the trained ones;
    without it, a feature that no hour of any visit has is dropped. ``seq`` is read twice then: give a written table,
    or one made from a written table where its rows are too large to be read many at a time."""
    if keep is None:
        found = {r["column_name"] for r in sequence_non_null(seq, features, steps).where("non_null > 0").collect()}
        keep = [f for f in features if f in found]
    unknown = set(keep) - set(features)
    if unknown:
        raise ValueError(f"not among the features: {sorted(unknown)}")
    at = [features.index(f) for f in keep]
    cut = F.transform(F.col(steps), lambda s: s.withField(
        "x", F.array(*[s["x"][i] for i in at]) if at else F.slice(s["x"], 1, 0)))
    return seq.withColumn(steps, cut), keep


def label_extract(df: DataFrame, features: list[str], labels=("stage_6", "stage_24", "stage_48", "stage_72")):
    """Features as doubles and the horizon labels as ints."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in features], *[F.col(c).cast("int").alias(c) for c in labels])


def stage_trajectory(df: DataFrame, keys=VISIT, hour="hour", label="stage_48") -> DataFrame:
    """Per visit, its hours and stages in order of the hour, as two arrays (the reference's visits as columns
    would make the table as wide as there are visits)."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(hour).alias("hour"), F.col(label).alias("stage"))))
    return df.groupBy(*keys).agg(steps.alias("_s")).select(
        *keys, F.col("_s.hour").alias("hours"), F.col("_s.stage").alias("stages"))


def stack_hours(*frames: DataFrame) -> DataFrame:
    """Concatenate snapshots of several hours, aligning columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---- T1 Kruskal–Wallis ------------------------------------------------------------------------------------------

def melt(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Long form (feature, value) of the given feature columns, nulls dropped."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(features)}, {stack}) AS (feature, value)") \
        .where(F.col("value").isNotNull())


def kruskal_h(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Kruskal–Wallis H per feature over the classes of ``label`` (nulls dropped), with tie correction.

    Returns feature, h (null when every value is equal), dof (= classes present - 1), n. A feature without any
    value has no row."""
    long = melt(df, features, [label]).where(F.col(label).isNotNull())
    r = average_ranks(long, ["feature"], "value", [label])
    per_class = r.groupBy("feature", label).agg(F.sum(F.col("rank") * F.col("cnt")).alias("R"),
                                                F.sum("cnt").alias("n_i"))
    ties = r.select("feature", "value", "t").distinct().groupBy("feature").agg(
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    g = per_class.groupBy("feature").agg(F.sum(F.col("R") * F.col("R") / F.col("n_i")).alias("S"),
                                         F.sum("n_i").alias("n"), F.count(F.lit(1)).alias("k"))
    n = F.col("n").cast("double")
    h0 = F.lit(12.0) / (n * (n + 1)) * F.col("S") - 3 * (n + 1)
    corr = 1 - F.col("tie") / (n * n * n - n)
    return g.join(ties, on="feature").select(
        "feature", F.when(corr > 0, h0 / corr).alias("h"), (F.col("k") - 1).cast("int").alias("dof"),
        F.col("n").cast("long").alias("n"))


def chi2_sf(x: float | None, k: int) -> float | None:
    """Chi-square survival function for integer degrees of freedom (closed forms; no SciPy)."""
    if x is None or k is None or k < 1 or (isinstance(x, float) and math.isnan(x)):
        return None
    if x <= 0:
        return 1.0
    if k % 2 == 0:
        term, s = 1.0, 1.0
        for i in range(1, k // 2):
            term *= (x / 2) / i
            s += term
        return math.exp(-x / 2) * s
    s = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (k - 1) // 2 + 1):
        s += term
        term *= x / (2 * i + 1)
    return s


def kruskal_select(df: DataFrame, features: list[str], label: str, threshold: float = 0.05,
                   keep: str = "p_above", classes=(0, 1, 2, 3)) -> tuple[list[str], list[tuple]]:
    """T1 decision: (kept features, [(feature, h, dof, p)]), p from the few H rows.

    ``keep='p_above'`` keeps features with p > threshold (the reference), 'p_below' the significant ones. A feature
    that has no value in one of ``classes`` has no test: p is None and the feature is dropped either way. So is one
    whose values are all equal; the reference's test raises there and p counts as 0."""
    stats, kept = [], []
    tested = kruskal_h(df.where(F.col(label).isin(list(classes))), features, label).collect() if features else []
    rows = {r["feature"]: r for r in tested}
    for f in features:
        r = rows.get(f)
        if r is None or r["dof"] < len(classes) - 1:
            stats.append((f, r and r["h"], r and r["dof"], None))
        elif r["h"] is None:
            stats.append((f, None, r["dof"], 0.0))
        else:
            p = chi2_sf(r["h"], r["dof"])
            stats.append((f, r["h"], r["dof"], p))
            if (p > threshold) if keep == "p_above" else (p <= threshold):
                kept.append(f)
    return kept, stats


# ---- T2 VIF -------------------------------------------------------------------------------------------------------

def gram_matrix(df: DataFrame, features: list[str], stripe: int = 512) -> DataFrame:
    """X'X (uncentered) as long rows (i, j, g) for i <= j, from one pass.

    Every task multiplies its batches and sends one row per pair; a null counts as 0 in its products. The number of
    expressions doesn't grow with the features, as one sum per pair would."""
    import numpy as np
    p = len(features)
    x = df.select(*[F.col(c).cast("double").alias(f"x{n}") for n, c in enumerate(features)])

    def part(first, last):
        def partial(batches):
            g = np.zeros((last - first, p))
            for b in batches:
                x = np.column_stack([np.asarray(c.fill_null(0.0)) for c in b.columns])
                g += x[:, first:last].T @ x
            i, j = np.indices(g.shape)
            i += first
            use = j >= i
            for lo in range(0, np.count_nonzero(use), 1 << 20):
                s = slice(lo, lo + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(i[use][s].astype("int32")), pa.array(j[use][s].astype("int32")),
                                                  pa.array(g[use][s])], ["i", "j", "g"])
        return x.mapInArrow(partial, "i int, j int, g double")

    out = part(0, min(stripe, p))
    for first in range(stripe, p, stripe):
        out = out.unionByName(part(first, min(first + stripe, p)))
    return out.groupBy("i", "j").agg(F.sum("g").alias("g"))


def vif_of(gram, tolerance: float = 1e-9):
    """VIF of each feature by regression on the others without intercept, from the uncentered Gram matrix.

    The matrix is scaled to unit diagonal. Features that take part in a linear dependency (a direction of variance
    zero) have VIF infinity; the others' follow from the pseudo-inverse. A zero column has NaN."""
    import numpy as np
    g = np.asarray(gram, float)
    d = np.sqrt(np.diag(g))
    out = np.full(len(g), np.nan)
    use = np.flatnonzero(d > 0)
    if len(use):
        r = g[np.ix_(use, use)] / np.outer(d[use], d[use])
        value, vector = np.linalg.eigh(r)
        null = value <= tolerance * len(use)
        inverse = (vector[:, ~null] ** 2 / value[~null]).sum(1)
        dependent = (vector[:, null] ** 2).sum(1) > tolerance ** 0.5
        out[use] = np.where(dependent, np.inf, inverse)
    return out


def vif_eliminate(df: DataFrame, features: list[str], max_vif: float = 5.0, drop: str = "largest"
                  ) -> tuple[list[str], dict]:
    """(kept features, their final VIFs). The Gram matrix is computed once and inverted by sweeps; dropping a
    feature is one rank-one update of the inverse.

    Zero columns go first. ``drop='largest'`` then drops the feature with the largest VIF, of equal ones the last,
    while it is at least ``max_vif``; ``drop='all'`` drops all such features at once, in rounds."""
    import numpy as np
    p = len(features)
    if not p:
        return [], {}
    g = np.zeros((p, p))
    for r in gram_matrix(df, features).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    idx = np.flatnonzero(np.diag(g) > 0)
    d = np.sqrt(np.diag(g)[idx])
    r = g[np.ix_(idx, idx)] / np.outer(d, d)
    while True:
        # dependencies first: the sweeps skip the last feature of each, as dropping the largest, infinite ones would
        swept, inverse, skipped = sweep_inverse(r)
        if drop != "all" or not len(skipped):
            break
        tied = np.abs(swept[:, skipped]).max(1) > DEPENDENT
        tied[skipped] = True
        keep = ~tied
        keep[keep] = np.diag(inverse)[~tied[np.setdiff1d(np.arange(len(r)), skipped)]] < max_vif
        idx, r = idx[keep], r[np.ix_(keep, keep)]
    idx = np.delete(idx, skipped)
    while len(idx) and np.diag(inverse).max() >= max_vif:
        v = np.diag(inverse)
        bad = np.flatnonzero(v >= max_vif) if drop == "all" else np.flatnonzero(v >= v.max() * (1 - 1e-9))[-1:]
        for n, k in enumerate(bad.tolist()):
            # without feature k the inverse loses the part that goes through it
            k -= n
            inverse = inverse - np.outer(inverse[:, k], inverse[k]) / inverse[k, k]
            inverse = np.delete(np.delete(inverse, k, 0), k, 1)
        idx = np.delete(idx, bad)
    return [features[i] for i in idx], {features[i]: float(x) for i, x in zip(idx, np.diag(inverse), strict=True)}


#: A swept feature takes part in a dependency if its coefficient for the dependent one is larger.
DEPENDENT = 1e-4


def sweep_inverse(r, tolerance: float = 1e-9):
    """(swept matrix, inverse over the features that were swept, features that were not) of a correlation matrix.

    Features are swept in order, one rank-one update each; one that the features before it determine, whose residual
    variance is at most ``tolerance`` times their number, is skipped."""
    import numpy as np
    a = np.array(r, float)
    swept = np.zeros(len(a), bool)
    for k in range(len(a)):
        if a[k, k] <= tolerance * len(a):
            continue
        row = a[k] / a[k, k]
        pivot = a[k, k]
        a -= np.outer(a[:, k], row)
        a[k], a[:, k] = row, row
        a[k, k] = -1 / pivot
        swept[k] = True
    keep = np.flatnonzero(swept)
    return a, -a[np.ix_(keep, keep)], np.flatnonzero(~swept)


# ---- T14 composite -------------------------------------------------------------------------------------------------

def prepare(df: DataFrame, splits: DataFrame, features: list[str], labels: list[str], kruskal: bool = False,
            vif: bool = False, normals: dict | None = None, resample: bool = True, seed: int = 0, keys=VISIT):
    """T5 split -> P13 (devel) -> T1? -> T7? -> T6 -> T2? -> T10 for each label.
    Returns (frame with a ``split`` column, kept feature list)."""
    data = apply_split(df, splits, keys)
    devel = data.where(F.col("split") == "devel")
    feats = nonempty_columns(devel, features)
    if kruskal:
        feats, _ = kruskal_select(devel, feats, labels[0])
    if normals:
        data = fill(data, {c: normals.get(c) for c in feats})
    means = column_means(data.where(F.col("split") == "devel"), feats)
    data = fill(data, means)
    if vif:
        feats, _ = vif_eliminate(data.where(F.col("split") == "devel"), feats)
    rid = F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, "hour") if c in data.columns])
    data = data.select(*keys, rid.alias("rid"), "split", *feats, *labels)
    if resample:
        data = materialize(data, "prepared")
        for lab in labels:
            # each pass reads the rows so far twice (distribution, pool): its new rows are written, and only they, so
            # the plan stays linear in the number of passes
            new = materialize(synthetic_rows(data, feats, lab, labels, seed=seed, keys=keys), "synthetic")
            data = data.unionByName(new, allowMissingColumns=True)
    return data, feats
