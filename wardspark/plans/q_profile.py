"""Registered queries: counts, statistics, lookups and null profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.functions.vocab import item_vocab, sql_values, vocab_rows
from wardspark.operators import align, profile
from wardspark.plans.q_align import cohort, sql as align_sql, timed_events
from wardspark.plans.registry import R6, r6, register
from wardspark.sources import fixtures as fx

VISIT = ["subject_id", "hadm_id"]
FX_ITEMS = [50912, 51006, 677, 678, 211]
CHART_FX_ITEMS = [677, 678, 211]
MIN_OBS = 25          # A8 threshold for the driver tables (the reference uses 1000 on 200 M chart rows)

PROFILE_CTES = {
    "vocab": "SELECT * FROM " + sql_values(vocab_rows(), ["itemid", "source", "feature", "unit", "scale", "shift"], "v"),
    "hourly": """SELECT subject_id, hadm_id, itemid, time, count(valuenum) AS cnt, avg(valuenum) AS average
        FROM fx_timed GROUP BY ALL""",
    "item_means": f"""SELECT itemid, avg(average) AS avg_average, count(average) AS n_average FROM hourly
        WHERE itemid IN ({', '.join(map(str, FX_ITEMS))}) GROUP BY itemid""",
    "li": """SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_partkey AS itemid
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "wide_hourly": "SELECT subject_id, hadm_id, time, "
                   + ", ".join(f"avg(average) FILTER (WHERE itemid = {i}) AS item_{i}" for i in FX_ITEMS)
                   + " FROM hourly GROUP BY subject_id, hadm_id, time",
}


def sql(body, extra=None):
    ctes = dict(PROFILE_CTES)
    if extra:
        ctes.update(extra)
    return align_sql(body, ctes)


def _stats_sql(src: str, by: str) -> str:
    return f"""SELECT itemid, CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS num,
        CAST(min(n) AS BIGINT) AS min, {R6('avg(n)')} AS avg, CAST(max(n) AS BIGINT) AS max,
        {R6('CASE WHEN count(*) >= 2 THEN stddev_samp(n) ELSE -1.0 END')} AS sd
        FROM (SELECT itemid, {by}, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY itemid"""


def _stats_out(df, *more):
    return df.select("itemid", *more, F.col("count").cast("long").alias("count"), F.col("num").cast("long").alias("num"),
                     F.col("min").cast("long").alias("min"), r6("avg").alias("avg"),
                     F.col("max").cast("long").alias("max"), r6("sd").alias("sd"))


#: Order lines that one task joins and counts.
LINES_PER_TASK = 250_000


def line_items(spark, d):
    """lineitem as (subject = customer, visit = order, item = part) rows, dealt by visit into tasks of about
    ``LINES_PER_TASK`` rows, so that neither the join nor a count per visit holds more, whatever the table's size."""
    li = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hadm_id"), F.col("l_partkey").alias("itemid"))
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"))
    tasks = max(1, -(-li.count() // LINES_PER_TASK))
    return li.repartition(tasks, "hadm_id").join(o.repartition(tasks, "hadm_id"), on="hadm_id", how="inner")


def hourly(spark, d):
    return align.hourly_aggregate(timed_events(spark, d))


def item_means(spark, d):
    return profile.mean_of_hourly_means(hourly(spark, d), FX_ITEMS)


@register("a2_nonnull_per_item_visit", sql("""
SELECT itemid, subject_id, hadm_id, CAST(count(valuenum) AS BIGINT) AS n FROM fx_labevents GROUP BY ALL"""))
def q_a2(spark, d):
    c = profile.nonnull_count(fx.fx_labevents(spark, d))
    return profile.ordered_counts(c).select("itemid", *VISIT, F.col("n").cast("long").alias("n"))


@register("a3_count_per_visit", sql("""
SELECT subject_id, hadm_id, CAST(count(*) AS BIGINT) AS n FROM fx_cohort GROUP BY ALL"""))
def q_a3(spark, d):
    return profile.count_per_visit(cohort(spark, d))


@register("a4_count_histogram", sql("""
SELECT n, CAST(count(*) AS BIGINT) AS keys FROM (SELECT subject_id, hadm_id, count(*) AS n FROM fx_cohort
GROUP BY ALL) GROUP BY n"""))
def q_a4(spark, d):
    return profile.count_histogram(profile.count_per_visit(cohort(spark, d)))


@register("a6_mean_hourly_means", sql(f"""
SELECT itemid, {R6('avg_average')} AS avg_average, CAST(n_average AS BIGINT) AS n_average FROM item_means"""))
def q_a6(spark, d):
    m = item_means(spark, d)
    return m.select("itemid", r6("avg_average").alias("avg_average"), F.col("n_average").cast("long").alias("n_average"))


@register("a7_item_frequency", sql("""
SELECT l.l_partkey AS itemid, CAST(count(*) AS BIGINT) AS count, p.p_name AS label
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_partkey, p.p_name"""))
def q_a7(spark, d):
    li = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("itemid"))
    defs = fx.table(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    return profile.item_frequency(li, defs)


@register("a8_frequency_stats", sql(_stats_sql(
    f"(SELECT * FROM li WHERE itemid IN (SELECT itemid FROM li GROUP BY itemid HAVING count(*) > {MIN_OBS}))",
    "subject_id")))
def q_a8(spark, d):
    return _stats_out(profile.frequency_stats(line_items(spark, d), by=("subject_id",), min_obs=MIN_OBS))


@register("a8_frequency_stats_visit", sql(_stats_sql(
    f"(SELECT * FROM li WHERE itemid IN (SELECT itemid FROM li GROUP BY itemid HAVING count(*) > {MIN_OBS}))",
    "subject_id, hadm_id")))
def q_a8v(spark, d):
    return _stats_out(profile.frequency_stats(line_items(spark, d), by=VISIT, min_obs=MIN_OBS))


@register("a9_item_statistics", sql(f"""
SELECT s.*, p.p_name AS label, p.p_brand AS brand FROM ({_stats_sql('li', 'subject_id, hadm_id')}) s
JOIN part p ON p.p_partkey = s.itemid"""))
def q_a9(spark, d):
    defs = fx.table(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"),
                                             F.col("p_brand").alias("brand"))
    st = profile.item_statistics(line_items(spark, d), defs, def_cols=("label", "brand"))
    return _stats_out(st, "label", "brand")


@register("a10_distinct_item_units", sql("SELECT DISTINCT itemid, valueuom FROM fx_line_events"))
def q_a10(spark, d):
    return profile.distinct_pairs(fx.fx_line_events(spark, d), ("itemid", "valueuom"))


@register("a13_category_mean", sql(f"""
SELECT v.feature, {R6('sum((m.avg_average + v.shift) * v.scale * m.n_average) / sum(m.n_average)')} AS category_mean
FROM item_means m JOIN vocab v ON v.itemid = m.itemid WHERE v.source = 'chart' GROUP BY v.feature"""))
def q_a13(spark, d):
    c = profile.weighted_category_mean(item_means(spark, d), item_vocab(spark))
    return c.select("feature", r6("category_mean").alias("category_mean"))


def _wide_hourly(spark, d):
    h = hourly(spark, d)
    return h.groupBy(*VISIT, "time").pivot("itemid", FX_ITEMS).agg(F.avg("average")) \
        .select(*VISIT, "time", *[F.col(str(i)).alias(f"item_{i}") for i in FX_ITEMS])


@register("a15_null_profile", sql(" UNION ALL ".join(
    f"SELECT 'item_{i}' AS column_name, CAST(count(*) - count(item_{i}) AS BIGINT) AS nulls, "
    f"{R6(f'(count(*) - count(item_{i}))::DOUBLE / count(*)')} AS share FROM wide_hourly" for i in FX_ITEMS)))
def q_a15(spark, d):
    p = profile.null_profile(_wide_hourly(spark, d), [f"item_{i}" for i in FX_ITEMS])
    return p.select("column_name", "nulls", r6("share").alias("share"))


@register("a15_row_null_histogram", sql(
    "SELECT CAST(" + " + ".join(f"CAST(item_{i} IS NULL AS INT)" for i in FX_ITEMS)
    + " AS INT) AS nulls_in_row, CAST(count(*) AS BIGINT) AS rows FROM wide_hourly GROUP BY 1"))
def q_a15r(spark, d):
    r = profile.row_null_counts(_wide_hourly(spark, d), [f"item_{i}" for i in FX_ITEMS])
    return r.select(F.col("nulls_in_row").cast("int"), "rows")


@register("j7_lookup_default", sql(f"""
SELECT v.itemid, {R6('m.avg_average')} AS mean FROM vocab v LEFT JOIN item_means m ON m.itemid = v.itemid"""))
def q_j7(spark, d):
    j = profile.lookup_with_default(item_vocab(spark).select("itemid"), item_means(spark, d))
    return j.select("itemid", r6("mean").alias("mean"))


@register("j8_units_per_item", sql("""
SELECT v.itemid, coalesce(list_sort(u.units), []::VARCHAR[]) AS units FROM vocab v LEFT JOIN (
  SELECT itemid, list(DISTINCT valueuom) AS units FROM fx_events WHERE valueuom IS NOT NULL GROUP BY itemid) u
ON u.itemid = v.itemid"""))
def q_j8(spark, d):
    return profile.units_per_item(item_vocab(spark), fx.fx_events(spark, d))
