"""Registered queries: tables with a layout, visit files, as-of joins and the interval-coded snapshot (S3, S6, S7, S9,
P9, O2, J10, J11, W5)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.operators import asof, snapshot as snap
from wardspark.plans import q_prep, q_snapshot
from wardspark.plans.q_align import staged, timed_events
from wardspark.plans.registry import ORACLES, R6, r6, register
from wardspark.session import checkpoint_dir, materialize
from wardspark.sources import fixtures as fx
from wardspark.sources import tables, visit_files

VISIT = ["subject_id", "hadm_id"]


def _path(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def _table(name):
    return f"{name}_{uuid.uuid4().hex[:12]}"


# ---- S6 / S9 -----------------------------------------------------------------------------------------------------

@register("s9_bucketed_visits", q_snapshot.sql(f"""
SELECT t.subject_id, t.hadm_id, t.itemid, t.time, {R6('t.valuenum')} AS valuenum, s.worst,
       CAST(row_number() OVER (PARTITION BY t.subject_id, t.hadm_id ORDER BY t.time, t.itemid, t.valuenum) AS INT) AS place
FROM fx_timed t JOIN (SELECT subject_id, hadm_id, max(stage) AS worst FROM fx_staged GROUP BY ALL) s
  ON s.subject_id = t.subject_id AND s.hadm_id = t.hadm_id"""))
def q_s9_bucketed(spark, d):
    """Events and staged rows as catalog tables bucketed by visit, then grouped, joined and numbered without an exchange."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = tables.write_bucketed(timed_events(spark, d).select(*VISIT, "itemid", "time", "valuenum"), _table("events"), n,
                                   sort=["time"])
    stages = tables.write_bucketed(staged(spark, d).select(*VISIT, "time", "stage"), _table("stages"), n, sort=["time"])
    worst = stages.groupBy(*VISIT).agg(F.max("stage").alias("worst"))
    place = F.row_number().over(Window.partitionBy(*VISIT).orderBy("time", "itemid", "valuenum"))
    return events.join(worst, VISIT).select(*VISIT, "itemid", "time", r6("valuenum").alias("valuenum"), "worst",
                                            place.alias("place"))


# ---- S7 ----------------------------------------------------------------------------------------------------------

@register("s7_repeatable_load", q_snapshot.sql("""
SELECT subject_id, hadm_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(stage) AS BIGINT) AS stages
FROM fx_staged GROUP BY ALL"""))
def q_s7_loads(spark, d):
    """Staged rows in three loads by visit; each load is given twice, and one after an attempt that died."""
    columns = [*VISIT, "time", "stage"]
    rows = materialize(staged(spark, d).select(*columns), "load-input")
    table = tables.LoadTable(spark, _path(spark, "loads"), rows.schema)
    rows.write.parquet(f"{table.path}/data/part-0-died")  # written, never published
    for _ in range(2):
        for i in range(3):
            table.load(rows.where(F.pmod(F.col("hadm_id"), F.lit(3)) == i), f"part-{i}")
    return table.read().groupBy(*VISIT).agg(F.count(F.lit(1)).alias("rows"), F.sum("stage").cast("long").alias("stages"))


# ---- S3 ----------------------------------------------------------------------------------------------------------

@register("s3_visit_files_of_split", q_prep.sql(f"""
SELECT t.subject_id, t.hadm_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(t.itemid) AS BIGINT) AS items,
       {R6('sum(t.valuenum)')} AS total
FROM fx_timed t JOIN splits s ON s.subject_id = t.subject_id AND s.hadm_id = t.hadm_id AND s.split = 'test' GROUP BY ALL"""))
def q_s3_split(spark, d):
    """Events of every visit written as a file of its own, all in one folder; the files of the test split read back."""
    folder = _path(spark, "visits")
    visit_files.write_visit_files(timed_events(spark, d), folder, ["time", "itemid", "valuenum"], ["time", "itemid", "valuenum"])
    schema = T.StructType([T.StructField("itemid", T.LongType()), T.StructField("valuenum", T.DoubleType())])
    back = visit_files.read_visit_files(spark, folder, schema, q_prep.split_table(spark, d), "test")
    return back.groupBy(*VISIT).agg(F.count(F.lit(1)).alias("rows"), F.sum("itemid").alias("items"),
                                    r6(F.sum("valuenum")).alias("total"))


# ---- P9 ----------------------------------------------------------------------------------------------------------

@register("p9_pruned_lookup", q_snapshot.sql(f"""
SELECT t.subject_id, t.hadm_id, t.itemid, t.time, {R6('t.valuenum')} AS valuenum FROM fx_timed t JOIN (
  SELECT itemid, max(hadm_id) AS hadm_id FROM fx_timed GROUP BY itemid) p ON p.itemid = t.itemid AND p.hadm_id = t.hadm_id"""))
def q_p9_pruned(spark, d):
    """Events sorted by item and visit with Bloom filters; the last visit of every item is looked up."""
    path = _path(spark, "lookup")
    tables.write_lookup_table(timed_events(spark, d), path, ["itemid", "hadm_id"], "hadm_id")
    last = spark.read.parquet(path).groupBy("itemid").agg(F.max("hadm_id").alias("hadm_id")).collect()  # a row per item
    hits = tables.lookup(spark, path, [r.asDict() for r in last])
    return hits.select(*VISIT, "itemid", "time", r6("valuenum").alias("valuenum"))


# ---- O2 ----------------------------------------------------------------------------------------------------------

@register("o2_deep_page", """
SELECT l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS place,
         count(*) OVER () // 2 AS half FROM lineitem)
WHERE place >= half AND place < half + 500""")
def q_o2_deep(spark, d):
    """500 rows from the middle of all order lines, read from the buckets that hold them."""
    path, order = _path(spark, "pages"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = fx.table(spark, d, "lineitem").select(*order, "l_quantity")
    tables.write_pages(lines, path, order, rows_per_bucket=5_000)
    return tables.read_page(spark, path, order, lines.count() // 2, 500).select("l_orderkey", "l_linenumber", "l_quantity")


# ---- J10 / J11 ---------------------------------------------------------------------------------------------------

def _asof(spark, d, direction, tolerance=None):
    chart = fx.fx_chartevents(spark, d).select(*VISIT, "charttime", "itemid", "valuenum")
    lab = fx.fx_labevents(spark, d).select(*VISIT, F.col("charttime").alias("lab_time"), F.col("valuenum").alias("lab_value"))
    lab = lab.groupBy(*VISIT, "lab_time").agg(F.max("lab_value").alias("lab_value"))
    out = asof.asof_join(chart, lab, VISIT, "charttime", "lab_time", direction, tolerance)
    return out.select(*VISIT, "charttime", "itemid", r6("valuenum").alias("valuenum"), "lab_time", r6("lab_value").alias("lab_value"))


def _asof_sql(compare, far="false"):
    return fx.with_fixtures(f"""
SELECT c.subject_id, c.hadm_id, c.charttime, c.itemid, {R6('c.valuenum')} AS valuenum,
       CASE WHEN NOT ({far}) THEN l.lab_time END AS lab_time, CASE WHEN NOT ({far}) THEN {R6('l.lab_value')} END AS lab_value
FROM fx_chartevents c ASOF LEFT JOIN (
  SELECT subject_id, hadm_id, charttime AS lab_time, max(valuenum) AS lab_value FROM fx_labevents GROUP BY ALL) l
  ON l.subject_id = c.subject_id AND l.hadm_id = c.hadm_id AND c.charttime {compare} l.lab_time""")


@register("j10_asof_backward", _asof_sql(">="))
def q_j10(spark, d):
    """Every chart event with the last lab value of its visit until then."""
    return _asof(spark, d, "backward")


@register("j11_asof_forward", _asof_sql("<=", "coalesce(l.lab_time - c.charttime > INTERVAL 12 HOUR, false)"))
def q_j11(spark, d):
    """Every chart event with the next lab value of its visit within twelve hours."""
    return _asof(spark, d, "forward", 12 * 3_600_000_000)


# ---- W5 ----------------------------------------------------------------------------------------------------------

def _stored(spark, d):
    hourly, vis, _ = q_snapshot.snapshot_inputs(spark, d)
    return materialize(snap.snapshot_intervals(hourly, vis), "snapshot-intervals")


def _shown(cells):
    return cells.select(*VISIT, "hour", "name", r6("mean").alias("value"), "ok")


@register("w5_interval_cells", ORACLES["w5_snapshot_cells"])
def q_w5_intervals(spark, d):
    """The cells of all hours from the stored intervals."""
    stored = _stored(spark, d)
    shown = snap.behind_gate(stored, snap.gate_of_intervals(stored))
    return _shown(snap.cells_of(snap.expand_intervals(shown, q_snapshot.H)))


@register("w5_point_in_time", f"SELECT * FROM ({ORACLES['w5_snapshot_cells']}) WHERE hour = 37")
def q_w5_point(spark, d):
    """The cells of every visit at one hour from the stored intervals, without expanding hours."""
    stored = _stored(spark, d)
    shown = snap.behind_gate(stored, snap.gate_of_intervals(stored))
    return _shown(snap.cells_of(snap.intervals_at(shown, 37)))
