"""Registered queries: snapshot operators (W1–W8, J5, J9–J11, F1, F5) over the fixture visits.

The oracles are independent brute-force formulations (range joins over an hour table, pairwise admission
self-joins, arg_min over (time, value)), so they check the interval-explode / running-window plans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.functions.vocab import (ALL_FEATURES, LABEL_HORIZONS, bounds_rows, sql_values, vocab_rows)
from wardspark.operators import snapshot as snap
from wardspark.operators import staging
from wardspark.plans.q_align import cohort, sql as align_sql
from wardspark.plans.registry import R6, r6, register
from wardspark.sources import fixtures as fx

VISIT = ["subject_id", "hadm_id"]
H = 200                                  # extraction horizon of the reference runs (hours 1..200)
EXACT_HOUR = 24                          # W8 hour
FX_ITEMS = [50912, 51006, 677, 678, 211]  # the fixture's item ids


# ---- Spark builders -----------------------------------------------------------------------------------------

def visits(spark, d):
    return snap.visit_table(fx.fx_admissions(spark, d), fx.fx_patients(spark, d))


def conv_events(spark, d):
    from wardspark.operators.align import hour_offset
    timed = hour_offset(fx.fx_events(spark, d), fx.fx_admissions(spark, d))
    return snap.convert_events(timed)


def nonzero(spark, d):
    return staging.nonzero_stages(staging.add_stage(cohort(spark, d)))


# ---- SQL CTEs ------------------------------------------------------------------------------------------------

HOURS_SQL = f"SELECT CAST(range AS BIGINT) AS hour FROM range(1, {H + 1})"

SNAP_CTES = {
    "vocab": "SELECT * FROM " + sql_values(vocab_rows(), ["itemid", "source", "feature", "unit", "scale", "shift"], "v"),
    "bounds": "SELECT * FROM " + sql_values(bounds_rows(), ["feature", "low", "high"], "b"),
    "hours": HOURS_SQL,
    "conv": """SELECT t.subject_id, t.hadm_id, t.itemid, v.feature, v.source, t.time,
        (t.valuenum + v.shift) * v.scale AS cv FROM fx_timed t JOIN vocab v ON t.itemid = v.itemid""",
    "w1_latest": """SELECT c.subject_id, c.hadm_id, h.hour, c.itemid, max(c.time) AS lt
        FROM conv c JOIN hours h ON c.time <= h.hour WHERE c.source <> 'lab' OR c.time >= 1 GROUP BY ALL""",
    "w1": """SELECT l.subject_id, l.hadm_id, l.hour, c.feature, sum(c.cv) AS s, count(*) AS n
        FROM w1_latest l JOIN conv c ON c.subject_id = l.subject_id AND c.hadm_id = l.hadm_id
             AND c.itemid = l.itemid AND c.time = l.lt GROUP BY ALL""",
    "tot": "SELECT subject_id, hadm_id, feature, sum(cv) AS s, count(*) AS n FROM conv GROUP BY ALL",
    "w2_earlier": """SELECT v.subject_id, v.hadm_id, t.feature, sum(t.s) AS e_s, sum(t.n) AS e_n
        FROM fx_adm_age v JOIN fx_adm_age v2 ON v2.subject_id = v.subject_id AND v2.admittime < v.admittime
        JOIN tot t ON t.subject_id = v2.subject_id AND t.hadm_id = v2.hadm_id GROUP BY ALL""",
    "w2_cur": """SELECT c.subject_id, c.hadm_id, h.hour, c.feature, sum(c.cv) AS s, count(*) AS n
        FROM conv c JOIN hours h ON c.time < h.hour GROUP BY ALL""",
    "w2": """SELECT subject_id, hadm_id, hour, feature, sum(s) AS s, sum(n) AS n FROM (
        SELECT * FROM w2_cur UNION ALL
        SELECT e.subject_id, e.hadm_id, h.hour, e.feature, e.e_s, e.e_n FROM w2_earlier e CROSS JOIN hours h)
        GROUP BY ALL""",
    "nz": "SELECT subject_id, hadm_id, time, valuenum, stage FROM fx_staged WHERE stage > 0",
    "spine": "SELECT v.subject_id, v.hadm_id, h.hour FROM fx_adm_age v CROSS JOIN hours h",
}


def _label_sql(prefix: str, shift: int) -> str:
    """Labels over window [hour - shift, hour - shift + L] for every spine hour, as columns."""
    cols = []
    for L in LABEL_HORIZONS:
        cond = f"n.time <= s.hour - {shift} + {L}"
        cols.append(f"coalesce(min(n.time) FILTER (WHERE {cond}), 0) AS {prefix}tstage_{L}")
        cols.append(f"CAST(coalesce(arg_min(n.stage, (n.time, n.valuenum)) FILTER (WHERE {cond}), 0) AS INT)"
                    f" AS {prefix}stage_{L}")
    return (f"SELECT s.subject_id, s.hadm_id, s.hour, {', '.join(cols)} FROM spine s LEFT JOIN nz n"
            f" ON n.subject_id = s.subject_id AND n.hadm_id = s.hadm_id AND n.time >= s.hour - {shift}"
            f" AND n.time <= s.hour - {shift} + {max(LABEL_HORIZONS)} GROUP BY ALL")


LABEL_CTES = {
    "w3": _label_sql("", 0),
    "w4_shift": _label_sql("p", 1),
    "w4_first": """SELECT s.subject_id, s.hadm_id, arg_max(n.time, (n.time, n.valuenum)) AS t,
        arg_max(n.stage, (n.time, n.valuenum)) AS st FROM fx_adm_age s JOIN nz n
        ON n.subject_id = s.subject_id AND n.hadm_id = s.hadm_id AND n.time < 1 GROUP BY ALL""",
    "w4": "SELECT s.subject_id, s.hadm_id, s.hour, "
          + ", ".join(
              f"CASE WHEN s.hour = 1 THEN coalesce(f.t, 0) ELSE s.ptstage_{L} END AS ptstage_{L}, "
              f"CAST(CASE WHEN s.hour = 1 THEN coalesce(f.st, 0) ELSE s.pstage_{L} END AS INT) AS pstage_{L}"
              for L in LABEL_HORIZONS)
          + " FROM w4_shift s LEFT JOIN w4_first f ON f.subject_id = s.subject_id AND f.hadm_id = s.hadm_id",
}


def sql(body: str, extra: dict | None = None) -> str:
    ctes = dict(SNAP_CTES)
    ctes.update(LABEL_CTES)
    if extra:
        ctes.update(extra)
    return align_sql(body, ctes)


def _validity_sql(mean: str) -> str:
    return f"(coalesce({mean} >= b.low, true) AND coalesce({mean} <= b.high, true))"


# ---- queries ------------------------------------------------------------------------------------------------

@register("f1_unit_conversion", sql(f"""
SELECT subject_id, hadm_id, itemid, feature, time, {R6('cv')} AS cv FROM conv"""))
def q_f1(spark, d):
    c = conv_events(spark, d)
    return c.select(*VISIT, "itemid", "feature", "time", r6("cv").alias("cv"))


@register("j9_hour_spine", sql("SELECT subject_id, hadm_id, CAST(hour AS INT) AS hour FROM spine"))
def q_j9(spark, d):
    return snap.hour_spine(visits(spark, d).select(*VISIT), H).select(*VISIT, F.col("hour").cast("int"))


@register("w1_latest_snapshot", sql(f"""
SELECT subject_id, hadm_id, CAST(hour AS INT) AS hour, feature, {R6('s / n')} AS cur_mean,
       CAST(n AS BIGINT) AS cur_n FROM w1"""))
def q_w1(spark, d):
    w = snap.snapshot_latest(conv_events(spark, d), H)
    return w.select(*VISIT, F.col("hour").cast("int").alias("hour"), "feature",
                    r6(F.col("cur_sum") / F.col("cur_n")).alias("cur_mean"), F.col("cur_n").cast("long").alias("cur_n"))


@register("j5_earlier_admissions", sql(f"""
SELECT subject_id, hadm_id, feature, {R6('e_s')} AS e_sum, CAST(e_n AS BIGINT) AS e_n FROM w2_earlier"""))
def q_j5(spark, d):
    e = snap.earlier_admission_totals(conv_events(spark, d), visits(spark, d))
    return e.select(*VISIT, "feature", r6("e_sum").alias("e_sum"), F.col("e_n").cast("long").alias("e_n"))


@register("w2_prior_snapshot", sql(f"""
SELECT subject_id, hadm_id, CAST(hour AS INT) AS hour, feature, {R6('s / n')} AS prior_mean,
       CAST(n AS BIGINT) AS prior_n FROM w2"""))
def q_w2(spark, d):
    w = snap.snapshot_prior(conv_events(spark, d), visits(spark, d), H)
    return w.select(*VISIT, F.col("hour").cast("int").alias("hour"), "feature",
                    r6(F.col("prior_sum") / F.col("prior_n")).alias("prior_mean"),
                    F.col("prior_n").cast("long").alias("prior_n"))


def _label_table(spark, d, side: str):
    parts = snap.label_parts(nonzero(spark, d), H, sides=(side,))
    spine = snap.spine_parts(visits(spark, d), H)
    g = snap.explode_hours(parts.unionByName(spine)).groupBy(*VISIT, "hour").agg(*snap.label_aggs(sides=(side,)))
    return g


@register("w3_label_forward", sql("SELECT subject_id, hadm_id, CAST(hour AS INT) AS hour, "
                                  + ", ".join(f"tstage_{L}, stage_{L}" for L in LABEL_HORIZONS) + " FROM w3"))
def q_w3(spark, d):
    return _label_table(spark, d, "next")


@register("w4_label_previous", sql("SELECT subject_id, hadm_id, CAST(hour AS INT) AS hour, "
                                   + ", ".join(f"ptstage_{L}, pstage_{L}" for L in LABEL_HORIZONS) + " FROM w4"))
def q_w4(spark, d):
    return _label_table(spark, d, "prev")


@register("f5_validity_status", sql(f"""
SELECT w.subject_id, w.hadm_id, CAST(w.hour AS INT) AS hour, w.feature,
       CASE WHEN {_validity_sql('w.s / w.n')} THEN 'ok' ELSE 'invalid' END AS status
FROM w1 w LEFT JOIN bounds b ON b.feature = w.feature"""))
def q_f5(spark, d):
    from wardspark.functions.clinical import status
    w = snap.snapshot_latest(conv_events(spark, d), H).withColumn("mean", F.col("cur_sum") / F.col("cur_n"))
    v = snap.with_validity(w, "mean", "valid")
    return v.select(*VISIT, F.col("hour").cast("int").alias("hour"), "feature", status("mean", "valid").alias("status"))


def _snapshot_sql(emit_empty: bool, every: bool = False) -> str:
    """The wide snapshot. ``every``: all columns are computed, also those of features that the views don't have."""
    feats = ALL_FEATURES
    lab_cols_p = ", ".join(f"p.ptstage_{L}, p.pstage_{L}" for L in LABEL_HORIZONS)
    lab_cols_n = ", ".join(f"n.tstage_{L}, n.stage_{L}" for L in LABEL_HORIZONS)
    # the views have these features only; the other columns are null
    some = set(feats) if every else {r[2] for r in vocab_rows() if r[0] in FX_ITEMS}

    def columns(side):
        return ", ".join(f"max(value) FILTER (WHERE feature = '{f}') AS {side}_{f}" if f in some else
                         f"CAST(NULL AS DOUBLE) AS {side}_{f}" for f in feats)

    def cells(table):
        mean = "t.s / t.n"
        return (f"(SELECT t.subject_id, t.hadm_id, t.hour, t.feature, CASE WHEN {_validity_sql(mean)} THEN {R6(mean)} END AS value "
                f"FROM {table} t LEFT JOIN bounds b ON b.feature = t.feature)")
    extra = {
        "curw": f"SELECT subject_id, hadm_id, hour, {columns('cur')}, count(*) AS n_cur FROM {cells('w1')} GROUP BY ALL",
        "priw": f"SELECT subject_id, hadm_id, hour, {columns('prior')} FROM {cells('w2')} GROUP BY ALL",
    }
    gate = "" if emit_empty else "WHERE c.n_cur IS NOT NULL"
    body = f"""
SELECT CAST(s.hour AS INT) AS hour, s.subject_id, s.hadm_id, a.ethnicity, a.age,
       CAST(CASE WHEN a.gender = 'F' THEN 0 ELSE 1 END AS INT) AS gender,
       {', '.join(f"CASE WHEN c.n_cur IS NOT NULL THEN q.prior_{f} END AS prior_{f}" for f in feats)},
       {lab_cols_p},
       {', '.join(f"c.cur_{f}" for f in feats)},
       {lab_cols_n}
FROM spine s JOIN fx_adm_age a ON a.subject_id = s.subject_id AND a.hadm_id = s.hadm_id
LEFT JOIN curw c ON c.subject_id = s.subject_id AND c.hadm_id = s.hadm_id AND c.hour = s.hour
LEFT JOIN priw q ON q.subject_id = s.subject_id AND q.hadm_id = s.hadm_id AND q.hour = s.hour
JOIN w3 n ON n.subject_id = s.subject_id AND n.hadm_id = s.hadm_id AND n.hour = s.hour
JOIN w4 p ON p.subject_id = s.subject_id AND p.hadm_id = s.hadm_id AND p.hour = s.hour
{gate}"""
    return sql(body, extra)


def snapshot_inputs(spark, d):
    """Hourly sums, visits and non-zero stages, each written once under the checkpoint folder: the snapshot
    reads each of them several times, and the written tables cut the lineage back to the raw scans."""
    from wardspark.session import materialize
    hourly = materialize(snap.hourly_sums(conv_events(spark, d)), "hourly_sums")
    return hourly, materialize(visits(spark, d), "visits"), materialize(nonzero(spark, d), "nonzero")


def snapshot_df(spark, d, emit_empty: bool, hours: int = H):
    hourly, vis, nz = snapshot_inputs(spark, d)
    return snap.snapshot(hourly, vis, nz, hours=hours, emit_empty=emit_empty, shape=r6)


@register("w5_snapshot_by_hour", _snapshot_sql(emit_empty=False, every=True))
def q_w5_hour(spark, d):
    return snapshot_df(spark, d, emit_empty=False)


@register("w5_snapshot_by_visit", _snapshot_sql(emit_empty=True, every=True))
def q_w5_visit(spark, d):
    """As w5_snapshot_by_hour, with the hours before a visit's first observation."""
    return snapshot_df(spark, d, emit_empty=True)


@register("w5_snapshot_cells", sql(f"""
SELECT x.subject_id, x.hadm_id, CAST(x.hour AS INT) AS hour, x.name, {R6('x.mean')} AS value, x.ok FROM (
  SELECT w.subject_id, w.hadm_id, w.hour, 'cur_' || w.feature AS name, w.s / w.n AS mean,
         {_validity_sql('w.s / w.n')} AS ok FROM w1 w LEFT JOIN bounds b ON b.feature = w.feature
  UNION ALL
  SELECT q.subject_id, q.hadm_id, q.hour, 'prior_' || q.feature, q.s / q.n, {_validity_sql('q.s / q.n')}
  FROM w2 q LEFT JOIN bounds b ON b.feature = q.feature
  WHERE EXISTS (SELECT 1 FROM w1 g WHERE g.subject_id = q.subject_id AND g.hadm_id = q.hadm_id AND g.hour = q.hour)
) x"""))
def q_w5_cells(spark, d):
    """Every cell of the snapshot in long form, current and prior, with its validity; prior ones behind the gate."""
    hourly, vis, _ = snapshot_inputs(spark, d)
    cells = snap.snapshot_cells(hourly, vis, H, gate=snap.gate_hours(hourly, H))
    return cells.select(*VISIT, "hour", "name", r6("mean").alias("value"), "ok")


@register("w8_exact_hour_snapshot", sql(f"""
SELECT a.subject_id, a.hadm_id, a.age, CAST(CASE WHEN a.gender = 'F' THEN 0 ELSE 1 END AS INT) AS gender,
       coalesce(l.t, 0) AS tstage,
       {', '.join(f"x.item_{i}" for i in FX_ITEMS)},
       CAST(coalesce(l.st, 0) AS INT) AS stage
FROM fx_adm_age a
LEFT JOIN (SELECT subject_id, hadm_id,
           {', '.join(f"{R6(f'avg(valuenum) FILTER (WHERE itemid = {i})')} AS item_{i}" for i in FX_ITEMS)}
           FROM fx_timed WHERE time = {EXACT_HOUR} GROUP BY ALL) x
  ON x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id
LEFT JOIN (SELECT subject_id, hadm_id, arg_min(time, (time, valuenum)) AS t, arg_min(stage, (time, valuenum)) AS st
           FROM nz WHERE time BETWEEN {EXACT_HOUR} AND {EXACT_HOUR + 48} GROUP BY ALL) l
  ON l.subject_id = a.subject_id AND l.hadm_id = a.hadm_id"""))
def q_w8(spark, d):
    from wardspark.operators.align import hour_offset, hourly_aggregate
    hourly = hourly_aggregate(hour_offset(fx.fx_events(spark, d), fx.fx_admissions(spark, d)))
    w = snap.snapshot_exact(hourly, visits(spark, d), nonzero(spark, d), EXACT_HOUR, FX_ITEMS)
    return w.select(*[r6(c).alias(c) if c.startswith("item_") else F.col(c) for c in w.columns])


def _item_list():
    return sorted({r[0] for r in vocab_rows()})


@register("w8_exact_hour_item_list", sql(f"""
SELECT a.subject_id, a.hadm_id,
       {', '.join(f"x.item_{i}" if i in FX_ITEMS else f"CAST(NULL AS DOUBLE) AS item_{i}" for i in _item_list())}
FROM fx_adm_age a
LEFT JOIN (SELECT subject_id, hadm_id,
           {', '.join(f"{R6(f'avg(valuenum) FILTER (WHERE itemid = {i})')} AS item_{i}" for i in FX_ITEMS)}
           FROM fx_timed WHERE time = {EXACT_HOUR} GROUP BY ALL) x
  ON x.subject_id = a.subject_id AND x.hadm_id = a.hadm_id"""))
def q_w8_list(spark, d):
    """The hour's value of every item of the vocabulary, null for an item that a visit does not have."""
    from wardspark.operators.align import hour_offset, hourly_aggregate
    hourly = hourly_aggregate(hour_offset(fx.fx_events(spark, d), fx.fx_admissions(spark, d)))
    w = snap.snapshot_exact(hourly, visits(spark, d), nonzero(spark, d), EXACT_HOUR, _item_list())
    return w.select(*VISIT, *[r6(f"item_{i}").alias(f"item_{i}") for i in _item_list()])


@register("w6_last_stage_per_time", sql("""
SELECT subject_id, hadm_id, time, arg_max(stage, valuenum) AS stage FROM fx_staged GROUP BY ALL"""))
def q_w6(spark, d):
    s = staging.add_stage(cohort(spark, d))
    return snap.last_write_wins(s, [*VISIT, "time"], "stage", "valuenum")
