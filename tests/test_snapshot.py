import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardspark.operators import snapshot as snap

T = dt.datetime
EV = "subject_id long, hadm_id long, itemid long, time long, valuenum double"


def _conv(spark, rows):
    return snap.convert_events(spark.createDataFrame(rows, EV))


def _cur(df, feature):
    return {r.hour: r.cur_sum / r.cur_n for r in df.where(F.col("feature") == feature).collect()}


def test_w1_latest_value_with_ties_and_negative_time(spark):
    rows = [(1, 1, 211, 1, 5.0), (1, 1, 211, 2, 6.0), (1, 1, 211, 2, 8.0), (1, 1, 211, 5, 9.0),
            (1, 1, 618, -3, 12.0)]
    w = snap.snapshot_latest(_conv(spark, rows), hours=8)
    hr = _cur(w, "heart_rate")
    assert hr[1] == 5 and hr[2] == hr[3] == hr[4] == 7 and hr[5] == hr[8] == 9
    rr = _cur(w, "respiratory_rate")
    assert sorted(rr) == list(range(1, 9)) and set(rr.values()) == {12.0}


def test_w1_pools_converted_items_of_a_category(spark):
    rows = [(1, 1, 677, 1, 37.0), (1, 1, 678, 1, 100.4)]      # C and F temperature in one category
    t = _cur(snap.snapshot_latest(_conv(spark, rows), hours=1), "temperature")
    assert t[1] == pytest.approx((37.0 + 38.0) / 2)


def test_w1_labs_need_positive_time(spark):
    rows = [(1, 1, 50912, 0, 1.0), (1, 1, 50912, 2, 3.0)]
    c = _cur(snap.snapshot_latest(_conv(spark, rows), hours=3), "50912")
    assert sorted(c) == [2, 3] and c[2] == 3.0


def test_w2_prior_with_earlier_admissions(spark):
    visits = spark.createDataFrame([(1, 1, T(2020, 1, 1)), (1, 2, T(2020, 1, 5)), (1, 3, T(2020, 1, 5))],
                                   "subject_id long, hadm_id long, admittime timestamp_ntz")
    rows = [(1, 1, 211, 0, 4.0), (1, 1, 211, 3, 6.0), (1, 2, 211, 2, 10.0), (1, 3, 211, 1, 100.0)]
    p = snap.snapshot_prior(_conv(spark, rows), visits, hours=5)
    got = {r.hour: r.prior_sum / r.prior_n for r in p.where((F.col("hadm_id") == 2)).collect()}
    assert got[1] == got[2] == 5.0 and got[3] == pytest.approx(20 / 3) and got[5] == pytest.approx(20 / 3)


def _labels(spark, staged_rows, hours=12, horizons=(6,)):
    nz = spark.createDataFrame(staged_rows, "subject_id long, hadm_id long, time long, valuenum double, stage int")
    parts = snap.label_parts(nz, hours, list(horizons))
    spine = snap.spine_parts(spark.sql("SELECT 1L AS subject_id, 1L AS hadm_id"), hours)
    g = snap.explode_hours(parts.unionByName(spine)).groupBy("subject_id", "hadm_id", "hour").agg(
        *snap.label_aggs(list(horizons)))
    return {r.hour: r for r in g.collect()}


def test_w3_w4_labels(spark):
    lab = _labels(spark, [(1, 1, 3, 2.0, 1), (1, 1, 9, 3.0, 2), (1, 1, -2, 5.0, 3)])
    assert (lab[1].tstage_6, lab[1].stage_6) == (3, 1)
    assert (lab[2].tstage_6, lab[2].stage_6) == (3, 1)
    assert (lab[3].tstage_6, lab[3].stage_6) == (3, 1)
    assert (lab[4].tstage_6, lab[4].stage_6) == (9, 2)      # 9 = 3 + 6 would count at h = 3; here first at/after 4
    assert (lab[10].tstage_6, lab[10].stage_6) == (0, 0)
    assert (lab[5].ptstage_6, lab[5].pstage_6) == (lab[4].tstage_6, lab[4].stage_6)
    assert (lab[1].ptstage_6, lab[1].pstage_6) == (-2, 3)
    edge = _labels(spark, [(1, 1, 9, 1.0, 2)])
    assert (edge[3].tstage_6, edge[3].stage_6) == (9, 2) and (edge[2].tstage_6, edge[2].stage_6) == (0, 0)


def test_w1_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for v in range(1, 6):
        for _ in range(30):
            rows.append((1, v, rnd.choice([211, 220045, 677, 678]), rnd.randint(-4, 14), float(rnd.randint(30, 110))))
    hours = 12
    got = {(r.hadm_id, r.hour, r.feature): (r.cur_sum, r.cur_n)
           for r in snap.snapshot_latest(_conv(spark, rows), hours=hours).collect()}
    conv = {211: ("heart_rate", lambda x: x), 220045: ("heart_rate", lambda x: x),
            677: ("temperature", lambda x: x), 678: ("temperature", lambda x: (x - 32) * 5 / 9)}
    want = {}
    for v in range(1, 6):
        for h in range(1, hours + 1):
            for item in conv:
                ts = [t for (_, vv, i, t, _) in rows if vv == v and i == item and t <= h]
                if not ts:
                    continue
                vals = [conv[item][1](x) for (_, vv, i, t, x) in rows if vv == v and i == item and t == max(ts)]
                f = conv[item][0]
                s, n = want.get((v, h, f), (0.0, 0))
                want[(v, h, f)] = (s + sum(vals), n + len(vals))
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1]


def test_snapshot_gate_and_shape(spark):
    visits = spark.createDataFrame([(1, 1, T(2020, 1, 1), 70, "F", "WHITE"), (1, 2, T(2020, 2, 1), 70, "F", "WHITE")],
                                   "subject_id long, hadm_id long, admittime timestamp_ntz, age int, gender string, ethnicity string")
    conv = _conv(spark, [(1, 1, 211, 3, 80.0), (1, 1, 618, 4, 500.0)])    # 500 breaths/min is out of range
    nz = spark.createDataFrame([], "subject_id long, hadm_id long, time long, valuenum double, stage int")
    hourly = snap.hourly_sums(conv)
    by_hour = snap.snapshot(hourly, visits, nz, hours=6)
    assert sorted(r.hour for r in by_hour.collect()) == [3, 4, 5, 6]      # gate opens at the first observation
    by_visit = snap.snapshot(hourly, visits, nz, hours=6, emit_empty=True, as_text=True)
    assert by_visit.count() == 12 and len(by_visit.columns) == 226
    r4 = [r for r in by_visit.collect() if r.hadm_id == 1 and r.hour == 4][0]
    assert r4.cur_respiratory_rate == "!" and r4.cur_heart_rate.startswith("80") and r4.cur_weight == "?"
    r2 = [r for r in by_visit.collect() if r.hadm_id == 2 and r.hour == 2][0]
    assert r2.prior_heart_rate == "?"          # no current data at this hour -> prior blank too


def test_snapshot_runs_hold_hours_without_a_change(spark):
    """Work of the wide snapshot follows what changes, not the hours."""
    hourly = snap.hourly_sums(_conv(spark, [(1, 1, 211, 3, 80.0), (1, 1, 211, 50, 90.0), (2, 2, 50912, 10, 1.0)]))
    visits = spark.createDataFrame([(1, 1, T(2020, 1, 1), 50, "F", "WHITE"), (2, 2, T(2020, 1, 1), 60, "M", "WHITE")],
                                   "subject_id long, hadm_id long, admittime timestamp_ntz, age int, gender string, ethnicity string")
    nonzero = spark.createDataFrame([(1, 1, 60, 3.0, 2)], "subject_id long, hadm_id long, time long, valuenum double, stage int")
    runs = snap.snapshot_runs(hourly, visits, nonzero, hours=200)
    got = {(r.subject_id, r.first_hour): r for r in runs.collect()}
    assert {k: r.last_hour for k, r in got.items()} == {
        (1, 3): 3, (1, 4): 49, (1, 50): 50, (1, 51): 60, (1, 61): 61, (1, 62): 200, (2, 10): 10, (2, 11): 200}
    assert got[1, 4].cur_heart_rate == 80 and got[1, 4].prior_heart_rate == 80 and got[1, 3].prior_heart_rate is None
    hours = {(r.subject_id, r.hour): r for r in snap.run_hours(runs).collect()}
    assert set(hours) == {(1, h) for h in range(3, 201)} | {(2, h) for h in range(10, 201)}
    assert [hours[1, h].stage_6 for h in (53, 54, 60, 61)] == [0, 2, 2, 0]
    assert [hours[1, h].pstage_6 for h in (54, 55, 61, 62)] == [0, 2, 2, 0]
    assert hours[1, 100].prior_heart_rate == 85 and hours[1, 100].cur_heart_rate == 90
