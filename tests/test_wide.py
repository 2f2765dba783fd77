"""The snapshot's intervals, whole rows, sequences and text, on events of this file."""

import datetime as dt
import glob
import os

import duckdb
import pytest

from wardspark import session
from wardspark.operators import prep, snapshot as snap
from wardspark.plans import catalog, q_prep, q_snapshot
from wardspark.sources import io

KEYS = ["subject_id", "hadm_id"]
KINDS = ("click", "error", "view", "purchase", "other")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    start = dt.datetime(2024, 1, 1, 3)
    rows = [(i, start + dt.timedelta(hours=7 * i % 400), i % 3, KINDS[i % 5], float(20 + 11 * i % 170), "{}") for i in range(60)]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def oracle(folder, sql):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return con.execute(sql)


def test_partitions_follow_the_hours_in_the_intervals(spark, monkeypatch):
    monkeypatch.setattr(snap, "HOURS_PER_TASK", 500)
    rows = [(i, i, 1, 100) for i in range(40)] + [(99, 99, 5, 4)]
    out = snap.explode_hours(spark.createDataFrame(rows, "subject_id long, hadm_id long, lo int, hi int"))
    assert out.rdd.getNumPartitions() == 8
    assert out.count() == 4000 and out.distinct().count() == 4000


def test_the_gate_cuts_intervals_and_not_hours(spark, events):
    hourly, vis, _ = q_snapshot.snapshot_inputs(spark, events)
    gate = snap.gate_hours(hourly, 50)
    late = snap.snapshot_cells(hourly, vis, 50).join(gate, KEYS, "left").where("name like 'cur%' or hour >= _gate")
    got = snap.snapshot_cells(hourly, vis, 50, gate=gate)
    cols = [*KEYS, "hour", "name", "mean", "ok"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, late.select(cols).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # that with the fixed bounds


@pytest.mark.parametrize("name", ["w5_snapshot_by_hour", "w5_snapshot_by_visit"])
def test_rows_of_the_snapshot_are_whole(spark, events, name):
    df = catalog.queries()[name](spark, events)
    found = oracle(events, catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert df.columns == names and len(names) == 226
    key = lambda r: r[:3]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(found.fetchall(), key=key)


def test_sequences_are_not_read_from_a_file(spark, events, monkeypatch):
    monkeypatch.setattr(q_prep, "SEQUENCE_HOURS", 200)
    seq, _ = q_prep.wide_sequences(spark, events)
    plan = seq._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan
    assert seq.rdd.getNumPartitions() > 4
    for name in ("p13_sequence_non_null", "p13_sequence_drop_columns"):
        got = catalog.queries()[name](spark, events)
        want = oracle(events, catalog.oracle_sql()[name])
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_text_of_the_snapshot_is_compressed(spark, events, tmp_path, monkeypatch):
    name = "s9_s2_snapshot_text_roundtrip"
    written = []
    plain = io.write_per_visit
    monkeypatch.setattr(io, "write_per_visit", lambda df, path, **options: written.append(path) or plain(df, path, **options))
    got = catalog.queries()[name](spark, events)
    want = oracle(events, catalog.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    files = [f for f in glob.glob(os.path.join(written[0].removeprefix("file:"), "part-*"))]
    assert files and all(f.endswith(".csv.gz") for f in files)


def test_label_hours_are_not_sent_to_all_executors(spark, tmp_path):
    """The intervals of the labels are small files, the hours made of them are not."""
    start, events = dt.datetime(2024, 1, 1, 3), str(tmp_path)
    rows = [(i, start + dt.timedelta(hours=7 * i % 400), 40 + i % 3, KINDS[i % 5], float(20 + 11 * i % 170), "{}") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{events}/events.parquet")
    table = q_prep.model_table(spark, events)
    rows = table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "hour#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    names = ["subject_id", "hadm_id", "hour", *q_prep.LABELS]
    want = oracle(events, q_prep.sql(f"SELECT {', '.join(names)} FROM mt")).fetchall()
    assert any(r[-1] for r in want)
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want)


def test_sequences_hold_a_vector_once_for_equal_hours(spark, events):
    seq, feats = q_prep.wide_sequences(spark, events)
    rows = seq.collect()
    steps = [s for r in rows for s in r["steps"]]
    hours = oracle(events, q_snapshot._snapshot_sql(emit_empty=False)).fetchall()
    assert sum(s["last"] - s["hour"] + 1 for s in steps) == len(hours) > 4 * len(steps)
    assert {len(s["x"]) for s in steps} == {len(feats)}


def test_text_of_the_snapshot_is_sorted_in_runs(spark, events, tmp_path):
    hourly, vis, nz = q_snapshot.snapshot_inputs(spark, events)
    text = snap.snapshot(hourly, vis, nz, hours=50, emit_empty=True, as_text=True, in_order=True)
    plan = text._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "Sort [" in line][0]
    assert any("Generate explode" in line for line in plan[:at]) and "first_hour" in plan[at]
    io.write_per_visit(text, str(tmp_path / "text"), dealt=True, in_order=True)
    seen = []
    for f in glob.glob(str(tmp_path / "text" / "part-*.csv")):
        lines = open(f).read().splitlines()
        head = lines[0].split(",")
        rows = [tuple(int(line.split(",")[head.index(c)]) for c in (*KEYS, "hour")) for line in lines[1:]]
        assert rows == sorted(rows)
        seen += rows
    assert len(seen) == len(set(seen)) == 50 * vis.count()


def test_preparation_writes_only_new_rows(spark, events, monkeypatch):
    """A pass of resampling leaves the rows before it where they are, and the wide snapshot is written once."""
    written = []
    plain = session.materialize

    def noted(df, name, *more):
        written.append((name, plain(df, name, *more)))
        return written[-1][1]
    for module in (session, prep):
        monkeypatch.setattr(module, "materialize", noted)
    out = catalog.queries()["t14_prepare_resampled"](spark, events)
    rows = {n: [x.count() for name, x in written if name == n] for n in ("prepared", "synthetic")}
    assert len(rows["prepared"]) == 1 and len(rows["synthetic"]) == len(q_prep.LABELS)
    assert out.count() == sum(rows["prepared"]) + sum(rows["synthetic"])
    written.clear()
    catalog.queries()["t14_prepare_snapshot_width"](spark, events)
    assert [name for name, _ in written].count("snapshot-model") == 1 and "snapshot" not in dict(written)
