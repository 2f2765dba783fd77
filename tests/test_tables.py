import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardspark.operators import asof
from wardspark.sources import io, tables, visit_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_and_rank_without_an_exchange(spark, tmp_path):
    a = spark.range(2000).selectExpr("id % 97 AS subject_id", "id % 97 * 2 AS hadm_id", "id AS time")
    b = spark.range(97).selectExpr("id AS subject_id", "id * 2 AS hadm_id", "id AS worst")
    left = tables.write_bucketed(a, "bucketed_a", 4, sort=["time"], path=str(tmp_path / "a"))
    right = tables.write_bucketed(b, "bucketed_b", 4, path=str(tmp_path / "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = Window.partitionBy("subject_id", "hadm_id").orderBy("time")
        out = left.join(right, ["subject_id", "hadm_id"]).withColumn("n", F.row_number().over(w))
        assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
        counted = left.groupBy("subject_id", "hadm_id").count()
        assert "Exchange" not in plan(counted) and counted.count() == 97
        assert out.count() == 2000 and out.agg(F.max("n")).first()[0] == 21
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len([f for f in os.listdir(tmp_path / "a") if f.endswith(".parquet")]) <= 4
    spark.sql("DROP TABLE bucketed_a")
    spark.sql("DROP TABLE bucketed_b")


def test_a_repeated_load_adds_nothing(spark, tmp_path, monkeypatch):
    rows = spark.range(10).selectExpr("id", "id * 2 AS v")
    table = tables.LoadTable(spark, str(tmp_path / "t"), rows.schema)
    assert table.read().count() == 0 and table.committed() == []
    assert table.load(rows, "day-1") and not table.load(rows, "day-1") and table.read().count() == 10
    with monkeypatch.context() as m:  # the job dies after its rows are written and before they are published
        m.setattr(tables.LoadTable, "_publish", lambda self, entry: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.load(rows.where("id < 5"), "day-2")
    assert table.read().count() == 10
    assert table.load(rows.where("id < 5"), "day-2") and table.read().count() == 15
    # of two attempts at once both write, and one is published
    with monkeypatch.context() as m:
        m.setattr(tables.LoadTable, "committed", lambda self: [])
        assert not table.load(rows, "day-2")
    assert table.read().count() == 15 and [(r["load"], r["rows"]) for r in table.committed()] == [("day-1", 10), ("day-2", 5)]
    assert table.load(rows.where("id < 0"), "empty") and table.read().count() == 15
    for bad in ("", "a/b", ".x", "_x"):
        with pytest.raises(ValueError):
            table.load(rows, bad)


def scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_lookup_reads_the_touched_row_groups_only(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("id % 20 AS itemid", "xxhash64(id DIV 40) AS hadm_id", "id AS v", "md5(CAST(id AS STRING)) AS pad")
    path = str(tmp_path / "lookup")
    tables.write_lookup_table(rows, path, ["itemid", "hadm_id"], "hadm_id", distinct=10_000, row_group=256 << 10, rows_per_file=100_000)
    some = rows.where("v IN (7, 1234)").select("itemid", "hadm_id").collect()
    hits = tables.lookup(spark, path, [r.asDict() for r in some])
    want = rows.join(spark.createDataFrame(some), ["itemid", "hadm_id"], "left_semi")
    assert sorted(hits.select("v").collect()) == sorted(want.select("v").collect()) and want.count() == 4
    assert scanned(hits) < 40_000
    # a visit that is not there: the filters alone rule out every row group
    assert scanned(tables.lookup(spark, path, [{"hadm_id": 12345}])) < 40_000
    many = rows.where("v % 40 = 0").select("itemid", "hadm_id").limit(300).collect()
    assert tables.lookup(spark, path, [r.asDict() for r in many]).count() == rows.join(
        spark.createDataFrame(many).distinct(), ["itemid", "hadm_id"], "left_semi").count()
    assert tables.lookup(spark, path, []).count() == 0


@pytest.mark.parametrize("offset,limit", [(0, 5), (4999, 3), (5000, 1), (9990, 50), (20_000, 5), (3, 9000)])
def test_pages_equal_the_sorted_rows(spark, tmp_path, offset, limit):
    path = str(tmp_path / "pages")
    rows = spark.range(10_000).selectExpr("id * 7919 % 10007 AS k", "id % 3 AS v")
    tables.write_pages(rows, path, ["k"], rows_per_bucket=1000)
    got = tables.read_page(spark, path, ["k"], offset, limit)
    want = sorted(r["k"] for r in rows.collect())[offset:offset + limit]
    assert [r["k"] for r in got.orderBy("_place").collect()] == want
    if 0 < len(want) < 10:
        # one window per bucket, and only the buckets of the page in the scan
        assert "SinglePartition" not in plan(got) and re.search(r"PartitionFilters: \[[^\]]*_bucket", plan(got))


def test_visit_files_of_a_split(spark, tmp_path):
    folder = str(tmp_path / "visits")
    rows = [(s, s * 10 + h, t, None if t == 2 else t / 4, 'quoted, "text"\nof two lines' if t else "") for s in range(1, 9)
            for h in range(2) for t in range(s)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, time long, value double, note string")
    written = visit_files.write_visit_files(df, folder, ["time", "value", "note"], ["time"])
    assert written.count() == 16 and written.agg(F.sum("rows")).first()[0] == len(rows)
    assert sorted(os.listdir(folder))[0] == "S1_H10.csv" and len([f for f in os.listdir(folder) if f[0] == "S"]) == 16
    schema = df.select("value", "time", "note").schema.add("absent", "integer")
    back = visit_files.read_visit_files(spark, folder, schema)
    assert sorted((r[0], r[1], r["time"], r["value"], r["note"] or "") for r in back.collect()) == sorted(rows)
    assert back.where("absent is not null").count() == 0
    # the files of other splits are not opened: they may be unreadable
    splits = df.select("subject_id", "hadm_id").distinct().withColumn("split", F.when(F.col("subject_id") < 4, "test").otherwise("devel"))
    for name in os.listdir(folder):
        if name[0] == "S" and int(name[1]) >= 4:
            with open(f"{folder}/{name}", "wb") as f:
                f.write(b"\xff\xfe not a csv")
    test = visit_files.read_visit_files(spark, folder, schema, splits, "test", task_bytes=1 << 17)
    assert sorted({r[0] for r in test.collect()}) == [1, 2, 3] and test.count() == len([r for r in rows if r[0] < 4])
    assert visit_files.read_visit_files(spark, folder, schema, splits, "none").count() == 0
    # a repeated write replaces what is there
    visit_files.write_visit_files(df, folder, ["time", "value", "note"], ["time"])
    assert visit_files.read_visit_files(spark, folder, schema).count() == len(rows)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("bucket,tolerance", [(10, None), (7, 5), (100_000, 3), (1, None)])
def test_asof_join_equals_a_loop(spark, direction, bucket, tolerance):
    import random
    r = random.Random(1)
    # key 0 holds most rows
    left = [(i, r.choice([0, 0, 0, 1, 2, None]), r.choice([r.randrange(-200, 200)] * 9 + [None])) for i in range(300)]
    right = [(r.choice([0, 0, 1, None]), r.choice([r.randrange(-200, 200)] * 9 + [None]), i % 7) for i in range(80)]
    out = asof.asof_join(spark.createDataFrame(left, "i long, k long, t long"), spark.createDataFrame(right, "k long, u long, v long"),
                         ["k"], "t", "u", direction, tolerance, bucket)
    want = set()
    for i, k, t in left:
        s = 1 if direction == "backward" else -1
        found = [(u * s, v, u) for kk, u, v in right if None not in (k, t, kk, u) and kk == k and u * s <= t * s
                 and (tolerance is None or abs(t - u) <= tolerance)]
        best = max(found, default=(None, None, None))
        want.add((i, k, t, best[2], best[1]))
    assert {tuple(r) for r in out.select("i", "k", "t", "u", "v").collect()} == want and out.count() == 300


def test_asof_join_of_time_stamps_and_a_hot_key(spark):
    left = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "timestamp_micros(id * 3600000000) AS t")
    right = spark.range(0, 20_000, 50).selectExpr("1L AS k", "timestamp_micros(id * 3600000000) AS u", "id AS v")
    out = asof.asof_join(left, right, ["k"], "t", "u")
    assert out.where("k = 1").agg(F.max(F.expr("unix_micros(t) - unix_micros(u)"))).first()[0] <= 50 * 3_600_000_000
    # the hot key's rows lie in many windows: a bucket of one day has few of them
    assert "_b" in plan(out) and left.where("k = 1").groupBy(F.to_date("t")).count().agg(F.max("count")).first()[0] <= 24
    with pytest.raises(ValueError):
        asof.asof_join(left, right.withColumnRenamed("u", "t"), ["k"], "t", "t")


def test_pages_are_sorted_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_RANGE", 4000)
    path = str(tmp_path / "pages")
    rows = spark.range(10_000).selectExpr("id * 7919 % 10007 AS k", "id % 3 AS v")
    tables.write_pages(rows, path, ["k"], rows_per_bucket=100)
    index = spark.read.parquet(f"{path}/index").orderBy("_bucket").collect()
    assert len({r["_bucket"] // tables.MOST_BUCKETS for r in index}) == 3 and 100 <= len(index) <= 103
    assert [r["before"] for r in index] == [sum(x["n"] for x in index[:i]) for i in range(len(index))]
    got = tables.read_page(spark, path, ["k"], 3950, 120)
    assert [r["k"] for r in got.orderBy("_place").collect()] == sorted(r["k"] for r in rows.collect())[3950:4070]
    assert len(got.inputFiles()) <= 3


def test_nested_visit_files_are_listed_by_tasks(spark, tmp_path):
    folder = str(tmp_path / "nested")
    rows = [(s, s * 10 + h, t, 'quoted, "text"' if t else None) for s in range(1, 9) for h in range(3) for t in range(4)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, time long, note string")
    visit_files.write_visit_files(df, folder, ["time", "note"], ["time"], nested=True)
    (tmp_path / "nested" / "_SUCCESS").write_text("")
    files = visit_files.list_tree(spark, folder)
    names = sorted(r["path"].rsplit("/", 2)[1] for r in files.collect())
    assert names == sorted(f"visit=S{s}_H{s * 10 + h}" for s in range(1, 9) for h in range(3))
    back = io.read_visit_files(spark, folder, files=files)
    assert io.header_of(back) == ["time", "note", "file_subject_id", "file_hadm_id"]
    assert sorted(back.groupBy("file_subject_id", "file_hadm_id", "time").count().collect()) == sorted(
        (s, h, str(t), 1) for s, h, t, _ in rows)
    assert back.where("note is null").count() == 24
    splits = spark.createDataFrame([(1, 10, "test"), (1, 11, "devel")], "subject_id long, hadm_id long, split string")
    assert io.read_visit_files(spark, folder, splits, "test", files=files).count() == 4
