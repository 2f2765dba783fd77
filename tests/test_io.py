import os
import tempfile

from pyspark.sql import functions as F

from wardspark.operators import prep
from wardspark.sources import io


def test_delimited_scan_handles_quotes_and_bad_rows(spark):
    d = tempfile.mkdtemp(prefix="ws-csv-")
    with open(os.path.join(d, "ev.csv"), "w") as f:
        f.write('row_id,subject_id,hadm_id,itemid,charttime,valuenum,valueuom\n')
        f.write('1,10,100,211,2020-01-01 10:00:00,80.5,"bpm, sitting"\n')
        f.write('2,10,100,211,not-a-time,81,bpm\n')
    df = io.read_delimited(spark, d, io.EVENT_SCHEMA)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].valueuom == "bpm, sitting" and rows[0].valuenum == 80.5


def test_visit_file_scan(spark):
    d = tempfile.mkdtemp(prefix="ws-visits-")
    for s, h in [(1, 11), (2, 22)]:
        with open(os.path.join(d, f"S{s}_H{h}.csv"), "w") as f:
            f.write("HOUR,X\n1,3.5\n2,?\n")
    with open(os.path.join(d, ".hidden.csv"), "w") as f:
        f.write("HOUR,X\n9,9\n")
    df = io.read_visit_files(spark, d)
    assert sorted((r.file_subject_id, r.file_hadm_id) for r in df.select("file_subject_id", "file_hadm_id").distinct().collect()) == [(1, 11), (2, 22)]
    assert df.count() == 4 and io.header_of(df)[:2] == ["HOUR", "X"]
    splits = spark.createDataFrame([(1, 11, "test"), (2, 22, "devel")], "subject_id long, hadm_id long, split string")
    assert io.read_visit_files(spark, d, splits, "test").count() == 2


def test_sinks_round_trip(spark):
    base = tempfile.mkdtemp(prefix="ws-sinks-")
    df = spark.createDataFrame([(1, 10, h, float(h)) for h in range(1, 5)], "subject_id long, hadm_id long, hour int, v double")
    io.write_per_hour(df, os.path.join(base, "h"), fmt="parquet")
    assert spark.read.parquet(os.path.join(base, "h")).count() == 4
    io.write_per_visit(df, os.path.join(base, "v"), buckets=2, fmt="parquet")
    assert spark.read.parquet(os.path.join(base, "v")).count() == 4
    counts = spark.createDataFrame([(211, 1, 10, 3)], "itemid long, subject_id long, hadm_id long, n long")
    io.write_count_json(counts, os.path.join(base, "j"))
    r = spark.read.json(os.path.join(base, "j")).first()
    assert (r.itemid, r.visit, r.n) == (211, "1,10", 3)


def test_stage_trajectory(spark):
    df = spark.createDataFrame([(1, 10, 2, 2), (1, 10, 1, 0), (2, 20, 1, 1)],
                               "subject_id long, hadm_id long, hour int, stage_48 int")
    t = {r.hadm_id: (r.hours, r.stages) for r in prep.stage_trajectory(df).collect()}
    assert t == {10: ([1, 2], [0, 2]), 20: ([1], [1])}


def test_bad_rows_do_not_depend_on_the_columns_selected(spark):
    d = tempfile.mkdtemp(prefix="ws-bad-")
    with open(os.path.join(d, "ev.csv"), "w") as f:
        f.write("row_id,subject_id,hadm_id,itemid,charttime,valuenum,valueuom\n")
        f.write("1,1,1,1,2020-01-01 10:00:00,1,x\n2,1,1,1,nope,2,x\n3,1,1,1,2020-01-01 10:00:00,3,x\n")
    df = io.read_delimited(spark, d, io.EVENT_SCHEMA)
    assert df.count() == df.select("row_id").count() == len(df.collect()) == 2
    assert io.bad_rows(spark, d, io.EVENT_SCHEMA) == 1
    assert io.read_delimited(spark, d, io.EVENT_SCHEMA, bad_rows="keep").count() == 3


def test_read_snapshot_csv_sentinels(spark):
    d = tempfile.mkdtemp(prefix="ws-snap-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("HOUR,SUBJECT_ID,HADM_ID,X,Y,STAGE_48\n1,1,10,?,!,0\n2,1,10,3.5,!7.2,1\n")
    df = prep.read_snapshot_csv(spark, d)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].x == 3.5 and rows[0].y is None and rows[0].stage_48 == 1
