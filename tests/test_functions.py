import pytest
from pyspark.sql import functions as F

from wardspark.functions import clinical as C
from wardspark.functions.vocab import NORMAL_VALUES, bounds_rows, vocab_rows


def test_baseline_samples(spark):
    df = spark.createDataFrame([(65, "WHITE", "M"), (65, "WHITE", "F"), (40, "BLACK/AFRICAN AMERICAN", "M")],
                               "age int, eth string, sex string")
    got = [r[0] for r in df.select(C.baseline_creatinine("age", "eth", "sex")).collect()]
    assert got == pytest.approx([1.054152, 0.813957, 1.354354], abs=1e-6)


def test_stage_boundaries(spark):
    df = spark.createDataFrame([(1.4999,), (1.5,), (2.0,), (3.0,), (0.2,)], "r double")
    assert [r[0] for r in df.select(C.stage_from_ratio("r")).collect()] == [0, 1, 2, 3, 0]


def test_validity_margin(spark):
    b = {f: (lo, hi) for f, lo, hi in bounds_rows()}
    lo, hi = b["systolic_bp"]
    df = spark.createDataFrame([(15.0,), (14.9,), (457.5,), (457.6,)], "v double")
    got = [r[0] for r in df.select(C.is_valid("v", F.lit(lo), F.lit(hi))).collect()]
    assert got == [True, False, True, False]
    lo, hi = b["51003"]          # only a low bound
    assert hi is None and lo == pytest.approx(0.015)


def test_sentinels(spark):
    df = spark.createDataFrame([("?",), ("!",), ("!17.2",), ("3.5",), (None,)], "s string")
    assert [r[0] for r in df.select(C.clear_sentinel("s")).collect()] == [None, None, None, 3.5, None]


def test_vocab_sizes():
    rows = vocab_rows()
    assert len([r for r in rows if r[1] == "chart"]) == 49 and len([r for r in rows if r[1] == "lab"]) == 90
    assert sum(v is not None for v in NORMAL_VALUES.values()) == 58
    temp_f = [r for r in rows if r[0] == 678][0]
    assert (100 + temp_f[5]) * temp_f[4] == pytest.approx(37.7777778)


def test_one_hot_and_file_names(spark):
    df = spark.createDataFrame([(2, "S12_H34.csv")], "y int, f string")
    r = df.select(C.one_hot("y").alias("o"), *C.parse_visit_file("f")).first()
    assert list(r[0]) == [0, 0, 1, 0] and r[1] == 12 and r[2] == 34
    t = spark.createDataFrame([("hpo_hour12_48.db.csv",)], "f string").select(*C.parse_trial_file("f")).first()
    assert (t[0], t[1]) == ("hour12", 48)
