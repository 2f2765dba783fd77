"""Columns without a value over visits x hours (the three-dimensional form)."""

import math

import pytest

from wardspark.operators import prep

FEATS = ["a", "b", "c", "d"]
ROWS = [(1, 1, 1, 1.0, None, None, None), (1, 1, 2, None, None, float("nan"), 2.5),
        (2, 3, 1, 3.0, None, None, None), (2, 4, 5, None, None, float("nan"), None)]


def sequences(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, hour int, a double, b double, c double, d double")
    return prep.to_sequences(df, FEATS)


def test_values_are_counted_over_visits_and_hours(spark):
    got = {r["column_name"]: r["non_null"] for r in prep.sequence_non_null(sequences(spark), FEATS).collect()}
    assert got == {"a": 2, "b": 0, "c": 0, "d": 1}


def test_columns_without_a_value_go_from_every_vector(spark):
    cut, kept = prep.drop_sequence_columns(sequences(spark), FEATS)
    assert kept == ["a", "d"]
    got = {(r["subject_id"], r["hadm_id"]): [(s["hour"], s["x"]) for s in r["steps"]] for r in cut.collect()}
    assert got == {(1, 1): [(1, [1.0, None]), (2, [None, 2.5])], (2, 3): [(1, [3.0, None])], (2, 4): [(5, [None, None])]}


def test_columns_kept_for_one_set_are_taken_for_another(spark):
    cut, kept = prep.drop_sequence_columns(sequences(spark), FEATS, keep=["d", "c"])
    assert kept == ["d", "c"]
    x = [s["x"] for r in cut.orderBy("subject_id", "hadm_id").collect() for s in r["steps"]]
    assert [v[0] for v in x] == [None, 2.5, None, None]
    assert [v[1] is not None and math.isnan(v[1]) for v in x] == [False, True, False, True]
    with pytest.raises(ValueError):
        prep.drop_sequence_columns(sequences(spark), FEATS, keep=["e"])


def test_no_visits_and_visits_without_hours(spark):
    none = sequences(spark, [])
    assert {r["non_null"] for r in prep.sequence_non_null(none, FEATS).collect()} == {0}
    cut, kept = prep.drop_sequence_columns(none, FEATS)
    assert kept == [] and cut.count() == 0
    bare = sequences(spark).selectExpr("subject_id", "hadm_id", "slice(steps, 1, 0) AS steps")
    assert {r["non_null"] for r in prep.sequence_non_null(bare, FEATS).collect()} == {0}
    cut, kept = prep.drop_sequence_columns(sequences(spark), FEATS, keep=[])
    assert {tuple(s["x"]) for r in cut.collect() for s in r["steps"]} == {()}


def test_a_step_stands_for_a_run_of_equal_hours(spark):
    runs = spark.createDataFrame([(1, 1, 1, 3, 1.0, None), (1, 1, 4, 4, None, float("nan")), (2, 3, 2, 6, 2.0, None)],
                                 "subject_id long, hadm_id long, first_hour int, last_hour int, a double, b double")
    hours = runs.selectExpr("subject_id", "hadm_id", "explode(sequence(first_hour, last_hour)) AS hour", "a", "b")
    short = prep.to_sequences(runs, ["a", "b"], hour="first_hour", last="last_hour")
    full = prep.to_sequences(hours, ["a", "b"])
    assert {r["column_name"]: r["non_null"] for r in prep.sequence_non_null(short, ["a", "b"]).collect()} == {"a": 8, "b": 0}
    cut, kept = prep.drop_sequence_columns(short, ["a", "b"])
    assert kept == ["a"] == prep.drop_sequence_columns(full, ["a", "b"])[1]

    def spread(seq, last):
        return sorted((r["hadm_id"], h, s["x"][0]) for r in seq.collect() for s in r["steps"] for h in range(s["hour"], s[last] + 1))
    assert spread(cut, "last") == spread(prep.drop_sequence_columns(full, ["a", "b"])[0], "hour")
