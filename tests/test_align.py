import datetime as dt

from pyspark.sql import functions as F

from wardspark.operators import align

T = dt.datetime


def test_hour_offset_truncates_toward_zero(spark):
    visits = spark.createDataFrame([(1, 10, T(2020, 1, 1, 10, 30))], "subject_id long, hadm_id long, admittime timestamp_ntz")
    ev = spark.createDataFrame([(1, 10, T(2020, 1, 1, 10, 0), 1.0), (1, 10, T(2020, 1, 1, 8, 0), 2.0),
                                (1, 10, T(2020, 1, 1, 12, 29), 3.0), (1, 10, T(2020, 1, 1, 12, 29), None)],
                               "subject_id long, hadm_id long, charttime timestamp_ntz, valuenum double")
    got = sorted((r.valuenum, r.time) for r in align.hour_offset(ev, visits).collect())
    assert got == [(1.0, 0), (2.0, -2), (3.0, 1)]


def test_hourly_aggregate(spark):
    t = spark.createDataFrame([(1, 1, 5, 2, 1.0, "a"), (1, 1, 5, 2, 3.0, "b"), (1, 1, 5, 3, 4.0, "a")],
                              "subject_id long, hadm_id long, itemid long, time long, valuenum double, valueuom string")
    rows = {r.time: r for r in align.hourly_aggregate(t).collect()}
    assert (rows[2]["count"], rows[2]["average"], rows[2]["min"], rows[2]["max"], rows[2]["valueuom"]) == (2, 2.0, 1.0, 3.0, "a")


def test_semi_filter_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 1)], "subject_id long, hadm_id long")
    ids = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "subject_id long, hadm_id long")
    assert align.cohort_filter(df, ids).count() == 3
    r = align.membership_report(df, ids).first()
    assert (r.kept, r.total) == (3, 4)


def test_age_and_adult_filter(spark):
    adm = spark.createDataFrame([(1, 10, T(2020, 6, 14)), (2, 20, T(2020, 6, 15))], "subject_id long, hadm_id long, admittime timestamp_ntz")
    pat = spark.createDataFrame([(1, dt.date(2002, 6, 15), "F"), (2, dt.date(2002, 6, 15), "M")], "subject_id long, dob date, gender string")
    a = {r.subject_id: r.age for r in align.admissions_with_age(adm, pat).collect()}
    assert a == {1: 17, 2: 18}
    assert [r.subject_id for r in align.adult_filter(align.admissions_with_age(adm, pat)).collect()] == [2]
