"""Cohort, hour offset and hourly aggregate (inventory J1–J4, P2–P9, A1, U1, O1, O2).

All joins here are equi-joins on the visit key. None of them is forced to broadcast: the visit table grows
with the data, so the choice is left to AQE, which converts a join to broadcast only after measuring the
shuffled side at run time (``spark.sql.adaptive.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.functions.vocab import CREATININE_ITEM

VISIT = ["subject_id", "hadm_id"]


def cohort_filter(df: DataFrame, ids: DataFrame, keys=VISIT) -> DataFrame:
    """Rows of ``df`` whose key tuple is in ``ids`` (semi-join; duplicates in ``ids`` are harmless)."""
    return df.join(ids.select(*keys), on=list(keys), how="left_semi")


def membership_report(df: DataFrame, ids: DataFrame, keys=VISIT) -> DataFrame:
    """J4 report: one row (kept, total) — how many rows of ``df`` have their key tuple in ``ids``."""
    marks = ids.select(*keys).distinct().withColumn("_in", F.lit(1))
    return (df.select(*keys).join(marks, on=list(keys), how="left")
            .agg(F.count("_in").alias("kept"), F.count(F.lit(1)).alias("total")))


def hour_diff(start, end):
    """Whole hours from start to end, truncated toward zero (TIMESTAMPDIFF(HOUR, start, end))."""
    return F.timestamp_diff("HOUR", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end)


def admissions_with_age(admissions: DataFrame, patients: DataFrame, subject="subject_id",
                        start="admittime", dob="dob", out="age") -> DataFrame:
    """J1 + P3: admissions joined to patients; age = whole years from date of birth to admission."""
    return (admissions.join(patients, on=subject, how="inner")
            .withColumn(out, F.timestamp_diff("YEAR", F.col(dob).cast("timestamp_ntz"), F.col(start)).cast("int")))


def adult_filter(df: DataFrame, age="age", lo=18, hi=300) -> DataFrame:
    """Lo <= age < hi (ages >= 300 are the de-identified > 89 group)."""
    return df.where((F.col(age) >= lo) & (F.col(age) < hi))


def hour_offset(events: DataFrame, visits: DataFrame, keys=VISIT, start="admittime", ts="charttime",
                out="time", value="valuenum", keep_start=True, carry=()) -> DataFrame:
    """J2 + P2 + P4: events of the visits, non-null value, with the signed whole-hour offset from visit start.

    ``carry`` names extra visit columns to bring along (e.g. the subject when events only carry the visit)."""
    v = visits.select(*keys, *carry, start)
    timed = (events.where(F.col(value).isNotNull())
             .join(v, on=list(keys), how="inner")
             .withColumn(out, hour_diff(start, ts)))
    return timed if keep_start else timed.drop(start)


def hourly_aggregate(timed: DataFrame, keys=VISIT, item="itemid", value="valuenum", unit="valueuom",
                     time="time") -> DataFrame:
    """A1: per (visit, item, hour) count, average, min, max and one unit.

    The unit is ``min(unit)`` so the result is deterministic (the reference selects an ungrouped column).
    Partial aggregation runs map-side, so the shuffle carries one row per group and task, not per event.
    """
    aggs = [F.count(value).alias("count"), F.avg(value).alias("average"),
            F.min(value).alias("min"), F.max(value).alias("max")]
    if unit:
        aggs.append(F.min(unit).alias(unit))
    return timed.groupBy(*keys, item, time).agg(*aggs)


def cohort_hour(admissions: DataFrame, patients: DataFrame, labs: DataFrame, item=CREATININE_ITEM,
                keys=VISIT, start="admittime", ts="charttime") -> DataFrame:
    """Cohort measurement table: adult visits' values of one lab item with hour offset, age, ethnicity, gender.

    (J1, J2, P1–P5, P7.) Columns: subject_id, hadm_id, age, ethnicity, gender, time, valuenum, valueuom.
    """
    ap = admissions_with_age(admissions.select(*keys, start, "ethnicity"), patients.select("subject_id", "dob", "gender"))
    ap = adult_filter(ap)
    l = labs.where((F.col("itemid") == item) & F.col("valuenum").isNotNull()) \
            .select(*keys, ts, "valuenum", "valueuom")
    return (ap.join(l, on=list(keys), how="inner")
            .select(*keys, "age", "ethnicity", "gender", hour_diff(start, ts).alias("time"),
                    "valuenum", "valueuom"))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL UNION — rows of both, duplicates within and across collapsed."""
    return a.unionByName(b).distinct()


def sort_events(df: DataFrame, keys=VISIT, extra=("time", "valuenum")) -> DataFrame:
    """O1: the reference's storage order (visit, time, value). Only needed right before an ordered write."""
    return df.orderBy(*keys, *extra)


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """O2: LIMIT offset, n — made deterministic by an explicit order."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out
