"""Portable views over the driver tables, in Spark and in the SQL used by the DuckDB oracle.

The reference works on hospital admissions, patients and event tables. The driver tables carry an ``events``
stream; one visit per user and ISO week, one patient per user, and five event types mapped to five items give
every operator an input of the same shape. The same definitions are spelled once for Spark (DataFrames) and
once as SQL common table expressions, so that the oracle reads exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- Spark side -------------------------------------------------------------------------------------------

def _visit_id(ev: DataFrame):
    # the ISO year belongs to the id: weeks of two years must not collide
    return (F.col("user_id") * 1_000_000 + F.expr("extract(YEAROFWEEK FROM ts)") * 100 + F.weekofyear("ts")
            ).cast("long").alias("hadm_id")


def fx_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, hadm_id, admittime, ethnicity: one visit per user and ISO week."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("subject_id"),
        _visit_id(ev),
        F.date_trunc("week", "ts").cast("timestamp_ntz").alias("admittime"),
        F.when(F.col("user_id") % 5 == 0, "BLACK/AFRICAN AMERICAN").otherwise("WHITE").alias("ethnicity"),
    ).distinct()


def fx_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, gender, dob (date)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("subject_id"),
        F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.make_date((F.lit(2014) - F.col("user_id") % 80).cast("int"), F.lit(6), F.lit(15)).alias("dob"),
    ).distinct()


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, hadm_id, charttime, itemid, src ('lab'/'chart'), valuenum, valueuom."""
    ev = table(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    return ev.select(
        F.col("user_id").alias("subject_id"),
        _visit_id(ev),
        F.col("ts").alias("charttime"),
        (F.when(et == "click", 50912).when(et == "error", 51006).when(et == "view", 677)
         .when(et == "purchase", 678).otherwise(211)).cast("long").alias("itemid"),
        F.when(et.isin("click", "error"), "lab").otherwise("chart").alias("src"),
        (F.when(et == "click", v / 50).when(et == "view", 36 + v / 100)
         .when(et == "purchase", 96 + v / 50).otherwise(v)).alias("valuenum"),
        (F.when(et == "click", "mg/dL").when(et == "view", "C").when(et == "purchase", "F")).alias("valueuom"),
    )


def fx_labevents(spark, sf_dir) -> DataFrame:
    return fx_events(spark, sf_dir).where(F.col("src") == "lab").drop("src")


def fx_chartevents(spark, sf_dir) -> DataFrame:
    return fx_events(spark, sf_dir).where(F.col("src") == "chart").drop("src")


def fx_order_visits(spark, sf_dir) -> DataFrame:
    """Second event family: visit = order, subject = customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                    F.col("o_orderdate").alias("admittime"))


def fx_line_events(spark, sf_dir) -> DataFrame:
    """lineitem as events of the order visits: item = supplier key mod 10, value = quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("hadm_id"), F.col("l_shipdate").alias("charttime"),
                     (F.col("l_suppkey") % 10).alias("itemid"), F.col("l_quantity").alias("valuenum"),
                     F.col("l_returnflag").alias("valueuom"))


# ---- SQL side (DuckDB spelling) ----------------------------------------------------------------------------

FIXTURE_CTES = {
    "fx_admissions": """SELECT DISTINCT user_id AS subject_id, CAST(user_id * 1000000 + isoyear(ts) * 100 + weekofyear(ts) AS BIGINT) AS hadm_id,
        CAST(date_trunc('week', ts) AS TIMESTAMP) AS admittime,
        CASE WHEN user_id % 5 = 0 THEN 'BLACK/AFRICAN AMERICAN' ELSE 'WHITE' END AS ethnicity FROM events""",
    "fx_patients": """SELECT DISTINCT user_id AS subject_id, CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        make_date(CAST(2014 - user_id % 80 AS INT), 6, 15) AS dob FROM events""",
    "fx_events": """SELECT user_id AS subject_id, CAST(user_id * 1000000 + isoyear(ts) * 100 + weekofyear(ts) AS BIGINT) AS hadm_id, ts AS charttime,
        CAST(CASE event_type WHEN 'click' THEN 50912 WHEN 'error' THEN 51006 WHEN 'view' THEN 677
                        WHEN 'purchase' THEN 678 ELSE 211 END AS BIGINT) AS itemid,
        CASE WHEN event_type IN ('click','error') THEN 'lab' ELSE 'chart' END AS src,
        CASE event_type WHEN 'click' THEN value/50 WHEN 'view' THEN 36 + value/100
                        WHEN 'purchase' THEN 96 + value/50 ELSE value END AS valuenum,
        CASE event_type WHEN 'click' THEN 'mg/dL' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'F' END AS valueuom
        FROM events""",
    "fx_labevents": "SELECT * EXCLUDE (src) FROM fx_events WHERE src = 'lab'",
    "fx_chartevents": "SELECT * EXCLUDE (src) FROM fx_events WHERE src = 'chart'",
    "fx_order_visits": "SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime FROM orders",
    "fx_line_events": """SELECT l_orderkey AS hadm_id, l_shipdate AS charttime, l_suppkey % 10 AS itemid,
        l_quantity AS valuenum, l_returnflag AS valueuom FROM lineitem""",
}


def with_fixtures(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the fixture CTEs (and ``extra`` ones, in order). Unreferenced CTEs cost nothing."""
    ctes = dict(FIXTURE_CTES)
    if extra:
        ctes.update(extra)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body
