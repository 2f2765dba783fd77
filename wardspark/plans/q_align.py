"""Registered queries: cohort, hour offset, hourly aggregate, staging and visit summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.operators import align, staging
from wardspark.plans.registry import R6, r6, register
from wardspark.sources import fixtures as fx
from wardspark.sources.fixtures import with_fixtures

VISIT = ["subject_id", "hadm_id"]

# ---- shared builders (Spark) --------------------------------------------------------------------------------


def cohort(spark, d):
    return align.cohort_hour(fx.fx_admissions(spark, d), fx.fx_patients(spark, d), fx.fx_labevents(spark, d))


def staged(spark, d):
    return staging.add_stage(cohort(spark, d))


def timed_events(spark, d, src=None):
    ev = fx.fx_events(spark, d)
    if src:
        ev = ev.where(F.col("src") == src)
    return align.hour_offset(ev, fx.fx_admissions(spark, d))


# ---- shared CTEs (SQL) --------------------------------------------------------------------------------------

def _baseline_sql(age="age", eth="ethnicity", sex="gender"):
    return (f"power(75.0::DOUBLE / ((CASE WHEN {sex} = 'F' THEN 0.742::DOUBLE ELSE 1.0::DOUBLE END)"
            f" * (CASE WHEN {eth} LIKE '%BLACK%' THEN 1.21::DOUBLE ELSE 1.0::DOUBLE END)"
            f" * 186.0::DOUBLE * power(CAST({age} AS DOUBLE), -0.203::DOUBLE)), {-1.0 / 1.154!r}::DOUBLE)")


COHORT_CTES = {
    "fx_adm_age": """SELECT a.subject_id, a.hadm_id, a.admittime, a.ethnicity, p.gender,
        CAST(date_sub('year', CAST(p.dob AS TIMESTAMP), a.admittime) AS INT) AS age
        FROM fx_admissions a JOIN fx_patients p ON a.subject_id = p.subject_id""",
    "fx_cohort": """SELECT a.subject_id, a.hadm_id, a.age, a.ethnicity, a.gender,
        date_sub('hour', a.admittime, l.charttime) AS time, l.valuenum, l.valueuom
        FROM fx_adm_age a JOIN fx_labevents l ON a.subject_id = l.subject_id AND a.hadm_id = l.hadm_id
        WHERE l.itemid = 50912 AND l.valuenum IS NOT NULL AND a.age >= 18 AND a.age < 300""",
    "fx_staged0": f"SELECT *, {_baseline_sql()} AS baseline FROM fx_cohort",
    "fx_staged": """SELECT *, valuenum / baseline AS ratio,
        CAST(CASE WHEN valuenum / baseline >= 3.0 THEN 3 WHEN valuenum / baseline >= 2.0 THEN 2
                  WHEN valuenum / baseline >= 1.5 THEN 1 ELSE 0 END AS INT) AS stage FROM fx_staged0""",
    "fx_timed": """SELECT e.*, a.admittime, date_sub('hour', a.admittime, e.charttime) AS time
        FROM fx_events e JOIN fx_admissions a ON e.subject_id = a.subject_id AND e.hadm_id = a.hadm_id
        WHERE e.valuenum IS NOT NULL""",
}


def sql(body: str, extra: dict | None = None) -> str:
    ctes = dict(COHORT_CTES)
    if extra:
        ctes.update(extra)
    return with_fixtures(body, ctes)


# ---- queries ------------------------------------------------------------------------------------------------

@register("j1_admissions_patients_age", sql("""
SELECT subject_id, hadm_id, admittime, ethnicity, gender, age FROM fx_adm_age"""))
def q_j1(spark, d):
    ap = align.admissions_with_age(fx.fx_admissions(spark, d), fx.fx_patients(spark, d))
    return ap.select("subject_id", "hadm_id", "admittime", "ethnicity", "gender", "age")


@register("p7_adult_admissions", sql("""
SELECT subject_id, hadm_id, age FROM fx_adm_age WHERE age >= 18 AND age < 300"""))
def q_p7(spark, d):
    ap = align.admissions_with_age(fx.fx_admissions(spark, d), fx.fx_patients(spark, d))
    return align.adult_filter(ap).select("subject_id", "hadm_id", "age")


@register("j2_hour_offset", sql(f"""
SELECT subject_id, hadm_id, itemid, charttime, time, {R6('valuenum')} AS valuenum FROM fx_timed"""))
def q_j2(spark, d):
    return timed_events(spark, d).select("subject_id", "hadm_id", "itemid", "charttime", "time",
                                         r6("valuenum").alias("valuenum"))


@register("j2_hour_offset_orders", with_fixtures(f"""
SELECT v.subject_id, e.hadm_id, e.itemid, date_sub('hour', v.admittime, e.charttime) AS time,
       {R6('e.valuenum')} AS valuenum
FROM fx_line_events e JOIN fx_order_visits v ON e.hadm_id = v.hadm_id WHERE e.valuenum IS NOT NULL"""))
def q_j2_orders(spark, d):
    ev = fx.fx_line_events(spark, d)
    t = align.hour_offset(ev, fx.fx_order_visits(spark, d), keys=["hadm_id"], carry=["subject_id"])
    return t.select("subject_id", "hadm_id", "itemid", "time", r6("valuenum").alias("valuenum"))


@register("a1_hourly_aggregate", sql(f"""
SELECT subject_id, hadm_id, itemid, time, CAST(count(valuenum) AS BIGINT) AS count,
       {R6('avg(valuenum)')} AS average, {R6('min(valuenum)')} AS min, {R6('max(valuenum)')} AS max,
       min(valueuom) AS valueuom
FROM fx_timed GROUP BY subject_id, hadm_id, itemid, time"""))
def q_a1(spark, d):
    h = align.hourly_aggregate(timed_events(spark, d))
    return h.select(*VISIT, "itemid", "time", F.col("count").cast("long").alias("count"),
                    r6("average").alias("average"), r6("min").alias("min"), r6("max").alias("max"), "valueuom")


@register("a1_hourly_aggregate_orders", with_fixtures(f"""
SELECT v.subject_id, e.hadm_id, e.itemid, date_sub('hour', v.admittime, e.charttime) AS time,
       CAST(count(e.valuenum) AS BIGINT) AS count, {R6('avg(e.valuenum)')} AS average,
       {R6('min(e.valuenum)')} AS min, {R6('max(e.valuenum)')} AS max, min(e.valueuom) AS valueuom
FROM fx_line_events e JOIN fx_order_visits v ON e.hadm_id = v.hadm_id WHERE e.valuenum IS NOT NULL
GROUP BY ALL"""))
def q_a1_orders(spark, d):
    t = align.hour_offset(fx.fx_line_events(spark, d), fx.fx_order_visits(spark, d), keys=["hadm_id"],
                          carry=["subject_id"])
    h = align.hourly_aggregate(t, keys=["subject_id", "hadm_id"])
    return h.select(*VISIT, "itemid", "time", F.col("count").cast("long").alias("count"),
                    r6("average").alias("average"), r6("min").alias("min"), r6("max").alias("max"), "valueuom")


@register("p5_cohort_creatinine", sql(f"""
SELECT subject_id, hadm_id, age, ethnicity, gender, time, {R6('valuenum')} AS valuenum, valueuom FROM fx_cohort"""))
def q_cohort(spark, d):
    return cohort(spark, d).withColumn("valuenum", r6("valuenum"))


@register("f3_staged_cohort", sql(f"""
SELECT subject_id, hadm_id, age, ethnicity, gender, time, {R6('valuenum')} AS valuenum,
       {R6('baseline')} AS baseline, {R6('ratio')} AS ratio, stage FROM fx_staged"""))
def q_staged(spark, d):
    s = staged(spark, d)
    return s.select(*VISIT, "age", "ethnicity", "gender", "time", r6("valuenum").alias("valuenum"),
                    r6("baseline").alias("baseline"), r6("ratio").alias("ratio"), "stage")


@register("j3_cohort_semi_filter", sql(f"""
SELECT subject_id, hadm_id, itemid, src, charttime, {R6('valuenum')} AS valuenum FROM fx_events e
WHERE EXISTS (SELECT 1 FROM fx_cohort c WHERE c.subject_id = e.subject_id AND c.hadm_id = e.hadm_id)"""))
def q_j3(spark, d):
    ids = cohort(spark, d).select(*VISIT)
    ev = align.cohort_filter(fx.fx_events(spark, d), ids)
    return ev.select(*VISIT, "itemid", "src", "charttime", r6("valuenum").alias("valuenum"))


@register("j4_membership_report", sql("""
SELECT CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fx_cohort c
         WHERE c.subject_id = e.subject_id AND c.hadm_id = e.hadm_id)) AS BIGINT) AS kept,
       CAST(count(*) AS BIGINT) AS total FROM fx_events e"""))
def q_j4(spark, d):
    ids = cohort(spark, d).select(*VISIT)
    return align.membership_report(fx.fx_events(spark, d), ids)


@register("u1_union_distinct_events", sql(f"""
SELECT subject_id, hadm_id, itemid, charttime, {R6('valuenum')} AS valuenum FROM fx_chartevents
UNION
SELECT subject_id, hadm_id, itemid, charttime, {R6('valuenum')} AS valuenum FROM fx_labevents"""))
def q_u1(spark, d):
    cols = [*VISIT, "itemid", "charttime", r6("valuenum").alias("valuenum")]
    return align.union_distinct(fx.fx_chartevents(spark, d).select(*cols), fx.fx_labevents(spark, d).select(*cols))


@register("o2_page_of_events", sql(f"""
SELECT subject_id, hadm_id, itemid, time, {R6('valuenum')} AS valuenum FROM fx_timed
ORDER BY subject_id, hadm_id, time, valuenum, itemid LIMIT 100 OFFSET 50"""))
def q_o2(spark, d):
    t = timed_events(spark, d).select(*VISIT, "itemid", "time", "valuenum")
    p = align.page(t, [*VISIT, "time", "valuenum", "itemid"], offset=50, limit=100)
    return p.withColumn("valuenum", r6("valuenum"))


@register("a11_pos_neg_visits", sql("""
SELECT CAST(coalesce(sum(p), 0) AS BIGINT) AS pos_visits, CAST(coalesce(sum(n), 0) AS BIGINT) AS neg_visits FROM (
  SELECT max(CAST(ratio >= 1.5 AS INT)) AS p, max(CAST(ratio < 1.5 AS INT)) AS n
  FROM fx_staged GROUP BY subject_id, hadm_id)"""))
def q_a11(spark, d):
    return staging.visit_pos_neg(staged(spark, d))


@register("a12_visit_stage_counts", sql("""
SELECT subject_id, hadm_id, CAST(count(*) FILTER (WHERE ratio < 1.5) AS BIGINT) AS neg_aki,
       CAST(count(*) FILTER (WHERE ratio >= 1.5) AS BIGINT) AS pos_aki,
       CAST(count(*) FILTER (WHERE ratio >= 1.5 AND ratio < 2.0) AS BIGINT) AS stage1,
       CAST(count(*) FILTER (WHERE ratio >= 2.0 AND ratio < 3.0) AS BIGINT) AS stage2,
       CAST(count(*) FILTER (WHERE ratio >= 3.0) AS BIGINT) AS stage3
FROM fx_staged WHERE age >= 18 GROUP BY subject_id, hadm_id"""))
def q_a12(spark, d):
    return staging.visit_stage_counts(staged(spark, d))


# staged measurements of all ages: the age tests of A12 have something to skip
_ALL_STAGED = """SELECT a.subject_id, a.hadm_id, a.age, l.valuenum / ({b}) AS ratio
  FROM fx_adm_age a JOIN fx_labevents l ON a.subject_id = l.subject_id AND a.hadm_id = l.hadm_id
  WHERE l.itemid = 50912 AND l.valuenum IS NOT NULL AND a.age > 0""".replace("{b}", _baseline_sql())


def staged_all_ages(spark, d):
    ap = align.admissions_with_age(fx.fx_admissions(spark, d), fx.fx_patients(spark, d)).where("age > 0")
    lab = fx.fx_labevents(spark, d).where("itemid = 50912 AND valuenum IS NOT NULL")
    return staging.add_stage(ap.join(lab, on=VISIT))


@register("a12_all_ages_stage_counts", sql(f"""
WITH s AS ({_ALL_STAGED})
SELECT subject_id, hadm_id, CAST(count(*) FILTER (WHERE ratio < 1.5) AS BIGINT) AS neg_aki,
       CAST(count(*) FILTER (WHERE ratio >= 1.5) AS BIGINT) AS pos_aki,
       CAST(count(*) FILTER (WHERE ratio >= 1.5 AND ratio < 2.0) AS BIGINT) AS stage1,
       CAST(count(*) FILTER (WHERE ratio >= 2.0 AND ratio < 3.0) AS BIGINT) AS stage2,
       CAST(count(*) FILTER (WHERE ratio >= 3.0) AS BIGINT) AS stage3,
       (SELECT CAST(count(*) AS BIGINT) FROM s WHERE age < 18) AS skipped
FROM s WHERE age >= 18 GROUP BY subject_id, hadm_id""".replace("\nWITH s AS (", "\nSELECT * FROM (WITH s AS (") + ")"))
def q_a12_all(spark, d):
    """A12 over patients of all ages: the counts per adult visit, and how many measurements of minors were skipped."""
    s = staged_all_ages(spark, d)
    return staging.visit_stage_counts(s).crossJoin(F.broadcast(staging.minors_skipped(s)))


@register("a5_stage_by_hour", sql("""
SELECT time, CAST(count(*) FILTER (WHERE stage = 0) AS BIGINT) AS stage0,
       CAST(count(*) FILTER (WHERE stage = 1) AS BIGINT) AS stage1,
       CAST(count(*) FILTER (WHERE stage = 2) AS BIGINT) AS stage2,
       CAST(count(*) FILTER (WHERE stage = 3) AS BIGINT) AS stage3
FROM fx_staged GROUP BY time"""))
def q_a5(spark, d):
    return staging.stage_by_hour(staging.simple_stage(staged(spark, d)))


@register("a14_visit_stage_bin", sql("""
SELECT subject_id, hadm_id, CAST(floor(avg(s) / 0.75::DOUBLE) AS INT) AS stage_bin FROM (
  SELECT subject_id, hadm_id, time, arg_max(stage, valuenum) AS s FROM fx_staged GROUP BY ALL)
GROUP BY subject_id, hadm_id"""))
def q_a14(spark, d):
    return staging.visit_stage_bin(staged(spark, d))


# ---- filters, lookups, sort, scalar functions -----------------------------------------------------------------

def _vocab_items_sql():
    from wardspark.functions.vocab import vocab_rows
    return ", ".join(str(r[0]) for r in vocab_rows())


@register("p6_item_in_list", sql(f"""
SELECT subject_id, hadm_id, itemid, charttime, {R6('valuenum')} AS valuenum FROM fx_events
WHERE itemid IN ({_vocab_items_sql()})"""))
def q_p6(spark, d):
    from wardspark.functions.vocab import vocab_rows
    # the item list is the fixed vocabulary: a set of literals, which a scan of an item column takes as its filter
    kept = fx.fx_events(spark, d).where(F.col("itemid").isin([r[0] for r in vocab_rows()]))
    return kept.select(*VISIT, "itemid", "charttime", r6("valuenum").alias("valuenum"))


@register("p8_time_window", sql(f"""
SELECT subject_id, hadm_id, itemid, time, {R6('valuenum')} AS valuenum FROM fx_timed
WHERE time > 0 AND time <= 72"""))
def q_p8(spark, d):
    t = timed_events(spark, d).where((F.col("time") > 0) & (F.col("time") <= 72))
    return t.select(*VISIT, "itemid", "time", r6("valuenum").alias("valuenum"))


@register("p9_batched_point_lookup", sql(f"""
SELECT t.subject_id, t.hadm_id, t.time, t.itemid, {R6('t.valuenum')} AS valuenum
FROM fx_timed t JOIN fx_admissions a ON a.subject_id = t.subject_id AND a.hadm_id = t.hadm_id
WHERE t.time = 24 AND t.itemid IN (50912, 51006, 211)"""))
def q_p9(spark, d):
    """Point lookups (visit, hour 24, item list) for every visit at once: a probe table joined to events."""
    probes = fx.fx_admissions(spark, d).select(*VISIT).withColumn("time", F.lit(24).cast("long"))
    t = timed_events(spark, d).where(F.col("itemid").isin([50912, 51006, 211]))
    hits = t.join(probes, on=[*VISIT, "time"], how="left_semi")
    return hits.select(*VISIT, "time", "itemid", r6("valuenum").alias("valuenum"))


@register("o1_storage_order", sql(f"""
SELECT subject_id, hadm_id, time, {R6('valuenum')} AS valuenum FROM fx_cohort
ORDER BY subject_id, hadm_id, time, valuenum"""))
def q_o1(spark, d):
    return align.sort_events(cohort(spark, d)).select(*VISIT, "time", r6("valuenum").alias("valuenum"))


@register("f_scalar_functions", sql(f"""
SELECT subject_id, hadm_id, time,
       CAST(CASE WHEN gender = 'F' THEN 0 ELSE 1 END AS INT) AS gender_code,
       concat(CAST(subject_id AS VARCHAR), CAST(hadm_id AS VARCHAR)) AS visit_key,
       TRY_CAST(CAST(age AS VARCHAR) AS DOUBLE) AS age_parsed,
       [CAST(stage = 0 AS INT), CAST(stage = 1 AS INT), CAST(stage = 2 AS INT), CAST(stage = 3 AS INT)] AS stage_onehot,
       CAST(stage > 0 AS INT) AS aki,
       CAST(regexp_extract('S' || subject_id || '_H' || hadm_id || '.csv', 'S(\\d+)_H(\\d+)', 1) AS BIGINT) AS file_subject,
       CAST(regexp_extract('S' || subject_id || '_H' || hadm_id || '.csv', 'S(\\d+)_H(\\d+)', 2) AS BIGINT) AS file_hadm,
       CASE WHEN regexp_matches(s, '^(\\?|!.*)$') THEN NULL ELSE TRY_CAST(s AS DOUBLE) END AS cleared
FROM (SELECT *, CASE WHEN stage = 0 THEN '?' WHEN stage >= 2 THEN '!' || CAST(time AS VARCHAR)
                     ELSE CAST(time AS VARCHAR) END AS s FROM fx_staged)"""))
def q_fs(spark, d):
    from wardspark.functions import clinical as C
    s = staged(spark, d)
    txt = F.when(F.col("stage") == 0, F.lit("?")).when(F.col("stage") >= 2, F.concat(F.lit("!"), F.col("time").cast("string"))) \
        .otherwise(F.col("time").cast("string"))
    fs, fh = C.parse_visit_file(F.concat(F.lit("S"), F.col("subject_id"), F.lit("_H"), F.col("hadm_id"), F.lit(".csv")))
    return s.select(*VISIT, "time", C.gender_code("gender").alias("gender_code"),
                    C.concat_ids("subject_id", "hadm_id").alias("visit_key"),
                    C.parse_number(F.col("age").cast("string")).alias("age_parsed"),
                    C.one_hot("stage").alias("stage_onehot"), C.binarize("stage").alias("aki"),
                    fs.alias("file_subject"), fh.alias("file_hadm"), C.clear_sentinel(txt).alias("cleared"))
