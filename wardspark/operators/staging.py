"""Baseline creatinine, ratio, stage and per-visit stage summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.functions.clinical import STAGE_CUTS, baseline_creatinine, stage_from_ratio

VISIT = ["subject_id", "hadm_id"]


def add_stage(df: DataFrame, value="valuenum", age="age", ethnicity="ethnicity", sex="gender",
              cuts=STAGE_CUTS) -> DataFrame:
    """F2 + F3: adds baseline, ratio = value / baseline, stage 0–3. One projection, no shuffle."""
    bl = baseline_creatinine(age, ethnicity, sex)
    return (df.withColumn("baseline", bl)
            .withColumn("ratio", F.col(value) / F.col("baseline"))
            .withColumn("stage", stage_from_ratio("ratio", cuts)))


def nonzero_stages(staged: DataFrame) -> DataFrame:
    """Staged rows with stage > 0 (the table the forward / previous labels read)."""
    return staged.where(F.col("stage") > 0)


def simple_stage(staged: DataFrame, keys=VISIT) -> DataFrame:
    """(subject_id, hadm_id, time, stage) projection."""
    return staged.select(*keys, "time", "stage")


def visit_pos_neg(staged: DataFrame, keys=VISIT, ratio="ratio", cut=STAGE_CUTS[0]) -> DataFrame:
    """Number of distinct visits with any ratio >= cut (pos_visits) and with any < cut (neg_visits).

    Two-level aggregate (per visit, then total) instead of COUNT(DISTINCT) so the distinct step is an
    ordinary partial-aggregated shuffle on the visit key.
    """
    per_visit = staged.groupBy(*keys).agg(
        F.max((F.col(ratio) >= cut).cast("int")).alias("p"),
        F.max((F.col(ratio) < cut).cast("int")).alias("n"))
    return per_visit.agg(F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("pos_visits"),
                         F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("neg_visits"))


def visit_stage_counts(staged: DataFrame, keys=VISIT, ratio="ratio", age="age", min_age=18,
                       cuts=STAGE_CUTS) -> DataFrame:
    """Per adult visit, counts of negative, positive, stage-1, stage-2 and stage-3 measurements."""
    r = F.col(ratio)
    c1, c2, c3 = cuts
    return (staged.where(F.col(age) >= min_age).groupBy(*keys).agg(
        F.count_if(r < c1).alias("neg_aki"),
        F.count_if(r >= c1).alias("pos_aki"),
        F.count_if((r >= c1) & (r < c2)).alias("stage1"),
        F.count_if((r >= c2) & (r < c3)).alias("stage2"),
        F.count_if(r >= c3).alias("stage3")))


def minors_skipped(staged: DataFrame, age="age", min_age=18) -> DataFrame:
    """A12 side count: one row, the measurements skipped because the patient is under ``min_age``."""
    return staged.agg(F.count_if(F.col(age) < min_age).alias("skipped"))


def stage_by_hour(stages: DataFrame, time="time", stage="stage") -> DataFrame:
    """A5: per hour, counts of stage 0, 1, 2, 3 as four columns (0 when absent).

    Pivot with an explicit value list: no extra job to discover the values, fixed output schema.
    """
    out = stages.groupBy(time).pivot(stage, [0, 1, 2, 3]).count()
    return out.select(time, *[F.coalesce(F.col(str(s)), F.lit(0)).cast("long").alias(f"stage{s}")
                              for s in range(4)])


def visit_stage_bin(stages: DataFrame, keys=VISIT, time="time", stage="stage", order="valuenum",
                    max_stage=3, n_stages=4) -> DataFrame:
    """Last stage per (visit, time) in storage order, mean over times, int(mean / (max/n)).

    W6 last-write-wins is ``max_by(stage, order)``: the storage order within a visit and hour is by value.
    """
    last = stages.groupBy(*keys, time).agg(F.max_by(stage, order).alias("_s"))
    return (last.groupBy(*keys).agg(F.avg("_s").alias("_m"))
            .select(*keys, F.floor(F.col("_m") / F.lit(max_stage / n_stages)).cast("int").alias("stage_bin")))
