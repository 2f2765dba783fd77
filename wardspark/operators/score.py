"""Confusion counts, scores, ROC AUC and reports (inventory M4–M12).

Input is a long predictions table: one row per scored example with a true class, a predicted class and one
score per class (``score_0`` .. ``score_{n-1}``). Everything is aggregation: one-vs-rest counts are an
``explode`` over the class list followed by ``count_if`` per (class[, hour]); AUC is the rank-sum
(Mann–Whitney) statistic over tie-averaged ranks, which equals the trapezoid area under the ROC curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.operators.prep import average_ranks

METRICS = ["acc", "ppv", "npv", "sen", "spe", "f1"]


def _classes(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("class")


def confusion(pred: DataFrame, n_classes: int = 4, label="label", prediction="prediction", by=(),
              count: str | None = None) -> DataFrame:
    """M4/M5: one-vs-rest TP, FP, TN, FN per class (and per ``by`` columns, e.g. hour).

    Rows are counted per (by, label, prediction) first; only that small table is expanded over the classes. A null
    label or prediction is no class: the row counts as a negative or not predicted, as comparisons with null do.
    ``count``: the column that tells how many rows a row stands for; without it each is one."""
    rows = F.sum(count) if count else F.count(F.lit(1))
    n = pred.groupBy(*by, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(rows.alias("_n"))
    x = n.select(*by, "_y", "_p", "_n", _classes(n_classes))
    y, p, c = F.col("_y"), F.col("_p"), F.col("class")

    def total(condition):
        return F.sum(F.when(condition, F.col("_n")).otherwise(F.lit(0))).cast("long")
    return x.groupBy(*by, "class").agg(
        total((p == c) & (y == c)).alias("tp"), total((p == c) & (y != c)).alias("fp"),
        total((p != c) & (y != c)).alias("tn"), total((p != c) & (y == c)).alias("fn"))


def scores(conf: DataFrame) -> DataFrame:
    """M6: ACC, PPV, NPV, SEN, SPE (= TN/(TN+FP)), F1 from counts; undefined ratios are NULL."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return conf.select(
        *[c for c in conf.columns if c not in ("tp", "fp", "tn", "fn")], "tp", "fp", "tn", "fn",
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("acc"), F.try_divide(tp, tp + fp).alias("ppv"),
        F.try_divide(tn, tn + fn).alias("npv"), F.try_divide(tp, tp + fn).alias("sen"),
        F.try_divide(tn, tn + fp).alias("spe"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def scores_with_auc(conf: DataFrame, auc: DataFrame, by=()) -> DataFrame:
    """M6, the form of the traditional models: AUC in place of ACC, per class (and ``by``)."""
    sc = scores(conf).drop("acc")
    on = [*by, "class"]
    return sc.join(auc.select(*on, "auc"), on=on, how="left")


def class_mean(sc: DataFrame, by=(), metrics=METRICS) -> DataFrame:
    """M6: mean of each metric over classes (NULLs ignored)."""
    return sc.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def roc_auc(pred: DataFrame, n_classes: int = 4, label="label", by=()) -> DataFrame:
    """M7: one-vs-rest ROC AUC per class (and per ``by``) from ``score_<c>`` columns, ties averaged.

    AUC = (sum of positive ranks - P(P+1)/2) / (P N); NULL when a group has no positive or no negative, and when any
    of its rows has a null or NaN score, as those have no place in the order. Rows without a label are left out."""
    stack = ", ".join(f"{c}, CAST(score_{c} AS DOUBLE)" for c in range(n_classes))
    long = pred.selectExpr(*[f"`{b}`" for b in by], f"`{label}` AS _y",
                           f"stack({n_classes}, {stack}) AS (class, score)") \
        .withColumn("pos", (F.col("_y") == F.col("class")).cast("int")).drop("_y").where(F.col("pos").isNotNull())
    # unordered scores rank last, as NaN, and are counted
    long = long.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
    r = average_ranks(long, [*by, "class"], "score", ["pos"])
    g = r.groupBy(*by, "class").agg(
        F.sum(F.when(F.col("pos") == 1, F.col("rank") * F.col("cnt"))).alias("rpos"),
        F.sum(F.when(F.col("pos") == 1, F.col("cnt"))).alias("np"),
        F.sum(F.when(F.col("pos") == 0, F.col("cnt"))).alias("nn"), F.max(F.isnan("score")).alias("lost"))
    npos, nneg = F.col("np").cast("double"), F.col("nn").cast("double")
    auc = F.try_divide(F.col("rpos") - npos * (npos + 1) / 2, npos * nneg)
    return g.select(*by, "class", F.when((F.col("np") > 0) & (F.col("nn") > 0) & ~F.col("lost"), auc).alias("auc"))


def support(pred: DataFrame, label="label") -> DataFrame:
    """M8: true count per class."""
    return pred.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("support"))


def accuracy(pred: DataFrame, label="label", prediction="prediction", by=()) -> DataFrame:
    """M9: share of exact matches."""
    return pred.groupBy(*by).agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def macro_f1_loss(conf: DataFrame, by=()) -> DataFrame:
    """Minus the mean over classes of F1 = 2TP/(2TP+FP+FN), 0 when undefined."""
    f1 = F.coalesce(F.try_divide(2 * F.col("tp").cast("double"),
                                 (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return conf.groupBy(*by).agg((-F.avg(f1)).alias("loss"))


def binary_report(pred: DataFrame, label="label", prediction="prediction", score="score",
                  data_hour: int | None = None, label_hour: int | None = None) -> DataFrame:
    """One row: data hour, label hour, TP, FP, TN, FN, ACC, AUC (of the positive-class score), PPV, NPV,
    SEN, SPE, F1 — positive class 1 (fixes the reference's swapped FP/FN and class-0 AUC)."""
    b = pred.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"),
                    F.col(score).alias("score_1"), (-F.col(score)).alias("score_0"))
    conf = confusion(b, 2).where(F.col("class") == 1).drop("class")
    auc = roc_auc(b, 2).where(F.col("class") == 1).select("auc")
    sc = scores(conf)
    # both sides are single rows; attach the AUC with a constant-key join
    one = F.lit(1)
    rep = sc.withColumn("_k", one).join(auc.withColumn("_k", one), on="_k", how="left").drop("_k")
    return rep.select(F.lit(data_hour).cast("int").alias("data_hour"), F.lit(label_hour).cast("int").alias("label_hour"),
                      "tp", "fp", "tn", "fn", "acc", "auc", "ppv", "npv", "sen", "spe", "f1")


def metric_report(sc: DataFrame, n_classes: int = 4, metrics=METRICS) -> DataFrame:
    """Metric x class layout (rows = metrics, columns class_<c> and the class mean)."""
    stack = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    long = sc.selectExpr("class", f"stack({len(metrics)}, {stack}) AS (metric, value)")
    wide = long.groupBy("metric").pivot("class", list(range(n_classes))).agg(F.first("value"))
    return wide.select("metric", *[F.col(str(c)).alias(f"class_{c}") for c in range(n_classes)],
                       F.try_divide(sum((F.coalesce(F.col(str(c)), F.lit(0.0)) for c in range(n_classes)), F.lit(0.0)),
                                    sum((F.col(str(c)).isNotNull().cast("double") for c in range(n_classes)),
                                        F.lit(0.0))).alias("average"))


def hours_report(conf_by_hour: DataFrame, conf: DataFrame, hours: list[int], metrics=METRICS) -> DataFrame:
    """M12, the layout of the sequence models: rows (class, metric), one column per hour and ``overall``.

    ``hours`` is the explicit list of columns; an hour without the class or an undefined ratio is NULL."""
    stack = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    by_hour = scores(conf_by_hour).selectExpr("hour", "class", f"stack({len(metrics)}, {stack}) AS (metric, value)")
    overall = scores(conf).selectExpr("-1 AS hour", "class", f"stack({len(metrics)}, {stack}) AS (metric, value)")
    wide = by_hour.unionByName(overall).groupBy("class", "metric").pivot("hour", [*hours, -1]).agg(F.first("value"))
    return wide.select("class", "metric", *[F.col(str(h)).alias(f"hour_{h}") for h in hours],
                       F.col("-1").alias("overall"))


def auc_report(auc_by_hour: DataFrame, auc: DataFrame, counts: DataFrame) -> DataFrame:
    """M12, AUC: per class the mean over hours, the overall value and the support."""
    mean = auc_by_hour.groupBy("class").agg(F.avg("auc").alias("hour_mean"))
    out = mean.join(auc.select("class", F.col("auc").alias("overall")), on="class", how="left")
    return out.join(counts, on="class", how="left").select(
        "class", "hour_mean", "overall", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def model_report(per_model: DataFrame, n_classes: int = 4, metric: str = "f1") -> DataFrame:
    """M12, the layout of the traditional models: one row per model, the average and each class's ``metric``.

    ``per_model``: model, class and the metric."""
    wide = per_model.groupBy("model").pivot("class", list(range(n_classes))).agg(F.first(metric))
    mean = per_model.groupBy("model").agg(F.avg(metric).alias("average"))
    return mean.join(wide, on="model").select("model", "average", *[F.col(str(c)).alias(f"class_{c}")
                                                                    for c in range(n_classes)])
