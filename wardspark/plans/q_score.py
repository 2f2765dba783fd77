"""Registered queries: confusion counts, scores, ROC AUC, reports.

Multiclass predictions come from a deterministic rule over the model table (derived from the driver tables):
true class = 48-hour stage label, predicted class = 6-hour stage label, class score = -|creatinine - class|.
Binary predictions come from ``labels`` joined to ``documents``: true = quality, predicted = 1 - toxic,
score = document length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.operators import score
from wardspark.plans.q_prep import imputed, sql as prep_sql
from wardspark.plans.registry import R6, r6, register
from wardspark.sources import fixtures as fx

VISIT = ["subject_id", "hadm_id"]
N = 4


def predictions(spark, d):
    m = imputed(spark, d)
    return m.select(*VISIT, "hour", F.col("stage_48").alias("label"), F.col("stage_6").alias("prediction"),
                    *[(-F.abs(F.col("f_50912") - c)).alias(f"score_{c}") for c in range(N)])


def binary_predictions(spark, d):
    lab = fx.table(spark, d, "labels")
    doc = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(doc, on="doc_id").select(F.col("quality").alias("label"),
                                             (1 - F.col("toxic")).alias("prediction"),
                                             F.col("n_chars").cast("double").alias("score"))


SCORE_CTES = {
    "pr": "SELECT subject_id, hadm_id, hour, stage_48 AS label, stage_6 AS prediction, "
          + ", ".join(f"-abs(f_50912 - {c}) AS score_{c}" for c in range(N)) + " FROM imp",
    "classes": f"SELECT CAST(unnest(range(0, {N})) AS INT) AS class",
    "conf": """SELECT c.class, count(*) FILTER (WHERE p.prediction = c.class AND p.label = c.class) AS tp,
        count(*) FILTER (WHERE p.prediction = c.class AND p.label <> c.class) AS fp,
        count(*) FILTER (WHERE p.prediction <> c.class AND p.label <> c.class) AS tn,
        count(*) FILTER (WHERE p.prediction <> c.class AND p.label = c.class) AS fn
        FROM pr p CROSS JOIN classes c GROUP BY c.class""",
    "conf_h": """SELECT p.hour, c.class, count(*) FILTER (WHERE p.prediction = c.class AND p.label = c.class) AS tp,
        count(*) FILTER (WHERE p.prediction = c.class AND p.label <> c.class) AS fp,
        count(*) FILTER (WHERE p.prediction <> c.class AND p.label <> c.class) AS tn,
        count(*) FILTER (WHERE p.prediction <> c.class AND p.label = c.class) AS fn
        FROM pr p CROSS JOIN classes c GROUP BY p.hour, c.class""",
    "auc_long": " UNION ALL ".join(f"SELECT hour, {c} AS class, score_{c} AS score, CAST(label = {c} AS INT) AS pos FROM pr"
                                   for c in range(N)),
    "bin": """SELECT l.quality AS label, 1 - l.toxic AS prediction, CAST(d.n_chars AS DOUBLE) AS score
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
}


def _auc_sql(by: str) -> str:
    part = f"{by}, class" if by else "class"
    return f"""SELECT {part}, CASE WHEN np > 0 AND nn > 0 THEN (rpos - np * (np + 1) / 2.0) / (np * nn) END AS auc FROM (
      SELECT {part}, sum(rk) FILTER (WHERE pos = 1) AS rpos, count(*) FILTER (WHERE pos = 1)::DOUBLE AS np,
             count(*) FILTER (WHERE pos = 0)::DOUBLE AS nn FROM (
        SELECT *, rank() OVER (PARTITION BY {part} ORDER BY score)
                  + (count(*) OVER (PARTITION BY {part}, score) - 1) / 2.0 AS rk FROM auc_long) GROUP BY {part})"""


def _scores_sql(src: str, keys: str) -> str:
    return (f"SELECT {keys}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, "
            f"CAST(fn AS BIGINT) AS fn, {R6('(tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0)')} AS acc, "
            f"{R6('tp::DOUBLE / nullif(tp + fp, 0)')} AS ppv, {R6('tn::DOUBLE / nullif(tn + fn, 0)')} AS npv, "
            f"{R6('tp::DOUBLE / nullif(tp + fn, 0)')} AS sen, {R6('tn::DOUBLE / nullif(tn + fp, 0)')} AS spe, "
            f"{R6('2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM {src}")


def sql(body, extra=None):
    ctes = dict(SCORE_CTES)
    if extra:
        ctes.update(extra)
    return prep_sql(body, ctes)


def _round(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _counts(df):
    return df.select(*[F.col(c).cast("long").alias(c) if c in ("tp", "fp", "tn", "fn") else F.col(c)
                       for c in df.columns])


@register("m4_confusion_per_class", sql("""SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn FROM conf"""))
def q_m4(spark, d):
    return _counts(score.confusion(predictions(spark, d), N))


@register("m5_confusion_by_hour", sql("""SELECT hour, class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn FROM conf_h"""))
def q_m5(spark, d):
    return _counts(score.confusion(predictions(spark, d), N, by=("hour",)))


@register("m6_scores_per_class", sql(_scores_sql("conf", "class")))
def q_m6(spark, d):
    sc = score.scores(_counts(score.confusion(predictions(spark, d), N)))
    return _round(sc, score.METRICS)


@register("m6_scores_by_hour_class", sql(_scores_sql("conf_h", "hour, class")))
def q_m6h(spark, d):
    sc = score.scores(_counts(score.confusion(predictions(spark, d), N, by=("hour",))))
    return _round(sc, score.METRICS)


RAW_SCORES = ("(tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0) AS acc, tp::DOUBLE / nullif(tp + fp, 0) AS ppv, "
              "tn::DOUBLE / nullif(tn + fn, 0) AS npv, tp::DOUBLE / nullif(tp + fn, 0) AS sen, "
              "tn::DOUBLE / nullif(tn + fp, 0) AS spe, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1")


@register("m6_class_mean_scores", sql(
    "SELECT " + ", ".join(f"{R6(f'avg({m})')} AS {m}" for m in score.METRICS)
    + f" FROM (SELECT class, {RAW_SCORES} FROM conf)"))
def q_m6m(spark, d):
    sc = score.scores(score.confusion(predictions(spark, d), N))
    return _round(score.class_mean(sc), score.METRICS)


@register("m7_roc_auc_per_class", sql(f"SELECT class, {R6('auc')} AS auc FROM ({_auc_sql('')})"))
def q_m7(spark, d):
    return _round(score.roc_auc(predictions(spark, d), N), ["auc"])


@register("m7_roc_auc_by_hour", sql(f"SELECT hour, class, {R6('auc')} AS auc FROM ({_auc_sql('hour')})"))
def q_m7h(spark, d):
    return _round(score.roc_auc(predictions(spark, d), N, by=("hour",)), ["auc"])


@register("m7_auc_hour_mean", sql(f"SELECT class, {R6('avg(auc)')} AS auc FROM ({_auc_sql('hour')}) GROUP BY class"))
def q_m7m(spark, d):
    a = score.roc_auc(predictions(spark, d), N, by=("hour",))
    return _round(a.groupBy("class").agg(F.avg("auc").alias("auc")), ["auc"])


@register("m8_support", sql("SELECT label AS class, CAST(count(*) AS BIGINT) AS support FROM pr GROUP BY label"))
def q_m8(spark, d):
    return score.support(predictions(spark, d))


@register("m9_accuracy_by_hour", sql(
    f"SELECT hour, {R6('avg(CAST(prediction = label AS DOUBLE))')} AS accuracy FROM pr GROUP BY hour"))
def q_m9(spark, d):
    return _round(score.accuracy(predictions(spark, d), by=("hour",)), ["accuracy"])


@register("m10_macro_f1_loss", sql(
    f"SELECT {R6('-avg(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0))')} AS loss FROM conf"))
def q_m10(spark, d):
    return _round(score.macro_f1_loss(score.confusion(predictions(spark, d), N)), ["loss"])


@register("m11_binary_report", sql(
    "SELECT CAST(NULL AS INT) AS data_hour, CAST(NULL AS INT) AS label_hour, "
    + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("tp", "fp", "tn", "fn")) + ", "
    + f"{R6('(tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0)')} AS acc, {R6('a.auc')} AS auc, "
    + f"{R6('tp::DOUBLE / nullif(tp + fp, 0)')} AS ppv, {R6('tn::DOUBLE / nullif(tn + fn, 0)')} AS npv, "
    + f"{R6('tp::DOUBLE / nullif(tp + fn, 0)')} AS sen, {R6('tn::DOUBLE / nullif(tn + fp, 0)')} AS spe, "
    + f"{R6('2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM ("
    + """SELECT count(*) FILTER (WHERE prediction = 1 AND label = 1) AS tp,
            count(*) FILTER (WHERE prediction = 1 AND label <> 1) AS fp,
            count(*) FILTER (WHERE prediction <> 1 AND label <> 1) AS tn,
            count(*) FILTER (WHERE prediction <> 1 AND label = 1) AS fn FROM bin) c, (
       SELECT CASE WHEN np > 0 AND nn > 0 THEN (rpos - np * (np + 1) / 2.0) / (np * nn) END AS auc FROM (
         SELECT sum(rk) FILTER (WHERE label = 1) AS rpos, count(*) FILTER (WHERE label = 1)::DOUBLE AS np,
                count(*) FILTER (WHERE label <> 1)::DOUBLE AS nn FROM (
           SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM bin))) a"""))
def q_m11(spark, d):
    rep = score.binary_report(binary_predictions(spark, d))
    return _round(_counts(rep), ["acc", "auc", "ppv", "npv", "sen", "spe", "f1"])


@register("m12_metric_report", sql(
    "SELECT metric, " + ", ".join(f"{R6(f'max(value) FILTER (WHERE class = {c})')} AS class_{c}" for c in range(N))
    + f", {R6('avg(value)')} AS average FROM (SELECT class, unnest(['acc','ppv','npv','sen','spe','f1']) AS metric, "
    + "unnest([(tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), tp::DOUBLE / nullif(tp + fp, 0), "
      "tn::DOUBLE / nullif(tn + fn, 0), tp::DOUBLE / nullif(tp + fn, 0), tn::DOUBLE / nullif(tn + fp, 0), "
      "2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)]) AS value FROM conf) GROUP BY metric"))
def q_m12(spark, d):
    rep = score.metric_report(score.scores(score.confusion(predictions(spark, d), N)))
    return _round(rep, [f"class_{c}" for c in range(N)] + ["average"])


_HOURS = list(range(0, 25))


def _metric_values(src):
    return (f"SELECT * FROM (SELECT * EXCLUDE (tp, fp, tn, fn), unnest(['acc','ppv','npv','sen','spe','f1']) AS metric, "
            "unnest([(tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), tp::DOUBLE / nullif(tp + fp, 0), "
            "tn::DOUBLE / nullif(tn + fn, 0), tp::DOUBLE / nullif(tp + fn, 0), tn::DOUBLE / nullif(tn + fp, 0), "
            f"2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)]) AS value FROM {src})")


@register("m12_hours_report", sql(
    "SELECT o.class, o.metric, "
    + ", ".join(f"{R6(f'max(h.value) FILTER (WHERE h.hour = {h})')} AS hour_{h}" for h in _HOURS)
    + f", {R6('max(o.value)')} AS overall FROM ({_metric_values('conf')}) o LEFT JOIN ({_metric_values('conf_h')}) h "
    "ON h.class = o.class AND h.metric = o.metric GROUP BY o.class, o.metric"))
def q_m12_hours(spark, d):
    p = predictions(spark, d)
    rep = score.hours_report(score.confusion(p, N, by=("hour",)), score.confusion(p, N), _HOURS)
    return _round(rep, [*(f"hour_{h}" for h in _HOURS), "overall"])


@register("m12_auc_report", sql(
    f"SELECT h.class, {R6('h.auc')} AS hour_mean, {R6('o.auc')} AS overall, coalesce(s.n, 0) AS support FROM "
    f"(SELECT class, avg(auc) AS auc FROM ({_auc_sql('hour')}) GROUP BY class) h "
    f"LEFT JOIN ({_auc_sql('')}) o ON o.class = h.class "
    "LEFT JOIN (SELECT label AS class, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY label) s ON s.class = h.class"))
def q_m12_auc(spark, d):
    p = predictions(spark, d)
    rep = score.auc_report(score.roc_auc(p, N, by=("hour",)), score.roc_auc(p, N), score.support(p))
    return _round(rep, ["hour_mean", "overall"])


@register("m6_scores_with_auc", sql(
    f"SELECT s.* EXCLUDE (acc), {R6('a.auc')} AS auc FROM ({_scores_sql('conf', 'class')}) s "
    f"LEFT JOIN ({_auc_sql('')}) a ON a.class = s.class"))
def q_m6_auc(spark, d):
    p = predictions(spark, d)
    sc = score.scores_with_auc(_counts(score.confusion(p, N)), score.roc_auc(p, N))
    return _round(sc, ["ppv", "npv", "sen", "spe", "f1", "auc"])


@register("m12_model_report", sql(
    "SELECT model, " + R6("avg(f1)") + " AS average, "
    + ", ".join(f"{R6(f'max(f1) FILTER (WHERE class = {c})')} AS class_{c}" for c in range(N))
    + " FROM (SELECT model, class, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, c.class, count(*) FILTER (WHERE i.{m} = c.class AND i.stage_48 = c.class) AS tp, "
        f"count(*) FILTER (WHERE i.{m} = c.class AND i.stage_48 <> c.class) AS fp, "
        f"count(*) FILTER (WHERE i.{m} <> c.class AND i.stage_48 = c.class) AS fn "
        "FROM imp i CROSS JOIN classes c GROUP BY c.class" for m in ("stage_6", "stage_24")) + ")) GROUP BY model"))
def q_m12_models(spark, d):
    """Two rules as models: the stage within 6 and within 24 hours as predictions of the stage within 48."""
    m = imputed(spark, d)
    rows = m.select(F.col("stage_48").alias("label"), F.explode(F.array(
        F.struct(F.lit("stage_6").alias("model"), F.col("stage_6").alias("prediction")),
        F.struct(F.lit("stage_24").alias("model"), F.col("stage_24").alias("prediction")))).alias("x")).select("label", "x.*")
    rep = score.model_report(score.scores(score.confusion(rows, N, by=("model",))), N)
    return _round(rep, ["average", *(f"class_{c}" for c in range(N))])
