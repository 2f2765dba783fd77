"""Classifiers, k-nearest neighbours, random trials and best-trial selection (inventory M1–M3, M13, M14, O3).

Fitting is Spark ML (distributed estimators), and ``operators.linear`` for SGD. All logistic and SGD trials of a data set
advance together there; of the others the driver starts a few at a time, each an ordinary distributed fit. k-NN is exact: training rows lie in cells around pivots, and a test row meets only the cells that the triangle
inequality cannot rule out; the distances of a meeting are estimated with numpy inside the task, and computed for the
pairs that the estimate leaves.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       OneVsRestModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.operators import linear
from wardspark.operators.prep import hash32
from wardspark.operators.score import binary_report, confusion, macro_f1_loss
from wardspark.session import materialize

MODEL_NAMES = ["logistic", "linear_svc", "gbt", "tree", "naive_bayes", "random_forest", "mlp", "sgd_linear"]
PARALLEL_FITS = 4
#: Trials of these models are fitted together, by ``fit_together``.
JOINT = ("logistic", "sgd_linear")


def classifier(name: str, params: dict | None = None, n_features: int | None = None, n_classes: int = 4,
               seed: int = 0):
    """M2: one Spark ML estimator. The first six are binary/one-vs-rest capable; MLP is natively multiclass."""
    p = dict(params or {})
    if name == "logistic":
        return LogisticRegression(maxIter=int(p.get("maxIter", 50)), regParam=float(p.get("regParam", 0.0)),
                                  elasticNetParam=float(p.get("elasticNetParam", 0.0)))
    if name == "linear_svc":
        return LinearSVC(maxIter=int(p.get("maxIter", 50)), regParam=float(p.get("regParam", 0.0)))
    if name == "gbt":
        return GBTClassifier(maxIter=int(p.get("maxIter", 10)), maxDepth=int(p.get("maxDepth", 3)), seed=seed)
    if name == "tree":
        return DecisionTreeClassifier(maxDepth=int(p.get("maxDepth", 5)), seed=seed)
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian")
    if name == "random_forest":
        return RandomForestClassifier(numTrees=int(p.get("numTrees", 20)), maxDepth=int(p.get("maxDepth", 5)),
                                      seed=seed)
    if name == "mlp":
        hidden = int(p.get("hidden", 8))
        return MultilayerPerceptronClassifier(layers=[n_features, hidden, n_classes], maxIter=int(p.get("maxIter", 100)),
                                              seed=seed)
    raise ValueError(name)


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, name: str = "logistic",
                params: dict | None = None, n_classes: int = 4, keep=()) -> DataFrame:
    """M1: fit on ``train`` (one-vs-rest around binary-capable models, native for MLP) and predict ``test``.
    Returns ``keep`` columns, label, prediction (ints)."""
    if name == "sgd_linear":
        fit = linear.fit_sgd(train, features, label, [sgd_setting(params)], n_classes)
        return linear.predict(fit, test, label, keep).select(*keep, "label", F.col("predictions")[0].alias("prediction"))
    return _predict(_fit(assembled(train, features, label), features, name, params, n_classes),
                    assembled(test, features, label), label, keep)


def assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``df`` with the label as ``_y`` and its features as a vector."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return asm.transform(df.withColumn("_y", F.col(label).cast("double")))


def _fit(train: DataFrame, features: list[str], name: str, params: dict | None, n_classes: int):
    """The model of an assembled table; the classes of one-vs-rest are fitted at the same time."""
    est = classifier(name, params, len(features), n_classes)
    if name != "mlp":
        est = OneVsRest(classifier=est, parallelism=n_classes)
    return est.setFeaturesCol("features").setLabelCol("_y").setPredictionCol("_p").fit(train)


def _predict(model, test: DataFrame, label: str, keep=()) -> DataFrame:
    """``keep`` columns, label, prediction. One-vs-rest takes the class of the greatest raw score, by expressions: the
    model's own ``transform`` hands each row to Python once per class."""
    given = [*keep, F.col(label).cast("int").alias("label")]
    if not isinstance(model, OneVsRestModel):
        return model.transform(test).select(*given, F.col("_p").cast("int").alias("prediction"))
    scored, scores = test, []
    for i, m in enumerate(model.models):
        made = ["rawPrediction", "probability", "_p"]
        scored = m.transform(scored).withColumn(f"_s{i}", vector_to_array("rawPrediction")[1]).drop(*made)
        scores.append(F.col(f"_s{i}"))
    # the first of equal scores; a score that is no number never wins, but in the first place it is never beaten
    ranked = F.array(*[F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x) for x in scores])
    best = F.when(F.isnan(scores[0]), 0).otherwise(F.array_position(ranked, F.array_max(ranked)) - 1)
    return scored.select(*given, best.cast("int").alias("prediction"))


@contextmanager
def held(train: DataFrame, features: list[str], label: str):
    """The assembled table, kept by the executors while several models are fitted on it."""
    table = assembled(train, features, label).select("_y", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield table
    finally:
        table.unpersist()


def sgd_setting(params: dict | None) -> linear.Setting:
    """Setting of an SGD trial; parameters may be text, as trial tables hold them."""
    p = dict(params or {})
    return linear.Setting(loss=p.get("loss", "hinge"), alpha=float(p.get("alpha", 1e-4)))


def fit_together(train: DataFrame, features: list[str], label: str, name: str, params: list[dict],
                 n_classes: int = 4) -> linear.Fit:
    """One model of each of ``params``, all in the same passes; ``name`` is one of ``JOINT``."""
    if name == "sgd_linear":
        return linear.fit_sgd(train, features, label, [sgd_setting(p) for p in params], n_classes)
    settings = [linear.Setting("log", float(p.get("regParam", 0.0)), float(p.get("elasticNetParam", 0.0))) for p in params]
    return linear.fit_gradient(train, features, label, settings, n_classes)


def fit_binary(train: DataFrame, test: DataFrame, features: list[str], label: str, name: str,
               params: dict | None = None) -> DataFrame:
    """Positive label against 0: label, prediction and score of class 1 of ``test``."""
    positive = lambda df: df.withColumn("_y", (F.col(label) > 0).cast("double"))
    if name == "sgd_linear":
        fit = linear.fit_sgd(positive(train), features, "_y", [sgd_setting(params)], 2)
        return linear.predict(fit, positive(test), "_y").select(
            "label", F.col("predictions")[0].alias("prediction"), F.col("margins")[0].alias("score"))
    est = classifier(name, params, len(features), 2).setFeaturesCol("features").setLabelCol("_y").setPredictionCol("_p")
    est = est.setRawPredictionCol("_raw")
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    out = Pipeline(stages=[asm, est]).fit(positive(train)).transform(positive(test))
    return out.select(F.col("_y").cast("int").alias("label"), F.col("_p").cast("int").alias("prediction"),
                      vector_to_array("_raw")[1].alias("score"))


def evaluate_models(train: DataFrame, test: DataFrame, features: list[str], label: str, names=MODEL_NAMES,
                    n_classes: int = 4) -> list[tuple]:
    """M2: fit every classifier and score it on ``test``: (model, macro F1, accuracy)."""
    def one(name, table):
        if name == "sgd_linear":
            pred = fit_predict(train, test, features, label, name, n_classes=n_classes)
        else:
            pred = _predict(_fit(table, features, name, None, n_classes), assembled(test, features, label), label)
        # the predictions are made once: a row per label and prediction
        counts = pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count")).collect()
        found = pred.sparkSession.createDataFrame(counts, "label int, prediction int, count long")
        loss = macro_f1_loss(confusion(found, n_classes, count="count")).first()["loss"]
        known = [r for r in counts if r["label"] is not None and r["prediction"] is not None]
        total = sum(r["count"] for r in known)
        return name, -loss, sum(r["count"] for r in known if r["label"] == r["prediction"]) / total if total else None
    with held(train, features, label) as table, ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(lambda name: one(name, table), names))


# ---- M3 exact k-NN with triangle pruning ----------------------------------------------------------------------------

MOST_PIVOTS = 1024


def _distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` to all rows of ``b``, in steps of bounded memory."""
    out = np.empty((len(a), len(b)))
    step = max(1, int(2_000_000 // max(1, len(b) * a.shape[1])))
    for s in range(0, len(a), step):
        out[s:s + step] = _norms(a[s:s + step, None, :] - b[None, :, :], p)
    return out


def _norms(diff: np.ndarray, p: float) -> np.ndarray:
    diff = np.abs(diff)
    return np.sqrt((diff * diff).sum(-1)) if p == 2 else (diff ** p).sum(-1) ** (1.0 / p)


def _slack(bound: np.ndarray) -> np.ndarray:
    """A bound on distances, widened by the rounding in them."""
    return bound * (1 + 1e-9) + 1e-9


def _estimate(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(distances of all rows of ``a`` to all rows of ``b``, squared for p = 2, what each row's may be off by).

    A matrix product for p = 2, sums of short floats for p = 1; what can't be estimated is exact."""
    dims = a.shape[1]
    if p == 2:
        size_a, size_b = (a * a).sum(1), (b * b).sum(1)
        off = 8 * np.finfo(np.float64).eps * (dims + 4) * (size_a + size_b.max())
        if np.isfinite(off).all():
            return size_a[:, None] + size_b[None, :] - 2 * (a @ b.T), off
    elif p == 1:
        size_a, size_b = np.abs(a).sum(1), np.abs(b).sum(1)
        off = 4 * float(np.finfo(np.float32).eps) * (dims + 4) * (size_a + size_b.max())
        if (off < 1e30).all():
            left, right = a.astype(np.float32), np.ascontiguousarray(b.T.astype(np.float32))
            out = np.zeros((len(a), len(b)), np.float32)
            # a few rows at a time, so that their sums stay in the processor's cache
            step = max(1, 65_536 // max(1, len(b)))
            for lo in range(0, len(a), step):
                x, total = left[lo:lo + step], out[lo:lo + step]
                diff = np.empty_like(total)
                for j in range(dims):
                    np.subtract(x[:, j, None], right[j], out=diff)
                    np.abs(diff, out=diff)
                    total += diff
            return out, off
    d = _distances(a, b, p)
    return (d * d if p == 2 else d), np.zeros(len(a))


def _candidates(a: np.ndarray, b: np.ndarray, bound: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``) pairs that hold the k nearest of each row that are no farther than its bound."""
    d, off = _estimate(a, b, p)
    limit = _slack(bound) ** 2 if p == 2 else _slack(bound)
    limit = limit * (1 + 1e-9) + off
    limit[np.isnan(d).sum(1) > d.shape[1] - k] = -1  # fewer than k have a distance
    many = np.flatnonzero((d <= limit[:, None]).sum(1) > k)
    # the k-th distance cuts a row; what may be as near or nearer stays
    kth = np.partition(d[many], k - 1, axis=1)[:, k - 1].astype(np.float64)
    limit[many] = np.minimum(limit[many], kth * (1 + 1e-9) + 2 * off[many])
    return np.nonzero(d <= limit[:, None])


def _rows_of(b: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    col = b.column(name) if isinstance(b, pa.RecordBatch) else b[name].combine_chunks()
    return np.asarray(col.flatten()).reshape(b.num_rows, -1)


def _nearest(t: pa.Table, k: int, p: float) -> pa.Table:
    """The k nearest training rows of each test row of one (cell, part) group."""
    t = t.combine_chunks()
    test = np.asarray(t["is_test"])
    vec, ids, label = _rows_of(t, "vec"), np.asarray(t["id"]), np.asarray(t["label"].fill_null(0))
    bound = np.asarray(t["bound"].fill_null(np.inf))
    out = {"test_id": [], "train_id": [], "dist": [], "label": []}
    b = np.flatnonzero(~test)
    kk = min(k, len(b))
    for lo in range(0, np.count_nonzero(test) if kk else 0, 256):
        a = np.flatnonzero(test)[lo:lo + 256]
        row, col = _candidates(vec[a], vec[b], bound[a], kk, p)
        dist = np.empty(len(row))
        step = max(1, 2_000_000 // max(1, vec.shape[1]))
        for at in range(0, len(row), step):
            s = slice(at, at + step)
            dist[s] = _norms(vec[a[row[s]]] - vec[b[col[s]]], p)
        order = np.lexsort((ids[b[col]], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        keep = (np.arange(len(row)) - np.searchsorted(row, row) < kk) & (dist <= _slack(bound[a])[row])
        row, col = row[keep], col[keep]
        out["test_id"].append(ids[a[row]])
        out["train_id"].append(ids[b[col]])
        out["dist"].append(dist[keep])
        out["label"].append(label[b[col]])
    kind = {"dist": np.float64}
    return pa.table({c: np.concatenate(x) if x else np.zeros(0, kind.get(c, np.int64)) for c, x in out.items()})


def knn_neighbors(train: DataFrame, test: DataFrame, k: int = 5, p: float = 2.0, id_col="id", vec_col="vec",
                  label_col="label", rows_per_part: int = 4096) -> DataFrame:
    """M3 core: the exact k nearest training rows of every test row (Minkowski p >= 1), ties by training id.
    Returns test_id, train_id, dist, label, rank (1..k).

    Training rows are assigned to the nearest of at most ``MOST_PIVOTS`` pivots (the rows with the least hashes, about
    the square root of their number), and each cell knows its radius. A test row first meets its nearest cell; the
    k-th distance found there bounds the answer, so by the triangle inequality it then meets only cells whose pivot
    is no farther than that bound plus the radius. A cell is cut into parts of ``rows_per_part`` rows by hash, so a
    cell of equal vectors is many groups. Work follows the cells met; on data without any structure all are met."""
    schema = "id long, vec array<double>, label long"
    tr = materialize(train.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                                  F.col(label_col).cast("long").alias("label")), "knn-train")
    te = materialize(test.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                                 F.lit(None).cast("long").alias("label")), "knn-test")
    n = tr.count()
    order = "test_id long, train_id long, dist double, label long"
    if not n:
        return tr.sparkSession.createDataFrame([], order + ", rank int")
    chosen = tr.orderBy(hash32("id", seed=2), "id").limit(min(MOST_PIVOTS, max(1, math.isqrt(n)))).select("vec").toArrow()
    pivots = _rows_of(chosen, "vec")

    def assign(batches):
        for b in batches:
            d = _distances(_rows_of(b, "vec"), pivots, p)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("int32")),
                                              pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "far"])
    tr = materialize(tr.mapInArrow(assign, schema + ", cell int, far double"), "knn-cells")
    cells = tr.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / F.lit(rows_per_part))
                                   .cast("int").alias("parts")).collect()  # a row per pivot
    radius, parts = np.full(len(pivots), -1.0), np.zeros(len(pivots), int)
    for r in cells:
        radius[r["cell"]], parts[r["cell"]] = r["radius"], r["parts"]

    def visits(batches):
        """One row per cell part that a test row meets: its nearest cell without a bound, the others within it."""
        for b in batches:
            bound = np.asarray(b.column("bound").fill_null(np.inf)) if "bound" in b.schema.names else None
            d = _distances(_rows_of(b, "vec"), pivots, p)
            first = np.where(radius >= 0, d, np.inf).argmin(1)
            own = np.zeros(d.shape, bool)
            own[np.arange(len(d)), first] = True
            # the slack absorbs rounding in the distances
            meet = own if bound is None else (~own & (radius >= 0) & (d - radius <= _slack(bound)[:, None]))
            row, cell = np.nonzero(meet)
            count = parts[cell]
            row, cell = np.repeat(row, count), np.repeat(cell, count)
            part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            far = np.full(b.num_rows, np.inf) if bound is None else bound
            for lo in range(0, len(row), 8192):
                s = slice(lo, lo + 8192)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(row[s])) for c in ("id", "vec", "label")), pa.array(cell[s].astype("int32")),
                     pa.array(part[s].astype("int32")), pa.array(far[row[s]])],
                    ["id", "vec", "label", "cell", "part", "bound"])

    # at most one row per pivot
    by_cell = tr.sparkSession.createDataFrame([(r["cell"], r["parts"]) for r in cells], "cell int, parts int")
    sized = tr.join(F.broadcast(by_cell), "cell")
    side = sized.select("id", "vec", "label", "cell", F.pmod(hash32("id", seed=3), F.col("parts")).cast("int").alias("part"),
                        F.lit(None).cast("double").alias("bound"), F.lit(False).alias("is_test"))

    def meet(tests: DataFrame) -> DataFrame:
        met = tests.mapInArrow(visits, schema + ", cell int, part int, bound double").withColumn("is_test", F.lit(True))
        return met.unionByName(side).groupBy("cell", "part").applyInArrow(lambda t: _nearest(t, k, p), order)
    near = materialize(meet(te), "knn-first")
    ranked = Window.partitionBy("test_id").orderBy("dist", "train_id")
    kth = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(
        F.col("test_id").alias("id"), F.col("dist").alias("bound"))
    cand = near.unionByName(meet(te.join(kth, "id", "left")))
    return cand.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def knn_vote(neigh: DataFrame, weights: str = "uniform") -> DataFrame:
    """M3 vote: uniform (most frequent label, smallest on ties) or distance (sum of 1/d; zero distances
    take all the weight)."""
    if weights == "uniform":
        wt = F.lit(1.0)
        nb = neigh
    else:
        # a window, as a join with itself would look for the neighbours twice
        zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("test_id"))
        nb = neigh.where(F.col("test_id").isNotNull()).withColumn("_z", zero)
        wt = F.when(F.col("_z") == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    s = nb.groupBy("test_id", "label").agg(F.sum(wt).alias("w"))
    best = Window.partitionBy("test_id").orderBy(F.col("w").desc(), F.col("label").asc())
    return s.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1) \
        .select("test_id", F.col("label").alias("prediction"))


# ---- M13 / M14 / O3 trials -----------------------------------------------------------------------------------------

PARAM_SPACE = {
    "logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "linear_svc": {"regParam": [0.0, 0.01, 0.1]},
    "gbt": {"maxIter": [5, 10], "maxDepth": [2, 3, 4]},
    "tree": {"maxDepth": [3, 5, 8]},
    "naive_bayes": {},
    "random_forest": {"numTrees": [10, 20], "maxDepth": [3, 5]},
    "mlp": {"hidden": [8, 16]},
    "sgd_linear": {"loss": ["hinge", "log"], "alpha": [0.0001, 0.001, 0.01]},
}


def draw_trials(n: int, seed: int = 0, models=MODEL_NAMES) -> list[tuple[int, str, dict]]:
    """Deterministic random draws from the conditional space (model first, then its parameters)."""
    import hashlib

    def h(*a):
        return int(hashlib.md5("|".join(map(str, (seed, *a))).encode()).hexdigest()[:8], 16)
    out = []
    for t in range(n):
        m = models[h(t, "model") % len(models)]
        params = {k: v[h(t, k) % len(v)] for k, v in PARAM_SPACE[m].items()}
        out.append((t, m, params))
    return out


def draw_table(data_sets: DataFrame, n: int, seed: int = 0, models=MODEL_NAMES) -> DataFrame:
    """The draws of ``draw_trials`` for every row of ``data_sets`` (column ``dataset``), by expressions: dataset,
    trial_id, model and params (map)."""
    def drawn(values: list, *key: str):
        text = F.concat_ws("|", F.lit(str(seed)), F.col("trial_id").cast("string"), *[F.lit(k) for k in key])
        at = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(len(values))).cast("int")
        return F.array(*[F.lit(str(v)) for v in values])[at]
    t = data_sets.select("dataset", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("trial_id"))
    t = t.withColumn("model", drawn(list(models), "model"))
    params = F.create_map().cast("map<string,string>")
    for m in models:
        space = PARAM_SPACE[m]
        if space:
            pairs = [x for k, v in space.items() for x in (F.lit(k), drawn(v, k))]
            params = F.when(F.col("model") == m, F.create_map(*pairs)).otherwise(params)
    return t.withColumn("params", params)


_TRIALS = "dataset string, trial_id int, model string, params map<string,string>, loss double"


def _losses(jobs: list[tuple], features: list[str], n_classes: int) -> list[tuple]:
    """(dataset, trial, model, params, loss) of (dataset, train, valid, label, trials) jobs.

    The trials of a data set that belong to a model of ``JOINT`` are one fit; the rest a few fits at a time, and a
    setting that was drawn again for a data set is fitted once, as fits repeat exactly."""
    def text(params):
        return {k: str(v) for k, v in params.items()}

    def together(job):
        dataset, train, valid, label, name, trials = job
        fit = fit_together(train, features, label, name, [p for _, _, p in trials], n_classes)
        found = linear.losses(fit, valid, label, n_classes)
        return [(dataset, t, m, text(p), loss) for (t, m, p), loss in zip(trials, found, strict=True)]

    def alone(job):
        dataset, table, valid, label, _, trials = job
        _, m, params = trials[0]
        pred = _predict(_fit(table, features, m, params, n_classes), assembled(valid, features, label), label)
        loss = macro_f1_loss(confusion(pred, n_classes)).first()["loss"]
        return [(dataset, t, m, text(params), float(loss)) for t, _, _ in trials]

    work = []
    with ExitStack() as tables, ThreadPoolExecutor(PARALLEL_FITS) as pool:
        for dataset, train, valid, label, trials in jobs:
            for name in JOINT:
                if any(m == name for _, m, _ in trials):
                    work.append((together, (dataset, train, valid, label, name, [t for t in trials if t[1] == name])))
            table = tables.enter_context(held(train, features, label))
            drawn = {}
            for t in trials:
                if t[1] not in JOINT:
                    drawn.setdefault((t[1], tuple(sorted(t[2].items()))), []).append(t)
            work += [(alone, (dataset, table, valid, label, m, same)) for (m, _), same in drawn.items()]
        return sorted((r for rows in pool.map(lambda w: w[0](w[1]), work) for r in rows), key=lambda r: r[:2])


def run_trials(spark, train: DataFrame, valid: DataFrame, features: list[str], label: str, n_trials: int = 6,
               seed: int = 0, dataset: str = "data", n_classes: int = 4) -> DataFrame:
    """Fit each drawn trial on ``train``, loss = macro-F1 loss (M10) on ``valid``.
    Returns dataset, trial_id, model, params (map), loss."""
    jobs = [(dataset, train, valid, label, draw_trials(n_trials, seed))]
    return spark.createDataFrame(_losses(jobs, features, n_classes), _TRIALS)


def run_grid(spark, data_sets: dict, features: list[str], labels: list[str], n_trials: int = 2, seed: int = 0,
             n_classes: int = 4) -> DataFrame:
    """M13 over data sets: for each data hour ``{name: (train, valid)}`` and each label, the trials of that data set."""
    jobs = [(f"{name}_{label}", train, valid, label, draw_trials(n_trials, seed)) for name, (train, valid) in data_sets.items()
            for label in labels]
    return spark.createDataFrame(_losses(jobs, features, n_classes), _TRIALS)


def best_trial(trials: DataFrame, by=("dataset",), loss="loss", min_estimators: int | None = None) -> DataFrame:
    """Per group, the trial with the lowest loss (ties: smallest trial id); with ``min_estimators`` only
    trials whose parameter numTrees is larger count."""
    if min_estimators is not None:
        trials = trials.where(F.col("params")["numTrees"].cast("int") > min_estimators)
    order = F.struct(F.col(loss), F.col("trial_id"))
    return trials.groupBy(*by).agg(F.min_by(F.struct(*[c for c in trials.columns if c not in by]), order).alias("b")) \
        .select(*by, "b.*")


def refit_best(trials: DataFrame, data_sets: dict, features: list[str], min_estimators: int | None = None) -> DataFrame:
    """The best trial of each data set, refitted as positive against 0, with its binary report on the test rows.

    ``data_sets``: {dataset: (data hour, label hour, label, train, test)}. One row per data set that has a trial."""
    chosen = [(r["dataset"], r) for r in best_trial(trials, min_estimators=min_estimators).collect()]  # one per data set

    def one(item):
        name, r = item
        data_hour, label_hour, label, train, test = data_sets[name]
        pred = materialize(fit_binary(train, test, features, label, r["model"], dict(r["params"] or {})), "refit")
        report = binary_report(pred, data_hour=data_hour, label_hour=label_hour).first()
        return (name, r["trial_id"], r["model"], float(r["loss"]), *report)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(one, chosen))
    return trials.sparkSession.createDataFrame(rows, _REPORT)


_REPORT = ("dataset string, trial_id int, model string, valid_loss double, data_hour int, label_hour int, tp long, fp long, "
           "tn long, fn long, acc double, auc double, ppv double, npv double, sen double, spe double, f1 double")
