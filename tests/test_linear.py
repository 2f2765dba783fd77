import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wardspark.operators import linear, models


def frame(spark, n=3000, classes=3, seed=0, noise=0.3):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, 4)) * [1, 5, 0.1, 20] + [0, 3, 1, -50]
    w = r.normal(0, 1, (classes, 4))
    z = ((x - [0, 3, 1, -50]) / [1, 5, 0.1, 20]) @ w.T + noise * r.normal(0, 1, (n, classes))
    rows = [(i, *map(float, x[i]), int(z[i].argmax())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int"), ["a", "b", "c", "d"]


#: The first draws of this seed hold two SGD trials, and no tree ensembles.
SEED = next(s for s in range(999) if sorted(m for _, m, _ in models.draw_trials(4, s)) == ["naive_bayes", "sgd_linear", "sgd_linear", "tree"])
SETTINGS = [linear.Setting("hinge", 1e-4), linear.Setting("log", 1e-2), linear.Setting("hinge", 0.1, rate=0.5, power=0.5)]


def test_all_settings_together_equal_a_plain_loop_and_single_fits(spark):
    df, feats = frame(spark, 1500)
    mean, scale = linear.scaling(df, feats)
    blocks = [(np.frombuffer(r["x"]).reshape(-1, 5), np.frombuffer(r["y"], np.int32))
              for r in linear.pack(df, feats, "y", mean, scale, rows=400).collect()]
    assert sum(len(y) for _, y in blocks) == 1500 and max(len(y) for _, y in blocks) == 400
    together = linear.fit_sgd(df, feats, "y", SETTINGS, 3, epochs=3, batch=50, rows=400)
    for s, got in zip(SETTINGS, together.coefficients, strict=True):
        single = linear.fit_sgd(df, feats, "y", [s], 3, epochs=3, batch=50, rows=400).coefficients[0]
        assert np.allclose(single, got, atol=1e-9)
        for c in range(3):  # one class of one setting, a row at a time
            w = np.zeros(5)
            for epoch in range(3):
                total = np.zeros(5)
                for x, y in blocks:
                    v, step = w.copy(), epoch * 8
                    for lo in range(0, len(y), 50):
                        g = np.zeros(5)
                        for xi, yi in zip(x[lo:lo + 50], y[lo:lo + 50], strict=True):
                            t = 1 if yi == c else -1
                            m = t * float(xi @ v)
                            g -= xi * t * ((m < 1) if s.loss == "hinge" else 1 / (1 + np.exp(m)))
                        g /= len(y[lo:lo + 50])
                        g[:4] += s.alpha * v[:4]
                        v -= s.rate / (1 + s.rate * s.alpha * step) ** s.power * g
                        step += 1
                    total += v * len(y)
                w = total / 1500
            assert np.allclose(w, got[c], atol=1e-8)


def test_passes_do_not_grow_with_the_settings(spark, monkeypatch):
    df, feats = frame(spark, 300)
    seen = []
    whole = linear._sum_over
    monkeypatch.setattr(linear, "_sum_over", lambda *a: seen.append(1) or whole(*a))
    linear.fit_sgd(df, feats, "y", SETTINGS[:1], 3, epochs=2)
    one = len(seen)
    linear.fit_sgd(df, feats, "y", SETTINGS * 5, 3, epochs=2)
    assert len(seen) == 2 * one == 4
    trials = models.run_trials(spark, df, df, feats, "y", n_trials=4, n_classes=3, seed=SEED).collect()
    assert len(seen) == 4 + 10 * any(r["model"] == "sgd_linear" for r in trials) + 41 * any(r["model"] == "logistic" for r in trials)


def test_full_gradient_reaches_the_coefficients_of_spark(spark):
    df, feats = frame(spark, 2000, classes=2, noise=1.0)
    vec = VectorAssembler(inputCols=feats, outputCol="features").transform(df)
    settings = [linear.Setting("log", a, l1) for a, l1 in ((0.1, 0.0), (0.05, 0.5))]
    fit = linear.fit_gradient(df, feats, "y", settings, 2, passes=60)
    for s, got in zip(settings, fit.coefficients, strict=True):
        m = LogisticRegression(labelCol="y", regParam=s.alpha, elasticNetParam=s.l1, tol=1e-10, maxIter=200).fit(vec)
        assert np.allclose(got[1][:4] / fit.scale, m.coefficients.toArray(), rtol=0.02, atol=2e-3)
        assert np.allclose(got[0], -got[1], atol=1e-9)


def test_one_vs_rest_accuracy_and_odd_rows(spark):
    df, feats = frame(spark, 4000, classes=4)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    pred = models.fit_predict(train, test, feats, "y", "sgd_linear", keep=["id"]).toPandas()
    assert list(pred.columns) == ["id", "label", "prediction"] and len(pred) == 1000
    assert (pred.label == pred.prediction).mean() > 0.8
    odd = df.unionByName(spark.createDataFrame([(-1, None, float("nan"), 1.0, 2.0, 1), (-2, 1.0, 1.0, 1.0, 1.0, None)], df.schema))
    out = linear.predict(linear.fit_sgd(odd, feats, "y", SETTINGS[:2], 4), odd, "y", ["id"])
    assert out.count() == 4002 and out.where("size(predictions) = 2 and exists(margins, m -> isnan(m))").count() == 0
    none = linear.fit_sgd(df.where("id < 0"), feats, "y", SETTINGS[:1], 4)
    assert not none.coefficients[0].any()
    # rows sorted by class, and a third of all rows equal
    sorted_rows = df.orderBy("y").unionByName(df.where("id = 0").select(F.explode(F.array_repeat(F.struct(*df.columns), 2000)).alias("r")).select("r.*"))
    pred = models.fit_predict(sorted_rows, test, feats, "y", "sgd_linear").toPandas()
    assert (pred.label == pred.prediction).mean() > 0.75


def test_losses_of_all_trials_equal_single_losses(spark):
    df, feats = frame(spark, 800)
    trials = {r["trial_id"]: r for r in models.run_trials(spark, df, df, feats, "y", n_trials=4, n_classes=3, seed=SEED).collect()}
    assert set(trials) == set(range(4))
    for t, m, p in models.draw_trials(4, SEED):
        if m == "sgd_linear":
            pred = models.fit_predict(df, df, feats, "y", m, p, 3)
            loss = models.macro_f1_loss(models.confusion(pred, 3)).first()["loss"]
            assert trials[t]["loss"] == pytest.approx(loss)


def test_draw_table_equals_the_draws(spark):
    sets = spark.createDataFrame([("x",), ("y",)], "dataset string")
    rows = models.draw_table(sets, 30).collect()
    want = {t: (m, {k: str(v) for k, v in p.items()}) for t, m, p in models.draw_trials(30)}
    assert len(rows) == 60 and all((r["model"], r["params"]) == want[r["trial_id"]] for r in rows)


def test_best_trial_of_every_data_set_is_refitted(spark):
    df, feats = frame(spark, 900)
    trials = spark.createDataFrame(
        [("p", 0, "tree", {"maxDepth": "3"}, -0.5), ("p", 1, "sgd_linear", {"loss": "log"}, -0.9),
         ("q", 2, "random_forest", {"numTrees": "5"}, -0.9), ("q", 3, "random_forest", {"numTrees": "12"}, -0.2)], models._TRIALS)
    sets = {"p": (12, 24, "y", df, df), "q": (24, 48, "y", df, df)}
    out = {r["dataset"]: r for r in models.refit_best(trials, sets, feats).collect()}
    assert (out["p"]["trial_id"], out["q"]["trial_id"]) == (1, 2) and out["p"]["auc"] > 0.8
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 900 for r in out.values()) and out["q"]["label_hour"] == 48
    only = models.refit_best(trials, sets, feats, min_estimators=10).collect()
    assert [(r["dataset"], r["trial_id"]) for r in only] == [("q", 3)]
