import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardspark import session
from wardspark.operators import models, prep, score


def test_chi2_tail():
    assert prep.chi2_sf(7.8147, 3) == pytest.approx(0.05, abs=1e-5)
    assert prep.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert prep.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)


def test_split_fractions_and_disjointness(spark):
    ids = spark.range(1000).select(F.col("id").alias("subject_id"), (F.col("id") * 7).alias("hadm_id"))
    s = prep.split_visits(ids, seed=3).groupBy("split").count().collect()
    counts = {r.split: r["count"] for r in s}
    assert counts == {"test": 200, "valid": 200, "devel": 600}
    assert prep.split_visits(ids, seed=3).select("subject_id", "hadm_id").distinct().count() == 1000


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "g string, v double")
    r = {row.v: row.rank for row in prep.average_ranks(df, ["g"], "v").collect()}
    assert r == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_kruskal_against_direct_formula(spark):
    rnd = random.Random(1)
    rows = [(c, float(rnd.randint(0, 20) + c)) for c in range(4) for _ in range(25)]
    df = spark.createDataFrame(rows, "y int, x double")
    h = prep.kruskal_h(df, ["x"], "y").first()
    # direct computation
    allv = sorted(v for _, v in rows)
    rank = {}
    i = 0
    while i < len(allv):
        j = i
        while j < len(allv) and allv[j] == allv[i]:
            j += 1
        rank[allv[i]] = (i + 1 + j) / 2
        i = j
    n = len(rows)
    S = sum(sum(rank[v] for c2, v in rows if c2 == c) ** 2 / 25 for c in range(4))
    H = 12 / (n * (n + 1)) * S - 3 * (n + 1)
    from collections import Counter
    ties = sum(t ** 3 - t for t in Counter(allv).values())
    H /= 1 - ties / (n ** 3 - n)
    assert h.h == pytest.approx(H) and h.dof == 3
    const = spark.createDataFrame([(c, 1.0) for c in range(4) for _ in range(3)], "y int, x double")
    kept, stats = prep.kruskal_select(const, ["x"], "y")
    assert stats[0][3] == 0.0 and kept == []


def test_vif_orthogonal_is_one(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)], "a double, b double")
    kept, vifs = prep.vif_eliminate(df, ["a", "b"])
    assert kept == ["a", "b"] and vifs["a"] == pytest.approx(1.0) and vifs["b"] == pytest.approx(1.0)
    col = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.1, 0.0), (3.0, 6.0, 1.0)], "a double, b double, c double")
    kept, _ = prep.vif_eliminate(col, ["a", "b", "c"])
    assert len(kept) < 3


def test_resample_brings_classes_up(spark):
    rows = []
    for i in range(60):
        rows.append((i, i, f"{i}", "devel", float(i), i % 4))
    for i in range(60, 100):
        rows.append((i, i, f"{i}", "test", float(i), 0 if i < 95 else 1))
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, rid string, split string, x double, y int")
    out = prep.resample_to_reference(df, ["x"], "y", ["y"], subsets=("test",))
    syn = out.where(F.col("subject_id") == 99999)
    # class 1: 5 of 40 test rows (share 0.125) vs 0.25 in devel -> ratio 0.5 -> ceil(0.5 * 5) = 3 new rows;
    # classes 2 and 3 have no test rows, so nothing can be drawn for them
    assert syn.where("y = 1").count() == 3 and syn.count() == 3
    assert syn.agg(F.min("x"), F.max("x")).first()[0] >= 95


def test_auc_constant_and_perfect(spark):
    const = spark.createDataFrame([(0, 0, 0.5, 0.5), (1, 1, 0.5, 0.5), (1, 0, 0.5, 0.5), (0, 1, 0.5, 0.5)],
                                  "label int, prediction int, score_0 double, score_1 double")
    a = {r["class"]: r.auc for r in score.roc_auc(const, 2).collect()}
    assert a == {0: 0.5, 1: 0.5}
    perfect = spark.createDataFrame([(0, 0, 0.9, 0.1), (1, 1, 0.2, 0.8), (1, 1, 0.3, 0.7), (0, 0, 0.8, 0.2)],
                                    "label int, prediction int, score_0 double, score_1 double")
    assert {r["class"]: r.auc for r in score.roc_auc(perfect, 2).collect()} == {0: 1.0, 1: 1.0}


def test_confusion_invariant(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 3)) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    c = score.confusion(df, 4).collect()
    assert all(r.tp + r.fp + r.tn + r.fn == 200 for r in c)
    assert sum(r.tp for r in c) == sum(1 for y, p in rows if y == p)


def test_exclusive_prefix_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 2), rnd.randint(0, 50), float(rnd.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, o long, v double")
    got = prep.exclusive_prefix_sums(df, ["g"], "o", ["v"], width=7).collect()
    for r in got:
        want = sum(v for g, o, v in rows if g == r.g and o < r.o)
        assert r.pre_v == pytest.approx(want)
    assert len(got) == 300


def test_positions_exact_with_few_and_many_buckets(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("g"), prep.hash32("id").alias("h"))
    for b in (1, 7, 4096):
        p = prep.positions(df, ["g"], "h", ["id"], buckets=b).collect()
        for g in range(3):
            rows = sorted((r.h, r.id, r.pos) for r in p if r.g == g)
            assert [x[2] for x in rows] == list(range(len(rows)))


def test_ranks_with_an_outlier_stay_balanced_and_exact(spark):
    rows = [(float(i % 1500) / 7,) for i in range(3000)] + [(1e12,), (float("inf"),), (float("-inf"),), (None,), (float("nan"),)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, v double")
    one = {str(r.v): (r.rank, r.cnt) for r in prep.average_ranks(df, ["g"], "v", buckets=1).collect()}
    many = {str(r.v): (r.rank, r.cnt) for r in prep.average_ranks(df, ["g"], "v", buckets=16).collect()}
    assert one == many and len(one) == 1504
    assert one["-inf"][0] == 1 and one["nan"][0] == 3004 and one["inf"][0] == 3003
    cuts = df.where("v is not null").select("g", "v").distinct().groupBy("g").agg(
        F.percentile_approx("v", [i / 16 for i in range(1, 16)], 320).alias("c")).first()["c"]
    values = sorted({r[0] for r in rows if r[0] is not None and r[0] == r[0]})
    import bisect
    sizes = [0] * 16
    for v in values:
        sizes[bisect.bisect_left(cuts, v)] += 1
    assert max(sizes) < 2 * len(values) / 16


def test_auc_with_unordered_scores_is_null_and_labels_missing_are_left_out(spark):
    schema = "label int, prediction int, score_0 double, score_1 double"
    df = spark.createDataFrame([(0, 0, None, 0.1), (1, 1, 0.2, 0.8), (1, 0, 0.4, 0.7), (None, 0, 0.4, float("nan"))], schema)
    assert {r["class"]: r.auc for r in score.roc_auc(df, 2).collect()} == {0: None, 1: 1.0}
    nan = spark.createDataFrame([(0, 0, 0.9, float("nan")), (1, 1, 0.2, 0.8)], schema)
    assert {r["class"]: r.auc for r in score.roc_auc(nan, 2).collect()} == {0: 1.0, 1: None}


def test_kruskal_with_an_absent_class_drops_the_feature(spark):
    df = spark.createDataFrame([(c, float(i), float(i) if c < 3 else None) for c in range(4) for i in range(5)],
                               "y int, x double, z double")
    for keep in ("p_above", "p_below"):
        kept, stats = prep.kruskal_select(df, ["x", "z"], "y", keep=keep)
        assert "z" not in kept and dict((s[0], s[3]) for s in stats)["z"] is None
        assert ("x" in kept) == (keep == "p_above")
    const = spark.createDataFrame([(c, 1.0) for c in range(4) for _ in range(3)], "y int, x double")
    assert prep.kruskal_select(const, ["x"], "y", keep="p_below")[0] == []
    assert prep.kruskal_select(df, [], "y") == ([], [])


@pytest.mark.parametrize("drop", ["largest", "all"])
def test_vif_names_what_stays(spark, drop):
    rnd = random.Random(2)
    a, b = [rnd.gauss(0, 1) for _ in range(200)], [rnd.gauss(0, 1) for _ in range(200)]
    rows = [(x, y, y, 0.0) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, c double, z double")
    kept, vifs = prep.vif_eliminate(df, ["a", "b", "c"], drop=drop)
    assert kept == (["a", "b"] if drop == "largest" else ["a"])
    assert vifs["a"] == pytest.approx(1, abs=0.1)
    assert prep.vif_eliminate(df, ["a", "b", "z"], drop=drop)[0] == ["a", "b"]
    assert prep.vif_eliminate(df, ["z"], drop=drop) == ([], {})
    assert prep.vif_eliminate(df, [], drop=drop) == ([], {})


def test_vif_equals_least_squares(spark):
    import numpy as np
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 5))
    x[:, 4] = x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.normal(size=300)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double, e double")
    _, vifs = prep.vif_eliminate(df, list("abcde"), max_vif=float("inf"))
    for i, n in enumerate("abcde"):
        others = np.delete(x, i, 1)
        rest = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        assert vifs[n] == pytest.approx((x[:, i] ** 2).sum() / (rest ** 2).sum(), rel=1e-6)


def test_synthetic_rows_expand_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prep, "SYNTHETIC_BLOCK", 3)
    rows = [(i, i, f"{i}", "devel" if i < 40 else "test", float(i), i % 2 if i < 40 else int(i >= 90)) for i in range(140)]
    rows = [r if not (r[3] == "test" and r[5] == 1 and r[0] >= 110) else (*r[:5], 0) for r in rows]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, rid string, split string, x double, y int")
    syn = prep.resample_to_reference(df, ["x"], "y", ["y"], subsets=("test",)).where("subject_id = 99999")
    # class 1: 20 of 100 test rows against a half of devel: ceil(0.6 * 20) = 12 new rows, in four blocks
    ids = sorted(r.rid for r in syn.collect())
    assert len(ids) == len(set(ids)) == 12 and all(f"|{n}" in "".join(i[-3:] for i in ids) for n in (1, 12))


def test_draws_use_sixty_bits(spark):
    r = spark.range(200).select(prep.hash60("id").alias("h")).agg(F.max("h"), F.min("h")).first()
    assert r[0] > 1 << 58 and r[0] < 1 << 60 and r[1] >= 0


def test_knn_is_exact_with_cells_and_parts(spark):
    import numpy as np

    from wardspark.operators import models
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(c * 4, 1, (60, 3)) for c in range(4)] + [np.zeros((40, 3))])
    df = spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(v)], "id long, vec array<double>, label int")
    for p in (1.0, 2.0):
        got = {}
        for row in models.knn_neighbors(df.where("id % 4 != 0"), df.where("id % 4 = 0"), k=4, p=p, rows_per_part=16).collect():
            got.setdefault(row.test_id, []).append((row.rank, row.train_id))
        train = [i for i in range(len(v)) if i % 4]
        for i in range(0, len(v), 4):
            d = (np.abs(v[train] - v[i]) ** p).sum(1)
            want = [train[j] for j in np.lexsort((train, d))[:4]]
            assert [t for _, t in sorted(got[i])] == want
    assert models.knn_neighbors(df.where("false"), df, k=2).count() == 0


def test_nearest_gives_only_rows_within_the_bound_and_estimates_lose_none():
    r = np.random.default_rng(3)
    for p in (1.0, 2.0, 3.0):
        vec = np.round(r.normal(size=(240, 4)) * 2, 0 if p == 1 else 2)
        vec[-1] = vec[-2]
        exact = (np.abs(vec[:40, None] - vec[None, 40:]) ** p).sum(-1) ** (1 / p)
        bound = np.sort(exact, 1)[:, 2]
        want = {(i, 40 + j) for i in range(40) for j in sorted(range(200), key=lambda j, i=i: (exact[i, j], j))[:5]
                if exact[i, j] <= bound[i] + 1e-9}
        t = pa.table({"id": pa.array(range(240)), "vec": pa.array(vec.tolist(), pa.list_(pa.float64())),
                      "label": pa.array([0] * 240), "is_test": pa.array([i < 40 for i in range(240)]),
                      "bound": pa.array([*bound, *[None] * 200], pa.float64())})
        found = models._nearest(t, 5, p)
        assert set(zip(found["test_id"].to_pylist(), found["train_id"].to_pylist(), strict=True)) == want
        row, _ = models._candidates(vec[:40], vec[40:], np.full(40, np.inf), 5, p)
        assert len(row) < 40 * 100


def test_split_never_broadcasts_the_wide_table(spark, monkeypatch):
    wide = session.materialize(spark.range(500).selectExpr("id % 50 AS subject_id", "id % 50 AS hadm_id", *[
        f"CAST(null AS double) AS x{i}" for i in range(60)]), "wide")
    splits = prep.split_visits(wide.select("subject_id", "hadm_id"))

    def plan():
        out = prep.apply_split(wide, splits)
        assert out.count() == 500 and {r["split"] for r in out.select("split").collect()} == set(prep.SPLITS)
        return out._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in (p := plan()) and "BuildLeft" not in p
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    assert "SortMergeJoin" in (p := plan()) and "Broadcast" not in p


def test_distance_vote_reads_the_neighbours_once(spark):
    near = session.materialize(spark.createDataFrame(
        [(1, 5, 0.0, 2), (1, 6, 0.1, 1), (1, 7, 0.1, 1), (2, 5, 0.5, 0), (2, 6, 0.2, 1), (None, 5, 0.5, 0)],
        "test_id long, train_id long, dist double, label long"), "near")
    vote = models.knn_vote(near, "distance")
    assert {r["test_id"]: r["prediction"] for r in vote.collect()} == {1: 2, 2: 1}
    assert vote._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def _separable(spark):
    return spark.createDataFrame([(float(i % 7), float(i % 3), i % 3) for i in range(90)], "a double, b double, y int")


def test_one_vs_rest_predicts_without_python_rows(spark):
    """Scores are compared by expressions, with the classes of the model's own transform."""
    from wardspark.operators import models
    data = _separable(spark)
    table = models.assembled(data, ["a", "b"], "y")
    for name in ("tree", "logistic"):
        model = models._fit(table, ["a", "b"], name, None, 3)
        pred = models._predict(model, table, "y", keep=["a", "b"])
        assert "EvalPython" not in pred._jdf.queryExecution().executedPlan().toString()
        own = [int(r["_p"]) for r in model.transform(table).orderBy("a", "b").select("_p").collect()]
        assert [r.prediction for r in pred.orderBy("a", "b").collect()] == own


def test_classifier_set_scores_its_predictions_once(spark, monkeypatch):
    from wardspark.operators import models
    made, plain = [], models._predict
    monkeypatch.setattr(models, "_predict", lambda *a, **k: made.append(1) or plain(*a, **k))
    data = _separable(spark)
    [(name, f1, accuracy)] = models.evaluate_models(data, data, ["a", "b"], "y", names=["tree"], n_classes=3)
    assert (name, f1, accuracy) == ("tree", 1.0, 1.0) and len(made) == 1


def test_equal_draws_are_fitted_once(spark, monkeypatch):
    """A setting that is drawn again takes the loss of its first fit; each trial has its row."""
    from wardspark.operators import models
    made, plain = [], models.classifier
    monkeypatch.setattr(models, "classifier", lambda *a, **k: made.append(a[0]) or plain(*a, **k))
    trials = [(0, "tree", {"maxDepth": 3}), (1, "tree", {"maxDepth": 5}), (2, "tree", {"maxDepth": 3})]
    data = _separable(spark)
    rows = models._losses([("d", data, data, "y", trials)], ["a", "b"], 3)
    assert [r[1] for r in rows] == [0, 1, 2] and rows[0][4] == rows[2][4] and len(made) == 2
