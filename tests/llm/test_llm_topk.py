import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.llm import topk


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
        good[i] = min(good.get(i, w), w)
    out = set()
    for q, v in good.items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in good.items() if i != q and len(c) == len(v))
            out |= {(q, n, i, -x) for n, (x, i) in enumerate(s[:k], 1)}
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "1 AS id", "2 AS v", "3 AS q", "4 AS score")
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **options).select(
        "query_id", "rank", "vec_id", "score").collect()}


def test_equal_to_brute_force_in_blocks(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.3, 16)], 0) for i in range(400)]
    assert run(spark, rows) == run(spark, rows, block=64, query_block=3) == brute([x[:2] for x in rows])


def test_odd_vectors(spark):
    same = [0.5] * 4
    rows = [(0, same, 1), (50, same, None), *((i, same, 1) for i in range(101, 160)), (1, None, 1), (2, [], 1),
            (3, [1.0, None, 0.0, 0.0], 1), (4, [float("nan")] * 4, 1), (5, [float("inf")] * 4, 1), (None, same, 1),
            (6, [0.1, 0.2], 1), (100, [-1.0, 2.0], 1), (7, [0.9, 0.9, 0.9, 0.9], 1), (7, [0.1] * 4, 1), (7, [0.9] * 4, 1)]
    assert run(spark, rows, block=16) == brute([x[:2] for x in rows])


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_the_index_stops_before_all_postings_and_stays_exact():
    r = np.random.default_rng(1)
    v = r.normal(0, 60, (2000, 8)).astype(np.int64)
    index = topk.ImpactIndex(v)
    fewer = 0
    for q in range(0, 2000, 100):
        ids, score = index.search(v[q], 5, q)
        truth = v @ v[q]
        truth[q] = -10 ** 12
        assert sorted(score)[-5:] == sorted(truth)[-5:] and q not in ids
        fewer += len(ids) < 1999
    assert fewer == 20


@pytest.mark.parametrize("scale", [1, 1e3, 1e5, 1e6, 1e7, 1e12])
def test_components_of_any_size_are_scored_exactly(scale):
    r = np.random.default_rng(7)
    v = np.floor(256 * np.float64((r.normal(0, 0.3, (1500, 24)) * scale).astype(np.float32))).astype(np.int64)
    index = topk.ImpactIndex(v)
    for q in range(0, 1500, 250):
        truth = sorted(((sum(int(a) * int(b) for a, b in zip(row, v[q])), -i) for i, row in enumerate(v) if i != q), reverse=True)[:5]
        if abs(truth[0][0]) >= 1 << 63:
            with pytest.raises(OverflowError):
                index.search(v[q], 5, q)
            continue
        ids, score = index.search(v[q], 5, q)
        got = sorted(((int(s), -int(i)) for i, s in zip(ids, score)), reverse=True)[:5]
        assert got == truth


def test_large_components_in_a_table(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 1e6, 8)], 0) for i in range(150)]
    assert run(spark, rows) == brute([x[:2] for x in rows])
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [*rows, (999, [3e38] * 8, 0)])
