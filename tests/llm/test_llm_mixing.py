import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import no_documents, odd_documents, prose
from wardspark.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(sizes), {}
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        free -= over


def test_targets_sizes_and_words_taken(spark):
    rows = [(i, prose(i, 5 + i * 7 % 300), "en", f"s{i % 4}" if i % 9 else "tiny", 0) for i in range(1, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    text = {r[0]: r[1] for r in rows}
    sizes, taken = {}, {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.03)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7), chunk=100_000).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}


def test_rates_are_exponential_in_size_and_capped_sources_take_all(spark):
    rows = [(i, "w " * (i + 1), "a", 0) for i in range(60)] + [(100, "w", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert out[100]["target"] == 3 and out[100]["copies"] == 3
    import math
    steps = [math.log(out[i + 1]["rate"]) - math.log(out[i]["rate"]) for i in range(59) if out[i + 1]["rate"] < 3]
    assert max(steps) - min(steps) < 1e-9


def test_chunks_of_a_hot_size(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    out = mixing.mix(df, chunk=100).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"))
    for r in out.collect():
        assert r["t"] == pytest.approx(r["g"], abs=6)


def test_odd_rows(spark):
    df = odd_documents(spark)
    out = mixing.mix(df).collect()
    assert len(out) == 14 and all(r["copies"] <= 3 for r in out)
    assert all(r["taken"] == 0 for r in out if r["doc_id"] in (5, 6, 7))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.where("doc_id = 9").count() <= 3
    assert mixing.mix(no_documents(spark)).count() == 0 and mixing.mixed(no_documents(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    p = mixing.mix(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p and "CartesianProduct" not in p
