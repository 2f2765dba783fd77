import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import no_documents, odd_documents, prose, write
from wardspark.llm import fingerprint as fp
from wardspark.llm import q_fingerprint


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = fp.with_anchors(df, F.col("text"), "a").select("i", "a", fp.sketch(F.col("a")).alias("s"))
    return {r["i"]: r for r in rows.collect()}


def test_anchors_are_closed_syncmers(spark):
    text = prose(1, 200)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    q = spark.createDataFrame([(words,)], "w array<string>")
    marks = "array(9223372036854775807L, 9223372036854775806L, 9223372036854775805L)"
    h = q.selectExpr(f"concat({marks}, transform(w, x -> xxhash64(x))) h").selectExpr(
        "transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1])) m").first()["m"]
    big = 9223372036854775807
    key = [big if i < 2 else x for i, x in enumerate(h)]
    want = [i for i in range(len(h) - 2) if not (key[i + 1] < key[i] and key[i + 1] < key[i + 2])]
    got = prints(spark, [text])[0]["a"]
    assert [a["pos"] for a in got] == want and 0.5 < len(want) / len(words) < 0.85


def test_choice_has_no_context(spark):
    a, b, c = prose(1, 100), prose(2, 50), prose(3, 80)
    got = prints(spark, [a + " " + b, c + " " + b])
    n = [len(x.split()) for x in (a, b, c)]
    tail = [{(x["pos"] - m, x["hash"]) for x in got[i]["a"] if x["pos"] >= m + 3} for i, m in ((0, n[0]), (1, n[2]))]
    assert tail[0] and tail[0] == tail[1]


def compared(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fp.with_anchors(fp.with_anchors(df, F.col("a"), "x"), F.col("b"), "y")
    return df.select("x", "y", fp.likeness(fp.sketch(F.col("x")), fp.sketch(F.col("y"))).alias("near"),
                     fp.matched(F.col("x"), F.col("y")).alias("share")).first()


def plain_matched(x, y):
    def links(s):
        s = [(a["hash"], a["pos"]) for a in s]
        return {(h, k, q - p) for (h, p), (k, q) in zip(s, s[1:], strict=False)} or {h for h, _ in s}
    return len(links(x) & links(y)) / len(links(x)) if x else 1.0


def test_texts_without_blanks_have_anchors_all_along(spark):
    import random
    r = random.Random(2)
    for signs in ("日本語のテキスト処理は難しい大学生活を始める", "ABCDEFabcdef0123456789+/", "สวัสดีชาวโลกภาษาไทย"):
        text, other = ("".join(r.choice(signs) for _ in range(600)) for _ in range(2))
        got = compared(spark, text, text[:300] + other[:300])
        assert len(got["x"]) > 300 and got["near"] > 0.2 and 0.4 < got["share"] < 0.6
        assert got["share"] == pytest.approx(plain_matched(got["x"], got["y"]))


def test_a_common_passage_of_long_texts_is_matched_by_position(spark):
    import random
    r = random.Random(3)
    a, b, shared = ([f"{r.choice('abcdefgh')}{r.randrange(10 ** 6)}" for _ in range(n)] for n in (20000, 20000, 40))
    long = compared(spark, " ".join(a[:9000] + shared + a[9000:]), " ".join(b[:15000] + shared + b[15000:]))
    assert long["share"] == pytest.approx(plain_matched(long["x"], long["y"])) and long["share"] * len(long["x"]) > 15
    turned = compared(spark, " ".join(shared), " ".join(shared[20:] + shared[:20]))
    assert turned["share"] == pytest.approx(plain_matched(turned["x"], turned["y"])) and 0.5 < turned["share"] < 1
    for x, y, want in (("", "", 1.0), (None, "a", 1.0), ("a", "", 0.0), ("a", "a", 1.0), ("a b", "a b", 1.0)):
        assert compared(spark, x, y)["share"] == want


def test_likeness_is_jaccard_for_short_texts(spark):
    texts = [prose(1, 90), prose(1, 90) + " tail of words", prose(7, 90), "", None, "one", "one"]
    got = prints(spark, texts)
    sets = {i: set(r["s"]) for i, r in got.items()}
    df = spark.createDataFrame([(i, j, list(got[i]["s"]), list(got[j]["s"])) for i in got for j in got],
                               "i int, j int, a array<int>, b array<int>")
    for r in df.select("i", "j", fp.likeness(F.col("a"), F.col("b")).alias("x")).collect():
        a, b = sets[r["i"]], sets[r["j"]]
        if len(a | b) <= fp.SIZE:
            assert r["x"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[3]["s"] == got[4]["s"] == [] and len(got[5]["s"]) == 1


def check(spark, folder, rows):
    got = {r["doc_id"]: r for r in q_fingerprint.op10_fingerprints(spark, folder).collect()}
    rows = sorted(rows)
    for i, (k, text) in enumerate(rows):
        text = text or ""
        after = (rows[(i + 1) % len(rows)][1] or "")
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if text == after:
            assert r["near_next"] == 1
    return got


def test_query_against_plain_python(spark, tmp_path):
    rows = [(i * 3, prose(i % 40, 3 + i % 90) + "é𝕏" * (i % 3)) for i in range(150)] + [(1000, None), (1001, ""), (1002, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = check(spark, write(spark, tmp_path / "a", documents=df), rows)
    assert got[0]["fingerprint"] == got[120 * 3]["fingerprint"] or rows[0][1] != rows[120][1]
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)


def test_odd_tables(spark, tmp_path):
    out = q_fingerprint.op10_fingerprints(spark, write(spark, tmp_path / "b", documents=no_documents(spark)))
    assert out.count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    r = q_fingerprint.op10_fingerprints(spark, write(spark, tmp_path / "c", documents=one)).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1
    odd = q_fingerprint.op10_fingerprints(spark, write(spark, tmp_path / "d", documents=odd_documents(spark)))
    rows = {}
    for r in odd.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {k: 1 + (k == 4) for k in (None, *range(1, 13))}
    assert rows[1][0]["near_next"] == 1 and rows[6][0]["fingerprint"] == ""
    text = prose(1, 60)  # the text of 1 and of 2
    assert rows[1][0]["edited_sha256"] == hashlib.sha256(
        (text[:len(text) - len(text) // 2] + text[:len(text) // 2]).encode()).hexdigest()
    p = odd._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p
