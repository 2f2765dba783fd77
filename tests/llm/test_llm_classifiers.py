import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import no_documents, odd_documents, prose
from wardspark.llm import bytesx, quality, toxicity

INSULTS = ("zorblax", "quimpf", "vlurgh")


def mixed_texts(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(seed * 10_000 + i, r.choice([8, 30, 120]))
        bad = i % 3 == 0
        if bad:
            w = text.split()
            w.insert(r.randrange(len(w)), r.choice(INSULTS) + r.choice(["", "er", "s"]))
            text = " ".join(w)
        rows.append((i, text, int(bad)))
    return rows


def plain_tokens(text):
    """Tokens as strings: words, and characters of unspaced scripts with the one after them."""
    parts = []
    for c in text.lower():
        o = ord(c)
        kind = 2 if 0x3040 <= o <= 0x9FFF or 0x1F000 <= o <= 0x1FAFF else int(c.isalnum())
        if kind == 1 and parts and parts[-1][0] == 1:
            parts[-1][1] += c
        else:
            parts.append([kind, c])
    return [p[1] + (parts[i + 1][1] if p[0] == 2 and i + 1 < len(parts) and parts[i + 1][0] == 2 else "")
            for i, p in enumerate(parts) if p[0]]


def test_tokens_equal_a_plain_loop():
    texts = ["Ab c", None, "", "é9, x!x", "  z", "Привет, ПРИВЕТ мир", "日本語、語。日本 ab日", "😀😀 ok", "a", "“a” – b…c"]
    data, off = toxicity.lowered(pa.array(texts))
    h, at = toxicity.tokens(data, off)
    want = [plain_tokens(t or "") for t in texts]
    assert list(np.diff(at)) == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    names = {}
    for x, w in zip(h.tolist(), flat, strict=True):
        assert names.setdefault(x, w) == w
    assert len(names) == len(set(flat))


def plain_model(texts):
    """Comparisons of words and pairs of (text, label), by the formulas written out."""
    from collections import Counter, defaultdict
    n = [Counter(), Counter()]
    for text, label in texts:
        w = plain_tokens(text)
        n[label].update(set(zip([None, *w], w, strict=False)))
    before = [defaultdict(set), defaultdict(set)]
    for label in (0, 1):
        for a, b in n[label]:
            before[label][b].add(a)
    vocabulary = before[0].keys() | before[1].keys()
    c = [{b: len(before[label][b]) for b in vocabulary} for label in (0, 1)]
    both = {b: len(before[0][b] | before[1][b]) for b in vocabulary}
    own = [{b: max(c[label][b] - 1.5, 0) for b in vocabulary} for label in (0, 1)]
    kept = sum(sum(o.values()) for o in own) / sum(sum(x.values()) for x in c)
    p = [{b: kept * own[label][b] / sum(own[label].values()) + (1 - kept) * both[b] / sum(both.values())
          for b in vocabulary} for label in (0, 1)]
    out = {b: np.log(p[1][b]) - np.log(p[0][b]) for b in vocabulary}
    for a, b in n[0].keys() | n[1].keys():
        if a is None or max(n[0][a, b], n[1][a, b]) < 3:
            continue
        begun = sum(v for label in (0, 1) for (x, _), v in n[label].items() if x == a)
        held = [sum(max(v - 2.5, 0) for (x, _), v in n[label].items() if x == a) for label in (0, 1)]
        mine = [max(n[label][a, b] - 2.5, 0) for label in (0, 1)]
        share = sum(held) / begun
        q = [share * (mine[i] / held[i] if held[i] else sum(mine) / sum(held)) + (1 - share) * p[i][b] for i in (0, 1)]
        out[a, b] = np.log(q[1]) - np.log(q[0]) - out[b]
    return out, p


def test_comparisons_equal_the_formulas(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_PAIRS", 300)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(r.randrange(12))), i % 3 // 2)
            for i in range(90)]
    rows += rows[:7]
    texts = sorted({(t, y) for _, t, y in rows})
    want, p = plain_model(texts)
    assert all(sum(x.values()) == pytest.approx(1) for x in p)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    got = {r["key"]: r["v2"] for r in toxicity.compare(toxicity.counts(toxicity.distinct_texts(df, "toxic", "text"))).collect()}

    def key(x):
        data, off = toxicity.lowered(pa.array([x if isinstance(x, str) else " ".join(x)]))
        h, _ = toxicity.tokens(data, off)
        return int((h if len(h) == 1 else toxicity.pair_keys(h[:1], h[1:])).view(np.int64)[0])
    want = {key(x): v for x, v in want.items()}
    assert got.keys() <= want.keys() and any(isinstance(x, int) for x in got)
    for k, v in want.items():
        assert got.get(k, 0) == pytest.approx(v) or abs(v) < toxicity.LEAST, k


def test_highest_runs_equal_a_plain_loop():
    r = np.random.default_rng(3)
    at = np.array([0, 0, 1, 30, 30, 90])
    value = r.normal(size=90)
    got = toxicity._highest(value, at, (1, 4))
    for i in range(5):
        v = value[at[i]:at[i + 1]]
        assert got[i, 0] == pytest.approx(v.mean() if len(v) else 0)
        for j, w in enumerate((1, 4)):
            runs = [v[s:s + w].sum() / w for s in range(len(v))]
            tops = []
            while len(tops) < 3:
                best = max(range(len(runs)), key=runs.__getitem__, default=None)
                if best is None or runs[best] <= 0:
                    tops.append(0)
                    continue
                tops.append(runs[best])
                for s in range(max(0, best - w + 1), min(len(runs), best + w)):
                    runs[s] = -99
            assert got[i, 1 + 3 * j:4 + 3 * j] == pytest.approx(tops), (i, w)


def scripts(n, seed):
    """Texts of Cyrillic, Greek and Japanese words; the toxic ones hold one of a few words of their script."""
    r = random.Random(seed)
    words = ("дом река поле утро вечер книга стол окно".split(), "σπιτι νερο βουνο μερα νυχτα βιβλιο".split(),
             "山川 空海 花 鳥 風 月 雪 星".split())
    bad = ("дурак", "ηλιθιε", "馬鹿野郎")
    rows = []
    for i in range(n):
        s = i % 3
        w = [r.choice(words[s]) for _ in range(r.choice([5, 20]))]
        if i % 4 == 0:
            w.insert(r.randrange(len(w)), bad[s] if r.random() < .5 else bad[s].upper())
        rows.append((i, ("" if s == 2 else " ").join(w), int(i % 4 == 0)))
    return rows


def test_toxicity_of_other_scripts(spark):
    cols = "doc_id long, text string, toxic int"
    model = toxicity.learn(spark.createDataFrame(scripts(400, 1), cols))
    got = toxicity.score(spark.createDataFrame(scripts(200, 2), cols), model, ["toxic"]).collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in got)


def test_a_model_too_large_to_broadcast_is_joined(spark, monkeypatch):
    cols = "doc_id long, text string, toxic int"
    train = spark.createDataFrame(mixed_texts(300), cols)
    docs = odd_documents(spark).drop("score", "features").select("doc_id", "text").union(
        spark.createDataFrame(mixed_texts(100, 1), cols).select("doc_id", "text"))

    def scores(model):
        return sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in toxicity.score(docs, model, ["doc_id"]).collect())
    want = scores(toxicity.learn(train))
    monkeypatch.setattr(toxicity, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 20_000)
    model = toxicity.learn(train)
    assert not isinstance(model.table.entries, tuple)
    assert scores(model) == want


def test_copies_do_not_take_the_bounded_rows(spark):
    cols = "doc_id long, text string, toxic int"
    rows = mixed_texts(200)
    rows += [(1000 + i, rows[1][1], 0) for i in range(400)]
    texts = toxicity.distinct_texts(spark.createDataFrame(rows, cols), "toxic", "text")
    found = toxicity.drawn(texts, 50).collect()
    assert texts.count() == 200 and len(found) == 50 == len({r["text"] for r in found})
    assert sum(r["n"] for r in texts.collect()) == 600
    assert toxicity.drawn(texts, 1000).count() == 200
    test = spark.createDataFrame(mixed_texts(150, 1), cols)

    def right(train):
        model = toxicity.learn(spark.createDataFrame(train, cols), max_fit=120)
        got = toxicity.score(test, model, ["toxic"]).collect()
        return np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in got])
    with_copies, without = right(rows), right(rows[:200])
    assert with_copies >= without - 0.02 and without > 0.9, (with_copies, without)


def test_toxicity_on_held_out_texts(spark):
    cols = "doc_id long, text string, toxic int"
    model = toxicity.learn(spark.createDataFrame(mixed_texts(600), cols))
    got = toxicity.score(spark.createDataFrame(mixed_texts(150, 1), cols), model, ["toxic"]).collect()
    right = np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in got])
    assert right > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = toxicity.score(odd_documents(spark).drop("score", "features"), model, ["doc_id"]).collect()
    assert len(odd) == 14 and all(0 <= r["score"] <= 1 for r in odd)
    by = {r["doc_id"]: r["score"] for r in odd}
    assert by[5] == by[6] and by[1] == by[2]


def test_toxicity_without_one_class(spark):
    cols = "doc_id long, text string, toxic int"
    docs = odd_documents(spark)
    for rows, want in (([], 0.0), ([(1, "a b", 0)], 0.0), ([(1, "a b", 1), (2, None, None)], 1.0)):
        model = toxicity.learn(spark.createDataFrame(rows, cols))
        assert {r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {want}
    assert toxicity.score(no_documents(spark), model, ["doc_id"]).count() == 0


def quality_rows(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(seed * 10_000 + i, r.choice([20, 60]))
        if i % 4 == 0:
            w = text.split()
            text = r.choice([" ".join(x for x in w[:6] for _ in range(8)), " | ".join(w), " ".join(x + "$$$" for x in w)])
        rows.append((i, text, int(i % 4 != 0)))
    return rows


def test_words_and_their_vectors(spark):
    texts = ["A b, b", None, "x"]
    data, off = bytesx.column_bytes(pa.array(texts))
    w, at = quality.words(data, off)
    assert list(np.diff(at)) == [4, 0, 1] and w[1] == w[3]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = quality.word_vectors(df)
    place, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for i in range(4):
        for j in range(4):
            if i != j and abs(i - j) <= 2:
                want[w[i], place[w[j]]] += sign[w[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert got == pytest.approx(want, abs=1e-6)


def test_quality_on_held_out_texts(spark):
    cols = "doc_id long, text string, quality int"
    train, test = (spark.createDataFrame(quality_rows(n, s), cols) for n, s in ((500, 0), (120, 1)))
    model = quality.learn(train, train)
    got = quality.score(test, model, ["quality"]).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in got]) > 0.95
    odd = {r["doc_id"]: r["score"] for r in quality.score(odd_documents(spark).drop("score"), model, ["doc_id"]).collect()}
    assert len(odd) == 13 and all(0 <= x <= 1 for x in odd.values()) and odd[5] == odd[6] and odd[1] == odd[2]
    again = {r["quality"]: r["score"] for r in quality.score(test.limit(1), quality.learn(train.repartition(5), train), ["quality"]).collect()}
    assert list(again.values())[0] == pytest.approx(quality.score(test.limit(1), model, ["quality"]).first()["score"])


def test_copies_do_not_outweigh_other_texts_in_the_network(spark):
    cols = "doc_id long, text string, quality int"
    rows = quality_rows(400)
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(800)]
    test = spark.createDataFrame(quality_rows(120, 1), cols)

    def right(rows):
        train = spark.createDataFrame(rows, cols)
        got = quality.score(test, quality.learn(train, train, max_fit=300), ["quality"]).collect()
        return np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in got])
    with_copies, without = right(rows), right(rows[:400])
    assert with_copies >= without - 0.03, (with_copies, without)


def test_quality_without_one_class(spark):
    cols = "doc_id long, text string, quality int"
    docs = odd_documents(spark)
    for rows, want in (([], 0.0), ([(1, "a b", 1)], 1.0), ([(1, "a", 0), (2, "b", None)], 0.0)):
        model = quality.learn(docs, spark.createDataFrame(rows, cols))
        assert {r["score"] for r in quality.score(docs.drop("score"), model, ["doc_id"]).collect()} == {want}
    empty = no_documents(spark)
    assert quality.score(empty, quality.learn(empty, spark.createDataFrame([], cols)), ["doc_id"]).count() == 0


def test_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 5))
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.fit(x, y, epochs=15)
    p = net.probability(r.normal(size=(4000, 5)))
    z = r.normal(size=(4000, 5))
    p, truth = net.probability(z), 1 / (1 + np.exp(-2 * z[:, 0]))
    assert abs(p.mean() - truth.mean()) < 0.03 and np.abs(p - truth).mean() < 0.08
