import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import no_documents, odd_documents
from wardspark.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    docs = [((lang or ""), (source or ""), [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
            for text, lang, source in rows]
    df, total, group = Counter(), Counter(), {}
    for lang, source, terms in docs:
        df.update((lang, t) for t in set(terms))
        group.setdefault((lang, source), Counter()).update(terms)
        total.update((lang, t) for t in terms)
    out = []
    for lang in {g[0] for g in group}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        p = {}
        for name, count in [*((s, c) for (x, s), c in group.items() if x == lang), (None, Counter({t: total[lang, t] for t in kept}))]:
            n = sum(count[t] for t in kept)
            p[name] = {t: 1 + 10 ** 9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for source in p.keys() - {None}:
            own = p[source]
            terms = [(t, f(own[t], p[None][t])) for t in kept if group[lang, source][t] and own[t] > p[None][t]]
            pairs = [(s, sum(f(own[t], p[s][t]) for t in kept)) for s in p if s is not None and s != source]
            for part, items, most in (("term", terms, top), ("pair", pairs, len(pairs))):
                items.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, source, part, item, v, i) for i, (item, v) in enumerate(items[:most], 1)]
    return sorted(out)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocabulary = [r.choice("abcXYZéß日") + "".join(r.choice("abcdÀ") for _ in range(r.randrange(1, 4))) for _ in range(150)]
    rows = []
    for _ in range(n):
        source = f"s{min(int(r.expovariate(0.25)), 30):02d}"
        own = vocabulary[int(source[1:]) % 5 * 20:][:60]
        rows.append((r.choice([" ", "1", "-"]).join(r.choice(own) for _ in range(r.randrange(30))), r.choice(["en", "de"]), source))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, n int, p0 int, term string")
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"side": 8, "stripe": 16}, {"side": 16, "stripe": 50, "least": 3, "top": 2}])
def test_equal_to_brute_force(spark, options):
    rows = corpus(3)
    assert run(spark, rows, **options) == brute(rows, options.get("least", 10), options.get("top", 10))


def test_odd_documents(spark):
    df = odd_documents(spark)
    got = sorted(tuple(r) for r in divergence.audit(df, least=2).collect())
    assert got == brute([(r["text"], r["lang"], r["source"]) for r in df.collect()], least=2)
    none = sorted(tuple(r) for r in divergence.audit(df).collect())  # no term is in ten documents
    assert none == brute([(r["text"], r["lang"], r["source"]) for r in df.collect()]) and {r[4] for r in none} == {0}
    assert divergence.audit(no_documents(spark)).collect() == []


def test_joint_traversal_visits_only_what_one_side_holds():
    r = np.random.default_rng(0)
    side, n_cols = 32, 75
    zero_a, zero_b = r.integers(1, 50, side), r.integers(1, 50, side)
    a, b = np.repeat(zero_a[:, None], n_cols, 1), np.repeat(zero_b[:, None], n_cols, 1)
    forests = []
    for dense, zero in ((a, zero_a), (b, zero_b)):
        row, col = r.integers(0, 9, 40), r.integers(0, n_cols, 40)
        cell = np.unique(row * n_cols + col)
        row, col = cell // n_cols, cell % n_cols
        value = r.integers(100, 10 ** 9, len(cell))
        dense[row, col] = value
        forests.append(divergence.K2Forest(side, row, col, value, zero, n_cols))
    sums, terms = divergence.joint_differences(*forests, own=False)
    d = a[:, None, :] - b[None, :, :]
    f = d * d // (a[:, None, :] + b[None, :, :])
    unseen = d[:, :, 0] * 0 + (zero_a[:, None] - zero_b[None, :]) ** 2 // (zero_a[:, None] + zero_b[None, :])
    assert np.array_equal(sums + (n_cols - terms) * unseen, f.sum(2))
    assert terms[16:, 16:].max() == 0 and terms[:9, :9].max() <= n_cols


def test_weights_beyond_64_bits(spark):
    df = spark.createDataFrame([(5 * 10 ** 12, 9 * 10 ** 12, 10 ** 11)], "c long, n long, v long")
    from pyspark.sql import functions as F
    got = df.select(divergence.weight(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10 ** 9 * (5 * 10 ** 12 + 2) // (9 * 10 ** 12 + 2 * 10 ** 11)
