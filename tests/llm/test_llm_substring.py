import hashlib
import random
import re

import pytest

from tests.llm.cases import no_documents, odd_documents, prose
from wardspark.llm import substring


def brute(rows, window=20):
    """Rows in order of id, null first; equal ids by nothing but their place, so only for distinct ids."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, doc int, tie int, at int, n int")
    return sorted((tuple(r) for r in substring.repeats_removed(df, **options).collect()), key=str)


def cases(seed):
    r = random.Random(seed)
    passage, line = prose(seed, 60).split(), prose(seed + 1, 25).split()
    rows = []
    for i in range(60):
        w = [f"{r.randrange(400)}" for _ in range(r.randrange(0, 90))]
        for part in (passage[r.randrange(20):60 - r.randrange(20)], line, ["the"] * r.randrange(70)):
            if r.random() < 0.4:
                at = r.randrange(len(w) + 1)
                w[at:at] = part
        if r.random() < 0.2 and rows:  # an earlier text with one word changed
            w = rows[r.randrange(len(rows))][1].split()
            if w:
                w[r.randrange(len(w))] = "é日本"
        rows.append((i * 3 - 20, r.choice([" ", "\n", " \t"]).join(w)))
    return rows


@pytest.mark.parametrize("options", [{}, {"period": 7, "chunk": 50}, {"period": 1}, {"window": 3}, {"window": 1, "chunk": 1}])
def test_equal_to_brute_force(spark, options):
    rows = cases(5)
    assert run(spark, rows, **options) == brute(rows, options.get("window", 20))


def test_two_equal_windows_share_an_anchor_at_any_offset():
    for period in (1, 3, 7, 13, 21):
        cover = substring.difference_cover(period)
        for a in range(period):
            for b in range(period):
                assert any((a + s) % period in cover and (b + s) % period in cover for s in range(period))
    assert substring.difference_cover(13) == (0, 1, 3, 9) and substring.period_for(20) == 13
    assert [substring.period_for(w) for w in (1, 3, 8, 10, 50)] == [1, 1, 1, 3, 31]


def test_odd_documents(spark):
    df = odd_documents(spark)
    out = substring.repeats_removed(df).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    # the rows that repeat id and text: one stays, as the earlier
    once = [r for r in rows if r[0] != 4] + [next(r for r in rows if r[0] == 4)]
    later = (4, 80, 80, hashlib.sha256(b"").hexdigest(), "")
    assert sorted((tuple(r) for r in out), key=str) == sorted([*brute(once), later], key=str)
    assert substring.repeats_removed(no_documents(spark)).collect() == []


def test_rows_of_one_id_with_different_texts(spark):
    a, b = prose(1, 50), prose(2, 30)
    out = run(spark, [(1, a + " " + b), (1, b + " " + a), (2, b)])
    assert sorted(r[2] for r in out) == [0, 30, 80] and all(r[2] == 30 for r in out if r[0] == 2)


def test_one_text_of_one_word_and_very_common_passages(spark):
    line = prose(9, 22)
    rows = [(0, "word " * 5000), *((i, f"{prose(i, 10)} {line} {prose(i + 500, 10)}") for i in range(1, 300))]
    assert run(spark, rows, chunk=1000) == brute(rows)
