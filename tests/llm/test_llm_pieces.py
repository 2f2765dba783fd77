import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import no_documents, odd_documents
from wardspark.llm import bytesx, pieces


@pytest.fixture(scope="module")
def v():
    return pieces.load()


def coded(v, texts, n=4):
    raw, off = bytesx.column_bytes(pa.array(texts, pa.string()))
    out = [np.zeros(0, np.uint8)]
    at = [0]
    for i in range(len(texts)):
        t = raw[off[i]:off[i + 1]]
        out += [np.frombuffer(b" ", np.uint8), t] if len(t) else []
        at.append(sum(map(len, out)))
    return pieces.encode_slice(v, np.concatenate(out), np.array(at), n, {})


def brute(v, text):
    """Every segmentation of the lattice of a short text, best first."""
    lattice = pieces.edges(v, text)
    paths = {0: [(0.0, ())]}
    for e in range(1, len(text) + 1):
        paths[e] = [(x + s, ids + tuple(i)) for a, s, i in lattice[e] for x, ids in paths.get(a, [])]
    return sorted(paths[len(text)], key=lambda p: -p[0])


@pytest.mark.parametrize("text", ["the then", "a  b", "été", "x\ny", "日本𝕏", "▁ b", "aaaaaaa"])
def test_n_best_equal_all_segmentations(v, text):
    want = brute(v, b" " + text.encode())
    ids, at, score, more = coded(v, [text], 6)
    assert [score[0], *(m["score"] for m in more[0])] == pytest.approx([s for s, _ in want[:6]])
    assert pieces.n_best(v, b" " + text.encode(), 6)[0][0] == pytest.approx(want[0][0])
    allowed = {(round(s, 3), i) for s, i in want}
    seen = {tuple(ids.tolist())}
    for m in more[0]:
        x = ids.tolist()
        for e in sorted(m["edits"], key=lambda e: -e["first"]):
            x[e["first"]:e["first"] + e["count"]] = e["ids"]
        assert (round(m["score"], 3), tuple(x)) in allowed and tuple(x) not in seen
        seen.add(tuple(x))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_round_trip(v, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, at, _, _ = coded(v, texts)
    assert pieces.decode_ids(v, ids.astype(np.int64), at) == texts


def test_long_units_and_many_rows_agree_with_single_ones(v):
    texts = ["the quick brown fox", "x" * 3000, "", "über größe", "the quick brown fox " * 200]
    ids, at, score, more = coded(v, texts)
    for i, t in enumerate(texts):
        one = coded(v, [t])
        assert one[0].tolist() == ids[at[i]:at[i + 1]].tolist() and one[2][0] == pytest.approx(score[i])
        assert one[3][0] == more[i]


def test_walk_equals_viterbi(v):
    r = random.Random(5)
    signs = "日本語のテキスト処理は難しい。abcdefXYZ0123é𝕏😀"
    for n in (30, 70, 300):
        for letters in (signs, "x", "ab"):
            unit = np.frombuffer("".join(r.choice(letters) for _ in range(n)).encode(), np.uint8)
            best, second, _ = pieces.viterbi(v, unit[None, :])
            score, other, ids = pieces.walk(v, unit)
            assert score == best[-1, 0] and (other == second[-1, 0] or max(other, second[-1, 0]) < -1e17)
            assert b"".join(v.pieces[i] for i in ids.tolist()) == unit.tobytes()


def test_walked_and_padded_units_have_equal_results(v, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("日本語の処理、テキスト。") for _ in range(n)) + " end" for n in (40, 41, 90, 200)] + ["x" * 500]
    monkeypatch.setattr(pieces, "_BLOCK", 64)

    def run():
        data = np.frombuffer("".join(" " + t for t in texts).encode(), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in texts])])
        return pieces.encode_slice(v, data, off, 4, {})
    walked = run()
    monkeypatch.setattr(pieces, "_FEW", 0)
    padded = run()
    assert all(list(a) == list(b) for a, b in zip(walked[:2], padded[:2], strict=True))
    assert walked[2] == pytest.approx(padded[2]) and walked[3] == padded[3]


def test_a_megabyte_without_blanks_takes_seconds(v):
    import time
    r = random.Random(7)
    for letters in ("日本語のテキスト処理は難しい大学生活", "ABCDEFabcdef0123456789+/"):
        text = "".join(r.choice(letters) for _ in range(1_000_000 // len(letters[0].encode())))
        data = np.frombuffer((" " + text).encode(), np.uint8)
        begin = time.process_time()
        ids, at, _, more = pieces.encode_slice(v, data, np.array([0, len(data)]), 4, {})
        assert time.process_time() - begin < 60
        only = pieces.walk(v, data)[1] < -1e17  # no second segmentation: no character is part of a longer piece
        assert len(more[0]) == (0 if only else 3)
        assert pieces.decode_ids(v, ids.astype(np.int64), at) == [text]


def test_combine_equals_all_sums():
    lists = [[0.0, -1.0, -5.0], [-2.0, -2.5], [0.0, -0.25, -0.5, -9.0]]
    want = sorted((-sum(c) for c in itertools.product(*lists)))[:7]
    assert [-s for s, _ in pieces.combine(lists, 7)] == pytest.approx(want)


def test_table_and_back(spark, v):
    df = odd_documents(spark)
    out = pieces.encode(df, v, ["doc_id", "text"])
    rows = pieces.decode(out.withColumnRenamed("text", "was"), v, ["doc_id", "was"]).collect()
    assert len(rows) == 14 and all((r["was"] or "") == r["text"] for r in rows)
    empty = {r["doc_id"]: r for r in out.collect()}
    for i in (5, 6):
        assert empty[i]["ids"] == [] and empty[i]["score"] == 0 and empty[i]["alternatives"] == []
    assert pieces.encode(no_documents(spark), v, ["doc_id"]).count() == 0
    strange = spark.createDataFrame([(1, [5, -1, 10 ** 6, None, 0]), (2, None), (3, [])], "k long, ids array<int>")
    assert [r["text"] for r in pieces.decode(strange, v, ["k"]).orderBy("k").collect()] == ["\x02", "", ""]
