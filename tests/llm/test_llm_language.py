import random

import numpy as np
import pyarrow as pa

from tests.llm.cases import no_documents, odd_documents, prose
from wardspark.llm import bytesx, language


def test_grams_equal_a_plain_loop():
    texts = ["Ab, c", None, "", "ÉA  9x!", "a"]
    data, off = bytesx.column_bytes(pa.array(texts))
    g, at = language.grams(data, off)
    for i, t in enumerate(texts):
        low = (t or "").encode()
        out, gap = bytearray(b"  "), True
        s = (t or "").lower().encode()
        for j, c in enumerate(s):
            letter = chr(low[j]).isalpha() and low[j] < 128 or low[j] >= 128
            if letter:
                out.append(c)
            elif not gap:
                out.append(32)
            gap = not letter
        out += b"  "
        want = [int.from_bytes(out[k:k + 4], "little") for k in range(len(out) - 3)]
        assert list(g[at[i]:at[i + 1]]) == want, t


def test_filters_hold_every_gram_kept_and_masks_are_sets(spark):
    df = spark.createDataFrame([(prose(i, 40, x), x) for i in range(20) for x in ("en", "de")], "text string, lang string")
    f = language.learn(df, min_count=1, keep_ratio=0.0)
    assert f.languages == ["de", "en"] and (f.filled > 0).all()
    data, off = bytesx.column_bytes(pa.array([prose(0, 40, "de")]))
    g, _ = language.grams(data, off)
    mask = np.full(len(g), 255, np.uint8)
    for j in range(f.hashes):
        mask &= f.words[0][language.positions(g, len(f.words[0]), j)]
    assert (mask & 1 == 1).all()


def test_held_out_accuracy_and_odd_rows(spark):
    df = spark.createDataFrame([(i, prose(i, 30, x), x) for i in range(40) for x in ("en", "de")],
                               "doc_id long, text string, lang string")
    f = language.learn(df.where("doc_id < 30"))
    got = language.identify(df.where("doc_id >= 30"), f, keep=["lang"]).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language.identify(odd_documents(spark), f, keep=["doc_id"]).collect()}
    for i in (5, 6, 7, 10):
        assert odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0
    assert odd[1]["lang_pred"] == "en" and odd[4]["lang_pred"] == "de" and odd[12]["lang_pred"] in ("en", "de")


def test_stage_keeps_clean_rows_and_all_columns(spark):
    df = odd_documents(spark)
    kept = language.recognised(df)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 2, 3, 4, 8} <= ids and not ids & {5, 6, 7, 10}


def test_nothing_to_learn_from(spark):
    empty = no_documents(spark)
    f = language.learn(empty)
    assert f.languages == [] and language.identify(empty, f).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_documents(spark), f).collect()} == {"und"}


def test_more_languages_than_one_machine_word(spark):
    rows = [(f"{chr(97 + i % 26) * 5} {chr(97 + i // 26) * 6} {prose(i, 3)}", f"l{i:03d}") for i in range(70)]
    f = language.learn(spark.createDataFrame(rows, "text string, lang string"), min_count=1, slots=1 << 16)
    assert len(f.words) == 2 and len(f.languages) == 70
    data, off = bytesx.column_bytes(pa.array([r[0] for r in rows]))
    best, _ = language.score_rows(f, data, off)
    assert (best == np.arange(70)).mean() > 0.9


def test_stage_keeps_clean_rows_of_many_languages(spark):
    r = random.Random(4)

    def vocabulary(n):
        return ["".join(r.choice("aeioubdfgklmnprst") for _ in range(6)) for _ in range(n)]
    common = vocabulary(30)
    own = [vocabulary(20) for _ in range(40)]
    rows = [(i * 10 + j, " ".join(r.choice(common if k % 2 else own[i]) for k in range(80)), f"l{i:02}")
            for i in range(40) for j in range(10)]
    rows.append((-1, " ".join("wxyzjqvhc"[k % 9] * 2 + "zxqj"[k % 4] * 3 for k in range(60)), None))
    kept = language.recognised(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(400))
