import random

import numpy as np
import pyarrow as pa

from tests.llm.cases import no_documents, odd_documents, prose
from wardspark.llm import bytesx, secrets


def secret_documents(n=240):
    r = random.Random(2)
    rows = []
    for i in range(n):
        w = prose(i, 60).split()
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
        put, secret = [(f'token = "{hexa}"', hexa), (f"password={hexa[:18]}", hexa[:18]),
                       ("AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(16)), None),
                       (f"mail{i}.77@mail5.example.com", ""), ("4091796438840516", ""), ("42.144.35.254", "")][i % 6]
        w.insert(30, put)
        rows.append((i, " ".join(w), put if secret is None else secret))
    return rows


def test_findings_are_the_secrets_and_spans_are_right(spark):
    rows = secret_documents()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    text = {i: t for i, t, _ in rows}
    got = {}
    for r in secrets.scan(df, ["doc_id"]).collect():
        assert text[r["doc_id"]][r["start"]:r["start"] + r["length"]] == r["value"]
        if r["is_secret"]:
            got.setdefault(r["doc_id"], []).append(r["value"])
    assert got == {i: [s] for i, _, s in rows if s}


def test_redaction_keeps_all_rows_and_all_else(spark):
    rows = secret_documents(120)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows] + [(5, None, "x", "y")],
                               "doc_id long, text string, score string, start string")
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
    assert got == sorted([(i, t.replace(s, "[SECRET]") if s else t) for i, t, s in rows] + [(5, "")])


def test_reviewed_findings_outrank_rules(spark):
    rows = secret_documents(120)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    d = secrets.dictionary(df)
    found = secrets.candidates(df, d, ["doc_id"])
    reviewed = found.selectExpr("features", "CAST(value LIKE '%@%' AS INT) AS label")
    got = secrets.scan(df, ["doc_id"], labelled=reviewed).collect()
    assert {r["is_secret"] for r in got if "@" in r["value"]} == {True}
    assert {r["is_secret"] for r in got if "@" not in r["value"]} == {False}


def test_candidates_of_a_plain_loop():
    texts = ["a1b2c3d4e", "short1 22", "key: value12", "é1234567890 x", None, "", "pass=abcdef", "x" * 5000 + "12"]
    data, off = bytesx.column_bytes(pa.array(texts))
    starts, ends, chosen = secrets._tokens(data, off)
    rows = bytesx.rows_of(starts, off)
    assert [(int(rows[i]), bytes(data[starts[i]:ends[i]]).decode()) for i in np.flatnonzero(chosen)] == [
        (0, "a1b2c3d4e"), (6, "pass=abcdef")] + []


def test_odd_rows_and_no_labels(spark):
    out = secrets.scan(odd_documents(spark).drop("score", "features"), ["doc_id"]).collect()
    assert all(not r["is_secret"] for r in out)
    assert secrets.scan(no_documents(spark), ["doc_id"]).count() == 0
    odd = odd_documents(spark)
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == 14
    assert secrets.redact(no_documents(spark)).count() == 0
    only = spark.createDataFrame([(1, "password=0a1b2c3d4e5f")], "doc_id long, text string")
    assert [r["score"] for r in secrets.scan(only, ["doc_id"]).collect()] == [1.0]


def _hidden_secrets():
    r = random.Random(5)

    def rnd(n, chars="abcdefghijkmnpqrstuvwxyz23456789"):
        return "".join(r.choice(chars) for _ in range(n - 2)) + "47"
    k = [rnd(24) for _ in range(12)]
    ghp = "ghp_" + rnd(36)
    akia = "AKIA" + "".join(r.choice("BCDFGHJKLMNP") for _ in range(16))
    return [
        (f"he said \u201cpassword={k[0]}\u201d and left", k[0]), (f"the key is api_key={k[1]}\u2026", k[1]),
        (f"\u5bc6\u94a5password={k[2]}\u3002\u8bf7\u4fdd\u7ba1", k[2]),
        ("{" + ",".join(f'"a{i}":{i}' for i in range(900)) + f',"token":"{k[3]}"' + "}", k[3]),
        (f'{{"user":"bob","token":"{ghp}"}}', ghp), (f"https://api.example.org/v1?user=bob&token={k[4]}&page=2", k[4]),
        (f"https://host.org/{akia}/list", akia), (f"\\u00e9{akia}", None), (f"\u00e9{akia}", akia),
        ('{"password":"qwzxvbnmkjhg"}', "qwzxvbnmkjhg"), ("password=p&zq,w9x;r7kt", "p&zq,w9x;r7kt"),
        ("secret=zürqwx7kvpq9 here", "zürqwx7kvpq9"), ('passphrase = "xkqz vbnw 77 plmj"', "xkqz vbnw 77 plmj"),
        (f"token={k[5]}==", k[5] + "==")]


def test_secrets_inside_other_text_are_candidates_with_right_spans(spark):
    texts = [t for t, _ in _hidden_secrets()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in secrets.candidates(df, secrets.dictionary(df), ["doc_id"]).collect():
        assert texts[r["doc_id"]][r["start"]:r["start"] + r["length"]] == r["value"]
        found.setdefault(r["doc_id"], {})[r["value"]] = r["rule"]
    for i, (t, want) in enumerate(_hidden_secrets()):
        if want:
            assert found.get(i, {}).get(want) == 1, (t[-80:], want, found.get(i))


def test_redaction_reaches_secrets_inside_other_text(spark):
    hidden = [(1000 + i, t, s) for i, (t, s) in enumerate(_hidden_secrets()) if s]
    rows = secret_documents(120) + hidden
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for i, t, s in hidden:
        assert s not in got[i] and "[SECRET]" in got[i], (t[-80:], got[i][-80:])
        assert got[i][0] == t[0] and len(got[i]) >= len(t) - len(s) - 30


def test_overlapping_secrets_get_one_mark(spark, monkeypatch):
    def found(texts, *a, **k):
        return texts.crossJoin(spark.createDataFrame(
            [(2, 6), (2, 3), (4, 8), (14, 2)], "start long, length long")).selectExpr("_llm_key", "start", "length", "true AS is_secret")
    monkeypatch.setattr(secrets, "scan", found)
    df = spark.createDataFrame([("abcdefghijklmnopqrst",)], "text string")
    assert secrets.redact(df).first()["text"] == "ab[SECRET]mn[SECRET]qrst"


def test_coverage_reads_the_whole_value(spark):
    df = spark.createDataFrame([("harbour " * 30,)], "text string")
    d = secrets.dictionary(df)
    share, longest = secrets._coverage(d, "7" * 300 + "harbour" * 60)
    assert longest == 7 and abs(share - 420 / 720) < 1e-9


def test_dictionary_does_not_fill_up_with_rare_words(spark):
    r = random.Random(9)
    rare = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(400_000)]
    many = [" ".join(w for w in rare[i::400] for _ in range(19)) + " harbour" * 200 for i in range(400)]
    d = secrets.dictionary(spark.createDataFrame([(t,) for t in many], "text string"))
    assert len(d.known) == 1
    assert secrets._known_words(d, b"harbour " + " ".join(rare[:500]).encode()) == [True] + [False] * 500


def test_known_words_keep_their_share_in_a_larger_corpus(spark):
    texts = spark.createDataFrame([("ocean " * 99_900 + "velvet " * 80 + "cobalt " * 20,)], "text string")
    small = secrets.dictionary(texts, min_share=5e-4)
    large = secrets.dictionary(spark.range(30).crossJoin(texts).select("text"), min_share=5e-4)
    assert secrets._known_words(small, b"ocean velvet cobalt") == [True, True, False]
    assert secrets._known_words(large, b"ocean velvet cobalt") == [True, True, False]


def test_provider_and_key_rules_come_before_coverage(spark):
    d = secrets.dictionary(spark.createDataFrame([("correct horse battery staple " * 30,)], "text string"))
    d.known = np.sort(np.append(d.known, bytesx.span_hashes(np.frombuffer(b"bcdf", np.uint8), np.array([0]), np.array([4]))))
    rules = [secrets.describe(d, t, [], [])[3] for t in
             ("AKIA" + "BCDF" * 4, 'password="correcthorsebattery"', "correcthorsebattery", "password:correcthorsebattery")]
    assert rules == [1, 1, 0, -1]
