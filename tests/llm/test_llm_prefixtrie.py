import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wardspark.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, shard int, n int, k1 int, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        parents = {x[:-1] for x in members if x}
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m),
                    sum(1 for x in members if x and x[:-1] == node), sum(1 for x in below if x not in parents),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    turns = prefixtrie.ordered_turns(frame(spark, rows))
    heads = prefixtrie.with_shared_heads(turns, F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string")) % 9)
    return sorted((tuple(r) for r in prefixtrie.trie(heads, **options).collect()), key=str)


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        c = r.randrange(-70, 200)
        for t in range(r.randrange(1, 12)):
            rows.append((c, r.choice([t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "ü日", "", None, "bb"])))
    return rows


@pytest.mark.parametrize("bits", [12, 3, 0])
def test_equal_to_brute_force_in_shards(spark, bits):
    rows = conversations(4)
    assert run(spark, rows, shard_bits=bits) == brute(rebuilt(rows))


def test_copies_a_very_long_conversation_and_no_turns_left(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(0, 300, 5) for t in range(4)]
    deep = [(1001, t, "user", str(t % 3)) for t in range(2500)]
    short = [(c, 0, "user", "only") for c in (2001, 2002, 2003, 2004)]  # heads of a conversation that is not there
    rows = same + deep + short + [(None, 0, "user", "nobody's")]
    convs = rebuilt(rows)
    got = run(spark, rows, shard_bits=5)
    assert any(not t for t in convs.values())
    # brute force without the deep chain, which is compared by its own numbers
    chain = [g for g in got if g[0] == 1001 and g[1] > 8]
    assert len(chain) == len(convs[1001]) - 8 and {g[3] for g in chain} == {1} and {g[5] for g in chain} == {1}
    cut = {c: t[:8] if c == 1001 else t for c, t in convs.items()}
    strip = lambda rows: [g[:4] + g[6:7] for g in rows]
    assert strip(sorted((g for g in got if g not in chain), key=str)) == strip(brute(cut))


def test_order_of_turns(spark):
    rows = [(1, 2, "b", "x"), (1, None, "z", "first"), (1, 2, "a", "y"), (1, 5000, None, None), (1, -1, "q", "w"), (1, 2, "a", "y")]
    out = prefixtrie.ordered_turns(frame(spark, rows)).orderBy("ord").collect()
    want = [("z", "first"), ("q", "w"), ("a", "y"), ("a", "y"), ("b", "x"), ("", "")]
    assert [r["ord"] for r in out] == list(range(6)) and [r["bytes"] for r in out] == [len(t) for _, t in want]
    assert [bytes(r["md5"]) for r in out] == [hashlib.md5(f"{len(a)}:{a}{b}".encode()).digest() for a, b in want]


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []
