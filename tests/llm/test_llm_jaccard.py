import itertools
import random

from tests.llm.cases import no_documents, odd_documents, prose
from wardspark.llm import jaccard
from wardspark.llm.components import components


def brute(rows, k=5, t=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    links = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t:
            links[i].add(j)
            links[j].add(i)
    classes = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        classes[i] = min(rows[j][0] for j in seen)
    return {rows[i][0]: (classes[i], len(links[i])) for i in range(len(rows))}


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = prose(g, r.choice([3, 8, 60, 150]))
        for _ in range(r.choice([1, 2, 9])):
            rows.append((len(rows), edited(r, base, r.choice([0, 0, 1, 2, 5]))))
    return rows


def test_links_and_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_small_blocks_give_the_same(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"])
           for r in jaccard.near_duplicates(df, block=2, block_grams=100).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    got = jaccard.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[1]["class_id"] == by[2]["class_id"] == by[3]["class_id"] == 1
    assert by[1]["n_copies"] == 2 and by[1]["n_links"] == 2 and by[4]["n_links"] == 1
    for i in (5, 6, 7):
        assert by[i]["class_id"] == i and by[i]["n_links"] == 0 and by[i]["class_key"] is None
    kept = jaccard.deduplicate(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i or 0 for i in ids) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12]


def test_empty_table(spark):
    assert jaccard.near_duplicates(no_documents(spark)).count() == 0
    assert jaccard.deduplicate(no_documents(spark)).count() == 0


def test_prefix_is_shortened_until_the_recall_is_reached():
    n = jaccard.prefix_length(0.8, 32, 8, 0.99999)
    assert 1 - (1 - 0.8 ** n) ** 32 >= 0.99999 > 1 - (1 - 0.8 ** (n + 1)) ** 32
    assert jaccard.prefix_length(0.8, 32, 3, 0.5) == 3 and jaccard.prefix_length(0.1, 2, 8, 0.9999) == 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 5)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 200, 201: 200}


def test_blocks_are_as_many_as_the_texts_need_and_not_as_the_labels(spark):
    # (tid, label, size, chain): a chain of 90 labels that fits a block, and one of 400 with a heavy label
    rows = [(i, i, 10, 0) for i in range(90)]
    rows += [(1000 + i, 1000 + (i if i < 400 else 0), 10, 1000) for i in range(1000)]
    found = jaccard.homes(spark.createDataFrame(rows, "tid long, label long, size long, chain long"), 100, 10**6).collect()
    assert sorted(r["tid"] for r in found) == [r[0] for r in rows]
    blocks = {}
    for r in found:
        blocks.setdefault(r["block"], []).append(r["tid"])
    assert sorted(next(b for b in blocks.values() if 0 in b)) == list(range(90))
    assert len(blocks) <= 1 + 20 + 7 and max(len(b) for b in blocks.values()) <= 150
