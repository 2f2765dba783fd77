import ast
import pathlib

import corpus_pipeline as pipeline
import __spark_entry__ as ent
from tests.llm.cases import no_documents, odd_documents, prose, write
from tests.llm.test_llm_jaccard import brute

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_stages_one_after_another(spark):
    docs, d = odd_documents(spark), ""
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = out
    rows = pipeline.encode(spark, docs, d)
    assert set(rows.columns) == {*docs.columns, "ids", "scores"}
    ids = {r["doc_id"] for r in rows.collect()}
    assert 8 in ids or 1 in ids or 4 in ids


def test_empty_table(spark):
    docs = no_documents(spark)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_each_decision_against_plain_python(spark, tmp_path):
    rows = [(i, prose(i // 2 if i % 5 == 0 else i, 80) + (" password=0a1b2c3d4e5f" if i % 7 == 0 else ""), "en",
             f"s{i % 3}", 0) for i in range(90)] + [(1000, "!!! 123", "en", "s0", 0), (1001, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = pipeline.language_id(spark, df, "")
    assert {r["doc_id"] for r in a.collect()} == set(range(90))
    b = pipeline.near_duplicates(spark, a, "")
    classes = brute([r[:2] for r in rows[:90]])
    kept = {r["doc_id"] for r in b.collect()}
    assert kept == {i for i, (c, _) in classes.items() if c == i}
    c = {r["doc_id"]: r for r in pipeline.secret_scan(spark, b, "").collect()}
    text = {r[0]: r[1] for r in rows}
    assert set(c) == kept
    for i, r in c.items():
        assert r["text"] == text[i].replace("0a1b2c3d4e5f", "[SECRET]") and r["n_chars"] == len(r["text"])
    whole = pipeline.run(spark, write(spark, tmp_path / "p", documents=df)).collect()
    assert {r["doc_id"] for r in whole} <= kept and all(len(r["ids"]) > 0 and len(r["scores"]) == 4 for r in whole)
    times = {}
    for r in whole:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3


def test_every_operator_is_registered_once():
    names = list(ent.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def test_nothing_else_imports_the_package():
    for path in ROOT.rglob("*.py"):
        inside = "llm" in path.relative_to(ROOT).parts or path.name in ("corpus_pipeline.py", "__spark_entry__.py")
        for node in ast.walk(ast.parse(path.read_text())):
            module = getattr(node, "module", None) or ""
            names = [x.name for x in getattr(node, "names", [])] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert inside or not any("wardspark.llm" in x or "corpus_pipeline" in x for x in [module, *names]), path
            if inside and path.name != "__spark_entry__.py" and isinstance(node, ast.ExceptHandler):
                assert "ImportError" not in ast.dump(node) and "ModuleNotFoundError" not in ast.dump(node)
