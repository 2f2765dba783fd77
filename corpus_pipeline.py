"""A corpus pipeline from raw documents to token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents that it keeps,
with all their columns. ``run`` applies them to the table ``documents``; every stage's result is written and read
again, so a lost executor costs at most one stage. No SQL can express the stages, so ``ORACLE_SQL`` is None; the tests
compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import jaccard, language, mixing, pieces, secrets
from wardspark.llm.common import table
from wardspark.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that occur; texts without a recognisable language go."""
    return language.recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least id."""
    return jaccard.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced by a mark."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the pieces of their best segmentation, and the scores of the four best.

    Columns named like one of the two are replaced.
    """
    keep = [c for c in docs.columns if c not in ("ids", "scores")]
    coded = pieces.encode(docs, pieces.load(), keep, names=("ids", "_llm_score", "_llm_more"))
    return coded.select(*keep, "ids", F.concat(
        F.array("_llm_score"), F.transform("_llm_more", lambda a: a["score"])).alias("scores"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
          ("mix_sources", mix_sources), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
