"""op3: quality of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.llm import quality
from wardspark.llm.common import crc_mod, join_checked, table
from wardspark.session import materialize


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0).select("doc_id", "quality")
    labels = materialize(labels, "quality-labels")
    model = quality.learn(docs, join_checked(docs.select("doc_id", "text"), labels, "doc_id", row_bytes=48))
    keyed = docs.select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return quality.score(keyed, model, ["doc_id", "held_out"]).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
