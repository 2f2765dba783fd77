"""op7: the language of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.llm import language
from wardspark.llm.common import crc_mod, table


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = language.learn(docs.where(crc_mod("doc_id", 5) != 0))
    keyed = docs.select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    return language.identify(keyed, filters, keep=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "lang_pred", F.col("score"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
