"""op9: every candidate for a secret in all documents, with the forest's decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.llm import secrets
from wardspark.llm.common import table


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLES: dict[str, str] = {}
