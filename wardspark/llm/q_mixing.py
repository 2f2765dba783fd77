"""op5: all documents mixed to source weights 1, 2, 3."""

from __future__ import annotations

from wardspark.llm import mixing
from wardspark.llm.common import table


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}
