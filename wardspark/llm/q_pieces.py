"""op4: the four best segmentations of every document, and the text decoded from the best."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardspark.llm import pieces
from wardspark.llm.common import table


def op4_sentencepiece(spark, sf_dir):
    v = pieces.load()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
    coded = pieces.encode(docs, v, ["doc_id", "text_sha256"])
    digest = coded.select(
        "doc_id", "text_sha256", "ids", F.size("ids").alias("n_pieces"),
        F.concat(F.array("score"), F.transform("alternatives", lambda a: a["score"])).alias("scores"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    keep = ["doc_id", "text_sha256", "n_pieces", "scores", "ids_sha256"]
    back = pieces.decode(digest, v, keep)
    return back.select("doc_id", "n_pieces", "scores", "ids_sha256",
                       (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLES: dict[str, str] = {}
