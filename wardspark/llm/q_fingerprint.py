"""op10: fingerprints of every document, of its edited text, and how alike they and the next document's are.

``matched_edited`` is the share of the text that the edited text still has, by anchors in equal positions to each other.

Defined cases: a null id comes before all others. Of rows that repeat an id, the one with the least text is the next
document of the id before; each of them has the same next document. A single id is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm import fingerprint as fp
from wardspark.llm.common import table
from wardspark.session import materialize


#: Stands for a null id inside the query.
NO_ID = -(1 << 63)


def next_ids(ids: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """(doc_id, next_id, prev_id, prev_n) of a table (doc_id, n), circular, without one window over all rows.

    Ids are dealt out by range into buckets of about ``per_bucket`` ids; the first and the last id of each bucket meet
    in a table of one row per bucket.
    """
    n = ids.count()
    k = max(-(-n // per_bucket), int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(ids.repartitionByRange(k, "doc_id").withColumn("b", F.spark_partition_id()), "fp-ranges")
    ends = rows.groupBy("b").agg(F.min("doc_id").alias("first"), F.max_by("n", "doc_id").alias("last_n"),
                                 F.max("doc_id").alias("last"))
    order = Window.orderBy("b")
    around = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("b", F.coalesce(F.lead("first").over(order), F.min("first").over(around)).alias("after"),
                       F.coalesce(F.lag("last").over(order), F.max("last").over(around)).alias("before"),
                       F.coalesce(F.lag("last_n").over(order), F.max_by("last_n", "b").over(around)).alias("before_n"))
    w = Window.partitionBy("b").orderBy("doc_id")
    return rows.withColumns({"nx": F.lead("doc_id").over(w), "pv": F.lag("doc_id").over(w),
                             "pn": F.lag("n").over(w)}).join(ends, "b").select(
        "doc_id", F.coalesce("nx", "after").alias("next_id"), F.coalesce("pv", "before").alias("prev_id"),
        F.coalesce("pn", "before_n").alias("prev_n"))


def op10_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = materialize(docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"),
                                                 F.count(F.lit(1)).alias("rows")), "fp-ids")
    repeated = bool(ids.where("rows > 1").limit(1).count())
    near = materialize(next_ids(ids.drop("rows")), "fp-next")
    own = fp.with_anchors(docs, F.col("text"), "anchors")
    own = own.select("doc_id", "text", fp.sketch(F.col("anchors")).alias("sketch")).join(near, "doc_id")
    # the edited text takes its end from the next document, which sends what its predecessor needs; both read the
    # same columns of the same shuffle, so the texts move once
    giver = own
    if repeated:
        giver = own.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("row = 1")
    given = giver.select(F.col("prev_id").alias("doc_id"), F.col("sketch").alias("next_sketch"),
                         F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("tail"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.drop("next_id", "prev_id", "prev_n").join(given, "doc_id").withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring("tail", F.lit(1), half)))
    rows = fp.with_anchors(edited, F.col("edited"), "edited_anchors")
    rows = rows.withColumn("edited_sketch", fp.sketch(F.col("edited_anchors")))
    # all anchors of the text itself are found again rather than sent along
    rows = fp.with_anchors(rows, F.col("text"), "own_anchors")
    return rows.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), fp.fingerprint(F.col("sketch")).alias("fingerprint"),
        fp.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fp.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fp.matched(F.col("own_anchors"), F.col("edited_anchors")).alias("matched_edited"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLES: dict[str, str] = {}
