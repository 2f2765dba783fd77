"""Session construction and lineage cutting.

On a cluster the session is created by the platform; ``get_session`` then returns it unchanged, and elsewhere it
only fills in settings that are unset. The checkpoint folder is the context's, else ``spark.checkpoint.dir``; a
scratch folder is taken only on a local master (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if its rows take no more than this together.
BROADCAST_BYTES = 32 << 20

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wardspark") -> SparkSession:
    """Session with the defaults above for every setting that is not set yet.

    On a session that exists already nothing is changed: ``builder.config`` would overwrite its settings.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from pyspark import SparkConf
    given = SparkConf()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    A folder already set on the context is respected, then ``spark.checkpoint.dir`` is read. Only a ``local``
    master, where driver and executors are one process, gets a scratch folder of its own; on a cluster a missing
    folder is an error, because executors could not see a folder of the driver.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="wardspark-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts lineage so that a lost executor recomputes from the written table, not from the raw scan, and
    lets a reused intermediate (e.g. the hourly aggregate) be scanned with pushdown by later stages.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", row_bytes: int = 128) -> DataFrame:
    """Join that broadcasts ``right``, a written table, if its counted size allows, and else leaves the plan to Spark.

    ``row_bytes`` is an upper bound of what a row of ``right`` takes.
    """
    small = right.count() * row_bytes <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)
