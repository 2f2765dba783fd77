"""Helpers shared by the training-data operators: reading tables, scans in Arrow batches, native hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.session import materialize

#: Bytes of text that one step of a vectorised scan holds; its arrays take up to a hundred times as much.
SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(m)


def scanned(df: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int]:
    """``keep`` columns and the text for a scan, and the place of the text; a text that is kept is sent once."""
    if text_col in keep:
        return df.select(*keep), keep.index(text_col)
    return df.select(*keep, F.col(text_col).alias("_llm_text")), len(keep)


def release() -> None:
    """Give freed memory back, so that a worker between batches and queries holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch; batches without rows are left out."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                del out, b
                release()
    return df.mapInArrow(run, schema)


def written(df: DataFrame, name: str, rows: int, rows_per_file: int) -> DataFrame:
    """``materialize`` for a narrow table of at most ``rows`` rows, in files of about ``rows_per_file`` or more.

    A small table then isn't cut into a file per shuffle partition. The number of tasks grows with the rows.
    """
    return materialize(df.coalesce(max(1, -(-rows // rows_per_file))), name)


#: A side of a join is broadcast if its rows take no more than this together.
BROADCAST_BYTES = 32 << 20


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", row_bytes: int = 96) -> DataFrame:
    """Join that broadcasts ``right``, a written table, if its counted size allows, and else shuffles both sides.

    ``row_bytes`` is an upper bound of what a row of ``right`` takes.
    """
    small = right.count() * row_bytes <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)
