"""Tables with a layout: bucketed catalog tables (S6, S9), loads that may be repeated (S7), lookup tables that prune
(P5, P9) and tables read by pages (O2)."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wardspark.session import checkpoint_dir

VISIT = ["subject_id", "hadm_id"]


# ---- S6 / S9: bucketed catalog tables --------------------------------------------------------------------------------

def write_bucketed(df: DataFrame, table: str, buckets: int, keys=VISIT, sort=(), path: str | None = None) -> DataFrame:
    """A catalog table bucketed by ``keys`` and sorted inside a bucket by keys and ``sort``; the table, read.

    Joins, groupings and windows by the keys over tables of the same number of buckets need no exchange. Rows are dealt
    by the bucket hash first, so a bucket is one file. ``path``: where the files lie, else in the checkpoint folder."""
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/table-{table}-{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *sort)
     .option("path", path).format("parquet").saveAsTable(table))
    return spark.table(table)


# ---- S7: loads that may be repeated ----------------------------------------------------------------------------------

class LoadTable:
    """A folder of loads, each under an id of its own, that shows every committed load exactly once.

    A load writes its rows to a new folder, then publishes one manifest entry by a rename that fails if the entry exists.
    Readers follow the manifest, so rows of a load that died, or of the slower of two attempts, are never seen, and a
    load that is repeated adds nothing. The manifest has one small entry per load. Renames must be atomic in the store."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(path)

    def committed(self) -> list[dict]:
        """The manifest: load id, folder and rows of each committed load, by id."""
        try:
            rows = self.spark.read.schema("load string, folder string, rows long").json(f"{self.path}/manifest").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted((r.asDict() for r in rows), key=lambda r: r["load"])

    def _publish(self, entry: dict) -> bool:
        """Whether the entry is the first of its load."""
        jvm, final = self._hadoop(f"{self.path}/manifest/{entry['load']}.json")
        conf = self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
        _, temp = self._hadoop(f"{self.path}/staging/{uuid.uuid4().hex}.json")
        fs = final.getFileSystem(conf)
        fs.mkdirs(final.getParent())
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        from py4j.protocol import Py4JJavaError
        try:
            context.rename(temp, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def load(self, rows: DataFrame, load_id: str) -> bool:
        """Add ``rows`` as load ``load_id``; False if that load is there already."""
        if not load_id or "/" in load_id or load_id.startswith((".", "_")):
            raise ValueError("a load id is a file name that is not hidden")
        if any(r["load"] == load_id for r in self.committed()):
            return False
        folder = f"data/{load_id}-{uuid.uuid4().hex[:12]}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.parquet(f"{self.path}/{folder}").count()
        return self._publish({"load": load_id, "folder": folder, "rows": written})

    def read(self) -> DataFrame:
        """The rows of all committed loads."""
        folders = [f"{self.path}/{r['folder']}" for r in self.committed()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)


# ---- P5 / P9: lookup tables ------------------------------------------------------------------------------------------

#: Points of a lookup that become literals of the scan; more of them are joined.
MOST_LITERALS = 256


def write_lookup_table(df: DataFrame, path: str, sort: list[str], bloom: str, distinct: int = 1_000_000,
                       row_group: int = 16 << 20, rows_per_file: int = 5_000_000) -> None:
    """Rows in order of ``sort`` over all files, with Bloom filters on ``bloom``: a lookup reads the row groups whose
    ranges and filters admit its points only. ``distinct``: distinct values of ``bloom`` that a filter is sized for."""
    parts = max(1, -(-df.count() // rows_per_file))
    (df.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).write.mode("overwrite")
     .option(f"parquet.bloom.filter.enabled#{bloom}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{bloom}", str(distinct))
     .option("parquet.block.size", str(row_group)).parquet(path))


def lookup(spark: SparkSession, path: str, points: list[dict]) -> DataFrame:
    """Rows of a lookup table that equal one of the points in all of its columns.

    A few points are literals that reach the scan; of many, the ranges of their columns do, and the points are joined."""
    table = spark.read.parquet(path)
    if not points:
        return table.limit(0)
    names = list(points[0])
    if any(list(p) != names for p in points):
        raise ValueError("all points have the same columns")
    if len(points) <= MOST_LITERALS:
        any_of = [F.col(n).isin(sorted({p[n] for p in points})) for n in names]
        exact = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(n) == p[n] for n in names]) for p in points])
        return table.where(reduce(lambda a, b: a & b, any_of)).where(exact)
    for n in names:
        table = table.where(F.col(n).between(min(p[n] for p in points), max(p[n] for p in points)))
    wanted = spark.createDataFrame([tuple(p[n] for n in names) for p in points], table.select(*names).schema).distinct()
    return table.join(wanted, names, "left_semi")


# ---- O2: pages -------------------------------------------------------------------------------------------------------

#: Rows that a task sorts and cuts into buckets; smaller buckets have no task, and no sample of the rows, of their own.
ROWS_PER_RANGE = 1_000_000
#: More buckets than a range can have.
MOST_BUCKETS = 10_000_000


def write_pages(df: DataFrame, path: str, order: list[str], rows_per_bucket: int = 100_000) -> None:
    """Rows in buckets of consecutive places in ``order``, which should tell rows apart, and an index with the place of
    each bucket's first row. A range of ``ROWS_PER_RANGE`` rows is sorted by one task and cut into its buckets."""
    ranges = max(1, -(-df.count() // max(ROWS_PER_RANGE, rows_per_bucket)))
    # the id is the range in the upper bits and the place in it in the lower 33
    at = F.monotonically_increasing_id()
    bucket = F.shiftright(at, 33) * F.lit(MOST_BUCKETS) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(rows_per_bucket))
    (df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_bucket", bucket.cast("long"))
     .write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows"))
    written = df.sparkSession.read.parquet(f"{path}/rows").groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    written.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).write.mode("overwrite").parquet(f"{path}/index")


def read_page(spark: SparkSession, path: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """The rows at places offset to offset + limit - 1, from the buckets that hold them only; in no particular order,
    with their place in ``_place``."""
    index = spark.read.parquet(f"{path}/index")
    held = index.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()
    folders = [f"{path}/rows/_bucket={r['_bucket']}" for r in held] or [f"{path}/rows"]
    # only the folders of the page are listed
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*folders).where(
        F.col("_bucket").isin([r["_bucket"] for r in held]))
    start = F.create_map(*[F.lit(x) for r in held for x in (r["_bucket"], r["before"])]) if held else None
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    if start is None:
        return rows.drop("_bucket").withColumn("_place", F.lit(0).cast("long")).limit(0)
    placed = rows.withColumn("_place", (place + F.element_at(start, F.col("_bucket"))).cast("long"))
    return placed.where(F.col("_place").between(offset, offset + limit - 1)).drop("_bucket")
