"""Files named ``S<subject>_H<visit>.csv``, many of them in one folder.

Listing yields a row per file without opening any. The split is joined to that list by the key in the name, and only the
files left are dealt out to tasks, about ``task_bytes`` each, and read there. Writing keeps a visit's file whole: a task
writes the files of its visits one after the other, each under a temporary name until it is complete, so that a repeated
task replaces what a lost one left.
"""

from __future__ import annotations

import csv
import io
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.functions.clinical import parse_visit_file
from wardspark.session import join_checked, materialize

VISIT = ["subject_id", "hadm_id"]
#: Folders that hold the folders of all visits, where every visit has one.
SHARDS = 256
FOLDERS_PER_TASK = 2_000


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _text(column: pa.Array) -> list[str]:
    return ["" if v is None else str(v) for v in column.to_pylist()]


def write_visit_files(df: DataFrame, folder: str, columns: list[str], order: list[str] = (), keys=VISIT,
                      nested: bool = False) -> DataFrame:
    """One CSV file with a header per visit, rows in ``order``; the files written (name, rows).

    ``nested``: a visit's file lies in a folder ``visit=<name>`` of its own, and these folders in ``SHARDS`` others, so
    that no folder lists all visits."""
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns)

    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        place = base
        now, buffer, out, count, done = None, None, None, 0, []

        def close():
            out.write(buffer.getvalue().encode())
            out.close()
            store.move(temp, f"{place}/{now}.csv")
            done.append((now, count))

        for b in batches:
            names = [f"S{s}_H{h}" for s, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            cells = [_text(b.column(i + len(keys))) for i in range(len(columns))]
            for name, *row in zip(names, *cells, strict=True):
                if name != now:
                    if now is not None:
                        close()
                    now, count, buffer = name, 0, io.StringIO()
                    if nested:
                        place = f"{base}/{zlib.crc32(name.encode()) % SHARDS:03d}/visit={name}"
                        store.create_dir(place, recursive=True)
                    temp = f"{place}/.{name}-{uuid.uuid4().hex[:8]}"
                    out = store.open_output_stream(temp)
                    writer = csv.writer(buffer, lineterminator="\n")
                    writer.writerow(columns)
                writer.writerow(row)
                count += 1
                if buffer.tell() > 1 << 20:
                    out.write(buffer.getvalue().encode())
                    buffer.seek(0)
                    buffer.truncate()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["name", "rows"])
                done = []
        if now is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["name", "rows"])

    return materialize(sorted_rows.mapInArrow(run, "name string, rows long"), "visit-files")


def list_visit_files(spark: SparkSession, folder: str, keys=VISIT) -> DataFrame:
    """(keys, path, length) of the files in a folder, from its listing; hidden and other files are left out."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "S*_H*.csv").option(
        "recursiveFileLookup", True).load(folder).select("path", "length")
    subject, visit = parse_visit_file(F.regexp_extract("path", r"(S\d+_H\d+)\.csv$", 1))
    return listed.select(subject.alias(keys[0]), visit.alias(keys[1]), "path", "length").where(F.col(keys[0]).isNotNull())


def read_visit_files(spark: SparkSession, folder: str, schema: T.StructType, splits: DataFrame | None = None,
                     split: str | None = None, keys=VISIT, task_bytes: int = 64 << 20, file_cost: int = 64 << 10) -> DataFrame:
    """Keys and columns of ``schema`` (read by header name; a text that doesn't parse is null) of all rows.

    With ``splits`` (keys, split) only the files of the visits of ``split`` are opened. ``file_cost``: bytes that opening
    a file counts as."""
    files = list_visit_files(spark, folder, keys)
    if splits is not None:
        wanted = materialize(splits.where(F.col("split") == split).select(*keys).distinct(), "split-visits")
        files = join_checked(files, wanted, keys, "left_semi", row_bytes=32)
    files = materialize(files, "visit-list")
    total = files.agg(F.sum(F.col("length") + file_cost)).first()[0] or 0
    dealt = files.repartition(max(1, -(-total // task_bytes)))
    names = [f.name for f in schema.fields]

    def run(batches):
        for b in batches:
            for k1, k2, path in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store, local = _store(path)
                with store.open_input_stream(local) as file:
                    lines = csv.reader(io.TextIOWrapper(file, encoding="utf-8", newline=""))
                    header = next(lines, [])
                    at = [header.index(n) if n in header else None for n in names]
                    held: list[list] = []
                    for row in lines:
                        held.append([row[i] if i is not None and i < len(row) and row[i] != "" else None for i in at])
                        if len(held) >= 8192:
                            yield _batch(k1, k2, held, keys, names)
                            held = []
                    if held:
                        yield _batch(k1, k2, held, keys, names)

    schema_text = ", ".join([*(f"{k} long" for k in keys), *(f"`{n}` string" for n in names)])
    text = dealt.select(*keys, "path").mapInArrow(run, schema_text)
    return text.select(*keys, *[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
                                for f in schema.fields])


def list_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder, hidden ones left out. Tasks list a level of folders at a time, so
    neither paths nor folders pass through the driver."""
    def children(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, local = _store(path)
                found = [i for i in store.get_file_info(pafs.FileSelector(local)) if i.base_name[:1] not in (".", "_")]
                for lo in range(0, len(found), 10_000):
                    some = found[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{path.rstrip('/')}/{i.base_name}" for i in some], pa.string()),
                         pa.array([i.type == pafs.FileType.Directory for i in some], pa.bool_()),
                         pa.array([i.size for i in some], pa.int64())], ["path", "is_folder", "length"])

    level, files = spark.createDataFrame([(folder,)], "path string").coalesce(1), None
    while True:
        found = materialize(level.mapInArrow(children, "path string, is_folder boolean, length long"), "visit-tree")
        here = found.where("not is_folder").select("path", "length")
        files = here if files is None else files.unionByName(here)
        folders = found.where("is_folder").select("path")
        n = folders.count()
        if not n:
            return files
        level = folders.repartition(max(min(n, 16), -(-n // FOLDERS_PER_TASK)))


def file_lines(files: DataFrame, task_bytes: int = 64 << 20, file_cost: int = 64 << 10) -> DataFrame:
    """(path, line) of text files (path, length): the lines behind each file's first one, blank lines left out.

    Files are dealt out to tasks by their bytes, as in ``read_visit_files``."""
    total = files.agg(F.sum(F.col("length") + file_cost)).first()[0] or 0
    dealt = files.select("path").repartition(max(1, -(-total // task_bytes)))

    def run(batches):
        paths, lines = [], []
        for b in batches:
            for path in b.column(0).to_pylist():
                store, local = _store(path)
                with store.open_input_stream(local) as file:
                    text = (x.rstrip("\n") for x in io.TextIOWrapper(file, encoding="utf-8", errors="replace"))
                    rows = (x for x in text if x.strip())
                    next(rows, None)
                    for line in rows:
                        paths.append(path)
                        lines.append(line)
                        if len(lines) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(lines)], ["path", "line"])
                            paths, lines = [], []
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(lines)], ["path", "line"])

    return dealt.mapInArrow(run, "path string, line string")


def _batch(k1: int, k2: int, rows: list[list], keys, names: list[str]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()),
         *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], [*keys, *names])
