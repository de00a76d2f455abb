"""Folders of many files, written, listed and opened by tasks.

Spark's file sources keep every file of a listing in the driver and plan a task for some 32
small files; its writers start a process for each local file to set its mode.  Here tasks do
this work through Arrow's file systems.  What those cannot open stays with Spark.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.session import materialise_observed

# Executors get these functions by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 64 << 20   # bytes of files that one task should read
ROWS, BYTES = 10_000, 16 << 20   # of a batch that a task hands on
_FOUND = "path string, folder boolean, bytes bigint, modified bigint"
_ESCAPED = frozenset('"#%\'*/:=?\\{[]^\x7f') | {chr(i) for i in range(1, 32)}


def file_tasks(spark: SparkSession, size: int = 0) -> int:
    """Tasks that write many small files, or read ``size`` bytes; a small table alone would be one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism,
               size // PIECE + 1)


def place(address: str) -> tuple[fs.FileSystem, str]:
    """File system and place of an address as Spark writes it, with nothing escaped."""
    return fs.FileSystem.from_uri(quote(address, safe=":/@"))


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def folder(spark: SparkSession, path: str) -> str | None:
    """Full address of the folder ``path``; None where it is none (a file, a pattern) or
    Arrow has no access to its file system."""
    at, system = _hadoop(spark, path)
    address = system.makeQualified(at).toString()
    try:
        there, top = place(address)
        return address if there.get_file_info(top).type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError):
        return None


def new_folder(spark: SparkSession, path: str) -> str | None:
    """Creates ``path``, which must not exist; returns its ``folder``."""
    at, system = _hadoop(spark, path)
    if system.exists(at):
        raise FileExistsError(path)
    system.mkdirs(at)
    return folder(spark, path)


# ------------------------------------------------------------------ listing

def _hidden(name: str, is_folder: bool) -> bool:
    """The names that Spark's file sources leave out."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      names=["path", "folder", "bytes", "modified"])


def _list(pattern: str) -> Callable:
    """What stands in each folder: its folders, and the files whose name fits."""
    def listed(batches):
        fits, rows = re.compile(pattern, re.S).fullmatch, []
        for batch in batches:
            for address in batch.column(0).to_pylist():
                system, top = place(address)
                for x in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                    name, is_folder = x.base_name, x.type == fs.FileType.Directory
                    if not _hidden(name, is_folder) and (is_folder or (x.size and fits(name))):
                        rows.append((f"{address.rstrip('/')}/{name}", is_folder, x.size or 0,
                                     (x.mtime_ns or 0) // 1_000_000))
                        if len(rows) == ROWS:
                            yield _found(rows)
                            rows = []
        if rows:
            yield _found(rows)
    return listed


def listing(spark: SparkSession, path: str, glob: str) -> tuple[DataFrame, int, int]:
    """(path, bytes, modified in milliseconds) of the files below ``path``, listed once and written;
    their bytes in all, and of the largest.  A folder is listed by one task.  Empty and hidden
    files are left out, as Spark does."""
    top, metrics = folder(spark, path), [
        F.sum("bytes").alias("size"), F.max("bytes").alias("widest"), F.count_if("folder").alias("folders"),
        F.count("*").alias("rows")]
    if top is None:
        files, seen = materialise_observed(spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
            "recursiveFileLookup", "true").load(path).select(
            "path", F.lit(False).alias("folder"), F.col("length").alias("bytes"),
            F.unix_millis("modificationTime").alias("modified")), "listing", *metrics)
        return files.drop("folder"), seen["size"] or 0, seen["widest"] or 0
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    level, levels, size, widest = spark.range(1).select(F.lit(top).alias("path")), [], 0, 0
    while True:
        found, seen = materialise_observed(level.repartition(file_tasks(spark)).mapInArrow(
            _list(pattern), _FOUND), "listing", *metrics)
        size, widest = size + (seen["size"] or 0), max(widest, seen["widest"] or 0)
        if seen["rows"] > seen["folders"] or not seen["folders"]:
            levels.append(found.filter("not folder").drop("folder"))
        if not seen["folders"]:
            return reduce(DataFrame.unionAll, levels), size, widest
        level = found.filter("folder").select("path")


# ------------------------------------------------------------------ reading

def _bodies(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64()))],
        names=["path", "content", "modified"])


def _read(limit: int) -> Callable:
    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for address, size, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "modified"))):
                if size > limit:
                    raise OSError(f"{address} has {size} bytes, more than the {limit} a row may have")
                system, at = place(address)
                with system.open_input_file(at) as file:
                    body = file.read()
                if rows and (held + len(body) > BYTES or len(rows) == ROWS):
                    yield _bodies(rows)
                    rows, held = [], 0
                rows.append((address, body, modified))
                held += len(body)
        if rows:
            yield _bodies(rows)
    return read


def contents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content, modificationTime) of the files below ``path``, a file a row."""
    if folder(spark, path) is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
            "recursiveFileLookup", "true").load(path).select("path", "content", "modificationTime")
    files, size, _ = listing(spark, path, glob)
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    return files.repartition(file_tasks(spark, size)).mapInArrow(
        _read(limit), "path string, content binary, modified bigint").select(
        "path", "content", F.timestamp_millis("modified").alias("modificationTime"))


# ------------------------------------------------------------------ writing

def escaped(name: str | None) -> str:
    """A partition value as Spark writes it into a folder's name."""
    if not name:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in name)


def write_lines(top: str, column: str, run: str, together: bool) -> Callable:
    """Rows (key, line), those of a key in sequence, as one file for each key: in a folder of
    its own, or in folders of ``ROWS`` files with the key in the file's name.  A file gets its
    name when it is whole, so a task may run again."""
    def write(batches):
        task = TaskContext.get()
        part, attempt, files = f"part-{task.partitionId():05d}-{run}", task.taskAttemptId(), 0
        system, root = place(top)
        rows = (row for batch in batches
                for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for key, lines in groupby(rows, itemgetter(0)):
            named = f"{escaped(column)}={escaped(key)}"
            at, name = (f"{root}/{task.partitionId():05d}-{files // ROWS}", f"{part}.{named}.txt") if together \
                else (f"{root}/{named}", f"{part}.c000.txt")
            if not together or files % ROWS == 0:
                system.create_dir(at)
            with system.open_output_stream(f"{at}/.{name}.{attempt}") as out:
                for _, line in lines:
                    out.write(line or b"")
                    out.write(b"\n")
            system.move(f"{at}/.{name}.{attempt}", f"{at}/{name}")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])
    return write
