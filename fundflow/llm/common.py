"""Helpers shared by the text operators.

Every operator reads only the columns that it names, so further columns of its
input, whatever they are called, never clash with its own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 4 << 20  # text handled at once by Python code, unless one text is larger


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name += "_"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) with an empty text in place of null."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def bucket_of(key: str, n: int) -> Column:
    """crc32 of a key's decimal form, modulo ``n``; null keys count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def chunks(batch: pa.RecordBatch, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column ``text``) hold about ``size`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += int(n)
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def per_chunk(fn: Callable[[pa.RecordBatch], list[pa.Array]], schema: pa.Schema):
    """A function for mapInArrow that applies ``fn`` to bounded slices."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays(fn(part), schema=schema)
    return run


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """Rows, with all their columns, whose text passes.  ``judge`` is called once
    in each task and gives the test of one text; null texts are empty."""
    def run(batches):
        passes = judge()
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array([passes(t or "") for t in part.column("text").to_pylist()],
                                           pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
