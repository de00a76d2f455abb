"""Exact repeats of a fixed length: shared first steps of the two removers.

A repeat of ``length`` units (bytes or words) can be found from sampled places:
each window of that length has one anchor, the place inside it where a shorter
gram has its least hash.  Equal windows have equal anchors at equal offsets.
The windows of a text that share an anchor form a run; a run whose whole
content stands twice needs no further look, one whose anchor gram stands once
cannot hold a repeat.  Only runs in between, at the ends of repeats, do.

All hashes are polynomial prefix hashes modulo 2^64 over random values of the
units, so the hash of any stretch takes one subtraction and one product.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow import session
from fundflow.llm import common
from fundflow.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])
# the removers name this module as a whole, and with it what it imports
cloudpickle.register_pickle_by_value(session)

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self, base: int = _BASES[0]):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            held = max(n, 1 << 14)
            fill = [np.full(held, b, np.uint64) for b in (self.base, self.inverse)]
            for f in fill:
                f[0] = 1
            self.up, self.down = (np.multiply.accumulate(f) for f in fill)
        return self.up[:n], self.down[:n]


class Prefix:
    """Prefix hashes of a row of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def runs(prefix: Prefix, n: int, length: int, gram: int):
    """(anchor, first window, last window) of every run, in order."""
    windows = n - length + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    places = np.arange(n - gram + 1)
    h = mix(prefix.of(places, places + gram))
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    span = length - gram + 1
    pad = (-len(packed)) % span
    grid = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
              & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], windows] - 1
    return anchor[first], first, last


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the units inside any of the stretches."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


TEXT_ID = ("c1", "c2")


def identified(docs: DataFrame) -> DataFrame:
    """Texts with an id of their content, 96 bits in two columns."""
    return common.texts(docs).withColumns({"c1": F.xxhash64("text"), "c2": F.hash("text")})




_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[1]))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def byte_units(raw: bytes, powers: Powers | None = None) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return _LETTERS[np.frombuffer(raw, np.uint8)]


def word_units(raw: bytes, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each word; blanks are those of ASCII."""
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return mix(Prefix(_LETTERS[data], powers).of(starts, ends) + (ends - starts).astype(np.uint64))


@dataclass(frozen=True)
class Kind:
    """What is removed: ``length`` units in a row that stand twice."""
    units: Callable[[bytes, Powers], np.ndarray]
    length: int
    gram: int
    resolve: Callable  # repeated windows of the runs of one anchor gram
    keep: Callable[[bytes, np.ndarray], tuple[int, bytes]]  # (spans removed, what is left)
    width: int = 8  # bytes that a unit takes when runs are sent: its hash, or 1 for the byte itself


_RUNS = "g long, f long, c1 long, c2 int, first int, last int, anchor int"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _scan(kind: Kind):
    schema = _schema(_RUNS)

    def run(batches):
        powers, word_powers = Powers(), Powers(_BASES[1])

        def part(batch):
            out = [[] for _ in schema]
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "c1", "c2")))
            for text, c1, c2 in rows:
                units = kind.units(text.encode(), word_powers)
                if len(units) < kind.length:
                    continue
                prefix = Prefix(units, powers)
                anchor, first, last = runs(prefix, len(units), kind.length, kind.gram)
                g = mix(prefix.of(anchor, anchor + kind.gram))
                shape = ((anchor - first) << 32 | (last - first)).astype(np.uint64)
                f = mix(prefix.of(first, last + kind.length) + mix(shape))
                n = len(anchor)
                for column, values in zip(out, (g.view(np.int64), f.view(np.int64), np.full(n, c1),
                                                np.full(n, c2, np.int32), first, last, anchor)):
                    column.append(values)
            return [pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, schema)]
        yield from common.per_chunk(part, schema)(batches)
    return run


_CONTENT = "g long, f long, left int, units binary"


def _load(kind: Kind):
    """Units of the picked runs of each text."""
    schema = _schema(_CONTENT)

    def run(batches):
        powers = Powers(_BASES[1])

        def part(batch):
            out = []
            for text, picked in zip(batch.column("text").to_pylist(), batch.column("picked").to_pylist()):
                raw = text.encode()
                units = np.frombuffer(raw, np.uint8) if kind.width == 1 else kind.units(raw, powers)
                for r in picked:
                    out.append((r["g"], r["f"], r["anchor"] - r["first"],
                                units[r["first"]:r["last"] + kind.length].tobytes()))
            return [pa.array([r[i] for r in out], schema.field(i).type) for i in range(4)]
        yield from common.per_chunk(part, schema)(batches)
    return run


_FOUND = "g long, f long, starts array<int>, ends array<int>"
TOGETHER = 1000  # runs resolved at once


def _resolve(kind: Kind):
    """Rows sorted by g: repeated stretches of each run, from its first unit."""
    schema = _schema(_FOUND)

    def settle(rows):
        masks = kind.resolve(rows, kind.length)
        out = []
        for (g, f, left, units), mask in zip(rows, masks):
            at = np.flatnonzero(mask)
            if len(at):
                n = len(units) // kind.width
                edge = np.diff(np.r_[False, covered(at, at + kind.length, n), False].astype(np.int8))
                out.append((g, f, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type)
                                           for i in range(4)], schema=schema)

    def run(batches):
        rows, g = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "f", "left", "units"))):
                if row[0] != g and len(rows) >= TOGETHER:
                    yield settle(rows)
                    rows = []
                g = row[0]
                rows.append(row)
        if rows:
            yield settle(rows)
    return run


_RESULT = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"


def _finish(kind: Kind, keep_text: bool):
    schema = _schema(_RESULT + ", kept string" * keep_text)

    def run(batches):
        powers = Powers(_BASES[1])

        def part(batch):
            out = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                raw = text.encode()
                n = len(kind.units(raw, powers))
                mask = np.zeros(n, bool)
                if found:
                    starts = np.concatenate([np.array(x["starts"], np.int64) + x["at"] for x in found])
                    ends = np.concatenate([np.array(x["ends"], np.int64) + x["at"] for x in found])
                    mask = covered(starts, ends, n)
                spans, left = kind.keep(raw, mask)
                row = (doc_id, n, int(mask.sum()), spans, hashlib.sha256(left).hexdigest())
                out.append(row + ((left.decode("utf-8", "replace"),) if keep_text else ()))
            return [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)]
        yield from common.per_chunk(part, schema)(batches)
    return run


def remove(docs: DataFrame, kind: Kind, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept_sha256[, kept]) per document."""
    texts = identified(docs)
    # read twice from the texts: cheaper than to keep every run on disk
    runs_ = texts.select("text", *TEXT_ID).mapInArrow(_scan(kind), _RUNS)
    # written, so that the join meets plain exchanges, whose hot parts are split
    twice = materialise(runs_.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                        .select("g"), "twice", rebalance=False)
    hot = materialise(runs_.join(twice, "g"), "hot-runs", rebalance=False)
    forms = materialise(hot.groupBy("g", "f").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("c1", "c2", "first", "last", "anchor")).alias("r")), "forms", rebalance=False)
    open_ = forms.groupBy("g").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("g")
    picked = forms.join(open_, "g").groupBy("r.c1", "r.c2").agg(F.collect_list(F.struct(
        "g", "f", F.col("r.first").alias("first"), F.col("r.last").alias("last"),
        F.col("r.anchor").alias("anchor"))).alias("picked"))
    content = texts.select("text", *TEXT_ID).join(picked, list(TEXT_ID)).select("text", "picked") \
        .mapInArrow(_load(kind), _CONTENT)
    found = content.groupBy("g", "f").agg(F.first("left").alias("left"), F.first("units").alias("units")) \
        .repartition("g").sortWithinPartitions("g").mapInArrow(_resolve(kind), _FOUND)
    # whole runs that stand twice, and parts of runs that stand in another form
    whole = forms.filter("n > 1").select(
        "g", "f", F.array(F.lit(0)).alias("starts"),
        F.array(F.col("r.last") - F.col("r.first") + kind.length).alias("ends"))
    parts = materialise(whole.unionByName(found), "parts", rebalance=False)
    per_text = hot.join(parts, ["g", "f"]).groupBy(*TEXT_ID).agg(F.collect_set(F.struct(
        F.col("first").alias("at"), "starts", "ends")).alias("found"))
    return texts.join(per_text, list(TEXT_ID), "left").select("doc_id", "text", "found") \
        .mapInArrow(_finish(kind, keep_text), _RESULT + ", kept string" * keep_text)
