"""Benchmark decontamination by greedy string tiling.

Shared seeds of ``SEED_WORDS`` words join a document with benchmark items.  For
each such pair the longest common unmarked run of words is found (Karp-Rabin
hashes, binary search on the length), marked on both sides, and so on until no
run of seed length is left.  The tiles may lie in any order, so a passage whose
parts were moved about is still covered.  A document is contaminated by an item
when tiles cover at least ``COVERAGE`` of the item's words.

Defined cases: null texts are empty and match nothing; items of fewer than
``SEED_WORDS`` words match where all their words stand in a row; items of fewer than
``SHORTEST`` words are no evidence and match nothing; repeated documents each
get their rows; items with the same id and text count once; of equally long
runs the first in the item, then in the document, is marked first.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm import common
from fundflow.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED_WORDS = 5
COVERAGE = 0.5
SHORTEST = 3
BLOCK_CHARS = 4_000_000  # benchmark characters broadcast at once; more items go in further passes
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_MIX), -1, 1 << 64))
SCHEMA = "doc_id long, item_id long, coverage double, covered_words long, n_tiles long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()),
                    ("covered_words", pa.int64()), ("n_tiles", pa.int64())])


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of all windows of ``size`` numbers, running:
    sums of numbers times powers, of which each window takes a difference and shifts
    it back to power zero, so the work does not depend on the size."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(ids), _MIX), _powers(n, _BACK)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * up, out=sums[1:])
    out = (sums[size:] - sums[:n]) * down
    return out ^ (out >> np.uint64(29))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def common_run(doc: np.ndarray, item: np.ndarray, size: int) -> tuple[int, int] | None:
    """First place (in the item, then the document) where both have the same
    ``size`` numbers, none of them zero; equal hashes are compared in full."""
    a, b = windows(doc, size), windows(item, size)
    whole = np.cumsum(np.r_[0, doc == 0])
    a_ok = whole[size:] == whole[:-size]
    order = np.flatnonzero(a_ok)[np.argsort(a[a_ok], kind="stable")]
    at = np.searchsorted(a[order], b)
    for j in np.flatnonzero(at < len(order)).tolist():
        k = at[j]
        while k < len(order) and a[order[k]] == b[j]:
            i = int(order[k])
            if (item[j:j + size] != 0).all() and (doc[i:i + size] == item[j:j + size]).all():
                return i, j
            k += 1
    return None


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the document, place in the item, length)."""
    doc, item = doc.copy(), item.copy()
    out = []
    most = min(len(doc), len(item))
    while most >= least:
        low, high, best = least, most, None
        while low <= high:  # a common run of some length contains all shorter ones
            mid = (low + high) // 2
            got = common_run(doc, item, mid)
            if got:
                best, low = (*got, mid), mid + 1
            else:
                high = mid - 1
        if best is None:
            break
        i, j, most = best
        out.append(best)
        doc[i:i + most] = 0
        item[j:j + most] = 0
    return out


class Items:
    """One block of benchmark items, indexed by seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        self.short: dict[int, dict[tuple, list[int]]] = {}
        for item_id, text in rows:
            split = words(text or "")
            if len(split) < SHORTEST:
                continue
            item = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split]
            if len(item) < SEED_WORDS:
                self.short.setdefault(len(item), {}).setdefault(tuple(item), []).append(item_id)
            else:
                self.ids.append(item_id)
                self.items.append(np.array(item, np.uint64))
        self.short_hashes = {n: windows(np.array([i for item in held for i in item], np.uint64), n)[::n]
                             for n, held in self.short.items()}
        seeds = [windows(i, SEED_WORDS) for i in self.items]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        every = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[order], owner[order]

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, covered words, tiles) of items that a text contains."""
        get = self.vocabulary.get
        split = words(text)
        ids = np.fromiter((get(w, 0) for w in split), np.uint64, len(split))
        out = [(item, 1.0, n, 1) for n in self.short for item in self._whole(ids, n)]
        known = np.cumsum(np.r_[0, ids != 0])
        at = np.flatnonzero(known[SEED_WORDS:] - known[:-SEED_WORDS] == SEED_WORDS) \
            if len(ids) >= SEED_WORDS else []
        if not len(at):
            return out
        seeds = windows(ids, SEED_WORDS)[at]
        left = np.searchsorted(self.seeds, seeds, "left")
        right = np.searchsorted(self.seeds, seeds, "right")
        places: dict[int, list[int]] = {}
        for p, lo, hi in zip(at.tolist(), left.tolist(), right.tolist()):
            for item in set(self.owner[lo:hi].tolist()):
                places.setdefault(item, []).append(p)
        for k, found in places.items():
            near = np.zeros(len(ids) + 1, bool)  # only words under a seed can be in a tile
            for i in range(SEED_WORDS):
                near[np.array(found) + i] = True
            keep = near | np.r_[False, near[:-1]]  # with one gap after each stretch
            part = np.where(near[:-1], ids, 0)[keep[:-1]]
            got = tiles(part, self.items[k])
            covered = sum(t[2] for t in got)
            coverage = covered / len(self.items[k])
            if coverage >= COVERAGE:
                out.append((self.ids[k], coverage, covered, len(got)))
        return out

    def _whole(self, ids: np.ndarray, n: int) -> list[int]:
        """Short items of ``n`` words that stand in a text as they are."""
        hits = np.flatnonzero(np.isin(windows(ids, n), self.short_hashes[n]))
        return sorted({item for p in hits.tolist()
                       for item in self.short[n].get(tuple(ids[p:p + n].tolist()), ())})


def _pass(docs: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        index = Items(block.value)

        def part(batch):
            out = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(),
                                           batch.column("text").to_pylist())
                   for m in index.matches(t)]
            return [pa.array([r[i] for r in out], _ARROW.field(i).type) for i in range(5)]
        yield from common.per_chunk(part, _ARROW)(batches)
    return common.texts(docs).mapInArrow(run, SCHEMA)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in blocks of about ``BLOCK_CHARS`` characters; the driver holds one."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct().toLocalIterator():
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    yield block


def _each(benchmark: DataFrame, apply: Callable[[list], DataFrame]) -> Iterator[DataFrame]:
    """``apply`` for every block; if there are several, each result is written
    before the next block is read, so that no more than one is held."""
    found = blocks(benchmark)
    block = next(found)
    for following in found:
        yield materialise(apply(block), "tiles")
        block = following
    yield apply(block)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, ...) of every contaminated document.

    Each block of items is broadcast and held against all documents, whatever
    the size of the benchmark.
    """
    return reduce(DataFrame.unionByName, _each(benchmark, lambda block: _pass(docs, block)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no benchmark item."""
    left = docs

    def apply(rows):
        block = docs.sparkSession.sparkContext.broadcast(rows)

        def judge():
            index = Items(block.value)
            return lambda text: not index.matches(text)
        return common.keep_rows(left, judge)
    for result in _each(benchmark, apply):
        left = result
    return left
