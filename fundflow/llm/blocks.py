"""Removal of repeated word sequences by fixed-block anchors.

Runs that share an anchor gram (see ``repeats``) are cut into non-overlapping
reference blocks, which are indexed by hash.  Every rolling window of block
length probes the index; a block of half the wanted length (rounded) lies in
any repeat, at whatever phase.  Hits are extended over the words around them,
and stretches equal over the wanted length are repeats.  Only these runs need
it: a run that stands twice as a whole is a repeat without a probe.

Defined cases: null texts have no word; texts shorter than the length keep every
word; documents that repeat count as repeats of one another, whatever their ids;
windows never cross documents.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from fundflow.llm import repeats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 35
GRAM = 6


def resolve(rows: list[tuple], length: int) -> list[np.ndarray]:
    """Mask of the repeated windows of each run (g, f, left, units)."""
    block = (length + 1) // 2
    units = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(u) for u in units])
    base = np.cumsum(np.r_[0, sizes[:-1]])
    prefix = repeats.Prefix(np.concatenate(units), repeats.Powers())
    total, owner = int(sizes.sum()), np.repeat(np.arange(len(rows)), sizes)
    bucket = np.unique([r[0] for r in rows], return_inverse=True)[1].astype(np.uint64)
    place = np.arange(total)
    inside = place - base[owner]

    def hashes(at: np.ndarray, size: int) -> np.ndarray:
        return repeats.mix(prefix.of(at, at + size) + repeats.mix(bucket[owner[at]]))

    probes = place[inside + block <= sizes[owner]]
    seen = hashes(probes, block)
    anchors = inside[probes] % block == 0  # the non-overlapping reference blocks
    index = np.unique(seen[anchors])
    slot = np.minimum(np.searchsorted(index, seen), len(index) - 1)
    probed = index[slot] == seen
    # a hit needs the block in at least two places
    _, back, held = np.unique(seen[probed], return_inverse=True, return_counts=True)
    hits = probes[probed][held[back] > 1]
    # extend each hit: windows of the full length around it
    near = np.zeros(total + 1, np.int32)
    np.add.at(near, np.maximum(hits - (length - block), base[owner[hits]]), 1)
    np.add.at(near, hits + 1, -1)
    starts = np.flatnonzero((np.cumsum(near[:total]) > 0) & (inside + length <= sizes[owner]))
    masks = [np.zeros(max(0, n - length + 1), bool) for n in sizes]
    if len(starts):
        _, back, held = np.unique(hashes(starts, length), return_inverse=True, return_counts=True)
        for at in starts[held[back] > 1].tolist():
            masks[owner[at]][inside[at]] = True
    return masks


def keep(raw: bytes, mask: np.ndarray) -> tuple[int, bytes]:
    words = raw.split()
    spans = int((np.diff(np.r_[False, mask].astype(np.int8)) == 1).sum())
    return spans, b" ".join(w for w, gone in zip(words, mask.tolist()) if not gone) if spans \
        else b" ".join(words)


KIND = repeats.Kind(repeats.word_units, LENGTH, GRAM, resolve, keep)


def remove(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    return repeats.remove(docs, KIND, keep_text)
