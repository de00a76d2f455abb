"""Removal of repeated byte strings by a hash-compared suffix sort.

Runs that share an anchor gram (see ``repeats``) are sorted by the text from
their anchor on.  Two suffixes are compared by binary search over prefix hashes
for their common length, then by the byte behind it, in a merge sort; the common
length of neighbours is kept, and hash matches are verified against the bytes.
For each offset of a window before the anchor, neighbours that agree far enough
to the right form intervals, and within these equal hashes to the left are equal
windows.  No pair of texts is compared with each other beyond that.

Defined cases: null texts are empty; texts shorter than the length keep every
byte; documents that repeat count as repeats of one another, whatever their ids;
matches never cross documents.
"""

from __future__ import annotations

import sys
from functools import cmp_to_key

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from fundflow.llm import repeats

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
GRAM = 96


def resolve(rows: list[tuple], length: int) -> list[np.ndarray]:
    """Mask of the repeated windows of each run (g, f, left, units)."""
    units = [repeats.byte_units(r[3]) for r in rows]
    sizes = np.array([len(u) for u in units])
    base = np.cumsum(np.r_[0, sizes[:-1]])
    every = np.concatenate(units)
    prefix = repeats.Prefix(every, repeats.Powers())
    left = np.array([r[2] for r in rows])
    anchor = base + left
    right = base + sizes - anchor  # units from the anchor on
    # views that give plain numbers: the comparison below is called one pair at a time
    sums, down = memoryview(prefix.sums), memoryview(prefix.down)
    at, reach, low64 = anchor.tolist(), right.tolist(), (1 << 64) - 1

    def shared(i: int, j: int) -> int:
        a, b, low, high = at[i], at[j], 0, min(reach[i], reach[j])
        while low < high:  # the longest equal stretch
            mid = (low + high + 1) // 2
            if (((sums[a + mid] - sums[a]) * down[a]) ^ ((sums[b + mid] - sums[b]) * down[b])) & low64:
                high = mid - 1
            else:
                low = mid
        return low

    def compare(i: int, j: int) -> int:
        n = shared(i, j)
        if n == min(reach[i], reach[j]):
            return reach[i] - reach[j]
        return -1 if every[at[i] + n] < every[at[j] + n] else 1

    order: list[int] = []
    start = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][0] != rows[start][0]:
            order += sorted(range(start, k), key=cmp_to_key(compare))  # a merge sort
            start = k
    common_ = np.full(len(order), -1)
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        if rows[i][0] == rows[j][0]:
            n = shared(i, j)
            while n and not np.array_equal(every[at[i]:at[i] + n], every[at[j]:at[j] + n]):
                n //= 2  # a collision
            common_[k] = n
    index = np.array(order)
    s_anchor, s_left, s_right = anchor[index], left[index], right[index]
    masks = [np.zeros(max(0, n - length + 1), bool) for n in sizes]
    for offset in range(int(left.max()) + 1):
        valid = (s_left >= offset) & (s_right >= length - offset)
        if valid.sum() < 2:
            continue
        interval = np.cumsum(common_ < length - offset)[valid].astype(np.uint64)
        a = s_anchor[valid]
        key = repeats.mix(prefix.of(a - offset, a) + repeats.mix(interval))
        _, back, held = np.unique(key, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(valid)[held[back] > 1].tolist():
            masks[order[k]][s_left[k] - offset] = True
    return masks


def keep(raw: bytes, mask: np.ndarray) -> tuple[int, bytes]:
    spans = int((np.diff(np.r_[False, mask].astype(np.int8)) == 1).sum())
    return spans, np.frombuffer(raw, np.uint8)[~mask].tobytes() if spans else raw


KIND = repeats.Kind(repeats.byte_units, LENGTH, GRAM, resolve, keep, width=1)


def remove(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    return repeats.remove(docs, KIND, keep_text)
