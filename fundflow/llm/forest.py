"""Nearest neighbours by cosine from a forest of random-projection trees.

Each tree splits unit vectors at medians along random directions, one direction
for each level, so a row falls to its leaf by one matrix product.  Medians come
from a bounded sample; every row is put into every tree.  A query walks all
trees through one priority queue: the node that the least squared distance to
its splits has been given up for comes first.  The walk ends at a bound set by
the query's own neighbours in the sample and a ratio learned from pairs of the
sample so that ``RECALL`` of them are found; near-copies therefore end it at
once, evenly spread vectors after many leaves.

Rows and queries meet by leaf.  A leaf is dealt into parts of about ``PART``
rows; a task holds one part while its queries stream past, scores by one matrix
product, reranks the best exactly and keeps a few for each query.

Rules:

* Vectors that are null, empty, zero or hold null or non-finite entries take no
  part, nor do those whose length is not the commonest (ties: the longer).
* A row repeated whole counts once.  Rows of one id with different vectors are
  candidates of their own; as queries, each is answered, under the same id.
* An id is never its own neighbour.  Rows without an id are candidates, after
  all others in ties, and no queries.
* Of copies of one vector only the ``k + 1`` smallest ids are kept: no query can
  return more.  Scores of copies are equal to the last bit.
* An empty table has no rows.  Only the id and the vector are read.
"""

from __future__ import annotations

import heapq
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 3
LEAF = 512       # rows that a leaf is meant for
SAMPLE = 16_384  # vectors that medians and the bound are learned from
SPLIT = 16       # vectors of the sample that a leaf holds at least
PAIRS = 1_024    # vectors of the sample whose neighbours set the ratio
RECALL = 0.985   # of neighbours within the sample, which are farther than those among all rows
PART = 4_096     # rows of a leaf in one task at once
SEED = 7


@dataclass(frozen=True)
class Forest:
    directions: np.ndarray   # tree, dimension, level
    splits: tuple            # for each tree and level, the split of every node
    sample: np.ndarray       # unit vectors
    ratio: float             # of the bound to the squared distance of a neighbour
    k: int

    @property
    def depth(self) -> int:
        return self.directions.shape[2]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(unit), len(self.directions)), np.int64)
        for t, (directions, splits) in enumerate(zip(self.directions, self.splits)):
            at, node = unit @ directions, out[:, t]
            for level, split in enumerate(splits):
                node[:] = 2 * node + (at[:, level] >= split[node])
        return out

    def reach(self, unit: np.ndarray) -> np.ndarray:
        """Squared distance to the k-th neighbour in the sample; no bound where it is too small."""
        if len(self.sample) <= self.k:
            return np.full(len(unit), np.inf)
        near = np.partition(unit @ self.sample.T, -self.k - 1, axis=1)[:, -self.k - 1]  # itself counts
        return np.maximum(2 - 2 * near, 0)

    def walk(self, unit: np.ndarray) -> list[list[int]]:
        """Cells, numbered over all trees, that each query looks into."""
        bounds = self.ratio * self.reach(unit) + 1e-12
        ats = np.einsum("nd,tdl->ntl", unit, self.directions)
        size, out = 1 << self.depth, []
        for at, bound in zip(ats, bounds):
            found, queue = [], [(0.0, t, 0, 0) for t in range(len(self.directions))]
            while queue:
                spent, t, level, node = heapq.heappop(queue)
                if spent > bound:
                    break
                if level == self.depth:
                    found.append(t * size + node)
                    continue
                margin = at[t, level] - self.splits[t][level][node]
                near = 2 * node + (margin >= 0)
                heapq.heappush(queue, (spent, t, level + 1, near))
                heapq.heappush(queue, (spent + margin * margin, t, level + 1, near ^ 1))
            out.append(found)
        return out


def grow(sample: np.ndarray, n: int, k: int, trees: int = TREES, leaf: int = LEAF,
         recall: float = RECALL, seed: int = SEED) -> Forest:
    """A forest for ``n`` vectors, from unit vectors of a sample of them."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    depth = max(0, int(np.ceil(np.log2(max(n / leaf, 1)))))
    depth = min(depth, int(np.log2(max(len(sample) / SPLIT, 1))))
    directions = np.empty((trees, dims, depth))
    splits = []
    for t in range(trees):
        blocks = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-depth // dims))]
        if depth:
            directions[t] = np.concatenate(blocks, axis=1)[:, :depth]
        at, node, levels = sample @ directions[t], np.zeros(len(sample), np.int64), []
        for level in range(depth):
            order = np.lexsort((at[:, level], node))
            edges = np.searchsorted(node[order], np.arange((1 << level) + 1))
            middle = np.minimum((edges[:-1] + edges[1:]) // 2, len(sample) - 1)
            split = at[order[middle], level]
            levels.append(split)
            node = 2 * node + (at[:, level] >= split[node])
        splits.append(levels)
    forest = Forest(directions, tuple(splits), sample, np.inf, k)
    return Forest(directions, tuple(splits), sample, _ratio(forest, recall, rng), k)


def _ratio(forest: Forest, recall: float, rng) -> float:
    """What a walk must spend, over the squared distance of the k-th neighbour,
    to find ``recall`` of the neighbours within the sample."""
    sample, k = forest.sample, forest.k
    if len(sample) <= k + 1 or not forest.depth:
        return np.inf
    some = np.sort(rng.permutation(len(sample))[:PAIRS])
    unit = sample[some]
    best = np.empty((len(some), k), np.int64)
    for start in range(0, len(some), 64):  # small blocks: the driver holds little
        near = unit[start:start + 64] @ sample.T
        near[np.arange(len(near)), some[start:start + 64]] = -2
        best[start:start + 64] = np.argpartition(-near, k, axis=1)[:, :k]
    reach = np.concatenate([forest.reach(unit[i:i + 64]) for i in range(0, len(unit), 64)])
    reach = np.maximum(reach, 1e-12)
    leaves = forest.leaves(sample)
    least = np.full(best.shape, np.inf)
    for t, (directions, splits) in enumerate(zip(forest.directions, forest.splits)):
        at, spent = unit @ directions, np.zeros(best.shape)
        goal = leaves[:, t][best]
        for level, split in enumerate(splits):
            node = goal >> (forest.depth - level)
            right = (goal >> (forest.depth - level - 1)) & 1
            margin = at[:, level][:, None] - split[node]
            spent += np.where((margin >= 0) == (right == 1), 0, margin * margin)
        least = np.minimum(least, spent)
    return float(np.quantile(least / reach[:, None], recall))


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): distinct rows whose vector can be compared."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    rows = rows.filter((F.size("v") > 0)
                       & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
                       & F.exists("v", lambda c: c != 0))
    commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (commonest["d"] if commonest else 0)).distinct()


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _cells(forest: Forest):
    """Rows of an index: each vector once for each tree."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                size = 1 << forest.depth
                cells = forest.leaves(_unit(_matrix(batch))) + np.arange(len(forest.directions)) * size
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(list(cells))], names=[*batch.schema.names, "cells"])
    return run


def _walks(forest: Forest):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                some = batch.slice(start, 128)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(forest.walk(_unit(_matrix(some))), pa.list_(pa.int64()))],
                    names=[*some.schema.names, "cells"])
    return run


_SPARE = 16  # beyond k, scores of the matrix product that are computed again


def _rerank(k: int):
    """Rows of one (cell, part) and then its queries, in order: the best of each query."""
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()),
                        ("score", pa.float64())])

    def best(rows, units, ids, queries):
        asked = _unit(_matrix(queries))
        rough = asked @ units.T
        take = min(len(units), k + 1 + _SPARE)
        near = np.argpartition(-rough, take - 1, axis=1)[:, :take]
        exact = _cosines(_matrix(queries), rows, near)
        out = []
        for query, key, places, scores in zip(queries.column("id").to_pylist(),
                                              queries.column("query_key").to_pylist(), near, exact):
            found = sorted((-s, other is None, other or 0) for p, s in zip(places.tolist(), scores.tolist())
                           for other in ids[p] if other != query)[:k]
            out.extend((query, key, None if none else other, -s) for s, none, other in found)
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type)
                                           for i, f in enumerate(schema)], schema=schema)

    def run(batches):
        held, key = [], None
        ready = None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("cell", "part")]
                             + [batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)])
            edges = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(0), True])
            for start, end in zip(edges[:-1], edges[1:]):
                some = batch.slice(start, end - start)
                if key != tuple(where[:2, start]):
                    held, key, ready = [], tuple(where[:2, start]), None
                if not where[2, start]:
                    held.append(some)
                    continue
                if ready is None and held:
                    rows = np.concatenate([_matrix(h) for h in held])
                    ready = rows, _unit(rows), [i for h in held for i in h.column("ids").to_pylist()]
                    held = []
                if ready is not None:
                    for at in range(0, some.num_rows, 512):
                        yield best(*ready, some.slice(at, 512))
    return run


def _cosines(asked: np.ndarray, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Cosine of each query with its places, row by row, so that it does not
    depend on what else is computed."""
    def scaled(v):
        top = np.abs(v).max(axis=1, keepdims=True)
        plain = (top > 1e-100) & (top < 1e100)  # squares stay in range
        return np.where(plain, v, v / top)
    asked, rows = scaled(asked), scaled(rows)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    out = np.empty(near.shape)
    for i, (q, places) in enumerate(zip(asked, near)):
        out[i] = np.einsum("ij,j->i", rows[places], q) / (np.sqrt(np.einsum("i,i->", q, q)) * norms[places])
    return out


def nearest(vectors: DataFrame, asks: Column, k: int = 5, key: str = "vec_id",
            column: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` that ``asks``,
    a condition on ``id``, picks, against all rows."""
    distinct = materialise(usable(vectors, key, column), "vectors", rebalance=False)
    same = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    copies = distinct.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    index = materialise(copies.groupBy("v").agg(F.collect_list("id").alias("some"),
                                                F.max(F.col("id").isNull()).alias("open"))
                        .select("v", F.when(F.col("open"), F.concat("some", F.array(F.lit(None).cast("long"))))
                                .otherwise(F.col("some")).alias("ids")), "index", rebalance=False)
    n = index.count()
    taken = index.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toPandas()["v"]
    sample = _unit(np.array(taken.tolist(), np.float64)) if n else np.zeros((0, 1))
    forest = grow(sample, n, k, **options)
    shared = _shared(vectors, forest)

    kind = vectors.schema[column].dataType.simpleString()
    rows = index.mapInArrow(shared(_cells), f"v {kind}, ids array<long>, cells array<long>") \
        .select("v", "ids", F.explode("cells").alias("cell"))
    # one row for each cell of the forest, whose size the sample bounds
    parts = materialise(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")),
                        "parts", rebalance=False)
    rows = rows.join(F.broadcast(parts), "cell").select(
        "cell", F.pmod(F.xxhash64("v"), "parts").alias("part"), F.lit(False).alias("asks"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("query_key"), "ids", "v")
    queries = distinct.filter(asks).select("v", "id").mapInArrow(
        shared(_walks), f"v {kind}, id long, cells array<long>") \
        .select("v", "id", F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell") \
        .select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                F.lit(True).alias("asks"), "id", F.xxhash64("v").alias("query_key"),
                F.lit(None).cast("array<long>").alias("ids"), "v")
    met = rows.unionByName(queries).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
    found = met.mapInArrow(_rerank(k), "query_id long, query_key long, vec_id long, score double")
    query = Window.partitionBy("query_id", "query_key").orderBy(
        F.desc("score"), F.col("vec_id").asc_nulls_last())
    # a neighbour comes once from each tree at most; the first limit runs before the shuffle
    few = found.withColumn("rank", F.row_number().over(query)) \
        .filter(F.col("rank") <= k * len(forest.directions)).drop("rank").distinct()
    return few.withColumn("rank", F.row_number().over(query)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _shared(vectors: DataFrame, forest: Forest):
    """Functions of a forest for tasks; it travels as one broadcast of bounded
    size, by value, so that executors need no installed package."""
    sent = vectors.sparkSession.sparkContext.broadcast(cloudpickle.dumps(forest))

    def of(make):
        def run(batches):
            yield from make(cloudpickle.loads(sent.value))(batches)
        return run
    return of
