"""Merkle manifest of a table: a leaf for each row, a tree for each source, one
tree over the sources, and a proof for every row.

The work is a cogrouped subtree exchange.  Nodes of a tree are numbered by a
range sort and dealt into superblocks of ``BLOCK`` consecutive nodes.  On the
way up each superblock is reduced to one node, and those nodes are dealt again,
until every source has one.  On the way down the nodes of a superblock meet the
one outer node that stands above it, with the siblings from there to the root:
``applyInPandas`` over the cogroup finishes the local reduction, joins the
siblings inside the superblock to the outer ones and folds every proof.  A
group holds at most two superblocks, however large its source, and small trees
share groups.

Rules:

* A field that is null counts as ``-``; an empty text as ``0:``.
* Order inside a source: null ids first, then by id, rows of one id by their
  leaf.  Sources: null first, then by UTF-8 bytes.  Repeated rows are leaves of
  their own.
* An empty table has no root and no rows.  A lone leaf is its source's root, a
  lone source's root is the root; a row without any sibling has an empty proof.
* Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm import common
from fundflow.session import materialise, materialise_observed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT, DEPTH = 3, 6
BLOCK = FANOUT ** DEPTH  # nodes of a superblock
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # of monotonically_increasing_id: the row inside its partition
_ROWS = (1 << _ROW_BITS) - 1

_NODE = "tree string, pos long, m long, start long, hash string"
_PATH = ("pos long, m long, start long, lefts array<string>, rights array<string>, "
         "subroot string, root string")
_PROVED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
           "folded_root string, verified boolean")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: every field as its byte count, a colon and its value."""
    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with ``pos`` (place inside their ``tree``), ``m`` (rows of the tree)
    and ``start`` (place of the tree's first row in the whole order).

    A range sort spreads a large tree over many partitions; counts for each
    (partition, tree) then give every row its place.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("at", F.monotonically_increasing_id()), name, rebalance=False)
    part = F.shiftright("at", _ROW_BITS)
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stats = (placed.groupBy(part.alias("part"), "tree")
             .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
             .select("part", F.col("tree").alias("t"), "first",
                     F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                     F.sum("n").over(tree).alias("m"), F.min("first").over(tree).alias("start")))
    return (placed.join(stats, (part == stats["part"]) & placed["tree"].eqNullSafe(stats["t"]))
            .withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
            .drop("part", "t", "first", "before", "at"))


def _groups(small: Column, block: Column) -> tuple[Column, Column]:
    """Key of an exchange: a superblock of a large tree, or the small trees that
    begin within one stretch of ``BLOCK`` rows."""
    part = F.shiftleft(F.shiftright("start", _ROW_BITS), _ROW_BITS)
    near = part + F.floor(F.col("start").bitwiseAND(F.lit(_ROWS)) / BLOCK)
    return (F.when(small, near).otherwise(F.col("start")).alias("x"),
            F.when(small, F.lit(-1)).otherwise(block).cast("long").alias("y"))


def below(nodes: DataFrame) -> DataFrame:
    """Nodes with the key of their own superblock."""
    return nodes.select("*", *_groups(F.col("m") <= BLOCK, F.floor(F.col("pos") / BLOCK)))


def above(nodes: DataFrame) -> DataFrame:
    """Nodes with the key of the superblock that they stand for."""
    return nodes.select("*", *_groups(F.col("m") == 1, F.col("pos")))


def reduction(nodes: list[str], m: int) -> list[list[str]]:
    """Levels of a superblock of a tree with ``m`` nodes, from the given one up."""
    out = [nodes]
    while len(out) <= DEPTH if m > BLOCK else len(out[-1]) > 1:
        row = out[-1]
        out.append([digest(*row[i:i + FANOUT]) for i in range(0, len(row), FANOUT)])
    return out


def siblings(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """For each level, what stands left and right of node ``i`` in its run."""
    lefts, rights = [], []
    for row in levels[:-1]:
        first = i - i % FANOUT
        lefts.append("".join(row[first:i]))
        rights.append("".join(row[i + 1:first + FANOUT]))
        i //= FANOUT
    return lefts, rights


def fold(node: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in zip(lefts, rights):
        node = digest(left, node, right)
    return node


def _blocks(group: pd.DataFrame):
    """(start, block, m, rows in order) of every tree in a group."""
    group = group.assign(block=group["pos"] // BLOCK).sort_values(["start", "pos"])
    for (start, block), rows in group.groupby(["start", "block"], sort=False):
        yield int(start), int(block), int(rows["m"].iloc[0]), rows


def _reduce(group: pd.DataFrame) -> pd.DataFrame:
    out = [(rows["tree"].iloc[0], block, -(-m // BLOCK), start,
            reduction(rows["hash"].tolist(), m)[-1][0])
           for start, block, m, rows in _blocks(group)]
    return pd.DataFrame(out, columns=["tree", "pos", "m", "start", "hash"])


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Nodes of each exchange, from the given ones to one for each tree."""
    levels = [nodes]
    while True:
        up = below(levels[-1]).select("tree", "pos", "m", "start", "hash", "x", "y") \
            .groupBy("x", "y").applyInPandas(_reduce, _NODE)
        up, seen = materialise_observed(up, name, F.max("m").alias("m"))
        levels.append(up)
        if (seen["m"] or 1) == 1:
            return levels


def _meet(nodes: pd.DataFrame, outer: pd.DataFrame):
    """(row, node, siblings from it to the root, subroot, root) of a cogroup."""
    over = {(o.start, o.pos): o for o in outer.itertuples(index=False)}
    for start, block, m, rows in _blocks(nodes):
        top = over[start, block]
        levels = reduction(rows["hash"].tolist(), m)
        for i, row in enumerate(rows.itertuples(index=False)):
            lefts, rights = siblings(levels, i)
            yield row, lefts + list(top.lefts), rights + list(top.rights), top


def _extend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    out = [(r.pos, r.m, r.start, lefts, rights, top.subroot, top.root)
           for r, lefts, rights, top in _meet(nodes, outer)]
    return pd.DataFrame(out, columns=["pos", "m", "start", "lefts", "rights", "subroot", "root"])


def _prove(with_siblings: bool):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, lefts, rights, top in _meet(nodes, outer):
            shown = r.hash if r.tampered is None else r.tampered
            folded = fold(shown, lefts, rights)
            proof = digest(*(x for pair in zip(lefts, rights) for x in pair))
            out.append((r.doc_id, r.hash, top.subroot, top.root, proof, folded, folded == top.root)
                       + ((lefts, rights) if with_siblings else ()))
        names = [c.split()[0] for c in _PROVED.split(", ")] + ["lefts", "rights"] * with_siblings
        made = pd.DataFrame(out, columns=names)
        return made.astype({"doc_id": "Int64"})
    return run


def descend(levels: list[DataFrame], outer: DataFrame, finish, schema: str) -> DataFrame:
    """``outer``: paths of the last level.  ``finish`` makes the rows of the first."""
    for i in range(len(levels) - 2, -1, -1):
        fn, ddl = (finish, schema) if i == 0 else (_extend, _PATH)
        outer = below(levels[i]).groupBy("x", "y").cogroup(above(outer).groupBy("x", "y")) \
            .applyInPandas(fn, ddl)
        if i:
            outer = materialise(outer, "paths", rebalance=False)
    return outer


def _source_paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Like ``_extend``, for subroots: each keeps the start of its own tree."""
    out = [(0, 1, r.origin, lefts, rights, r.hash, top.root)
           for r, lefts, rights, top in _meet(nodes, outer)]
    return pd.DataFrame(out, columns=["pos", "m", "start", "lefts", "rights", "subroot", "root"])


def manifest(docs: DataFrame, shown: Column | None = None, fields: Sequence[str] = FIELDS,
             with_siblings: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every
    row, with ``lefts`` and ``rights``, the siblings of each level, on request.

    ``shown`` is the text that somebody presents for a row, null where it is the
    stored one: ``verified`` tells whether it folds to the root.
    """
    columns = [F.col(c) for c in fields]
    presented = [F.col("_shown") if c == "text" else F.col(c) for c in fields]
    shown = F.lit(None).cast("string") if shown is None else shown
    leaves = docs.select(*fields, shown.alias("_shown")).select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(columns).alias("hash"),
        F.when(F.col("_shown").isNotNull(), leaf(presented)).alias("tampered"))
    # hashed once and written: the range sort reads its rows twice
    nodes = numbered(materialise(leaves, "leaves", rebalance=False), ["doc_id", "hash"], "ordered")
    levels = climb(nodes, "blocks")
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash",
                                 F.col("start").alias("origin"))
    sources = climb(numbered(subroots, ["source"], "sources"), "source-blocks")
    top = sources[-1].select("pos", "m", "start", F.array().cast("array<string>").alias("lefts"),
                             F.array().cast("array<string>").alias("rights"),
                             F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    outer = materialise(descend(sources, top, _source_paths, _PATH), "outer", rebalance=False)
    schema = _PROVED + ", lefts array<string>, rights array<string>" * with_siblings
    return descend(levels, outer, _prove(with_siblings), schema)


def without_newlines(key: str = "doc_id") -> Column:
    """The text as it comes back from a tool that deletes line feeds from rows
    whose id has an even crc32; null for the others, and where the id is null."""
    return F.when(F.col(key).isNotNull() & (common.bucket_of(key, 2) == 0),
                  F.replace(F.col("text"), F.lit("\n"), F.lit("")))
