"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles.  Documents with equal sets form
a copy class with one representative.  Each representative samples a few of its
shingles by a hash that all share; those that sample the same shingle meet in a
bucket.  Buckets over ``SMALL`` split again on further sampled shingles; the
rest are compared by brute force, short sets by fingerprints of all their
shingles and long ones on sketches.  Several samples on the first level
are the repetitions that bring the chance of meeting at similarity 0.8 to over
0.99; the few that each path follows on later levels keep it there without
multiplying paths.
Connected candidates are then compared exactly, whole sets in blocks of bounded
size, so every link within them is found and counted without listing pairs.

Defined cases: a text of one to four words has one shingle of all its words; a
text without words, or null, has none and no link; documents that repeat are
copies of one another; rows with a null id are in classes as others are, but
give a class no id.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm import common
from fundflow.operators.cluster import components
from fundflow.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
SIMILAR = 0.8
# Shingles sampled for each level, on average.  A pair at 0.8 shares at least 0.8 of
# them: it meets in no first bucket with a chance of e^-6.4 = 0.2 %.
SAMPLED = (8, 12, 12)
# Of these, a path goes on with so many, chosen anew for each path, so that paths
# end independently: where all buckets are split twice, 0.5 % of such pairs are missed.
KEPT = (None, 3, 2)
SMALL = 500      # buckets up to this size are not split
PART = 4000      # members in one side of a comparison within a bucket
SKETCH = 48      # bytes of a sketch
# A sketch says little of a set with few shingles, so sets of up to FEW are compared
# by fingerprints of 16 bits of all shingles, and only sets from LONG by sketches.  In
# a pair at 0.8 or more with one set over FEW, the other has at least LONG shingles.
FEW, LONG = 160, 128
# Similarity of sketches: to follow a leader; of texts that may be similar (0.8 less
# four deviations).  The same of fingerprints, with room for several that collide.
JOIN, MAYBE = 0.6, 0.55
FEW_JOIN, FEW_MAYBE = 0.7, 0.7
BLOCK = 1000     # sets in one side of an exact comparison
_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SETS = pa.schema([("doc_id", pa.int64()), ("c1", pa.int64()), ("key", pa.string()), ("sketch", pa.binary()),
                   ("few", pa.binary()), ("paths", pa.list_(pa.list_(pa.int64())))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of words, the same in every process; a bounded memory."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, hasher: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    ids = hasher.of(_WORD.findall(text.lower()))
    if not len(ids):
        return ids
    size = min(WORDS, len(ids))
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mix(out * _GOLD + ids[i:len(ids) - size + 1 + i])
    return np.unique(out)


def key_of(tokens: np.ndarray) -> str:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest()


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of each of ``SKETCH`` minimum hashes: one permutation, densified
    by taking the minimum of each residue class, empty ones from the next."""
    h = _mix(tokens ^ np.uint64(0xA5A5))
    slot = (h % np.uint64(SKETCH)).astype(np.int64)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, h // np.uint64(SKETCH))
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    after = full[np.searchsorted(full, np.arange(SKETCH)) % len(full)]
    return (_mix(least[after] + (after != np.arange(SKETCH)).astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def few(tokens: np.ndarray) -> bytes:
    """Sorted distinct fingerprints of 16 bits of all shingles."""
    return np.unique(_mix(tokens ^ np.uint64(0x5A5A)) >> np.uint64(48)).astype(np.uint16).tobytes()


def paths(tokens: np.ndarray) -> list[list[int]]:
    """Sampled shingles for each level; a set no larger than the sample gives all."""
    out = []
    for level, n in enumerate(SAMPLED):
        h = _mix(tokens + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        chosen = h[h <= np.uint64(n / len(tokens) * (2 ** 64 - 2048))] if len(tokens) > n else h
        out.append(chosen.view(np.int64).tolist())
    return out


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, key, sketch, few, paths) of every document; null key without words,
    null sketch or few where the other serves all its pairs, c1 is a hash of its text."""
    def run(batches):
        hasher = WordHash()

        def part(batch):
            rows = []
            for text in batch.column("text").to_pylist():
                t = shingles(text, hasher)
                rows.append((key_of(t), sketch(t) if len(t) >= LONG else None,
                             few(t) if len(t) <= FEW else None, paths(t)) if len(t) else (None,) * 4)
            return [batch.column("doc_id"), batch.column("c1")] + [
                pa.array([r[i] for r in rows], _SETS.field(i + 2).type) for i in range(4)]
        yield from common.per_chunk(part, _SETS)(batches)
    return common.texts(docs).withColumn("c1", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, c1 long, key string, sketch binary, few binary, paths array<array<long>>")


class _Sketches:
    """Share of equal bytes of sketches."""
    join, maybe = JOIN, MAYBE

    def __init__(self, blobs: list[bytes]):
        self.pool = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), SKETCH)

    def alike(self, rows, i: int) -> np.ndarray:
        return (self.pool[rows] == self.pool[i]).sum(axis=1, dtype=np.uint8) / SKETCH


class _Fingerprints:
    """Jaccard similarity of the fingerprints of whole sets."""
    join, maybe = FEW_JOIN, FEW_MAYBE

    def __init__(self, blobs: list[bytes]):
        self.sizes = np.array([len(b) // 2 for b in blobs])
        self.pool = np.full((len(blobs), self.sizes.max()), 1 << 16, np.int32)
        self.pool[np.arange(self.pool.shape[1]) < self.sizes[:, None]] = np.frombuffer(b"".join(blobs), np.uint16)
        self.held = np.zeros((1 << 16) + 1, bool)

    def alike(self, rows, i: int) -> np.ndarray:
        own = self.pool[i, :self.sizes[i]]
        self.held[own] = True
        shared = self.held[self.pool[rows]].sum(axis=1, dtype=np.int32)
        self.held[own] = False
        return shared / (self.sizes[rows] + self.sizes[i] - shared)


def _links(keys: list[str], sets_) -> list[tuple[str, str]]:
    """Links that connect all members with a similarity of ``maybe`` or more.  A
    member near a leader follows it; one that is near none leads itself.  Links go
    from each leader to its followers and to every member that may be similar to it
    or to a follower.  Both similarities are 1 less a metric, which bounds how far
    from the leader those similar to a follower can be."""
    n_all, every = len(keys), slice(None)
    if n_all < 2:
        return []
    leaders = np.zeros(n_all, np.int64)
    follows = np.zeros(n_all, np.int64)
    n_lead = 0
    for i in range(n_all):
        follows[i] = n_lead
        if n_lead:
            near = sets_.alike(leaders[:n_lead], i)
            best = int(near.argmax())
            if near[best] >= sets_.join:
                follows[i] = best
                continue
        leaders[n_lead] = i
        n_lead += 1
    order = np.argsort(follows, kind="stable")
    ends = np.searchsorted(follows[order], np.arange(n_lead + 1))
    links, root = [], np.arange(n_all)
    for n, i in enumerate(leaders[:n_lead].tolist()):
        near = sets_.alike(every, i)
        linked = near >= sets_.maybe
        doubt = np.flatnonzero((near >= sets_.join + sets_.maybe - 1 - 1e-9) & ~linked & (follows != n))
        for f in order[ends[n]:ends[n + 1]].tolist():
            if not len(doubt):
                break
            if f != i:
                some = doubt[near[doubt] >= near[f] + sets_.maybe - 1 - 1e-9]
                if len(some):
                    some = some[sets_.alike(some, f) >= sets_.maybe]
                    linked[some] = True
                    doubt = doubt[~linked[doubt]]
        js = np.flatnonzero(linked | (follows == n))
        labels, at = np.unique(root[js], return_index=True)
        links += [(keys[i], keys[j]) for label, j in zip(labels, js[at]) if label != root[i]]
        root[np.isin(root, labels)] = labels[0]
    return links


def _leaders(batches):
    """Candidate links of each bucket (rows sorted by bucket), of its short sets and
    of its long ones.  Texts that merely share a passage are not linked; a link between
    members that earlier links connect is left out, as it connects nothing more."""
    out = pa.schema([("a", pa.string()), ("b", pa.string())])
    bucket, members = None, []

    def settle():
        links = []
        for at, kind in ((1, _Sketches), (2, _Fingerprints)):
            some = [m for m in members if m[at] is not None]
            if len(some) > 1:
                links += _links([m[0] for m in some], kind([m[at] for m in some]))
        return links

    def emit(links):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.string())
                                           for i in range(2)], schema=out)
    waiting = []
    for batch in batches:
        for b, *member in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "sketch", "few"))):
            if b != bucket:
                waiting += settle()
                bucket, members = b, []
                if len(waiting) > 10_000:
                    yield emit(waiting)
                    waiting = []
            members.append(member)
    waiting += settle()
    yield emit(waiting)


def candidates(reps: DataFrame) -> DataFrame:
    """(a, b) keys that met in a bucket and look alike; not all pairs of a
    bucket, but enough to connect all that may be similar.  A bucket that stays
    large is dealt into parts, and each two of them are compared in a task, so
    no task holds more than two parts of it."""
    rows = reps.select("key", F.explode(F.col("paths")[0]).alias("bucket"))
    ready = None
    for level in range(len(SAMPLED)):
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = materialise(rows.join(sizes, "bucket"), f"met-{level}", rebalance=False)
        last = level == len(SAMPLED) - 1
        small = met if last else met.filter(F.col("n") <= SMALL)
        ready = small if ready is None else ready.unionByName(small)
        if not last:
            rows = met.filter(F.col("n") > SMALL).select("key", "bucket").join(
                reps.select("key", F.col("paths")[level + 1].alias("more")), "key") \
                .select("key", "bucket", F.size("more").alias("_size"), F.explode("more").alias("_t")) \
                .filter(F.pmod(F.xxhash64("_t", "bucket"), F.lit(1 << 20)) * F.col("_size")
                        < KEPT[level + 1] * (1 << 20)) \
                .select("key", F.xxhash64("bucket", "_t").alias("bucket"))
    parts = F.ceil(F.col("n") / PART)
    dealt = ready.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key", "bucket"), "parts")) \
        .withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .select("key", F.when(F.col("parts") == 1, F.col("bucket")).otherwise(
            F.xxhash64("bucket", F.least("part", "peer"), F.greatest("part", "peer"))).alias("bucket"))
    found = dealt.join(reps.select("key", "sketch", "few"), "key") \
        .repartition("bucket").sortWithinPartitions("bucket", "key") \
        .mapInArrow(_leaders, "a string, b string")
    return found.distinct()


_EXACT = "key string, other string, links long"


def _exact(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of one block pair: per key the number of documents it is linked
    with, and a key to which it is connected."""
    frame = frame.drop_duplicates("key", ignore_index=True)  # rows of repeated ids
    left = np.flatnonzero(frame["side"].to_numpy() == 0)
    right = np.flatnonzero(frame["side"].to_numpy() == 1)
    same = not len(right)
    if same:
        right = left
    tokens = [np.asarray(t, np.int64) for t in frame["tokens"]]
    sizes = np.array([len(t) for t in tokens])
    every, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), sizes)
    _, column, held = np.unique(every, return_inverse=True, return_counts=True)
    keep = held[column] > 1
    every, owner = column[keep], owner[keep]
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    kinds, every = np.unique(every, return_inverse=True)
    shared = np.zeros((len(left), len(right)), np.float32)
    row = np.full(len(tokens), -1)
    for at in range(0, len(kinds), 4096):
        a, b = np.searchsorted(every, [at, at + 4096])
        grid = np.zeros((len(tokens), min(4096, len(kinds) - at)), np.float32)
        grid[owner[a:b], every[a:b] - at] = 1
        shared += grid[left] @ grid[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    linked = shared >= SIMILAR * union - 1e-6
    if same:
        np.fill_diagonal(linked, False)
    keys, copies = frame["key"].to_numpy(), frame["copies"].to_numpy()
    out = []
    root = np.arange(len(tokens))
    for i in range(len(left)):  # connect: label of the least member over links
        js = right[linked[i]]
        if len(js):
            group = np.unique(root[np.r_[left[i], js]])
            root[np.isin(root, group)] = group[0]
    n_left = linked @ copies[right]
    for i, n in zip(left, n_left):
        if n:
            out.append((keys[i], keys[root[i]], int(n)))
    if not same:
        for j, n in zip(right, copies[left] @ linked):
            if n:
                out.append((keys[j], keys[root[j]], int(n)))
    return pd.DataFrame(out, columns=["key", "other", "links"])


def _tokens(batches):
    hasher = WordHash()
    schema = pa.schema([("key", pa.string()), ("component", pa.string()), ("copies", pa.int64()),
                        ("block", pa.int64()), ("blocks", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def part(batch):
        got = [shingles(t, hasher) for t in batch.column("text").to_pylist()]
        # an id may stand on several texts; only the representative's is wanted
        own = pa.array([len(t) > 0 and key_of(t) == k for t, k in zip(
            got, batch.column("key").to_pylist())], pa.bool_())
        tokens = pa.array([t.view(np.int64) for t in got], schema.field("tokens").type)
        return [c.filter(own) for c in (*(batch.column(f.name) for f in schema if f.name != "tokens"), tokens)]
    yield from common.per_chunk(part, schema)(batches)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, c1, key, component): the class of every document (its
    smallest id, and a key that no other class has, null without words) and the number
    of other documents with similarity of 0.8 or more."""
    all_sets = materialise(sets(docs), "shingle-sets", rebalance=False)
    reps = materialise(all_sets.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct(F.isnull("doc_id"), "doc_id", "c1")).alias("whose"), F.count(F.lit(1)).alias("copies"),
        F.first("sketch").alias("sketch"), F.first("few").alias("few"), F.first("paths").alias("paths")), "representatives", rebalance=False)
    edges = materialise(candidates(reps), "candidates")
    groups = materialise(components(edges), "candidate-groups").select(
        F.col("address").alias("key"), "component")
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = groups.join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    picked = placed.join(reps.select("key", F.col("whose.doc_id").alias("_id"), F.col("whose.c1").alias("_c1"),
                                     "copies"), "key")
    texts = common.texts(docs)
    whole = texts.join(picked, texts["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(texts["text"]) == F.col("_c1")))
    mine = whole.select("text", "key", "component", "copies", "block", "blocks").mapInArrow(
        _tokens, "key string, component string, copies long, block long, blocks long, tokens array<long>")
    pairs = mine.withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select("key", "component", "copies", "tokens",
                F.least("block", "peer").alias("low"), F.greatest("block", "peer").alias("high"),
                F.when(F.col("block") <= F.col("peer"), 0).otherwise(1).alias("side"))
    exact = materialise(pairs.groupBy("component", "low", "high").applyInPandas(_exact, _EXACT), "links")
    final = components(exact.filter("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b"))) \
        .select(F.col("address").alias("key"), "component")
    links = exact.groupBy("key").agg(F.sum("links").alias("links"))
    per_key = reps.select("key", "rep", "copies").join(links, "key", "left").join(final, "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    least = per_key.groupBy("component").agg(F.min("rep").alias("class_id"))
    known = per_key.join(least, "component").select(
        "key", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return all_sets.select("doc_id", "c1", "key").join(known, "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "c1", "key", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without all but the first of each class; those without words,
    and copies of no other, stay."""
    classes = materialise(join(docs), "classes", rebalance=False)
    first = classes.filter("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.isnull("doc_id"), "doc_id", "c1")).alias("stays"))
    goes = classes.join(first, "component").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("c1") == F.col("stays.c1")))) \
        .select(F.col("doc_id").alias("_id"), F.col("c1").alias("_c1"))
    digest = common.free(docs, "_text_hash")
    rows = docs.withColumn(digest, F.xxhash64(F.coalesce("text", F.lit(""))))
    left = rows.join(goes, rows["doc_id"].eqNullSafe(goes["_id"]) & (rows[digest] == goes["_c1"]),
                     "left_anti")
    return left.dropDuplicates(["doc_id", digest]).select(*docs.columns)
