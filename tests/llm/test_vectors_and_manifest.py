"""Whitening, nearest neighbours and the manifest against brute force; edge cases."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fundflow.llm import forest, merkle, queries, whitening


def _vectors(spark, rows, kind=pa.float32(), **more):
    ids, vectors = zip(*rows) if rows else ((), ())
    return spark.createDataFrame(pa.table({
        "vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(kind)),
        **{k: pa.array([v] * len(ids), pa.string() if v is None or isinstance(v, str) else None)
           for k, v in more.items()}}))


_CLASH = {"x": "x", "v": "v", "id": "i", "cell": "c", "part": None, "n": "n", "label": None, "tree": "t"}


# --- whitening ---------------------------------------------------------------

def _whitened_by_hand(rows, d, most=16):
    grid = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in enumerate(v for _, v in rows)}
    fit = sorted({tuple(x) for x in grid.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    out = []
    for (key, _), x in zip(rows, grid.values()):
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ q / np.sqrt(e)
        out.append((key, dev, w))
    return n, out, e / np.trace(v), e


@pytest.mark.parametrize("seed", [1, 2])
def test_whitening_equals_double_precision(spark, seed):
    rng = np.random.default_rng(seed)
    d = 20
    x = rng.standard_normal((300, d)) * np.linspace(2, 1, d)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]          # a large group of copies
    df = _vectors(spark, rows, **_CLASH).repartition(5)
    grid = whitening.on_grid(df)
    model = whitening.fit(grid)
    got = whitening.by_component(grid, model).toPandas()
    n, want, explained, _ = _whitened_by_hand([(i, np.float32(v)) for i, v in rows], d)
    assert len(got) == len(rows) * 16 and set(got["n"]) == {n} and n == 300
    g = got.pivot(index="vec_id", columns="component", values="whitened")
    hand = np.array([w for _, _, w in want])
    sign = np.sign((g.to_numpy() * hand).sum(0))
    assert np.abs(g.to_numpy() * sign - hand).max() < 1e-9
    deviations = got[got["component"] == 1].set_index("vec_id")["deviation"]
    assert [deviations[i] for i, _, _ in want] == [dev for _, dev, _ in want]
    np.testing.assert_allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10


@pytest.mark.parametrize("spectrum", [
    [5.0] * 10 + [3.0] * 6, list(5 + 1e-9 * np.arange(8)) + list(3 + 1e-6 * np.arange(8)),
    [1.0] * 16, [1.0] + [0.0] * 15, list(10.0 ** -np.arange(16)), list(np.arange(16.0))])
def test_refined_eigenvectors(spectrum):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((16, 16)))[0]
    a = (q * np.array(spectrum)) @ q.T
    a = (a + a.T) / 2
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    values, x = whitening.refine(a, rough)
    assert np.abs(np.sort(values) - np.linalg.eigvalsh(a)).max() < 1e-13 * 16
    assert np.abs(x.T @ x - np.eye(16)).max() < 1e-14
    assert np.abs(a @ x - x * values).max() < 1e-13
    assert np.abs(a @ rough - rough * values).max() < 1e-5  # what the refinement began with


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    good = [(7, [1.0, 2.0]), (None, [2.0, 1.0]), (7, [1.0, 2.0]), (8, [3.0, 5.0])]
    grid = whitening.on_grid(_vectors(spark, bad + good, pa.float64()))
    got = whitening.by_component(grid, whitening.fit(grid)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted(
        (i, c) for i in (7, 7, 8, 0) for c in (1, 2))
    for rows, count in (([], 0), (bad[:5], 0), ([(1, [1.0, 2.0])] * 3, 0),       # nothing varies
                        ([(1, [0.0, 0.0]), (2, [1.0, 1.0])], 2)):                 # one direction varies
        grid = whitening.on_grid(_vectors(spark, rows, pa.float64()))
        out = whitening.by_component(grid, whitening.fit(grid))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == count
    # entries whose deviation fits in 64 bits only in part, and one beyond the grid
    rows = [(1, [0.0, 1.0]), (2, [2.0 ** 20, 3.0]), (3, [2.0 ** 21, 4.0]), (4, [1e300, -1e300])]
    grid = whitening.on_grid(_vectors(spark, rows, pa.float64()))
    got = whitening.transform(grid, whitening.fit(grid)).collect()
    assert len(got) == 4 and all(r.deviation is None for r in got)
    grid = whitening.on_grid(_vectors(spark, rows[:3], pa.float64()))
    n, want, _, _ = _whitened_by_hand(rows[:3], 2)
    assert {r.vec_id: r.deviation for r in whitening.transform(grid, whitening.fit(grid)).collect()} == {
        k: dev for k, dev, _ in want}


def test_whitening_query(spark, sf):
    got = queries.QUERIES["op11_whitening"](spark, sf).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want, explained, _ = _whitened_by_hand(rows, len(rows[0][1]))
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n}
    np.testing.assert_allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-10)
    assert got["identity_error"].max() < 1e-10


# --- nearest neighbours ------------------------------------------------------

def _nearest_by_hand(rows, asks, k=5):
    """Distinct usable rows; every other id counts, ties go to the smaller id."""
    usable = {(i, tuple(v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)
              and any(v)}
    out = {}
    for q, a in usable:
        if q is None or not asks(q):
            continue
        a64 = np.array(a, np.float64)
        found = []
        for i, b in usable:
            if i != q and len(b) == len(a):
                b64 = np.array(b, np.float64)
                found.append((-(a64 @ b64) / np.sqrt((a64 @ a64) * (b64 @ b64)), i is None, i or 0))
        out[q, a] = sorted(found)[:k]
    return out


def _answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_forest_recall(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[1000:2000] = x[0] + 0.05 * rng.standard_normal((1000, 24)).astype(np.float32)   # near-copies
    x[2000:] = x[7]                                                                   # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = _answers(forest.nearest(_vectors(spark, rows).repartition(6), F.col("id") % 50 == 0, leaf=64))
    want = _nearest_by_hand(rows, lambda i: i % 50 == 0)
    hits = total = 0
    for (q, _), best in want.items():
        assert len(got[q]) == 5
        least = best[-1][0]
        hits += sum(-s <= least + 1e-12 for _, s in got[q])
        total += 5
        if q >= 2000:  # copies: the five smallest other ids, all at the same score
            assert [i for i, _ in got[q]] == [7, 2000, 2001, 2002, 2003, 2004][:5] if q not in range(2000, 2004) \
                else [i for i in (7, 2000, 2001, 2002, 2003, 2004) if i != q][:5] == [i for i, _ in got[q]]
            assert len({s for _, s in got[q]}) == 1
    assert hits / total >= 0.95


def test_forest_looks_into_part_of_the_rows(spark):
    """Clustered vectors: a walk ends early, and still finds the neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 100, axis=0) + 0.05 * rng.standard_normal((4000, 16))
    unit = forest._unit(x)
    grown = forest.grow(unit[rng.permutation(4000)[:2000]], 4000, 5, leaf=64)
    walks = grown.walk(unit[::50])
    assert np.mean([len(w) for w in walks]) < 0.5 * (3 << grown.depth)
    leaves = grown.leaves(unit)
    found = 0
    for at, walk in zip(range(0, 4000, 50), walks):
        seen = np.isin(leaves + np.arange(3) * (1 << grown.depth), walk).any(1)
        near = np.argsort(-(unit @ unit[at]), kind="stable")
        found += seen[near[near != at][:5]].sum()
    assert found / 400 >= 0.9


def test_forest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 1.0]),
            (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []),
            (9, [1.0, 2.0, 3.0]), (50, [-1.0, 0.0]), (100, [1e-200, 1e-200])]
    df = _vectors(spark, rows, pa.float64(), **_CLASH)
    got = _answers(forest.nearest(df.drop("id", "v", "x").withColumn("ids", F.lit(1)), F.col("id") % 50 == 0))
    want = {q: [(None if none else i, -s) for s, none, i in best]
            for (q, _), best in _nearest_by_hand(rows, lambda i: i % 50 == 0).items()}
    # by hand, the squares of 1e-200 vanish; its direction is that of (1, 1)
    assert [i for i, _ in got[0]] == [1, 100, None, 2, 50]
    assert [i for i, _ in got[50]] == [2, 100, None, 0, 1]
    assert got[0][0][1] == 1.0 and abs(got[0][1][1] - 2 ** -0.5) < 1e-15
    assert set(got) == {0, 50, 100} == set(want)
    assert forest.nearest(_vectors(spark, rows[5:11], pa.float64()), F.col("id") % 50 == 0).count() == 0
    assert forest.nearest(_vectors(spark, []), F.col("id") % 50 == 0).count() == 0
    assert forest.nearest(_vectors(spark, rows[:1]), F.col("id") % 50 == 0).count() == 0
    assert _answers(forest.nearest(_vectors(spark, rows[:3]), F.col("id") % 50 == 0)) == {0: [(1, 1.0)]}


def test_forest_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = _answers(queries.QUERIES["op12_forest"](spark, sf))
    want = {q: best for (q, _), best in _nearest_by_hand(rows, lambda i: i % 50 == 0).items()}
    assert set(got) == set(want)
    right = sum(i in {b for _, _, b in want[q]} for q, found in got.items() for i, _ in found)
    assert right >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        by_hand = {i: -s for s, _, i in _nearest_by_hand(
            [r for r in rows if r[0] == q or r[0] in dict(found)], lambda i, q=q: i == q)[
                q, tuple(dict(rows)[q])]}
        assert all(abs(by_hand[i] - s) < 1e-12 for i, s in found)


# --- manifest ----------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """(root, for each node its siblings level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            first = i - i % 3
            paths[j].append((nodes[first:i], nodes[i + 1:first + 3]))
            at[j] = i // 3
        nodes = [_h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def _manifest_by_hand(rows):
    def leaf(r, text):
        return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}"
                    for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    items = sorted(((r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None,
                     r["doc_id"] or 0, leaf(r, r["text"])), n) for n, r in enumerate(rows))
    groups = {}
    for key, n in items:
        groups.setdefault(key[:2], []).append((key[4], rows[n]))
    subs = [_tree([leaf_ for leaf_, _ in g]) for g in groups.values()]
    if not subs:
        return []
    root, tops = _tree([s for s, _ in subs])
    out = []
    for (sub, paths), top, group in zip(subs, tops, groups.values()):
        for (own, r), path in zip(group, paths):
            text, node = r["text"], own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                node = leaf(r, text.replace("\n", ""))
            for left, right in path + top:
                node = _h(*left, node, *right)
            proof = _h(*(s for left, right in path + top for s in left + right))
            out.append((r["doc_id"], own, sub, root, proof, node, node == root))
    return out


def _documents(spark, rows, **more):
    columns = {c: [r[c] for r in rows] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64()}
    return spark.createDataFrame(pa.table({
        **{c: pa.array(v, kinds.get(c, pa.string())) for c, v in columns.items()},
        **{k: pa.array([v] * len(rows)) for k, v in more.items()}}))


def _doc(i, source, text):
    return {"doc_id": i, "source": source, "lang": None if i and i % 3 else "en",
            "n_chars": None if text is None else len(text), "text": text}


def _same(got, want):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("case", ["mixed", "hot", "lone", "many", "empty"])
def test_manifest(spark, case):
    if case == "mixed":
        rows = [_doc(i, None if i % 7 == 0 else f"s{i % 5}é", f"line {i}\nmore\n" * (i % 4)) for i in range(90)]
        rows += [_doc(None, "s1é", None), _doc(None, None, "\n"), _doc(5, "s0é", ""), rows[3], rows[3],
                 _doc(1000, "alone", "a\nb"), _doc(1002, "long", "word \n" * 30_000), _doc(-4, "", None)]
    elif case == "hot":  # one source of several superblocks of superblocks' size, others small
        rows = [_doc(i * 7 % 1999, "hot" if i % 8 else f"s{i % 40}", f"t{i}\n") for i in range(1999)]
    elif case == "lone":
        rows = [_doc(4, "only", "x\ny")]
    elif case == "many":
        rows = [_doc(i, f"s{i % 800}", f"t{i}\n") for i in range(900)]
    else:
        rows = []
    docs = _documents(spark, rows, hash="h", tree="t", pos=1, m=2, start=3, at=4, _shown="q", x=1, y=2)
    got = merkle.manifest(docs.repartition(4), merkle.without_newlines())
    _same(got, _manifest_by_hand(rows))


def test_manifest_over_more_exchanges(spark, monkeypatch):
    """Superblocks of nine nodes: several rounds up and down."""
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [_doc(i, "a" if i < 200 else f"s{i % 30}", f"t{i}\n") for i in range(300)]
    _same(merkle.manifest(_documents(spark, rows), merkle.without_newlines()), _manifest_by_hand(rows))


def test_siblings_fold_to_the_root(spark):
    rows = [_doc(i, f"s{i % 3}", f"t{i}") for i in range(40)]
    got = merkle.manifest(_documents(spark, rows), with_siblings=True).collect()
    assert len({r.root for r in got}) == 1 and all(r.verified for r in got)
    for r in got:
        assert merkle.fold(r.leaf, r.lefts, r.rights) == r.root
        assert merkle.fold(_h("other"), r.lefts, r.rights) != r.root
        assert _h(*(x for pair in zip(r.lefts, r.rights) for x in pair)) == r.proof_sha256


def test_manifest_query(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    _same(queries.QUERIES["op13_merkle"](spark, sf), _manifest_by_hand(rows))
