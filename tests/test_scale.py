"""Plans of joins and writes whose tables grow with the ledger."""
from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import order as N
from fundflow.functions import skew as K
from fundflow.operators import cluster as C
from fundflow.operators import exits as E
from fundflow.operators import findings as G
from fundflow.operators import graphview as V
from fundflow.operators import prices as P
from fundflow.operators import provenance as PV
from fundflow.operators import trace as TR
from fundflow.plans import catalog
from fundflow.plans import fixtures as X
from fundflow.plans import q_streams as Q
from fundflow.plans import runs as R
from fundflow.session import materialise
from fundflow.sources import labels as L
from fundflow.sources.ledger import SaltedLedger, address_activity
from fundflow.streaming import watches as WT

from helpers import frame, label_rows, movements, run, seeds

catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def traced(spark):
    return run(spark, [("t1", 1, "a", "b", "USDT", 5000), ("t2", 2, "b", "c", "USDT", 4900),
                       ("t3", 3, "c", "d", "USDT", 4800)], activity=[("d", 9)], high_activity=5)


def test_nodes_are_never_broadcast(spark, traced):
    """A few columns of a written wide table seem tiny to the planner."""
    members = materialise(frame(spark, [("b", "a"), ("c", "a")], "address string, component string"), "m")
    cases = frame(spark, [(1, 1, "fx", "finished", "a")],
                  "case_id bigint, trace_id bigint, chain string, status string, victim string")
    labels = label_rows(spark, [("b", "K", S.EXCHANGE, "s", "high")])
    for df in (TR.not_visited(traced.nodes.select(*TR.NODE_KEY), [traced.nodes]),
               C.service_label(members, traced.nodes, labels),
               C.evidence_tx(members, frame(spark, [("t", "a"), ("t", "b")], "txid string, address string"))):
        assert "Broadcast" not in plan(df)
    assert "BroadcastHashJoin [trace_id" not in plan(V.convergence(cases, traced.nodes))
    assert {r.address for r in C.service_label(members, traced.nodes, labels)
            .withColumnRenamed("service_label", "address").collect()} == {"K"}


def test_reports_meet_nodes_by_shuffle(spark, traced):
    """Folds, findings, exits and chains."""
    edges = P.value_usd(traced.edges, R.no_prices(spark))
    valued = traced.with_edges(materialise(edges, "valued", rebalance=False))
    inp = G.FindingInputs(valued)
    feeders = G.sweep_feeders(valued, inp.incoming)
    for df in (feeders, G.unidentified_service(inp, feeders), G.probable_deposit(inp, feeders),
               E.exits(valued)):
        assert "Broadcast" not in plan(df)
    assert [r.from_address for r in feeders.collect()] == ["c"]


def test_a_pegged_ledger_needs_no_price_join(spark, traced):
    """Every edge was shuffled to meet an empty price table."""
    assert "Exchange" not in plan(P.value_usd(traced.edges, R.no_prices(spark)))


def test_a_hop_does_not_shuffle_the_stored_ledger(spark):
    """the buckets hold all join keys, whatever the session requires."""
    moves = movements(spark, [(f"t{i}", i, "a", f"b{i}", "X", 100) for i in range(40)])
    stored = SaltedLedger.write(moves, buckets=2, per_salt=10, directions=(S.FORWARD,))
    assert list(stored.tables) == [S.FORWARD]
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    try:
        hop = stored.expand(seeds(spark, "a").select("chain", "address"), S.FORWARD)
        assert plan(hop).count("Exchange hashpartitioning") == 1
        assert hop.count() == 40
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        stored.drop()


def test_linking_inputs_are_read_once(spark, sf, monkeypatch):
    """edges and evidence share the written inputs."""
    R.forget()
    calls, read = [], X.cospend
    monkeypatch.setattr(X, "cospend", lambda *a: calls.append(a) or read(*a))
    out = catalog.QUERIES["cluster_rollup"](spark, sf)
    assert out.count() > 0 and len(calls) == 1


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    """a small table was one task, whatever the number of files."""
    rows = spark.range(64).coalesce(1).select("id", F.concat(F.lit("v"), "id").alias("value"))
    X.write_each(rows, "id", str(tmp_path / "each"))
    names = [p.name for p in (tmp_path / "each").glob("id=*/part-*")]
    assert len(names) == 64 and len({n.split("-")[1] for n in names}) > 1
    files = PV.block_manifest(spark, str(tmp_path / "each"), "part-*", 2)
    assert {(r.bytes, r.n_blocks) for r in files.collect()} == {(3, 2), (4, 2)}


def test_the_end_of_a_list_is_found_without_its_whole_content(spark, tmp_path):
    """a file as one row grows with the list."""
    (tmp_path / "a.xml").write_text("<sdnList>\n" + "<x/>\n" * 500 + "</sdnList>\n \n")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        L._whole_files(spark, str(tmp_path), "</sdnList>", "list")
        (tmp_path / "b.xml").write_text("<sdnList>\n" + "<x/>\n" * 500)
        with pytest.raises(ValueError, match="b.xml"):
            L._whole_files(spark, str(tmp_path), "</sdnList>", "list")
        (tmp_path / "b.xml").write_text("\n \n")
        with pytest.raises(ValueError, match="b.xml"):
            L._whole_files(spark, str(tmp_path), "</sdnList>", "list")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_a_pack_is_one_file_however_often_its_supplier_stands(spark, tmp_path):
    """packs need no folder each; rows of one supplier stay one pack."""
    frame(spark, [(1, "a"), (1, "a"), (3, "b"), (None, "c")], "s_suppkey bigint, s_name string") \
        .write.parquet(str(tmp_path / "supplier.parquet"))
    out = catalog.QUERIES["tagpack_files"](spark, str(tmp_path))
    assert sorted((r.address, r.chain) for r in out.collect()) == [
        ("1A", "doge"), ("1b", "ethereum"), ("3b", "ethereum")]


def test_many_group_statistics_meet_their_rows_by_shuffle(spark):
    """only hot groups are broadcast, the others are as many as addresses."""
    rows = frame(spark, [("a", 1), ("a", 2), ("b", 3)], "u string, x bigint")
    stats = frame(spark, [("a", "m", 20_000), ("b", "l", 1)], "u string, _m string, n bigint")
    out = K.join_group_stats(rows, stats, ["u"], 30_000)
    assert plan(out).count("BroadcastHashJoin") == 2 and "SortMergeJoin" in plan(out)
    assert sorted((r.u, r.x, r["_m"]) for r in out.collect()) == [("a", 1, "m"), ("a", 2, "m"), ("b", 3, "l")]


def test_customers_and_orders_are_never_broadcast(spark, sf):
    """Two columns of a file stand for every customer or order."""
    for df in (X.ledger(spark, sf), X.cospend(spark, sf), X.coinjoin_inputs(spark, sf)):
        assert "Broadcast" not in plan(df)


def test_inputs_are_dealt_by_transaction_once(spark):
    """the smallest input and the join share one shuffle."""
    rows = materialise(frame(spark, [("t", "b"), ("t", "a"), ("t", "c"), ("s", "d"), ("v", "a"), ("v", "c")],
                             "txid string, address string"), "linking")
    out = C.cospend_edges(rows)
    assert sorted(map(tuple, out.collect())) == [("a", "b"), ("a", "c")]
    assert "ReusedExchange" in plan(out)


def test_the_watch_list_is_written_once(spark, sf):
    """every lot of a stream read all events again for it."""
    R.forget()
    watched = Q._watched(spark, sf)
    assert "events" not in plan(watched) and Q._watched(spark, sf) is watched
    assert watched.count() > 0


def test_snapshots_in_several_pieces_are_compared_in_order():
    """pieces of a lot, late ones among them, against the state."""
    class State:
        exists, get = True, (5, "100", 10, 1)

        def update(self, value):
            self.get = value
    piece = {"chain": ["fx"], "address": ["w"], "ts": [12], "seq": [3], "tx_count": [6], "balance": ["100"]}
    older = {**piece, "ts": [9], "seq": [9], "tx_count": [1]}
    first = {**piece, "ts": [11], "seq": [2], "tx_count": [5]}
    state = State()
    out = WT._compare(("fx", "w"), iter([pd.DataFrame(p) for p in (piece, older, first)]), state)
    rows = [tuple(r) for frame in out for r in frame.itertuples(index=False)]
    assert sorted(rows) == [("fx", "w", 9, 5, 1, "100", "100", True), ("fx", "w", 12, 5, 6, "100", "100", False)]
    assert state.get == (6, "100", 12, 3)


def test_only_busy_wallets_are_counted_by_transaction(spark):
    """Every transaction of every wallet was shuffled to find a few."""
    moves = movements(spark, [("t1", 1, "a", "h", "X", 1), ("t2", 2, "b", "h", "X", 1), ("t3", 3, "c", "h", "X", 1),
                              ("t4", 4, "d", "m", "X", 1), ("t4", 4, "d", "m", "X", 2), ("t4", 4, "d", "m", "X", 3),
                              ("t5", 5, None, "z", "X", 1), ("t6", 6, None, "z", "X", 1), ("t7", 7, None, "z", "X", 1)])
    busy = address_activity(moves, above=2)
    assert "_address" in plan(busy) and "LeftSemi" in plan(busy)
    key = lambda r: (str(r.address), r.activity)
    assert sorted(map(key, busy.collect())) == [("None", 3), ("h", 3), ("z", 3)]
    assert sorted(map(key, address_activity(moves).filter("activity > 2").collect())) == sorted(map(key, busy.collect()))


def test_running_sums_take_rows_beside_their_own(spark):
    """the wallets a trace finds needed a join to the wallet that found them."""
    rows = N.placed(frame(spark, [(1, "a", 2), (1, "b", 3), (1, "c", 4), (2, "a", 5)], "g bigint, k string, v bigint"),
                    ["g"], [F.col("k").asc()], "line")
    more = rows.filter("k = 'b'").select("g", "at", F.lit(10).cast("bigint").alias("n"))
    out = N.running(rows, ["g"], {"s": F.col("v"), "n": F.lit(1).cast("bigint")}, more)
    assert sorted((r.g, r.k, r.s, r.n) for r in out.collect()) == [
        (1, "a", 0, 0), (1, "b", 2, 1), (1, "c", 5, 12), (2, "a", 0, 0)]


def test_a_level_within_its_caps_is_written_once(spark, monkeypatch):
    """edges of a level that no cap touched were shuffled and written again."""
    written, write = [], TR.materialise_observed
    monkeypatch.setattr(TR, "materialise_observed", lambda df, name, *a, **k: written.append(name) or write(df, name, *a, **k))
    moves = [("t1", 1, "a", "b", "USDT", 5000), ("t2", 2, "b", "c", "USDT", 4900), ("t3", 2, "b", "d", "USDT", 4800)]
    out = run(spark, moves, max_depth=2, max_addresses=50, max_edges=50)
    assert out.edges.count() == 3 and written.count("edges") == 2
    cut = run(spark, moves, max_depth=2, max_addresses=2, max_edges=50)
    assert cut.edges.count() == 1 and {r.role for r in cut.nodes.filter("address = 'b'").collect()} == {S.UNEXPANDED}


def test_flows_meet_a_run_once_by_each_end(spark):
    """Flows were shuffled a third time for the entries of runs."""
    columns = "trace_id bigint, chain string, from_address string, to_address string, asset string, value double, " \
              "value_raw bigint, usd_cents bigint, usd_complete boolean, n_movements bigint"
    flows = materialise(frame(spark, [(1, "fx", f, t, "X", 1.0, v, v, True, 1) for f, t, v in (
        ("a", "b", 9), ("b", "c", 8), ("c", "d", 7), ("d", "e", 6), ("a", "e", 5))], columns), "flows")
    members = materialise(frame(spark, [(1, "fx", "b", "b", 1, "a", "d"), (1, "fx", "c", "b", 2, "a", "d"),
                                        (1, "fx", "c", "b", 2, "a", "d")],
                                "trace_id bigint, chain string, address string, first string, position bigint, "
                                "head string, tail string"), "members")
    out = V.collapse_chains(flows, members)
    assert sum("FileScan" in line and "usd_cents" in line for line in plan(out).splitlines()) == 1
    assert sorted((r.from_address, r.to_address, r.value_raw, r.kind, r.n_members) for r in out.collect()) == [
        ("a", "d", 9, "chain", 3), ("a", "e", 5, "flow", 0), ("d", "e", 6, "flow", 0)]


def _written(monkeypatch, module):
    """Names of what a module writes from now on."""
    names, write = [], module.materialise

    def noted(df, name, *more, **named):
        names.append(name)
        return write(df, name, *more, **named)
    monkeypatch.setattr(module, "materialise", noted)
    return names


def test_chain_members_need_no_collapse(spark, sf, monkeypatch):
    """the members of runs were read from a view that dealt all flows twice more."""
    kept = {k: v for k, v in R._memo.items() if not k[2].startswith("_chain")}
    monkeypatch.setattr(R, "_memo", kept)
    monkeypatch.setattr(V, "collapse_chains", None)
    assert catalog.QUERIES["chain_members"](spark, sf).count() > 0


def test_valued_edges_of_a_pegged_ledger_are_not_written_again(spark, sf, monkeypatch):
    """the edges of every trace of the ledger were written a second time with their value."""
    names = _written(monkeypatch, R)
    edges = R.customers.__wrapped__(spark, sf).edges
    assert "valued" not in names
    assert edges.filter("usd_cents is null or usd_cents <> value_raw").count() == 0 < edges.count()


def test_a_wide_frontier_is_dealt_out_once(spark, monkeypatch):
    """both readers of a level dealt out its distinct wallets."""
    monkeypatch.setattr(TR, "BROADCAST_FRONTIER", 0)
    names = _written(monkeypatch, TR)
    rows = [("t1", 1, "a", "b", "USDT", 5000), ("t2", 2, "b", "c", "USDT", 4900)]
    found = {(r.from_address, r.to_address) for r in run(spark, rows).edges.collect()}
    assert names.count("frontier") == 3 and found == {("a", "b"), ("b", "c")}


def test_edges_of_a_small_frontier_are_not_dealt_again(spark, monkeypatch):
    """few wallets can have most movements; a rebalance shuffled all of them once more."""
    hints, write = [], TR.materialise_observed

    def noted(df, name, *metrics, rebalance=False):
        hints.append((name, rebalance))
        return write(df, name, *metrics, rebalance=rebalance)
    monkeypatch.setattr(TR, "materialise_observed", noted)
    run(spark, [("t1", 1, "a", "b", "USDT", 5000)])
    assert ("edges", False) in hints and ("edges", True) not in hints


def test_inflow_is_written_when_asked_for(spark, monkeypatch):
    """a backward trace summed what every wallet received, which nothing read."""
    back = run(spark, [("t1", 1, "b", "a", "USDT", 5000), ("t2", 2, "c", "a", "USDT", 100)],
               direction=S.BACKWARD, activity=[("b", 9)], high_activity=5)
    names = _written(monkeypatch, G)
    inp = G.FindingInputs(back.with_edges(P.value_usd(back.edges, R.no_prices(spark))))
    rows = G.unidentified_service(inp, None).collect()
    assert [(r.address, r.usd_cents) for r in rows] == [("b", 5000)] and "inflow" not in names
    assert {(r.address, r.usd_cents) for r in inp.incoming.collect()} == {("a", 5100)}
    assert inp.incoming is inp.incoming and names.count("inflow") == 1
