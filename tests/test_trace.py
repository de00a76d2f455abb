from __future__ import annotations

import random

import pytest
from helpers import edge_set, facts, frame, movements, node_map, run, seeds
from reference_walk import walk

from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.operators import exits as E
from fundflow.operators.trace import TraceParams, notices, trace_many
from fundflow.sources.ledger import SaltedLedger
from fundflow.sources.utxo import UtxoLedger


def test_unknown_time_inherits_the_bound_and_unbinds(spark):
    rows = [("t1", 100, "a", "b", "X", 1000), ("t2", None, "b", "c", "X", 900),
            ("t3", 50, "c", "d", "X", 900), ("t4", 150, "c", "e", "X", 900)]
    out = run(spark, rows)
    assert edge_set(out) == {(1, "t1", "a", "b"), (2, "t2", "b", "c"), (3, "t4", "c", "e")}
    assert node_map(out)["c"].bound == 100
    # Two arrivals, one of them without any bound: nothing is ruled out.
    rows = [("t1", None, "a", "b", "X", 1000), ("t2", 100, "a", "b", "X", 1000),
            ("t3", 5, "b", "c", "X", 900)]
    out = run(spark, rows)
    assert node_map(out)["b"].bound is None
    assert (2, "t3", "b", "c") in edge_set(out)


def test_time_limit_is_inclusive(spark):
    rows = [("t1", 100, "a", "b", "X", 1000), ("t2", 100, "b", "c", "X", 500),
            ("t3", 99, "b", "d", "X", 500)]
    out = run(spark, rows)
    assert edge_set(out) == {(1, "t1", "a", "b"), (2, "t2", "b", "c")}
    acc = {r.address: r for r in out.accounting.collect()}
    assert acc["b"].n_time == 1 and acc["b"].n_followed == 1


def test_rapid_stops_at_eighty_percent(spark):
    rows = [("t1", 1, "a", "b", "X", 8000), ("t2", 1, "a", "c", "X", 1000),
            ("t3", 1, "a", "d", "X", 1000)]
    assert {e[1] for e in edge_set(run(spark, rows, pattern="rapid"))} == {"t1"}
    rows = [(f"t{i}", 1, "a", f"w{i}", "X", 1000) for i in range(6)]
    rows += [(f"y{i}", 1, "a", f"v{i}", "Y", 1000) for i in range(2)]
    got = {e[1] for e in edge_set(run(spark, rows, pattern="rapid"))}
    assert got == {"t0", "t1", "t2", "y0", "y1"}


def test_balanced_may_follow_nothing_and_says_so(spark):
    rows = [("t0", 1, "a", "b", "X", 5000)] + [
        (f"s{i:02d}", 2, "b", f"w{i}", "X", 1000) for i in range(30)]
    out = run(spark, rows, pattern="balanced")
    assert edge_set(out) == {(1, "t0", "a", "b")}
    b = node_map(out)["b"]
    assert b.branches_unexamined and not b.at_rest and "branches_unexamined" in b.flags
    acc = {r.address: r for r in out.accounting.collect()}["b"]
    assert (acc.n_skipped, acc.skipped_raw) == (30, 30000)


@pytest.mark.parametrize("pattern", ["rapid", "balanced", "thorough"])
def test_lone_movement_is_kept(spark, pattern):
    rows = [("t1", 1, "a", "b", "X", 1000), ("d", 1, "a", "c", "X", 5),
            ("s", 1, "a", "a", "X", 5)]
    out = run(spark, rows, pattern=pattern)
    assert edge_set(out) == {(1, "t1", "a", "b")}
    acc = out.accounting.filter("address = 'a'").first()
    # A self transfer below the dust limit counts as self, not as dust.
    assert (acc.n_self, acc.n_dust, acc.n_followed) == (1, 1, 1)
    assert node_map(out)["b"].at_rest


def test_sanctioned_custodian_is_an_exit_with_role_sanctioned(spark):
    labels = [("x", "SDN one", "sanctioned", "ofac_sdn", "high"),
              ("x", "Kraken", "exchange", "seed", "medium")]
    out = run(spark, [("t1", 1, "a", "x", "X", 1000)], labels=labels)
    node = node_map(out)["x"]
    assert node.role == S.SANCTIONED
    row = E.exits(out).first()
    assert (row.address, row.entity, row.role) == ("x", "SDN one", S.SANCTIONED)
    named = E.exits(out, [{"entity": "Kraken", "status": "ok"}], entity="exchange_label")
    assert (named.first().entity, named.first().compliance) == ("Kraken", "ok")


def test_stops_and_depth_limit(spark):
    rows = [("t1", 1, "a", "b", "X", 1000), ("t2", 2, "b", "x", "X", 900),
            ("t3", 2, "b", "c", "X", 900), ("t4", 3, "x", "y", "X", 800),
            ("t5", 2, "b", "m", "X", 900), ("t6", 2, "b", "k", "X", 900),
            ("t7", 2, "b", "h", "X", 900)]
    out = run(spark, rows, max_depth=2, high_activity=500, contracts=["k"],
              activity=[("h", 501), ("c", 500)],
              labels=[("x", "Kraken", "exchange", "seed", "medium"),
                      ("m", "Mix", "mixer", "tagpack", "medium")])
    roles = {a: r.role for a, r in node_map(out).items()}
    assert roles == {"a": S.VICTIM, "b": S.INTERMEDIARY, "x": S.EXCHANGE, "c": S.UNEXPANDED,
                     "m": S.MIXER, "k": S.CONTRACT, "h": S.HIGH_ACTIVITY}
    assert node_map(out)["c"].max_depth_reached and not node_map(out)["x"].max_depth_reached
    assert "t4" not in {e[1] for e in edge_set(out)}
    assert [r.address for r in E.exits(out).collect()] == ["x"]


def test_cycles_diamonds_and_paths(spark):
    rows = [("t1", 10, "a", "b", "X", 1000), ("t2", 20, "a", "c", "X", 3000),
            ("t3", 30, "b", "d", "X", 500), ("t4", 5, "b", "d", "X", 500),
            ("t5", 40, "c", "d", "X", 700), ("t6", 50, "d", "a", "X", 600),
            ("t7", 60, "d", "x", "X", 600), ("t8", 70, "c", "x", "X", 100)]
    out = run(spark, rows, labels=[("x", "K", "exchange", "seed", "medium")])
    edges = edge_set(out)
    assert (3, "t6", "d", "a") in edges and (2, "t4", "b", "d") not in edges
    assert node_map(out)["a"].depth == 0 and node_map(out)["d"].bound == 30
    hops = E.exit_paths(out, E.exits(out)).orderBy("hop").collect()
    assert [(h.hop, h.txid) for h in hops] == [(1, "t2"), (2, "t8")]
    lines = E.traceroute(E.exit_paths(out, E.exits(out))).orderBy("hop").collect()
    assert lines[0].line.startswith("Hop 1 of 2: a -> c  30 X")


def test_backward_edges_point_with_the_money(spark):
    rows = [("t1", 10, "b", "a", "X", 1000), ("t2", 9, "c", "b", "X", 900),
            ("t3", 11, "d", "b", "X", 900)]
    out = run(spark, rows, direction="backward",
              labels=[("c", "K", "exchange", "seed", "medium")])
    assert edge_set(out) == {(1, "t1", "b", "a"), (2, "t2", "c", "b")}
    hops = E.exit_paths(out, E.exits(out)).orderBy("hop").collect()
    assert [(h.from_address, h.to_address) for h in hops] == [("c", "b"), ("b", "a")]


def test_newest_n_counts_transactions_and_marks_the_wallet(spark):
    rows = [("t0", 1, "a", "b", "X", 1000)]
    rows += [(f"s{i}", 10 + i, "b", f"w{i}", "X", 1000) for i in range(5)]
    rows += [("s4", 14, "b", "w9", "X", 1000)]
    out = run(spark, rows, newest_n=3)
    assert {e[1] for e in edge_set(out) if e[0] == 2} == {"s2", "s3", "s4"}
    assert node_map(out)["b"].outgoing_txs_capped and not node_map(out)["b"].at_rest
    acc = out.accounting.filter("address = 'b'").first()
    assert (acc.n_capped, acc.n_eligible, acc.n_followed) == (2, 4, 4)
    assert notices(out).filter("kind = 'capped'").first().n == 1


def test_newest_n_counts_payments_on_both_sides_before_any_filter(spark):
    """Newer payments to a wallet push its own out of the list; it isn't at rest then."""
    rows = [("t0", 1, "a", "b", "X", 1000), ("s0", 5, "b", "c", "X", 1000)]
    rows += [(f"in{i}", 10 + i, f"q{i}", "b", "X", 1) for i in range(3)]
    out = run(spark, rows, newest_n=3)
    b = node_map(out)["b"]
    assert {e[1] for e in edge_set(out)} == {"t0"}
    assert b.outgoing_txs_capped and not b.at_rest and "no_onward_movements" not in b.flags
    assert out.accounting.filter("address = 'b'").first().n_capped == 1
    assert {e[1] for e in edge_set(run(spark, rows, newest_n=4))} == {"t0", "s0"}
    whole = run(spark, [r for r in rows if r[0] != "s0"][:3], newest_n=4)
    assert node_map(whole)["b"].at_rest and not node_map(whole)["b"].outgoing_txs_capped


def test_newest_n_of_raw_transactions(spark):
    from fundflow.operators.trace import newest_of
    raw = spark.sql("""
      SELECT concat('t', id) AS txid, struct(id * 10 AS block_time) AS status,
             array(struct(struct(concat('p', id % 2) AS scriptpubkey_address, 5L AS value) AS prevout)) AS vin,
             array(struct('hub' AS scriptpubkey_address, 4L AS value), struct('hub' AS scriptpubkey_address, 1L AS value)) AS vout
      FROM range(6)""")
    last = {r.address: (r["last"].ts, r["last"].txid) for r in newest_of(UtxoLedger(raw), 3).collect()}
    assert last == {"hub": (30, "t3"), "p0": (0, "t0"), "p1": (10, "t1")}


def _fan(spark, **caps):
    rows = [(f"t{i}", 1, "a", f"b{i}", "X", 1000 * (i + 1)) for i in range(5)]
    rows += [(f"s{i}", 2, f"b{i}", f"c{i}", "X", 500) for i in range(5)]
    rows += [("s4b", 2, "b4", "c3", "X", 400)]
    return run(spark, rows, **caps)


@pytest.mark.parametrize("caps, second", [
    ({"max_addresses": 3}, set()),                          # 6 wallets after the first
    ({"max_addresses": 7}, {"s4", "s4b"}),                  # b4 finds two more
    ({"max_addresses": 9}, {"s4", "s4b", "s3", "s2"}),      # c3 counts once, for b4
    ({"max_edges": 6}, {"s4", "s4b"}), ({"max_edges": 7}, {"s4", "s4b"}),
    ({"max_edges": 8}, {"s4", "s4b", "s3"}), ({"max_edges": 8, "max_addresses": 8}, {"s4", "s4b"}),
    ({"max_addresses": 100}, {"s4", "s4b", "s3", "s2", "s1", "s0"}), ({"max_addresses": 1}, None)])
def test_size_caps_stop_inside_a_level(spark, caps, second):
    out = _fan(spark, **caps)
    if second is None:
        assert edge_set(out) == set()
        return
    assert {e[1] for e in edge_set(out) if e[0] == 2} == second
    followed = {f"b{t[1]}" for t in second}
    for i in range(5):
        node = node_map(out)[f"b{i}"]
        assert (node.role == S.UNEXPANDED) == (f"b{i}" not in followed) and not node.at_rest
    assert out.accounting.filter("address like 'b%'").select("address").distinct().count() == len(followed)


def test_size_caps_are_kept_per_trace(spark):
    """Many traces at once against a walk of each that spends its caps in order."""
    rng = random.Random(8)
    wallets = [f"w{i}" for i in range(40)]
    rows = [(f"t{i:03d}", rng.randrange(100), rng.choice(wallets), rng.choice(wallets), "X",
             rng.randrange(100, 9999)) for i in range(160)]
    starts = wallets[:12]
    out = trace_many(movements(spark, rows), seeds(spark, *starts), facts(spark), TraceParams(
        high_activity=None, pattern=S.THOROUGH, max_addresses=9, max_edges=11))
    got = {(r.trace_id, r.depth, r.txid) for r in out.edges.collect()}
    want = set()
    for trace, start in enumerate(starts, 1):
        nodes, bound, worth = {start}, {start: None}, {start: 0}
        level, drawn = [start], 0
        for depth in range(1, 4):
            arrived = {}
            for wallet in sorted(level, key=lambda w: (-worth[w], w)):
                if len(nodes) >= 9 or drawn >= 11:
                    break
                for t, ts, a, b, _, raw in rows:
                    if a != wallet or a == b or (bound[wallet] is not None and ts < bound[wallet]):
                        continue
                    want.add((trace, depth, t))
                    drawn += 1
                    nodes.add(b)
                    arrived.setdefault(b, []).append((ts, raw))
            level = [w for w in arrived if w not in bound]
            for w in level:
                bound[w], worth[w] = min(t for t, _ in arrived[w]), max(v for _, v in arrived[w])
    assert got == want


def test_salted_ledger_splits_the_busiest_wallet(spark):
    """Half of a ledger on one wallet, many traces: the same result, in pieces."""
    rng = random.Random(4)
    rows = [(f"t{i:05d}", rng.randrange(1000), "hub" if i % 2 else f"w{rng.randrange(60)}",
             "hub" if i % 4 == 0 else f"w{rng.randrange(60)}", "X", rng.randrange(100, 9999))
            for i in range(2000)]
    moves = movements(spark, rows)
    stored = SaltedLedger.write(moves, buckets=4, per_salt=100)
    try:
        salts = spark.table(stored.tables[S.FORWARD]).groupBy("from_address").agg(
            F.count_distinct("salt").alias("n"), F.max("salt").alias("most")).collect()
        per = {r.from_address: r.n for r in salts}
        assert per["hub"] == 10 and {n for w, n in per.items() if w != "hub"} == {1}
        pieces = spark.table(stored.tables[S.FORWARD]).groupBy("from_address", "salt").count()
        assert pieces.agg({"count": "max"}).first()[0] <= 3 * 100
        starts = seeds(spark, *[f"w{i}" for i in range(60)], "hub")
        for direction in (S.FORWARD, S.BACKWARD):
            params = TraceParams(direction=direction, high_activity=None, max_depth=2, pattern=S.BALANCED)
            a, b = (trace_many(m, starts, facts(spark), params) for m in (moves, stored))
            assert sorted(map(tuple, a.edges.select(sorted(a.edges.columns)).collect()), key=repr) == \
                sorted(map(tuple, b.edges.select(sorted(b.edges.columns)).collect()), key=repr)
            assert sorted(map(tuple, a.accounting.select(sorted(a.accounting.columns)).collect()), key=repr) == \
                sorted(map(tuple, b.accounting.select(sorted(b.accounting.columns)).collect()), key=repr)
        frontier = seeds(spark, "hub").select("chain", "address")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = stored.expand(frontier, S.FORWARD)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        stored.drop()


def _focus(spark, legs, senders, seed="a", txid="f", chain="bitcoin", rows=()):
    from pyspark.sql import functions as F
    base = movements(spark, list(rows) or [("z", 1, "q", "r", "X", 1000)], chain)
    start = seeds(spark, seed, chain=chain).withColumn("focus_txid", F.lit(txid))
    pay = frame(spark, [(chain, txid, s) for s in senders],
                "chain string, txid string, address string")
    return trace_many(base, start, facts(spark), TraceParams(
        high_activity=None, max_depth=1), legs=movements(spark, legs, chain), senders=pay)


def test_focus_payment(spark):
    legs = [("f", None, "2 input addresses", "b", "X", 900),
            ("f", 100, "2 input addresses", "a", "X", 100)]
    out = _focus(spark, legs, ["a", "z"], rows=[("n", 101, "b", "c", "X", 500),
                                                ("o", 99, "b", "d", "X", 500)])
    assert edge_set(out) == {(1, "f", "a", "b"), (2, "n", "b", "c")}
    judged = out.focus.first()
    assert (judged.outcome, judged.n_inputs) == ("followed", 2)
    # Only received: the whole wallet is traced instead.
    out = _focus(spark, [("f", 1, "z", "a", "X", 900)], ["z"],
                 rows=[("n", 5, "a", "c", "X", 500)])
    assert out.focus.first().outcome == "incoming"
    assert edge_set(out) == {(1, "n", "a", "c")}
    for legs, senders, outcome in (
            ([("f", 1, "z", "y", "X", 900)], ["z"], "not_involved"),
            ([("f", 1, "a", "a", "X", 900)], ["a"], "all_change"),
            ([("g", 1, "a", "b", "X", 900)], ["a"], "no_movements")):
        out = _focus(spark, legs, senders)
        assert out.focus.first().outcome == outcome and out.edges.isEmpty()


def test_focus_on_account_chain_takes_only_own_legs(spark):
    legs = [("f", 1, "a", "b", "X", 900), ("f", 1, "pool", "c", "X", 900)]
    out = _focus(spark, legs, ["a"], chain="ethereum")
    assert edge_set(out) == {(1, "f", "a", "b")}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_match_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    wallets = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(160):
        ts = None if rng.random() < 0.1 else rng.randrange(200)
        rows.append((f"t{i:03d}", ts, rng.choice(wallets), rng.choice(wallets),
                     rng.choice("XY"), rng.choice([50, 200, 200, 700, 5000])))
    stops = {"w3": "mixer", "w5": "exchange"}
    labels = [("w3", "M", "mixer", "tagpack", "medium"),
              ("w5", "K", "exchange", "seed", "medium")]
    direction = "backward" if seed % 2 else "forward"
    pattern = ["balanced", "rapid", "thorough", "balanced"][seed]
    out = run(spark, rows, seed="w0", labels=labels, direction=direction, pattern=pattern)
    edges, nodes, accounts = walk(rows, "w0", stops, direction, pattern)
    mine = sorted((r.depth, r.txid, r.address, r.next_address, r.asset, r.value_raw)
                  for r in out.edges.collect())
    assert mine == sorted(edges)
    assert {a: (r.depth, r.role) for a, r in node_map(out).items()} == nodes
    # Conservation: every movement of an expanded wallet has exactly one state.
    seen = {}
    for r in out.accounting.collect():
        got = seen.setdefault(r.address, [0] * 5)
        for i, v in enumerate((r.n_self, r.n_dust, r.n_time, r.n_followed, r.n_skipped)):
            got[i] += v
    for wallet, (states, total) in accounts.items():
        got = seen.get(wallet, [0] * 5)
        assert sum(got) == total
        assert got == [states.get(k, 0) for k in
                       ("self", "dust", "time", "followed", "skipped")]


def test_extended_mode_follows_a_long_chain(spark):
    names = "abcdefghij"
    rows = [(f"t{i}", i, names[i], names[i + 1], "X", 1000) for i in range(9)]
    out = run(spark, rows, extended=True, max_depth=1)
    last = node_map(out)["j"]
    assert (last.depth, last.at_rest, last.role) == (9, True, S.INTERMEDIARY)
    hops = E.exit_paths(out, out.nodes.filter("address = 'j'")).orderBy("hop").collect()
    assert [h.txid for h in hops] == [f"t{i}" for i in range(9)]


def test_no_seeds_give_an_empty_result(spark):
    none = seeds(spark, "a").filter("trace_id < 0")
    out = trace_many(movements(spark, [("t", 1, "a", "b", "X", 1000)]), none, facts(spark))
    assert out.nodes.isEmpty() and out.edges.isEmpty() and out.accounting.isEmpty()


def test_parameters_are_checked():
    for bad in ({"direction": "up"}, {"pattern": "all"}, {"max_depth": 7}):
        with pytest.raises(ValueError):
            TraceParams(**bad)


def test_many_traces_equal_single_traces(spark):
    rows = [("t1", 1, "a", "b", "X", 1000), ("t2", 2, "b", "c", "X", 900),
            ("t3", 3, "c", "d", "X", 900), ("t4", 1, "z", "c", "X", 900)]
    both = trace_many(movements(spark, rows), seeds(spark, "a", "z"), facts(spark),
                      TraceParams(high_activity=None))
    got = {(r.trace_id, r.txid) for r in both.edges.collect()}
    assert got == {(1, "t1"), (1, "t2"), (1, "t3"), (2, "t4"), (2, "t3")}
