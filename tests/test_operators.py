from __future__ import annotations

import hashlib
import json
import random

import pytest
from helpers import facts, frame, label_rows, movements, run
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import amounts, base58, text
from fundflow.functions.skew import join_group_stats, number_within
from fundflow.operators import branches as B
from fundflow.operators import classify as C
from fundflow.operators import cluster as CL
from fundflow.operators import findings as G
from fundflow.operators import flows as FL
from fundflow.operators import graphview as V
from fundflow.operators import prices as P
from fundflow.operators import tables as TB


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ------------------------------------------------------------- expressions

def test_text_expressions(spark):
    df = frame(spark, [("1INCH0xABC", "bitcoin"), ("0xABC", "bitcoin"), ("ABC", "ethereum")],
               "a string, c string")
    assert [r[0] for r in df.select(text.norm_addr(F.col("a"), F.col("c"))).collect()] == [
        "1INCH0xABC", "0xabc", "abc"]
    row = spark.range(1).select(
        text.slug(F.lit("  Älpha & Co! ")).alias("s"), text.slug(F.lit("!!")).alias("e"),
        text.iso_text(F.lit(1704071864).cast("bigint")).alias("t"),
        text.iso_text(F.lit(None).cast("bigint")).alias("n"),
        text.amount_text(F.lit(1234.5)).alias("a"), text.amount_text(F.lit(100.0)).alias("b"),
        text.pipe_join(F.array(F.lit("x"), F.lit("y"))).alias("p"),
        text.clip(F.lit("abcdef"), 3).alias("c"),
        text.conf_rank(F.lit("other")).alias("r")).first()
    assert tuple(row) == ("lpha-co", "agency", "2024-01-01 01:17:44 UTC", "-", "1,234.5",
                          "100", "x | y", "abc", 3)


def test_entity_match_takes_the_first_entry_of_the_file(spark):
    book = [{"entity": "Binance", "status": "a"}, {"entity": "Binance.US", "status": "b"}]
    df = frame(spark, [("BINANCE.US hot 1",), ("Kraken",), (None,)], "n string")
    got = df.select(text.directory_field(text.entity_match(F.col("n"), book), book, "status"))
    assert [r[0] for r in got.collect()] == ["a", None, None]


def test_wide_amounts(spark):
    from fundflow.functions import wide
    many = ["9" * 36] * 200 + ["1" * 78, "0", "00012", str(2**256 - 1)]
    df = spark.createDataFrame([(t,) for t in many + ["x", "", None, "9" * 82]], "t string")
    limbs = df.select(wide.from_digits(F.col("t")).alias("l"))
    row = limbs.agg(wide.to_digits(wide.total(F.col("l"))).alias("s"), F.count("l").alias("n"),
                    wide.to_digits(F.max("l")).alias("m")).first()
    assert (int(row.s), row.n, int(row.m)) == (sum(map(int, many)), len(many), max(map(int, many)))
    for a, b in ((0, 0), (10**9 - 1, 1), (2**255, 2**255 - 1), (10**40, 999)):
        got = spark.range(1).select(wide.to_digits(wide.add(*(wide.from_digits(F.lit(str(v)))
                                                              for v in (a, b))))).first()[0]
        assert int(got) == a + b
    for v in (0, 5, 2**28, 2**60 - 1, 10**30, 2**256 - 1):
        got = spark.range(1).select(wide.from_hex(F.lit(hex(v))).alias("l")).select(
            wide.to_digits(F.col("l")), wide.to_decimal(F.col("l"))).first()
        assert int(got[0]) == v and (got[1] is None) == (v >= 10**38)
    assert spark.range(1).select(wide.from_hex(F.lit("0xzz"))).first()[0] is None
    most = wide.from_digits(F.lit("9" * 81))
    assert spark.range(1).select(wide.add(most, most)).first()[0] is None  # too wide: no wrong digits


@pytest.mark.parametrize("pattern, want", [("rapid", {"big"}), ("balanced", {"big"})])
def test_amounts_of_any_size_decide_branches(spark, pattern, want):
    from fundflow.operators.branches import select_branches
    rows = [("big", "a", "b", "X", 1e21)] + [(f"s{i}", "a", f"c{i}", "X", 5.0 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "txid string, address string, next_address string, asset string, value double") \
        .withColumn("ts", F.lit(1))
    assert {r.txid for r in select_branches(df, ["address"], pattern).collect()} == want
    held = spark.range(1).select(amounts.display_units(F.lit(1e21)), amounts.display_units(F.lit(1e40))).first()
    assert int(held[0]) == 10**31 and int(held[1]) == 10**35
    small = spark.range(1).select(amounts.display_units(F.lit(123456789.12)), amounts.display_units(F.lit(-0.5))).first()
    assert [int(v) for v in small] == [1234567891200000000, -5 * 10**9]


def test_amount_parsing(spark):
    big = "9" * 40
    row = spark.range(1).select(
        amounts.parse_amount(F.lit("0012")).alias("a"),
        amounts.parse_amount(F.lit(big)).alias("b"), amounts.is_oversize(F.lit(big)).alias("c"),
        amounts.parse_amount(F.lit("x1")).alias("d"),
        amounts.hex_amount(F.lit("0x" + format(10**30, "x"))).alias("e"),
        amounts.hex_amount(F.lit("0x" + "f" * 60)).alias("f"),
        amounts.hex_double(F.lit("0x" + "f" * 60)).alias("g"),
        amounts.to_units(F.lit(150_000_000), 8).alias("h")).first()
    assert (int(row.a), row.b, row.c, row.d, int(row.e), row.f) == (12, None, True, None,
                                                                  10**30, None)
    assert abs(row.g / (16**60) - 1) < 1e-12 and row.h == 1.5


def test_base58_known_address():
    assert base58.encode("41a614f803b6fd780986a42c78ec9c7f77e6ded13c") == \
        "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"
    assert base58.encode("zz") is None and base58.encode(None) is None


# ------------------------------------------------------------------- skew

def test_one_group_with_most_rows(spark):
    """A hot key takes the broadcast branch; the result is the plain join."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    got = join_group_stats(rows, stats, ["k"], 60_000)
    assert got.count() == 60_000
    assert got.filter("k = 0").agg(F.max("lo"), F.count("id")).first() == (0, 20_000)
    assert got.filter("k <> 0 and lo <> id").isEmpty()


def test_numbering_across_buckets(spark):
    rows = spark.range(5_000).select(
        F.lit("hot").alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    out = number_within(rows.withColumn("b", F.floor(F.col("v") / 100)), ["k"], "b", ["v"], "n")
    assert out.filter(F.col("n") != F.col("v") + 1).isEmpty() and out.count() == 5_000


def test_branch_selection_limits_before_the_shuffle(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") >= 0, F.concat(F.lit("hot"), F.col("id") % 1)).alias("address"),
        F.concat(F.lit("X"), F.col("id") % 1).alias("asset"),
        F.concat(F.lit("t"), "id").alias("txid"), F.lit(1).cast("bigint").alias("ts"),
        F.concat(F.lit("n"), "id").alias("next_address"),
        F.when(F.col("id") < 5, 10**9).otherwise(F.col("id")).cast("bigint").alias("value_raw")) \
        .withColumn("value", F.col("value_raw").cast("double"))
    chosen = B.select_branches(rows, ["address"], S.BALANCED)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {r.txid for r in chosen.collect()} == {f"t{i}" for i in range(5)}


def test_branches_compare_display_amounts(spark):
    """One symbol, two scales: base units would pick the half token of 18 decimals."""
    rows = spark.createDataFrame(
        [("w", "USDT", "a", 1, "n1", 10**12, 1e6), ("w", "USDT", "b", 2, "n2", 5 * 10**11, 5e5),
         ("w", "USDT", "c", 3, "n3", 5 * 10**17, 0.5)],
        "address string, asset string, txid string, ts long, next_address string, "
        "value_raw long, value double")
    for pattern in (S.RAPID, S.BALANCED):
        assert {r.txid for r in B.select_branches(rows, ["address"], pattern).collect()} == {"a", "b"}


def test_wide_amounts_do_not_stop_a_job(spark):
    rows = spark.range(200).select(
        F.lit("w").alias("address"), F.lit("SPAM").alias("asset"), F.col("id").cast("string").alias("txid"),
        F.col("id").alias("ts"), F.lit("n").alias("next_address"),
        F.lit("9" * 36).cast("decimal(38,0)").alias("value_raw"), F.lit(1e36).alias("value"))
    # two hundred equal branches: none carries 5 %
    for pattern, n in ((S.RAPID, 3), (S.BALANCED, 0)):
        assert B.select_branches(rows, ["address"], pattern).count() == n
    assert rows.agg(F.try_sum("value_raw")).first()[0] is None


# ------------------------------------------------------------------ labels

def test_facts_and_label_order(spark):
    labels = [("x", "Low", "other", "z", "low"), ("x", "Ex", "exchange", "seed", "medium"),
              ("y", "Part", "shared_flag", "pack:p", "medium")]
    flags = frame(spark, [("x", "fx", "bad", 1, "2024")],
                  "address string, chain string, reason string, case_id bigint, created_utc string")
    got = C.attach_labels(frame(spark, [("fx", "x"), ("fx", "n")], "chain string, address string"),
                          label_rows(spark, labels), flags)
    assert values(got.filter("address = 'x'"), "label_no", "entity_name") == [
        (1, "AGENCY FLAG: bad"), (2, "Ex"), (3, "Low")]
    assert got.filter("address = 'n'").first().entity_name is None
    row = {r.address: r for r in facts(spark, labels, flags=flags).collect()}
    assert row["x"].is_exchange and row["x"].agency_flagged and row["y"].shared_flagged
    assert row["x"].label.entity_name == "AGENCY FLAG: bad"
    assert row["x"].exchange_label.entity_name == "Ex" and row["y"].exchange_label is None


def test_replace_and_upsert(spark):
    base = frame(spark, [("a", "fx", "s1", "old"), ("b", "fx", "s2", "keep")],
                 "address string, chain string, source string, entity_name string")
    new = frame(spark, [("c", "fx", "one", 1), ("c", "fx", "two", 2)],
                "address string, chain string, entity_name string, seq bigint")
    assert values(TB.replace_source(base, "s1", new), "address", "entity_name") == [
        ("b", "keep"), ("c", "two")]
    old = frame(spark, [("k1", "v1", 1), ("k2", "v2", 1)], "k string, v string, seq bigint")
    change = frame(spark, [("k1", "v3", 2, False), ("k2", "", 3, True), ("k3", "n", 1, False)],
                   "k string, v string, seq bigint, deleted boolean")
    assert values(TB.upsert(old, change, ["k"], "seq"), "k", "v") == [("k1", "v3"), ("k3", "n")]


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    import os
    path = str(tmp_path / "keyed")
    table = TB.KeyedTable(path, ("k",), "seq", 8)
    table.create(spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).cast("bigint").alias("seq")))

    def stamps():
        return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("_bucket")}

    def change(*rows):
        return table.upsert(frame(spark, rows, "k bigint, v string, seq bigint, deleted boolean"))
    before = stamps()
    assert len(change((7, "new", 2, False))) == 1
    assert sum(before[d] != now for d, now in stamps().items()) == 1
    assert len(change((7, "tie", 2, False), (8, "", 5, True), (9, "late", 0, False), (-1, "added", 1, False))) <= 4
    rows = {r.k: (r.v, r.seq) for r in table.read(spark).collect()}
    assert rows[7] == ("tie", 2) and 8 not in rows and rows[9] == ("old", 1) and rows[-1] == ("added", 1)
    assert len(rows) == 2000 and change() == []
    small = TB.KeyedTable(str(tmp_path / "small"), ("k",), "seq", 4)
    small.create(frame(spark, [(1, "a", 1), (2, "b", 1)], "k bigint, v string, seq bigint"))
    small.upsert(frame(spark, [(1, "", 2, True)], "k bigint, v string, seq bigint, deleted boolean"))
    assert [r.k for r in small.read(spark).collect()] == [2]  # an emptied bucket goes


def test_directory_of_any_size(spark):
    from fundflow.operators.directory import first_matches
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(300)]
    names = [" ".join(rng.sample(words, 3)).upper() for _ in range(200)] + ["", None, "zz", "z"]
    for entries in (words, [w for w in words if len(w) > 2], ["zz", "Z"], []):
        directory = spark.createDataFrame(list(enumerate(entries)), "ord long, entity string")
        df = spark.createDataFrame([(n,) for n in names], "name string")
        got = {r.name: (r.ord, r.entity) for r in first_matches(df, "name", directory).collect()}
        want = {}
        for n in names:
            hits = [(i, e) for i, e in enumerate(entries) if n is not None and e.lower() in n.lower()]
            if hits:
                want[n] = hits[0]
        assert got == want


def test_paths_of_many_hops_take_few_rounds(spark, monkeypatch):
    from fundflow.operators import exits as EX
    written = []
    keep = EX.materialise
    monkeypatch.setattr(EX, "materialise", lambda df, name, **k: written.append(name) or keep(df, name, **k))
    rows = [(f"t{i}", i, f"w{i}", f"w{i + 1}", "X", 1000) for i in range(25)]
    out = run(spark, rows, seed="w0", extended=True, labels=[("w25", "Kraken", "exchange", "seed", "medium")])
    hops = EX.exit_paths(out, EX.exits(out)).orderBy("hop").collect()
    assert [(h.hop, h.txid) for h in hops] == [(i + 1, f"t{i}") for i in range(25)]
    assert written.count("walk") == 5


# ------------------------------------------------------------------ prices

def test_valuation_rules(spark):
    day = 19_723 * 86_400        # 2024-01-01
    edges = frame(spark, [("e1", "BTC", day + 5, 2.0), ("e2", "BTC", None, 2.0),
                          ("e3", "USDT", None, 3.456), ("e4", "BTC", day + 86_400, 1.0),
                          ("e5", "XYZ", day, 1.0), ("e6", "BTC", 0, 1.0)],
                  "txid string, asset string, ts bigint, value double")
    ticks = frame(spark, [("BTC", day + 60, 11.0), ("BTC", day + 2, 10.005)],
                  "asset string, ts bigint, usd double")
    prices = P.fill_prices(P.needed_keys(edges), ("one", P.daily_first(ticks)))
    got = {r.txid: (r.usd_cents, r.usd_price_date)
           for r in P.value_usd(edges, prices).collect()}
    assert got == {"e1": (2001, "2024-01-01"), "e2": (None, None),
                   "e3": (346, "pegged $1.00"), "e4": (None, None), "e5": (None, None),
                   "e6": (None, None)}
    assert [str(r.date) for r in P.missing_prices(P.needed_keys(edges), prices).collect()] == [
        "2024-01-02"]


# ---------------------------------------------------------------- findings

def _valued(result):
    return result.with_edges(result.edges.withColumn("usd_cents", F.col("value_raw")))


def test_sweep_limits(spark):
    h72 = 72 * 3600
    rows = []
    for i, (share, gap) in enumerate([(90, h72), (89, 10), (95, h72 + 1), (100, 5)]):
        rows += [(f"i{i}", 1000, "a", f"d{i}", "USDT", 100_000),
                 (f"o{i}", 1000 + gap, f"d{i}", "hot", "USDT", share * 1000)]
    rows += [("x1", 1000, "a", "two", "USDT", 100_000),
             ("x2", 1001, "two", "hot", "USDT", 95_000),
             ("x3", 1001, "two", "else", "USDT", 5_000)]
    inp = G.FindingInputs(_valued(run(spark, rows, high_activity=3, activity=[("hot", 4)])))
    feeders = G.sweep_feeders(inp.result, inp.incoming)
    assert {r.from_address for r in feeders.collect()} == {"d0", "d3"}
    row = G.probable_deposit(inp, feeders).first()
    assert (row.address, row.related, row.detail) == ("hot", "d3", "sweep tx o3")
    assert G.unidentified_service(inp, feeders).isEmpty()
    rest = {r.address for r in G.funds_at_rest(inp).collect()}
    assert rest == {"else"}
    shares = {r.bucket: (r.n, r.usd_cents, r.share_permille)
              for r in G.disposition(inp).collect()}
    assert shares["busy services"] == (1, 90_000 + 89_000 + 95_000 + 100_000 + 95_000, 989)
    assert shares["at rest"] == (1, 5_000, 11)


def test_ranked_list_counts_what_it_leaves_out(spark):
    rows = [(f"t{i:02d}", 1, "a", f"w{i:02d}", "X", 1000 + i) for i in range(13)]
    inp = G.FindingInputs(_valued(run(spark, rows)))
    ranked = G.rank_findings(G.funds_at_rest(inp))
    got = ranked.orderBy("rank").collect()
    assert len(got) == 10 and got[0].address == "w12" and {r.n_of_type for r in got} == {13}


# ---------------------------------------------------------------- clusters

def _tx(spark, spec):
    ins = [(t, a) for t, (addresses, _) in spec.items() for a in addresses]
    outs = [(t, v) for t, (_, amounts_) in spec.items() for v in amounts_]
    return (frame(spark, ins, "txid string, address string"),
            frame(spark, outs, "txid string, value bigint"))


def test_coinjoin_rules(spark):
    five = [f"p{i}" for i in range(5)]
    ins, outs = _tx(spark, {"four": (["q1", "q2", "q3", "q4"], [7, 7, 7]),
                            "mixed": (five, [7, 7, 7, 1]), "pairs": (five, [7, 7, 1, 1])})
    assert values(CL.coinjoin_like(ins, outs), "txid") == [("mixed",)]
    linked = CL.cospend_tx(CL.linking_inputs(ins, outs))
    assert values(linked, "txid", "n_inputs") == [("four", 4), ("pairs", 5)]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(260)]
    pairs += [(f"line{i:03d}", f"line{i + 1:03d}") for i in range(60)]
    pairs += [("hub", f"leaf{i:03d}") for i in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if a != b and ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    want = {x: find(x) for x in linked}
    got = {r.address: r.component for r in CL.components(
        frame(spark, pairs, "a string, b string")).collect()}
    assert got == want


def test_wide_cluster_is_low_confidence(spark):
    ins, outs = _tx(spark, {"w": ([f"a{i:02d}" for i in range(12)], [1]),
                            "s": (["b1", "b2"], [1])})
    linking = CL.linking_inputs(ins, outs)
    members = CL.components(CL.cospend_edges(linking))
    assert values(CL.cluster_rollup(members, linking), "component", "size", "confidence") == [
        ("a00", 12, "low"), ("b1", 2, "medium")]


# -------------------------------------------------------------- graph views

def _flows(spark, pairs):
    rows = [(1, "fx", a, b, "X", float(v), v * 100, v * 100, True, 1) for a, b, v in pairs]
    return frame(spark, rows, "trace_id bigint, chain string, from_address string, "
                 "to_address string, asset string, value double, value_raw bigint, "
                 "usd_cents bigint, usd_complete boolean, n_movements bigint")


def _nodes(spark, addresses, role="intermediary"):
    return frame(spark, [(1, "fx", a, role) for a in addresses],
                 "trace_id bigint, chain string, address string, role string")


def test_long_peel_chain_and_returning_run(spark):
    chain = [f"c{i:02d}" for i in range(41)]
    pairs = [("start", chain[0], 90)] + [(a, b, 80) for a, b in zip(chain, chain[1:])]
    pairs += [(chain[-1], "end", 70), ("v", "r1", 5), ("r1", "r2", 4), ("r2", "v", 3),
              ("l1", "l2", 1), ("l2", "l1", 1)]
    flows = _flows(spark, pairs)
    members = V.chain_members(flows, _nodes(spark, chain + ["r1", "r2", "l1", "l2"]))
    view = V.collapse_chains(flows, members)
    assert values(view.filter("kind = 'chain'"), "from_address", "to_address", "n_members",
                  "value_raw") == [("start", "end", 41, 9000), ("v", "r2", 1, 500)]
    assert values(view.filter("kind = 'flow'"), "from_address", "to_address") == [
        ("l1", "l2"), ("l2", "l1"), ("r2", "v")]
    places = members.filter("first = 'c00'").orderBy("position").collect()
    assert [r.address for r in places] == chain


def test_minor_branches_fold_to_a_stub(spark):
    pairs = [("p", f"w{i}", 10 + i) for i in range(8)] + [("q", f"x{i}", 5) for i in range(6)]
    view = _flows(spark, pairs).withColumns({"kind": F.lit("flow"),
                                             "n_members": F.lit(0).cast("bigint")})
    nodes = _nodes(spark, [b for _, b, _ in pairs])
    out = V.fold_minor(view, nodes)
    assert values(out.filter("kind = 'stub'"), "from_address", "n_members", "value_raw") == [
        ("p", 5, (10 + 11 + 12 + 13 + 14) * 100)]
    assert {r.to_address for r in out.filter("from_address = 'p' and kind = 'flow'").collect()
            } == {"w5", "w6", "w7"}
    assert out.filter("from_address = 'q'").count() == 6


def test_stub_keeps_usd_and_movements(spark):
    """Assets whose rest is known in full, in part and not at all."""
    rows = [(1, "fx", "p", f"{a}{i}", a, float(i), i * 100, usd, full, i)
            for i, a, usd, full in [
                (1, "A", 10, True), (2, "A", 20, True), (9, "A", 90_000, True),
                (3, "B", 30, True), (4, "B", None, False), (8, "B", None, False),
                (5, "C", None, False), (7, "C", 50_000, True), (6, "D", 40_000, True)]]
    view = frame(spark, rows, "trace_id bigint, chain string, from_address string, "
                 "to_address string, asset string, value double, value_raw bigint, "
                 "usd_cents bigint, usd_complete boolean, n_movements bigint") \
        .withColumns({"kind": F.lit("flow"), "n_members": F.lit(0).cast("bigint")})
    out = V.fold_minor(view, _nodes(spark, [r[3] for r in rows]))
    assert values(out.filter("kind = 'stub'"), "asset", "n_members", "value_raw", "usd_cents",
                  "usd_complete", "n_movements") == [
        ("A", 2, 300, 30, True, 3), ("B", 3, 1500, 30, False, 15), ("C", 1, 500, None, False, 5)]


def test_freeze_schedule_numbers_by_time(spark):
    rows = [("t1", 200_000, "b", "x", "USDT", 5), ("t2", None, "c", "x", "USDT", 7),
            ("t3", 100, "b", "x", "USDC", 9)]
    edges = movements(spark, rows).withColumns({
        "trace_id": F.lit(1), "usd_cents": F.when(F.col("txid") != "t2", F.col("value_raw"))})
    plan = FL.freeze_schedule(edges, frame(spark, [(1, "fx", "x")],
                                           "trace_id bigint, chain string, address string"))
    assert [r.txid for r in plan.orderBy("seq").collect()] == ["t2", "t3", "t1"]
    totals = {r.asset: (r.total_raw, r.usd_cents, r.first_ts)
              for r in FL.freeze_totals(plan).collect()}
    assert totals == {"USDT": (12, None, 200_000), "USDC": (9, 9, 100),
                      "TOTAL": (None, None, 100)}


def test_pack_hash_is_the_canonical_json_hash(spark):
    from fundflow.sources import packs as PK
    flags = frame(spark, [("b", "tron", 'say "hi" – ok', "2024-01-02"), ("a", "tron", None, None),
                          ("z", "bitcoin", "x", "2024")],
                  "address string, chain string, reason string, created_utc string")
    pack = PK.export_pack(flags, "Agency", "desk", "2024-05-01").first()
    items = [{"address": r.address, "chain": r.chain, "reason": r.reason,
              "flagged_utc": r.flagged_utc} for r in pack.flags]
    assert [(i["chain"], i["address"]) for i in items] == [
        ("bitcoin", "z"), ("tron", "a"), ("tron", "b")]
    text_ = json.dumps(items, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert pack.sha256 == hashlib.sha256(text_.encode()).hexdigest()
    packs = PK.export_pack(flags, "Agency", "desk", "2024-05-01")
    forged = packs.withColumn("flags", F.transform("flags", lambda f: F.struct(
        f["address"].alias("address"), f["chain"].alias("chain"),
        F.lit("changed").alias("reason"), f["flagged_utc"].alias("flagged_utc"))))
    assert PK.check_packs(packs).first().reject is None
    assert PK.check_packs(forged).first().reject == "hash mismatch"
    assert PK.check_packs(packs.withColumn("format", F.lit("x"))).first().reject == "format"
    again = PK.export_pack(flags.filter("chain = 'tron'"), " AGENCY ", "", "2024-06-01")
    got = PK.pack_labels(packs.unionByName(again))
    assert {(r.address, r.source) for r in got.collect()} == {
        ("a", "pack:agency"), ("b", "pack:agency")}
    assert PK.pack_register(packs).first().n_flags == 3
