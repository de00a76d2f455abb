from __future__ import annotations

import json

import pytest

from helpers import frame
from pyspark.sql import functions as F

from fundflow.operators.screening import clean_inputs
from fundflow import schemas as S
from fundflow.operators.trace import TraceParams, trace_many
from fundflow.sources import account as A
from fundflow.sources import labels as L
from fundflow.sources import ledger as LG
from fundflow.sources import reports as RP
from fundflow.sources import tron as TR
from fundflow.sources import utxo as U

EVM = "0x" + "Ab" * 20


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def write(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_sanctions_xml(spark, tmp_path):
    path = write(tmp_path / "sdn.xml", f"""<?xml version="1.0"?>
<sdnList xmlns="https://example.org/list">
 <sdnEntry><uid>1</uid><firstName>Ann</firstName><lastName>Example</lastName><idList>
  <id><idType>Digital Currency Address - ETH</idType><idNumber>{EVM}</idNumber></id>
  <id><idType>Passport</idType><idNumber>1</idNumber></id></idList></sdnEntry>
 <sdnEntry><lastName>GROUP</lastName><idList>
  <id><idType>Digital Currency Address - XBT</idType><idNumber>1AbC</idNumber></id>
  <id><idType>Digital Currency Address - USDT</idType><idNumber>T{'x' * 33}</idNumber></id>
  <id><idType>Digital Currency Address - ZEC</idType><idNumber>zAb</idNumber></id></idList>
 </sdnEntry></sdnList>""")
    got = rows_of(L.load_sdn(spark, path), "address", "chain", "entity_name", "category",
                  "confidence")
    assert got == sorted([
        (EVM.lower(), "ethereum", "OFAC SDN: Ann Example", "sanctioned", "high"),
        ("1AbC", "bitcoin", "OFAC SDN: GROUP", "sanctioned", "high"),
        ("T" + "x" * 33, "tron", "OFAC SDN: GROUP", "sanctioned", "high"),
        ("zAb", "zec", "OFAC SDN: GROUP", "sanctioned", "high")], key=str)


def test_tagpacks(spark, tmp_path):
    write(tmp_path / "exchanges.yaml", """
label: Pack Exchange
currency: BTC
category: exchange
lastmod: 2023-05-06
tags:
  - address: 1Aa
  - address: 1Bb
    label: Other Name
    category: mixer
  - address: 1Cc
    category: donation
  - address: "0xAA"
    currency: ETH
  - label: no address
""")
    write(tmp_path / "my-mixer.yaml", "- just\n- a list\n")
    write(tmp_path / "unrelated.yaml", "label: x\ncategory: exchange\n")
    tags, skipped = L.read_tagpacks(spark, str(tmp_path))
    got = rows_of(L.load_tagpacks(tags), "address", "chain", "entity_name", "category")
    assert got == sorted([
        ("1Aa", "bitcoin", "Pack Exchange [TagPack, as of 2023-05-06]", "exchange"),
        ("1Bb", "bitcoin", "Other Name [TagPack, as of 2023-05-06]", "mixer"),
        ("0xaa", "ethereum", "Pack Exchange [TagPack, as of 2023-05-06]", "exchange")],
        key=str)
    assert [r.path.rsplit("/", 1)[1] for r in skipped.collect()] == ["my-mixer.yaml"]
    _, skipped = L.read_tagpacks(spark, str(tmp_path), names="exchange|mixer")
    assert {(r.path.rsplit("/", 1)[1], r.reason == "name") for r in skipped.collect()} == {
        ("my-mixer.yaml", False), ("unrelated.yaml", True)}


def test_explorer_tags(spark, tmp_path):
    other = "0x" + "cd" * 20
    path = write(tmp_path / "tags.csv", "\n".join([
        "address,chainId,label,nameTag", f"{EVM},1,take-action,Phish", f"{EVM},1,kraken,Kraken 4",
        f"{EVM},1,binance,Late", f"{other},1,bitfinex,\"Tether: Token, USD\"",
        f"{other},56,binance,Elsewhere", "0x12,1,binance,short"]))
    got = rows_of(L.load_explorer_tags(spark, path), "address", "category", "entity_name",
                  "confidence")
    assert got == sorted([
        (EVM.lower(), "exchange", "Kraken 4 [explorer tag]", "medium"),
        (other, "other", "explorer tag: Tether: Token, USD (bitfinex)", "low")], key=str)
    assert rows_of(L.category_counts(L.load_explorer_tags(spark, path)), "category", "n") == [
        ("exchange", 1), ("other", 1)]


def test_json_sources(spark, tmp_path):
    black = write(tmp_path / "b.json", json.dumps([EVM, " ", "0xFF"]))
    assert rows_of(L.load_blacklist(spark, black), "address", "category") == [
        (EVM.lower(), "scam_report"), ("0xff", "scam_report")]
    seed = write(tmp_path / "s.json", json.dumps({"_comment": ["x"], "labels": [
        {"address": EVM, "chain": "ethereum", "entity": "Binance", "category": "exchange"}]}))
    assert rows_of(L.load_seed(spark, seed), "address", "entity_name", "source") == [
        (EVM.lower(), "Binance", "seed_community")]
    comp = write(tmp_path / "c.json", json.dumps({"source_note": "n", "designations": [
        {"entity": "Binance", "status": "compliant", "note": ""},
        {"entity": "FTX", "status": "non_compliant", "note": "closed"}]}))
    entries = L.directory_entries(L.load_compliance(spark, comp))
    assert [(e["ord"], e["entity"], e["status"]) for e in entries] == [
        (0, "Binance", "compliant"), (1, "FTX", "non_compliant")]
    cust = write(tmp_path / "d.json", json.dumps({"source_note": "n", "custodians": [
        {"entity": "Kraken", "legal_name": "Payward", "jurisdiction": "US"},
        {"entity": "OKX", "legal_name": "OKX", "jurisdiction": "Seychelles"}]}))
    assert [r.entity for r in L.load_custodians(spark, cust, "payw").collect()] == ["Kraken"]


def _tx(spark, txid, ts, vin, vout):
    return (txid, (ts,), [((a, v),) for a, v in vin], [(a, v) for a, v in vout])


def test_utxo_records(spark):
    raw = spark.createDataFrame([
        _tx(spark, "t1", 10, [("a", 5), ("a", 6), ("b", 7)], [("c", 9), ("a", 8), (None, 0)]),
        _tx(spark, "t2", None, [(None, 50)], [("c", 50)])], S.RAW_UTXO)
    out = rows_of(U.utxo_outgoing(raw), "txid", "from_address", "to_address",
                  F.col("value_raw").cast("int"), "is_self_transfer")
    assert out == sorted([("t1", "a", "c", 9, False), ("t1", "a", "a", 8, True),
                          ("t1", "b", "c", 9, False), ("t1", "b", "a", 8, False)], key=str)
    into = rows_of(U.utxo_incoming(raw), "from_address", "to_address",
                   F.col("value_raw").cast("int"))
    assert into == sorted([(f, t, v) for t in "ac" for f, v in
                           (("a", 5), ("a", 6), ("b", 7))], key=str)
    legs = rows_of(U.tx_outputs(raw), "txid", "from_address", "to_address")
    assert legs == [("t1", "2 input addresses", "a"), ("t1", "2 input addresses", "c"),
                    ("t2", "coinbase", "c")]
    assert rows_of(U.utxo_stats(raw), "address", "tx_count", "total_received_raw",
                   "balance_raw") == [("a", 1, 8, -3), ("b", 1, 0, -7), ("c", 2, 59, 59)]
    assert rows_of(U.tx_senders(raw), "txid", "address") == [("t1", "a"), ("t1", "b")]


def test_utxo_ledger_gives_the_same_trace_as_movements(spark):
    raw = spark.createDataFrame([
        _tx(spark, "t1", 10, [("a", 50_000), ("z", 70_000)], [("b", 90_000), ("a", 30_000)]),
        _tx(spark, "t2", 20, [("b", 90_000)], [("c", 80_000), ("d", 5)]),
        _tx(spark, "t3", 5, [("b", 1)], [("e", 90_000)])], S.RAW_UTXO)
    from helpers import facts
    start = frame(spark, [(1, "bitcoin", "a")], "trace_id bigint, chain string, address string")
    for direction, first in (("forward", "a"), ("backward", "c")):
        begin = start.withColumn("address", F.lit(first))
        params = TraceParams(direction=direction, pattern="thorough", high_activity=None,
                             max_depth=2, dust_limits={"BTC": 0.0001})
        moves = LG.movements(U.utxo_incoming(raw) if direction == "backward"
                             else U.utxo_outgoing(raw))
        one = trace_many(moves, begin, facts(spark), params)
        two = trace_many(U.UtxoLedger(raw), begin, facts(spark), params)
        columns = ("depth", "txid", "from_address", "to_address", F.col("value_raw").cast("int"))
        assert rows_of(one.edges, *columns) == rows_of(two.edges, *columns) != []


def test_account_edges(spark):
    raw = spark.createDataFrame([
        ("h1", "0xA", "0xB", "10", "5", "0"), ("h2", "0xA", "0xB", "10", "5", "1"),
        ("h3", "0xA", "0xB", "0", "5", "0"), ("h4", "0xA", None, "10", "5", "0"),
        ("h5", "0xA", "0xB", "9" * 50, "0", None)], S.RAW_ACCOUNT_TX)
    got = {r.txid: r for r in A.account_native(raw).collect()}
    assert set(got) == {"h1", "h5"} and got["h1"].ts == 5
    assert (got["h5"].value_raw, got["h5"].oversize, got["h5"].ts) == (None, True, None)
    both = LG.movements(A.account_native(raw), TR.tron_tokens(spark.createDataFrame([
        ("Transfer", "Ta", "Tb", "x1", "7", 1_500, ("c", "", None)),
        ("Approval", "Ta", "Tb", "x2", "7", 1_500, ("c", "", None)),
        ("Transfer", "Ta", "Tb", "x3", "7.5", 1_500, ("c", "", None))], S.RAW_TRON_TOKEN)))
    assert rows_of(both, "chain", "txid", "asset") == [
        ("ethereum", "h1", "ETH"), ("ethereum", "h5", "ETH"), ("tron", "x1", "TRC20")]


def test_bucketed_ledger_needs_no_shuffle(spark):
    from helpers import movements
    rows = [(f"t{i}", i, f"w{i % 50}", f"w{i % 7}", "X", 1000) for i in range(400)]
    spark.sql("DROP TABLE IF EXISTS moves_by_sender")
    LG.write_bucketed(LG.movements(movements(spark, rows)), "moves_by_sender",
                      "from_address", 4)
    table = spark.table("moves_by_sender")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from fundflow.operators.trace import PRUNE_WALLETS, expand

        def plan_of(wallets):
            frontier = frame(spark, [(1, "fx", w, 0, None) for w in wallets],
                             "trace_id bigint, chain string, address string, depth int, "
                             "bound bigint")
            joined = expand(frontier, table, "forward")
            return joined, joined._jdf.queryExecution().executedPlan().toString()
        # Many wallets: the ledger side is read bucket by bucket, unshuffled.
        _, plan = plan_of([f"w{i}" for i in range(PRUNE_WALLETS + 1)])
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
        # One wallet: only its bucket is read.
        joined, plan = plan_of(["w3"])
        assert "SelectedBucketsCount: 1 out of 4" in plan and joined.count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE moves_by_sender")


def test_scam_reports(spark):
    long = "x" * 1300
    many = [(f"a{i}", "bitcoin", None) for i in range(25)]
    report = ("1", None, "2024", True, None, False, long, many, [(1.0, "BTC")] * 12)
    raw = spark.createDataFrame([
        (EVM, "ethereum", "2024-05-01T00:00:00+00:00", 0, [report, report[:1] + ("RUG",) + report[2:]]),
        ("1Aa", "bitcoin", "2024-05-01T00:00:00+00:00", 0, [])], S.SCAM_REPORTS)
    shaped = RP.shape_reports(raw)
    row = shaped.first()
    assert (len(row.description), row.address_count, len(row.other_addresses),
            len(row.losses)) == (1200, 25, 20, 10)
    labels = RP.report_labels(RP.report_counts(raw), RP.report_categories(shaped))
    got = {r.address: (r.entity_name, r.deleted) for r in labels.collect()}
    assert got[EVM.lower()] == ("scam reports by the public: 2, most as RUG x1, "
                                "UNSPECIFIED x1; not verified", False)
    assert got["1Aa"][1] is True


def test_scam_reports_are_stored_whole(spark):
    many = [(f"a{i}", "bitcoin", None) for i in range(25)]
    report = ("1", None, "2024", True, None, False, "x" * 1300 + "end", many, [(1.0, "BTC")] * 12)
    bare = ("2", None, "2024", True, None, False, None, None, None)
    raw = spark.createDataFrame([(EVM, "ethereum", "2024-05-01T00:00:00+00:00", 0, [report, bare])],
                                S.SCAM_REPORTS)
    got = {r.id: (r.description, r.address_count, len(r.other_addresses), len(r.losses))
           for r in RP.whole_reports(raw).collect()}
    assert got == {"1": ("x" * 1300 + "end", 25, 25, 12), "2": ("", 0, 0, 0)}


def test_broken_blacklist_raises(spark, tmp_path):
    for i, text in enumerate(('{"error": "busy"}', "<html>", "")):
        bad = write(tmp_path / f"b{i}.json", text)
        with pytest.raises(Exception, match="no JSON array"):
            L.load_blacklist(spark, bad).collect()
    assert L.load_blacklist(spark, write(tmp_path / "none.json", "[]")).collect() == []


@pytest.mark.parametrize("load, good", [
    (L.load_sdn, "<sdnList><sdnEntry><lastName>A</lastName></sdnEntry></sdnList>"),
    (L.load_seed, '{"labels": []}'), (L.load_compliance, '{"designations": []}'),
    (L.load_custodians, '{"custodians": []}')])
def test_a_broken_file_is_no_empty_snapshot(spark, tmp_path, load, good):
    """Error pages, half downloads, other documents and empty files raise."""
    assert load(spark, write(tmp_path / "good", good)).collect() == []
    texts = ["<html><body>503</body></html>", "", good[:-4], "{}", '{"error": "busy"}', good + " {"]
    for i, text in enumerate(texts):
        with pytest.raises(Exception):
            load(spark, write(tmp_path / f"bad{i}", text)).collect()


def test_exact_amounts_of_any_width_in_transfers(spark):
    from fundflow.operators.flows import exact_totals
    values = ["9" * 36] * 200 + ["1" + "0" * 77, "\t12\n"]
    raw = spark.createDataFrame([(f"h{i}", "1", "0xa", "0xb", v, "0xc", "TKN", "18") for i, v in enumerate(values)],
                                "hash string, timeStamp string, from string, to string, value string, "
                                "contractAddress string, tokenSymbol string, tokenDecimal string")
    got = exact_totals(A.account_tokens(raw), "asset").first()
    assert int(got.total) == sum(int(v) for v in values) and (got.n_movements, got.n_exact) == (202, 202)
    assert int(got.largest) == 10**77


def test_newest_pack_by_time_whatever_the_notation(spark):
    from fundflow.sources import packs as PK
    flags = frame(spark, [("0xA1", "ethereum", "r", 1, "2024-01-02")],
                  "address string, chain string, reason string, case_id bigint, created_utc string")
    new = PK.export_pack(flags.withColumn("reason", F.lit("new")), "Agency", "", "2024-05-01T10:00:00+00:00")
    old = PK.export_pack(flags, "Agency", "", "2024-05-01T11:30:00+02:00")  # 9:30, though later as text
    assert PK.pack_labels(old.unionByName(new)).first().entity_name.split(": ")[1].startswith("new")


def test_white_space_of_any_kind_is_stripped(spark):
    rows = spark.createDataFrame([(i, a + EVM + b) for i, (a, b) in enumerate(
        [("", "\r"), ("\t", "\n"), (" ", "\r\n"), ("  ", "\x1f")])], "ord int, raw string")
    got = clean_inputs(rows).collect()
    assert [(r.address, r.kind, r.input) for r in got] == [(EVM.lower(), "address", EVM)]
