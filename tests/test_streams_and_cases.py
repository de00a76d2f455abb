from __future__ import annotations

import hashlib

from helpers import frame
from pyspark.sql import functions as F

from fundflow.operators import provenance as PV
from fundflow.operators import screening as SC
from fundflow.streaming import late as LT
from fundflow.streaming import live as LV
from fundflow.streaming import run_lots
from fundflow.streaming import watches as WT

SNAP = ("chain string, address string, ts bigint, seq bigint, tx_count bigint, "
        "balance string, failed boolean")


def _drain(stream, out, log, mode="append"):
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", log).trigger(availableNow=True).start())
    query.awaitTermination()


def test_watch_alerts_survive_a_restart(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    watches = frame(spark, [("fx", "w")], "chain string, address string")

    def feed(rows):
        frame(spark, rows, SNAP).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SNAP).parquet(src)
        _drain(WT.watch_alerts(stream, watches), out, log)
        return [(r.ts, r.before_count, r.after_count, r.before_balance, r.after_balance)
                for r in spark.read.parquet(out).orderBy("ts").collect()]
    # First sight sets the baseline; other wallets are ignored.
    assert feed([("fx", "w", 1, 1, 5, "100", False), ("fx", "other", 1, 2, 1, "1", False)]) == []
    first = feed([("fx", "w", 2, 3, 6, "100", False), ("fx", "w", 3, 4, 9, "0", True)])
    assert first == [(2, 5, 6, "100", "100")]
    # After a failed snapshot the old baseline still counts.
    again = feed([("fx", "w", 4, 5, 6, "100", False), ("fx", "w", 5, 6, 6, "90", False)])
    assert again == first + [(5, 6, 6, "100", "90")]
    # One older than the baseline is given back as late, in one lot with a newer one.
    both = feed([("fx", "w", 3, 7, 50, "1", False), ("fx", "w", 5, 5, 51, "1", False),
                 ("fx", "w", 6, 8, 7, "90", False)])
    assert sorted(both) == sorted(again + [(3, 6, 50, "90", "1"), (5, 6, 51, "90", "1"),
                                           (6, 6, 7, "90", "90")])
    assert {(r.ts, r.after_count) for r in spark.read.parquet(out).filter("late").collect()} == {
        (3, 50), (5, 51)}


def test_alerts_stay_until_acknowledged(spark):
    ddl = WT.ALERT_SCHEMA
    alerts = frame(spark, [("fx", "w", 2, 5, 6, "1", "1", False), ("fx", "w", 4, 6, 7, "1", "1", False),
                           ("fx", "w", 9, 7, 1, "1", "1", True), ("fx", "v", 3, 1, 2, "1", "1", False),
                           ("fx", "x", 3, 1, 2, "1", "1", False)], ddl)

    def shown(acks):
        seen = frame(spark, acks, "chain string, address string, ts bigint")
        return {(r.address, r.ts, r.after_count, r.n_alerts)
                for r in WT.open_alerts(alerts, seen).collect()}
    assert shown([]) == {("w", 4, 7, 2), ("v", 3, 2, 1), ("x", 3, 2, 1)}
    # An acknowledgement covers its own second; an earlier one leaves the newer alert.
    assert shown([("fx", "w", 3), ("fx", "v", 3), ("fx", "v", 1), ("fy", "x", 9)]) == {
        ("w", 4, 7, 2), ("x", 3, 2, 1)}
    assert WT.open_alerts(alerts.limit(0), alerts.select("chain", "address", "ts")).count() == 0


def test_activity_windows_drop_what_is_too_late(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    ddl = "chain string, address string, ts bigint, value_raw bigint"
    watches = frame(spark, [("fx", "w")], "chain string, address string")

    def feed(rows):
        frame(spark, rows, ddl).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src).withColumn(
            "event_time", F.timestamp_seconds("ts"))
        _drain(WT.watch_activity(stream, watches), out, log)
    feed([("fx", "w", 100, 5), ("fx", "w", 200, 6), ("fx", "w", 20_000, 1)])
    feed([("fx", "w", 300, 7), ("fx", "w", 40_000, 1)])       # 300 is too late
    got = {r.s: (r.n_movements, r.value_raw) for r in spark.read.parquet(out).withColumn(
        "s", F.unix_seconds("window_start")).collect()}
    assert got == {0: (2, 11), 19_800: (1, 1)}
    # What came too late is counted and added; the open interval is not.
    finals = spark.read.parquet(out)
    landed = spark.read.schema(ddl).parquet(src).withColumn("event_time", F.timestamp_seconds("ts"))
    late = LT.late_activity(landed, finals, watches)
    whole = {r.s: (r.n_movements, r.value_raw, r.n_late) for r in LT.with_late(
        finals, late).withColumn("s", F.unix_seconds("window_start")).collect()}
    assert whole == {0: (3, 18, 1), 19_800: (1, 1, 0)}
    assert LT.late_activity(landed.limit(0), finals, watches).count() == 0


def test_first_capture_of_a_day_is_the_earliest(spark, tmp_path):
    day = 86_400
    lots = [[("u", day + 50, 2, "b"), ("u", day + 10, 1, "a"), ("v", day + 7, 3, "c"),
             ("u", 3 * day, 4, "d")],
            [("u", day + 5, 5, "late"), ("w", day, 6, "only late"), ("u", 5 * day, 7, "e")]]
    ddl = "source string, ts bigint, seq bigint, body string"

    def timed(df):
        return df.withColumn("event_time", F.timestamp_seconds("ts"))
    landed, given = run_lots([frame(spark, rows, ddl) for rows in lots], "firsts", lambda s:
                             LV.first_captures(timed(s), ["source"], ["ts", "seq"]))
    assert {(r.source, r.body) for r in given.collect()} == {("u", "a"), ("v", "c"), ("u", "d")}
    rest = LT.late_pulls(timed(landed), given, ["source"], ["ts", "seq"])
    assert {(r.source, r.body) for r in rest.collect()} == {
        ("u", "late"), ("w", "only late"), ("u", "e")}


def test_late_sweeps_and_forwards_before_the_deposit(spark, tmp_path):
    hour, t0 = 3600, 1_000_000
    ddl = ("side string, chain string, txid string, from_address string, to_address string, "
           "asset string, value_raw bigint, ts bigint")

    def put(txid, feeder, ts, value=100):
        return ("in", "fx", txid, "a", feeder, "T", value, ts)

    def send(txid, feeder, ts, value=95):
        return ("out", "fx", txid, feeder, "hub", "T", value, ts)
    lots = [[put("d1", "f1", t0), send("s1", "f1", t0 + hour), put("d2", "f2", t0),
             put("d3", "f3", t0 + 5 * hour), send("s3", "f3", t0), put("d4", "f4", t0),
             send("s4", "f4", t0 + 72 * hour + 1), put("d9", "f9", t0 + 900 * hour),
             send("s9", "f8", t0 + 900 * hour)],
            [send("s2", "f2", t0 + 2 * hour), send("s9b", "f9", t0 + 901 * hour, 89)]]
    busy = frame(spark, [("fx", "hub")], "chain string, address string")

    def sides(df):
        timed = df.withColumn("event_time", F.timestamp_seconds("ts"))
        return timed.filter("side = 'in'"), timed.filter("side = 'out'")
    landed, given = run_lots([frame(spark, rows, ddl) for rows in lots], "sweeps",
                             lambda s: LV.sweep_stream(*sides(s), busy))
    assert {r.sweep_txid for r in given.collect()} == {"s1"}
    late = LT.late_sweeps(*sides(landed), busy, given)
    assert {(r.deposit_txid, r.sweep_txid) for r in late.collect()} == {("d2", "s2"), ("d3", "s3")}


def test_stream_dedup_and_screen(spark, tmp_path):
    from helpers import facts
    src = str(tmp_path / "in")
    frame(spark, [("u", 1, "a", "x", "fx"), ("u", 2, "a", "b", "fx"), ("v", 3, "x", "b", "fx")],
          "source string, ts bigint, from_address string, to_address string, chain string") \
        .coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src).withColumn(
        "event_time", F.timestamp_seconds("ts"))
    known = facts(spark, [("x", "K", "exchange", "seed", "medium")])
    _drain(LV.live_screen(stream, known), str(tmp_path / "o1"), str(tmp_path / "l1"))
    hits = {(r.ts, r.from_hits, r.to_hits) for r in spark.read.parquet(
        str(tmp_path / "o1")).collect()}
    assert hits == {(1, None, "exchange"), (3, "exchange", None)}
    _drain(LV.dedup_captures(stream, ["source"]), str(tmp_path / "o2"), str(tmp_path / "l2"))
    assert {r.source for r in spark.read.parquet(str(tmp_path / "o2")).collect()} == {"u", "v"}
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2


def test_captures_and_custody(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_bytes(b"alpha")
    (tmp_path / "files" / "b.bin").write_bytes(b"\x00\x01")
    rows = {r.file: (r.sha256, r.bytes) for r in PV.manifest(
        spark, str(tmp_path / "files")).collect()}
    assert rows == {"a.txt": (hashlib.sha256(b"alpha").hexdigest(), 5),
                    "b.bin": (hashlib.sha256(b"\x00\x01").hexdigest(), 2)}
    ddl = "cache_key string, body string, fetched_utc string"
    store = frame(spark, [("k1", "one", "1")], ddl)
    new = frame(spark, [("k1", "changed", "2"), ("k2", "late", "9"), ("k2", "early", "3")], ddl)
    kept = PV.first_capture(store, new)
    assert [(r.cache_key, r.body) for r in kept.collect()] == [("k2", "early")]
    log = frame(spark, [(1, "k1", hashlib.sha256(b"one").hexdigest()), (2, "k1", "00"),
                        (3, "k9", "00"), (4, "k1", None)], "id bigint, url string, sha256 string")
    assert {r.id: r.verdict for r in PV.verify(store, log).collect()} == {
        1: "ok", 2: "mismatch", 3: "missing"}


def test_files_of_many_blocks(spark, tmp_path, monkeypatch):
    def root(data, block, fan):
        level = [hashlib.sha256(data[i:i + block]).hexdigest() for i in range(0, len(data), block)]
        n = len(level)
        for _ in range(rounds):
            level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest()
                     for i in range(0, len(level), fan)]
        return n, level[0]
    files = {"empty": b"", "one": b"x", "even": b"ab" * 50, "long": bytes(range(256)) * 40}
    (tmp_path / "f" / "deep").mkdir(parents=True)
    for name, data in files.items():
        (tmp_path / "f" / "deep" / name).write_bytes(data)
    monkeypatch.setattr(PV, "CHUNK", 7)
    for block, fan, rounds in ((10, 4, 5), (100, 1024, 1), (1 << 20, 2, 1)):
        got = {r.file: (r.bytes, r.n_blocks, r.root) for r in PV.block_manifest(
            spark, str(tmp_path / "f"), block=block, fan=fan).collect()}
        assert got == {n: (len(d), *root(d, block, fan)) for n, d in files.items() if d}


def test_result_of_many_traces_has_few_folders(spark, tmp_path):
    rows = frame(spark, [(i % 500, f"a{i}") for i in range(2_000)], "trace_id bigint, address string")
    PV.export_result(rows, rows, rows.limit(0), str(tmp_path / "r"))
    assert len(list((tmp_path / "r" / "nodes").glob("bucket=*"))) <= PV.BUCKETS
    one = PV.read_result(spark, str(tmp_path / "r"), "edges", "trace_id bigint, address string", 7)
    assert sorted(r.address for r in one.collect()) == sorted(f"a{i}" for i in range(7, 2_000, 500))
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    whole = PV.read_result(spark, str(tmp_path / "r"), "nodes", "trace_id bigint, address string")
    assert sorted(whole.collect()) == sorted(rows.collect())


def test_case_moves_between_stores(spark, tmp_path):
    cases = frame(spark, [(3, "Case", "C-3"), (4, "Else", "C-4")],
                  "id bigint, name string, case_number string")
    traces = frame(spark, [(3, 12, "fx"), (3, 7, "fx"), (4, 9, "fx")],
                   "case_id bigint, trace_id bigint, chain string")
    custody = frame(spark, [(1, 7, "u1"), (2, 9, "u2"), (3, 12, "u3")],
                    "id bigint, trace_id bigint, url string")
    flags = frame(spark, [("w", "fx", 3), ("v", "fx", 4)],
                  "address string, chain string, case_id bigint")
    out = PV.export_case(3, cases, traces, custody, flags, flags, flags)
    assert {k: v.count() for k, v in out.items()} == {
        "cases": 1, "traces": 2, "custody_log": 2, "annotations": 1, "flags": 1, "watches": 1}
    PV.write_case(out, str(tmp_path / "case"))
    back = {n: spark.read.schema(df.schema).json(str(tmp_path / "case" / n))
            for n, df in out.items()}
    moved = PV.import_case(back, 50, 100)
    assert {(r.url, r.trace_id) for r in moved["custody_log"].collect()} == {
        ("u1", 101), ("u3", 102)}
    assert {r.case_id for r in moved["flags"].collect()} == {50}
    assert moved["cases"].first().id == 50


def test_screening_file(spark, tmp_path):
    raw = frame(spark, [(1, " 0x" + "AB" * 20 + " "), (2, "0x" + "ab" * 20), (3, ""),
                        (4, "hello")], "ord bigint, raw string")
    inputs = SC.clean_inputs(raw)
    assert {(r.ord, r.kind, r.chain) for r in inputs.collect()} == {
        (1, "address", "ethereum"), (4, "unknown", None)}
    labels = frame(spark, [("0x" + "ab" * 20, "ethereum", "Kraken", "exchange", "seed", "medium"),
                           ("0x" + "ab" * 20, "ethereum", "P", "shared_flag", "pack:p", "medium"),
                           ("0x" + "ab" * 20, "ethereum", "R", "scam_report", "chainabuse", "medium")],
                   "address string, chain string, entity_name string, category string, "
                   "source string, confidence string")
    empty = "chain string, address string"
    flags = frame(spark, [], empty + ", reason string")
    rows = SC.screen(inputs, labels, flags, frame(spark, [], empty),
                     frame(spark, [], empty + ", report_count bigint"))
    SC.screen_csv(rows).coalesce(1).write.option("header", "true").csv(str(tmp_path / "csv"))
    got = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert got.columns == list(SC.CSV_COLUMNS)
    row = got.filter("chain = 'ethereum'").first()
    assert (row.attribution, row.shared_flags, row.scam_lists) == ("Kraken", "P", None)
    assert row.labels == "P [pack:p/medium] | Kraken [seed/medium] | R [chainabuse/medium]" or \
        row.labels.count("|") == 2
    assert got.filter("input = 'hello'").first().note == "not an address: unknown"
