"""Streaming jobs over the event and order files, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.session import materialise, shuffled
from fundflow.streaming import run_available, run_lots
from fundflow.streaming import late as LT
from fundflow.streaming import live as LV
from fundflow.streaming import watches as WT


def read_stream(spark, sf, name):
    """A given table as a file stream."""
    schema = X.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet") \
        .option("maxFilesPerTrigger", "1").parquet(sf)


LOTS = 3
TARDY = 20   # one row in so many comes with the last lot, whatever its time


def _lots(rows, ts="ts", number="event_id"):
    """Rows in lots of rising time; those behind time come with the last."""
    lo, hi = rows.agg(F.min(ts), F.max(ts)).first()
    lot = F.when(F.col(number) % TARDY == 7, LOTS - 1).otherwise(
        F.floor((F.col(ts) - lo) * LOTS / (hi - lo + 1)))
    return [rows.filter(lot == i) for i in range(LOTS)]


# Events with the lot they come with; ``pos`` orders a wallet's rows.
_LOT_SQL = f"""(SELECT *, t * 100000000 + event_id AS pos,
    CASE WHEN event_id % {TARDY} = 7 THEN {LOTS - 1}
         ELSE CAST(floor((t - lo) * {LOTS} / (hi - lo + 1)) AS BIGINT) END AS lot
  FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
       (SELECT min(CAST(floor(epoch(ts)) AS BIGINT)) AS lo,
               max(CAST(floor(epoch(ts)) AS BIGINT)) AS hi FROM events))"""


def _moves(spark, sf):
    """Movements as a file stream."""
    return _timed(_as_moves(read_stream(spark, sf, "events")))


def _as_moves(events):
    to = F.get_json_object("props", "$.k")
    return events.select(
        F.lit(X.CHAIN).alias("chain"), F.col("event_id").cast("string").alias("txid"),
        X.epoch("ts").alias("ts"), F.concat(F.lit("u"), "user_id").alias("from_address"),
        F.concat(F.lit("u"), to).alias("to_address"), F.col("event_type").alias("asset"),
        X.cents("value").alias("value_raw"))


def _timed(moves):
    return moves.withColumn("event_time", F.timestamp_seconds("ts"))


@R.shared
def _watched(spark, sf):
    """Odd wallets are on the watch list, written once for all lots."""
    return shuffled(materialise(X.wallets(X.moves(spark, sf)).filter("i % 2 = 1").select(
        F.lit(X.CHAIN).alias("chain"), "address"), "watched"))


def _alerts(spark, sf):
    """Every event is a snapshot of its wallet; error events are failed pulls."""
    snaps = X.table(spark, sf, "events").select(
        F.lit(X.CHAIN).alias("chain"), F.concat(F.lit("u"), "user_id").alias("address"),
        X.epoch("ts").alias("ts"), F.col("event_id").alias("seq"),
        (F.floor("value") % 3).cast("bigint").alias("tx_count"),
        (F.col("event_id") % 2).cast("string").alias("balance"),
        (F.col("event_type") == "error").alias("failed"))
    watched = _watched(spark, sf)
    return run_lots(_lots(snaps, number="seq"), "alerts",
                    lambda stream: WT.watch_alerts(stream, watched))[1]


_ALERT_SQL = f"""
  SELECT address, ts, before_count, after_count, before_balance, after_balance, late FROM (
    SELECT *, CASE WHEN late THEN base_count ELSE lag(after_count) OVER w END AS before_count,
      CASE WHEN late THEN base_balance ELSE lag(after_balance) OVER w END AS before_balance FROM (
      SELECT 'u' || e.user_id AS address, e.t AS ts, e.pos,
        CAST(floor(e.value) AS BIGINT) % 3 AS after_count,
        CAST(e.event_id % 2 AS VARCHAR) AS after_balance, coalesce(e.pos < b.pos, false)
          AND e.event_id % {TARDY} = 7 AS late, b.base_count, b.base_balance
      FROM {_LOT_SQL} e LEFT JOIN (
        SELECT user_id, max(pos) AS pos,
               arg_max(CAST(floor(value) AS BIGINT) % 3, pos) AS base_count,
               arg_max(CAST(event_id % 2 AS VARCHAR), pos) AS base_balance FROM {_LOT_SQL}
        WHERE lot < {LOTS - 1} AND event_type <> 'error' GROUP BY 1) b USING (user_id)
      WHERE e.event_type <> 'error' AND e.user_id % 2 = 1)
    WINDOW w AS (PARTITION BY address, late ORDER BY pos))
  WHERE late OR before_count <> after_count OR before_balance <> after_balance"""


@query("watch_alerts_stream", _ALERT_SQL)
def watch_alerts_stream(spark, sf):
    """Alerts over three lots with a restart between them, late snapshots marked."""
    return _alerts(spark, sf).drop("chain")


@query("watch_open_alerts", f"""
  SELECT address, ts, before_count, after_count, before_balance, after_balance, n_alerts FROM (
    SELECT *, count(*) OVER (PARTITION BY address) AS n_alerts, row_number() OVER (
      PARTITION BY address ORDER BY ts DESC, after_count DESC, after_balance DESC,
        before_count DESC, before_balance DESC) AS k
    FROM ({_ALERT_SQL}) WHERE NOT late)
  LEFT JOIN (SELECT 'u' || user_id AS address, max(CAST(floor(epoch(ts)) AS BIGINT)) AS seen
             FROM events WHERE event_type = 'error' GROUP BY 1) USING (address)
  WHERE k = 1 AND (seen IS NULL OR ts > seen)""")
def watch_open_alerts(spark, sf):
    """Every error event acknowledges the wallet's alerts up to its time."""
    seen = X.table(spark, sf, "events").filter("event_type = 'error'").select(
        F.lit(X.CHAIN).alias("chain"), F.concat(F.lit("u"), "user_id").alias("address"),
        X.epoch("ts").alias("ts"))
    return WT.open_alerts(_alerts(spark, sf), seen).drop("chain")


@query("activity_window_stream", f"""
  SELECT 'u' || user_id AS address, t // 1800 * 1800 AS window_start,
         CAST(count(*) AS BIGINT) AS n_movements,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_raw,
         CAST(count(*) FILTER (lot = {LOTS - 1} AND t // 1800 * 1800 + 1800 <= passed) AS BIGINT)
           AS n_late
  FROM {_LOT_SQL},
    (SELECT max(t) - 3600 AS passed FROM {_LOT_SQL} WHERE lot < {LOTS - 1})
  WHERE user_id % 2 = 1 AND t // 1800 * 1800 + 1800 <= hi - 3600 GROUP BY 1, 2""")
def activity_window_stream(spark, sf):
    """Final intervals of the stream and the movements that came after them."""
    watched = _watched(spark, sf)

    def named(moves):
        return _timed(moves).withColumn("address", F.col("from_address"))
    moves = _as_moves(X.table(spark, sf, "events")).withColumn("event_id", F.col("txid").cast("bigint"))
    landed, finals = run_lots(_lots(moves), "activity",
                              lambda stream: WT.watch_activity(named(stream), watched))
    late = LT.late_activity(named(landed), finals, watched)
    return LT.with_late(finals, late).select(
        "address", F.unix_seconds("window_start").alias("window_start"),
        "n_movements", "value_raw", "n_late")


_HITS = """concat_ws(',', CASE WHEN {a}.flagged THEN 'agency_flag' END,
  CASE WHEN {a}.is_exchange THEN 'exchange' END, CASE WHEN {a}.is_mixer THEN 'mixer' END,
  CASE WHEN {a}.shared THEN 'partner_flag' END,
  CASE WHEN {a}.is_sanctioned THEN 'sanctioned' END,
  CASE WHEN {a}.scam THEN 'scam_report' END)"""


@query("live_screen_stream", O.with_fx(["fx_facts"], f"""
  SELECT * FROM (SELECT m.txid, nullif({_HITS.format(a='a')}, '') AS from_hits,
                        nullif({_HITS.format(a='b')}, '') AS to_hits
    FROM fx_moves m JOIN fx_facts a ON a.address = m.src JOIN fx_facts b ON b.address = m.dst)
  WHERE from_hits IS NOT NULL OR to_hits IS NOT NULL"""))
def live_screen_stream(spark, sf):
    hits = LV.live_screen(_moves(spark, sf), R.facts(spark, sf))
    return run_available(hits, "screened").select("txid", "from_hits", "to_hits")


@query("dedup_stream", """
  SELECT 'u' || user_id AS source, event_type AS url, CAST(date_trunc('day', ts) AS DATE) AS day,
         min_by(event_id, CAST(floor(epoch(ts)) AS BIGINT) * 100000000 + event_id) AS event_id
  FROM events GROUP BY 1, 2, 3""")
def dedup_stream(spark, sf):
    """The first pull of each key and day, whichever lot it came with."""
    pulls = X.table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("url"),
        "event_id", X.epoch("ts").alias("ts"))
    keys, order = ["source", "url"], ["ts", "event_id"]
    landed, given = run_lots(_lots(pulls), "pulls",
                             lambda stream: LV.first_captures(_timed(stream), keys, order))
    # A day given before an earlier pull came late has two firsts: the earlier one stays.
    both = given.unionByName(LT.late_pulls(_timed(landed), given, keys, order))
    return both.groupBy(*keys, "day").agg(F.min_by("event_id", F.struct(*order)).alias("event_id"))


@query("sweep_stream", O.with_fx(["fx_ledger_facts"], """
  SELECT d.dst AS feeder, f.dst AS service_address, d.txid AS deposit_txid,
         f.txid AS sweep_txid, d.raw AS in_raw, f.raw AS value_raw
  FROM fx_ledger d JOIN fx_ledger f ON f.src = d.dst AND f.asset = d.asset
  JOIN fx_ledger_facts b ON b.address = f.dst AND b.activity > 250
  WHERE f.ts - d.ts <= 259200 AND f.raw * 100 >= d.raw * 90"""))
def sweep_stream(spark, sf):
    """Sweeps given by the stream and those that only the landed tables show."""
    nation = X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    busy = R.ledger_facts(spark, sf).filter(F.col("activity") > R.BUSY)

    def legs(orders):
        chain, asset = F.lit(X.CHAIN).alias("chain"), F.lit("USDT").alias("asset")
        deposits = orders.select(
            chain, asset, F.concat(F.lit("p"), "o_orderkey").alias("txid"),
            F.concat(F.lit("c"), "o_custkey").alias("from_address"),
            F.concat(F.lit("o"), "o_orderkey").alias("to_address"),
            F.col("raw").alias("value_raw"), F.timestamp_seconds("ts").alias("event_time"))
        forwards = orders.filter("o_orderkey % 2 = 1").join(shuffled(nation), "o_custkey").select(
            chain, asset, F.concat(F.lit("s"), "o_orderkey").alias("txid"),
            F.concat(F.lit("o"), "o_orderkey").alias("from_address"),
            F.concat(F.lit("n"), "c_nationkey").alias("to_address"),
            F.expr("raw * (80 + o_orderkey % 21) div 100").alias("value_raw"),
            F.timestamp_seconds(F.col("ts") + (F.col("o_orderkey") % 120) * 3600)
            .alias("event_time"))
        return deposits, forwards
    orders = X.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", X.epoch("o_orderdate").alias("ts"),
        X.cents("o_totalprice").alias("raw"))
    landed, given = run_lots(_lots(orders, number="o_orderkey"), "sweeps",
                             lambda stream: LV.sweep_stream(*legs(stream), busy))
    late = LT.late_sweeps(*legs(landed), busy, given)
    return given.unionByName(late).drop("chain")
