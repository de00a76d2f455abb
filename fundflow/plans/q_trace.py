"""Movements, branches, traces, exits, prices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import text as T
from fundflow.operators import branches as B
from fundflow.operators import exits as E
from fundflow.operators import prices as P
from fundflow.operators import trace as TR
from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.sources.ledger import newest

U5 = "SELECT 1 AS trace_id, 'u5' AS address"
CUSTOMERS = "SELECT DISTINCT o_custkey AS trace_id, 'c' || o_custkey AS address FROM orders"
NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS trace_id, 'n' || n_nationkey AS address FROM nation"


def u5_ctes(direction="forward", pattern="balanced", depth=3):
    return O.trace_ctes("fx_moves", "fx_facts", U5, direction, pattern, depth)


def customer_ctes(pattern="thorough"):
    return O.trace_ctes("fx_ledger", "fx_ledger_facts", CUSTOMERS, "forward", pattern, 3,
                        busy=R.BUSY)


def nation_ctes():
    return O.trace_ctes("fx_ledger", "fx_ledger_facts", NATIONS, "backward", "thorough", 3,
                        busy=R.BUSY_CUSTOMER)


DAY = "DATE '1970-01-01' + CAST(ts // 86400 AS INTEGER)"


def usd_cte(source="t_edges", name="t_usd", pegged="purchase", prices=True):
    """Valued edges, same arithmetic on doubles as the rule states."""
    if not prices:
        return (name, f"SELECT *, CAST(floor((raw / 100.0::DOUBLE) * 1.0::DOUBLE "
                      f"* 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS usd_cents FROM {source}")
    return (name, f"""
      SELECT e.*, CAST(floor((e.raw / 100.0::DOUBLE)
          * (CASE WHEN e.asset = '{pegged}' THEN 1.0::DOUBLE ELSE p.usd END)
          * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS usd_cents,
        CASE WHEN e.asset = '{pegged}' THEN 'pegged $1.00'
             ELSE CAST(p.date AS VARCHAR) END AS usd_price_date
      FROM {source} e LEFT JOIN fx_prices p ON p.asset = e.asset
        AND p.date = {DAY.replace("ts", "e.ts")}""")


# ------------------------------------------------------------------ filters

@query("dust_split", O.with_fx(["fx_moves"], """
  SELECT asset, CAST(count(*) FILTER (raw < 1000) AS BIGINT) AS n_dust,
         CAST(coalesce(sum(raw) FILTER (raw < 1000), 0) AS BIGINT) AS dust_raw,
         CAST(count(*) FILTER (raw >= 1000) AS BIGINT) AS n_kept
  FROM fx_moves GROUP BY asset"""))
def dust_split(spark, sf):
    keep, dust = B.split_dust(X.moves(spark, sf), token=10.0)
    kept = keep.groupBy("asset").agg(F.count(F.lit(1)).alias("n_kept"))
    return kept.join(dust, "asset", "full").na.fill(0)


@query("self_filter", O.with_fx(["fx_moves"], """
  SELECT txid, src AS from_address, dst AS to_address, asset, raw AS value_raw
  FROM fx_moves WHERE src <> dst"""))
def self_filter(spark, sf):
    return B.drop_self(X.moves(spark, sf)).select(
        "txid", "from_address", "to_address", "asset", "value_raw")


@query("time_filter", O.with_fx(["fx_moves"], """
  SELECT m.src AS address, CAST(count(*) FILTER (m.ts >= b.bound) AS BIGINT) AS n_kept,
         CAST(count(*) FILTER (m.ts < b.bound) AS BIGINT) AS n_skipped
  FROM fx_moves m JOIN (SELECT dst, min(ts) AS bound FROM fx_moves GROUP BY 1) b
    ON b.dst = m.src GROUP BY 1"""))
def time_filter(spark, sf):
    """Movements of each wallet before and after it first received."""
    m = X.moves(spark, sf)
    bounds = m.groupBy(F.col("to_address").alias("from_address")).agg(
        F.min("ts").alias("bound"))
    keep, late = B.split_time(m.join(bounds, "from_address"), S.FORWARD)
    rows = keep.select("from_address", F.lit(True).alias("k")).unionByName(
        late.select("from_address", F.lit(False).alias("k")))
    return rows.groupBy(F.col("from_address").alias("address")).agg(
        F.count_if("k").alias("n_kept"), F.count_if(~F.col("k")).alias("n_skipped"))


_PASTED = """
  SELECT event_id AS id, CASE CAST(event_id % 8 AS INTEGER)
    WHEN 0 THEN chr(9) || chr(160) || ' 0xAB' || lpad(CAST(user_id AS VARCHAR), 38, '0')
           || ' ' || chr(13) || chr(10)
    WHEN 1 THEN '0xCD' || lpad(CAST(event_id AS VARCHAR), 62, '0')
    WHEN 2 THEN 'bc1q' || lpad(CAST(user_id AS VARCHAR), 36, '0')
    WHEN 3 THEN '1' || lpad(CAST(user_id + 1 AS VARCHAR), 30, 'B')
    WHEN 4 THEN lpad(CAST(event_id AS VARCHAR), 64, 'a')
    WHEN 5 THEN 'T' || lpad(CAST(user_id + 1 AS VARCHAR), 33, 'C')
    WHEN 6 THEN '4' || lpad(CAST(user_id AS VARCHAR), 94, 'A')
    ELSE event_type END AS raw FROM events"""
_B58 = "[a-km-zA-HJ-NP-Z1-9]"


@query("normalise_detect", f"""
  WITH p AS ({_PASTED}), t AS (
    SELECT id, trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS v FROM p), d AS (
    SELECT id, v, CASE
      WHEN regexp_full_match(v, '0x[a-fA-F0-9]{{40}}') THEN 'address/ethereum/true'
      WHEN regexp_full_match(v, '0x[a-fA-F0-9]{{64}}') THEN 'txid/ethereum/true'
      WHEN regexp_full_match(v, 'bc1[a-z0-9]{{20,80}}') THEN 'address/bitcoin/true'
      WHEN regexp_full_match(v, '[13]{_B58}{{25,34}}') THEN 'address/bitcoin/true'
      WHEN regexp_full_match(v, '[a-fA-F0-9]{{64}}') THEN 'txid/bitcoin/true'
      WHEN regexp_full_match(v, 'T{_B58}{{33}}') THEN 'address/tron/true'
      WHEN regexp_full_match(v, '[48][0-9AB]{_B58}{{93}}') THEN 'address/monero/false'
      WHEN regexp_full_match(v, '(ltc1[a-z0-9]{{20,80}}|[LM]{_B58}{{26,33}})')
        THEN 'address/litecoin/false'
      ELSE 'unknown//false' END AS k FROM t)
  SELECT id, split_part(k, '/', 1) AS kind, nullif(split_part(k, '/', 2), '') AS chain,
         split_part(k, '/', 3) = 'true' AS traceable,
         CASE WHEN split_part(k, '/', 2) = 'ethereum' OR starts_with(v, '0x')
              THEN lower(v) ELSE v END AS address FROM d""")
def normalise_detect(spark, sf):
    e = X.table(spark, sf, "events")
    kind = (F.col("event_id") % 8).cast("int")

    def pad(col, n, ch):
        return F.lpad(col.cast("string"), n, ch)
    user, event = F.col("user_id"), F.col("event_id")
    raw = (F.when(kind == 0, F.concat(F.lit("\t\u00a0 0xAB"), pad(user, 38, "0"),
                                    F.lit(" \r\n")))
           .when(kind == 1, F.concat(F.lit("0xCD"), pad(event, 62, "0")))
           .when(kind == 2, F.concat(F.lit("bc1q"), pad(user, 36, "0")))
           .when(kind == 3, F.concat(F.lit("1"), pad(user + 1, 30, "B")))
           .when(kind == 4, pad(event, 64, "a"))
           .when(kind == 5, F.concat(F.lit("T"), pad(user + 1, 33, "C")))
           .when(kind == 6, F.concat(F.lit("4"), pad(user, 94, "A")))
           .otherwise(F.col("event_type")))
    rows = e.select(event.alias("id"), raw.alias("raw")).withColumn("d", T.detect(F.col("raw")))
    return rows.select("id", "d.kind", "d.chain", "d.traceable",
                       T.norm_addr(T.strip(F.col("raw")), F.col("d.chain")).alias("address"))


_TOUCHING = """
  SELECT address, txid, n >= 25 AS capped FROM (
    SELECT *, max(k) OVER (PARTITION BY address) AS n FROM (
      SELECT address, txid, dense_rank() OVER (PARTITION BY address ORDER BY ts DESC, txid) AS k
      FROM (SELECT src AS address, txid, ts FROM fx_moves
            UNION SELECT dst, txid, ts FROM fx_moves)) WHERE k <= 25)"""


def _newest(spark, sf):
    return newest(X.moves(spark, sf), 25).select("address", "txid", "capped")


# the newest transactions on either side of a wallet, before any filter
query("newest_n", O.with_fx(["fx_moves"], _TOUCHING))(_newest)


@query("newest_touching", O.with_fx(["fx_facts"], """
  SELECT address, depth, role, at_rest, outgoing_txs_capped FROM t_nodes""", O.trace_ctes(
    "fx_moves", "fx_facts", U5, "forward", "thorough", 3, newest=25)))
def newest_touching(spark, sf):
    """A trace that reads 25 transactions of a wallet: one whose list is full is
    not at rest, whatever is left of the list after the filters."""
    run = TR.trace_many(R.moves(spark, sf), R._u5(spark), R.facts(spark, sf), replace(
        R.event_params(S.FORWARD, S.THOROUGH), newest_n=25))
    return run.nodes.select("address", "depth", "role", "at_rest", "outgoing_txs_capped")


# ----------------------------------------------------------------- branches

def _branch_rows(spark, sf):
    m = B.drop_self(X.moves(spark, sf))
    return m.withColumn("next_address", F.col("to_address"))


def _branch_sql(pattern):
    return O.with_fx(["fx_moves"], f"""
      SELECT txid, address, asset, raw AS value_raw FROM ({O.pattern_sql(
        pattern, "(SELECT txid, ts, src AS address, dst AS next, asset, raw FROM fx_moves WHERE src <> dst)",
        "address")})""")


def _branches(pattern):
    def run(spark, sf):
        return B.select_branches(_branch_rows(spark, sf), ["from_address"], pattern).select(
            "txid", F.col("from_address").alias("address"), "asset", "value_raw")
    return run


for _p in (S.RAPID, S.BALANCED, S.THOROUGH):
    query(f"branch_{_p}", _branch_sql(_p))(_branches(_p))


def _edge_sql(direction, pattern):
    return O.with_fx(["fx_facts"], """
      SELECT depth, txid, src AS from_address, dst AS to_address, asset, raw AS value_raw
      FROM t_edges""", u5_ctes(direction, pattern))


def _edge_query(direction, pattern):
    def run(spark, sf):
        return R.u5(spark, sf, direction, pattern).edges.select(
            "depth", "txid", "from_address", "to_address", "asset", "value_raw")
    return run


for _name, _d, _p in (("trace_fwd_rapid_edges", S.FORWARD, S.RAPID),
                      ("trace_fwd_balanced_edges", S.FORWARD, S.BALANCED),
                      ("trace_fwd_thorough_edges", S.FORWARD, S.THOROUGH),
                      ("trace_bwd_rapid_edges", S.BACKWARD, S.RAPID),
                      ("trace_bwd_balanced_edges", S.BACKWARD, S.BALANCED),
                      ("trace_bwd_thorough_edges", S.BACKWARD, S.THOROUGH)):
    query(_name, _edge_sql(_d, _p))(_edge_query(_d, _p))


_SKIP = """
  SELECT c.address, c.depth, c.asset, CAST(c.n - coalesce(e.n, 0) AS BIGINT) AS n_skipped,
         CAST(c.raw - coalesce(e.raw, 0) AS BIGINT) AS skipped_raw
  FROM (SELECT address, depth, asset, count(*) AS n, sum(raw) AS raw FROM t_cand
        WHERE status = 'eligible' GROUP BY ALL) c
  LEFT JOIN (SELECT address, depth - 1 AS depth, asset, count(*) AS n, sum(raw) AS raw
             FROM t_edges GROUP BY ALL) e
    ON e.address = c.address AND e.depth = c.depth AND e.asset = c.asset
  WHERE c.n > coalesce(e.n, 0)"""


@query("unexamined_totals", O.with_fx(["fx_facts"], _SKIP, u5_ctes()))
def unexamined_totals(spark, sf):
    run = R.u5(spark, sf, S.FORWARD, S.BALANCED)
    return B.unexamined(run.accounting).select("address", "depth", "asset", "n_skipped",
                                               "skipped_raw")


@query("trace_nodes", O.with_fx(["fx_facts"], """
  SELECT address, depth, bound, role, max_depth_reached, at_rest FROM t_nodes""", u5_ctes()))
def trace_nodes(spark, sf):
    return R.u5(spark, sf, S.FORWARD, S.BALANCED).nodes.select(
        "address", "depth", "bound", "role", "max_depth_reached", "at_rest")


@query("trace_bwd_nodes", O.with_fx(["fx_facts"], """
  SELECT address, depth, bound, role, max_depth_reached, at_rest FROM t_nodes""",
                                    u5_ctes("backward")))
def trace_bwd_nodes(spark, sf):
    return R.u5(spark, sf, S.BACKWARD, S.BALANCED).nodes.select(
        "address", "depth", "bound", "role", "max_depth_reached", "at_rest")


@query("classify_roles", O.with_fx(["fx_facts"], """
  SELECT role, depth, CAST(count(*) AS BIGINT) AS n FROM t_nodes GROUP BY ALL""",
                                   u5_ctes("forward", "thorough")))
def classify_roles(spark, sf):
    return R.u5(spark, sf, S.FORWARD, S.THOROUGH).nodes.groupBy("role", "depth").agg(
        F.count(F.lit(1)).alias("n"))


@query("arrival_bounds", O.with_fx(["fx_facts"], """
  SELECT address, CASE WHEN bool_or(bound IS NULL) THEN NULL ELSE min(bound) END AS bound
  FROM (SELECT next AS address, bound FROM t_e1) GROUP BY 1""", u5_ctes(depth=1)))
def arrival_bounds(spark, sf):
    run = R.u5(spark, sf, S.FORWARD, S.BALANCED)
    first = run.edges.filter("depth = 1").withColumn("order_value", F.col("value"))
    return TR.arrivals(first, S.FORWARD).select("address", "bound")


@query("trace_many", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, depth, txid, src AS from_address, dst AS to_address, raw AS value_raw
  FROM t_edges""", customer_ctes("balanced")))
def trace_many(spark, sf):
    return R.customers(spark, sf, S.BALANCED).edges.select(
        "trace_id", "depth", "txid", "from_address", "to_address", "value_raw")


CAPS = {"max_addresses": 12, "max_edges": 20}


def capped_ctes():
    return O.trace_ctes("fx_ledger", "fx_ledger_facts", CUSTOMERS, "forward", "thorough", 3,
                        busy=R.BUSY, cap=CAPS["max_addresses"], cap_edges=CAPS["max_edges"])


@query("trace_capped_nodes", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, address, depth, role, at_rest FROM t_nodes""", capped_ctes()))
def trace_capped_nodes(spark, sf):
    """Size caps per trace, spent inside a level on the most valuable wallets."""
    return R.customers_capped(spark, sf, *CAPS.values()).nodes.select(
        "trace_id", "address", "depth", "role", "at_rest")


@query("trace_capped_edges", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, depth, txid, src AS from_address, dst AS to_address, raw AS value_raw
  FROM t_edges""", capped_ctes()))
def trace_capped_edges(spark, sf):
    return R.customers_capped(spark, sf, *CAPS.values()).edges.select(
        "trace_id", "depth", "txid", "from_address", "to_address", "value_raw")


@query("at_rest", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, address, depth FROM t_nodes WHERE at_rest AND depth > 0""",
                            customer_ctes()))
def at_rest(spark, sf):
    return R.customers(spark, sf).nodes.filter("at_rest").select("trace_id", "address",
                                                                 "depth")


@query("trace_bwd_many_nodes", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, address, depth, bound, role FROM t_nodes""", nation_ctes()))
def trace_bwd_many_nodes(spark, sf):
    return R.nations(spark, sf).nodes.select("trace_id", "address", "depth", "bound", "role")


@query("trace_accounting", O.with_fx(["fx_facts"], """
  SELECT address, asset, CAST(count(*) FILTER (status = 'self') AS BIGINT) AS n_self,
         CAST(count(*) FILTER (status = 'dust') AS BIGINT) AS n_dust,
         CAST(count(*) FILTER (status = 'time') AS BIGINT) AS n_time,
         CAST(count(*) FILTER (status = 'eligible') AS BIGINT) AS n_eligible
  FROM t_cand GROUP BY ALL""", u5_ctes()))
def trace_accounting(spark, sf):
    return R.u5(spark, sf, S.FORWARD, S.BALANCED).accounting.select(
        "address", "asset", "n_self", "n_dust", "n_time", "n_eligible")


@query("trace_notices", O.with_fx(["fx_facts"], f"""
  SELECT 'dust' AS kind, asset, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(raw) AS BIGINT) AS total_raw FROM t_cand WHERE status = 'dust' GROUP BY asset
  UNION ALL SELECT 'pattern_skipped', asset, CAST(sum(n_skipped) AS BIGINT),
         CAST(sum(skipped_raw) AS BIGINT) FROM ({_SKIP}) GROUP BY asset
  UNION ALL SELECT 'time_skipped', NULL, CAST(count(*) AS BIGINT), NULL FROM t_cand
         WHERE status = 'time' HAVING count(*) > 0
  UNION ALL SELECT 'unexpanded', NULL, CAST(count(*) AS BIGINT), NULL FROM t_nodes
         WHERE role = 'unexpanded' HAVING count(*) > 0""", u5_ctes()))
def trace_notices(spark, sf):
    return TR.notices(R.u5(spark, sf, S.FORWARD, S.BALANCED)).select(
        "kind", "asset", "n", "total_raw")


@query("trace_stats", O.with_fx(["fx_facts"], """
  SELECT (SELECT count(*) FROM t_nodes) AS addresses,
         (SELECT count(*) FROM t_edges) AS edges,
         (SELECT count(DISTINCT next) FROM t_edges JOIN fx_facts f ON f.address = next
          WHERE f.is_exchange) AS exit_points""", u5_ctes()))
def trace_stats(spark, sf):
    run = R.u5(spark, sf, S.FORWARD, S.BALANCED)
    return TR.trace_stats(run, E.exits(run)).select("addresses", "edges", "exit_points")


# -------------------------------------------------------------- focus payment

# Every customer's largest order is its focus payment.
_FOCUS_SEEDS = """
  SELECT trace_id, address, txid FROM (
    SELECT o_custkey AS trace_id, 'c' || o_custkey AS address, 'p' || o_orderkey AS txid,
           row_number() OVER (PARTITION BY o_custkey
             ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1"""
_FOCUS_CAND = f"""
  SELECT s.trace_id, s.address, 0 AS depth, CAST(NULL AS BIGINT) AS bound, m.dst AS next,
         m.txid, m.ts, m.asset, m.raw, CASE WHEN m.raw < 100 THEN 'dust' ELSE 'eligible' END
         AS status
  FROM ({_FOCUS_SEEDS}) s JOIN fx_ledger m ON m.txid = s.txid WHERE m.dst <> s.address"""


@query("trace_focus_edges", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, depth, txid, src AS from_address, dst AS to_address, raw AS value_raw
  FROM t_edges""", O.trace_ctes(
    "fx_ledger", "fx_ledger_facts", f"SELECT trace_id, address FROM ({_FOCUS_SEEDS})",
    "forward", "balanced", 3, busy=R.BUSY, focus=_FOCUS_CAND)))
def trace_focus_edges(spark, sf):
    ledger = R.ledger(spark, sf)
    biggest = X.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by(
        "o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("k"))
    seeds = biggest.select(
        F.col("o_custkey").alias("trace_id"), F.lit(X.CHAIN).alias("chain"),
        F.concat(F.lit("c"), "o_custkey").alias("address"),
        F.concat(F.lit("p"), "k").alias("focus_txid"))
    senders = ledger.select("chain", "txid", F.col("from_address").alias("address"))
    run = TR.trace_many(ledger, seeds, R.ledger_facts(spark, sf), TR.TraceParams(
        max_depth=2, high_activity=R.BUSY), legs=ledger, senders=senders)
    return run.edges.select("trace_id", "depth", "txid", "from_address", "to_address",
                            "value_raw")


# --------------------------------------------------------------------- exits

_EXIT_EDGES = """t_edges e JOIN fx_facts f ON f.address = e.next AND f.is_exchange"""


@query("exits_totals", O.with_fx(["fx_facts"], f"""
  SELECT e.next AS address, e.asset, CAST(count(*) AS BIGINT) AS n_movements,
         CAST(sum(e.raw) AS BIGINT) AS total_raw FROM {_EXIT_EDGES} GROUP BY 1, 2""",
                                 u5_ctes()))
def exits_totals(spark, sf):
    return E.exit_totals(R.u5(spark, sf, S.FORWARD, S.BALANCED)).select(
        "address", "asset", "n_movements", "total_raw")


_EXITS_SQL = f"""
  SELECT x.address, n.depth, n.role, l.entity, l.confidence, l.source, x.max_total_raw,
         row_number() OVER (ORDER BY x.max_total_raw DESC, n.depth, x.address) AS rank
  FROM (SELECT address, CAST(max(total) AS BIGINT) AS max_total_raw FROM (
          SELECT e.next AS address, e.asset, sum(e.raw) AS total
          FROM {_EXIT_EDGES} GROUP BY 1, 2) GROUP BY 1) x
  JOIN t_nodes n ON n.address = x.address
  JOIN fx_ranked_labels l ON l.address = x.address AND l.label_no = 1"""


@query("exits_ranked", O.with_fx(["fx_facts", "fx_ranked_labels"], _EXITS_SQL, u5_ctes()))
def exits_ranked(spark, sf):
    from pyspark.sql import Window
    rows = E.exits(R.u5(spark, sf, S.FORWARD, S.BALANCED))
    order = Window.partitionBy("trace_id").orderBy(
        F.col("max_amount").desc_nulls_last(), "depth", "address")
    return E.rank_exits(rows).withColumn(
        "rank", F.row_number().over(order).cast("bigint")).select(
        "address", "depth", "role", "entity", "confidence", "source", "max_total_raw", "rank")


def _paths_sql():
    up = """
      SELECT e.trace_id, e.next AS node, e.address AS parent, e.txid, e.src, e.dst, e.raw
      FROM (SELECT u.*, row_number() OVER (PARTITION BY u.trace_id, u.next ORDER BY
              CASE WHEN coalesce(u.usd_cents, 0) <> 0 THEN u.usd_cents / 100.0::DOUBLE
                   ELSE u.raw / 100.0::DOUBLE END DESC, u.ts DESC, u.txid DESC,
              u.address DESC) AS k
            FROM t_usd u JOIN t_nodes n ON n.trace_id = u.trace_id AND n.address = u.next
              AND n.depth = u.depth) e WHERE k = 1"""
    walk = """
      SELECT n.trace_id, n.address AS end_address, n.address AS at, n.depth AS hop,
             n.depth AS n_hops FROM t_nodes n WHERE n.is_exchange AND n.depth > 0
      UNION ALL
      SELECT w.trace_id, w.end_address, u.parent, w.hop - 1, w.n_hops
      FROM walk w JOIN t_up u ON u.trace_id = w.trace_id AND u.node = w.at
      WHERE w.hop > 1"""
    return O.with_fx(["fx_facts", "fx_prices"], """
      SELECT w.end_address, w.hop, w.n_hops, u.txid, u.src AS from_address,
             u.dst AS to_address, u.raw AS value_raw
      FROM walk w JOIN t_up u ON u.trace_id = w.trace_id AND u.node = w.at""",
                     [*u5_ctes(), usd_cte(), ("t_up", up), ("walk", walk)], recursive=True)


@query("exit_paths", _paths_sql())
def exit_paths(spark, sf):
    run = R.u5_valued(spark, sf)
    return E.exit_paths(run, E.exits(run)).select(
        "end_address", "hop", "n_hops", "txid", "from_address", "to_address", "value_raw")


_LINE = """
  SELECT p.end_address, p.hop, 'Hop ' || p.hop || ' of ' || p.n_hops || ': ' || p.from_address || ' -> '
         || p.to_address || '  ' || rtrim(rtrim(format('{:,.6f}', p.value_raw / 100.0::DOUBLE), '0'), '.')
         || ' ' || m.asset || coalesce(' (~$' || format('{:,.2f}', u.usd_cents / 100.0::DOUBLE) || ')', '')
         || '  tx ' || p.txid || '  '
         || strftime(make_timestamp(m.ts * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC' AS line
  FROM paths p JOIN fx_moves m ON m.txid = p.txid JOIN t_usd u ON u.txid = p.txid
    AND u.src = p.from_address AND u.dst = p.to_address"""


def _lines_sql():
    sql = _paths_sql()
    at = sql.rindex("      SELECT w.end_address")
    return sql[:at].rstrip() + ",\npaths AS (" + sql[at:] + ")\n" + _LINE.replace(
        "SELECT p.end_address", "SELECT DISTINCT p.end_address", 1)


@query("traceroute_lines", _lines_sql())
def traceroute_lines(spark, sf):
    run = R.u5_valued(spark, sf)
    return E.traceroute(E.exit_paths(run, E.exits(run))).select("end_address", "hop", "line")


# -------------------------------------------------------------------- prices

@query("daily_first", O.with_fx(["fx_ticks"], "SELECT asset, date, usd FROM fx_ticks"))
def daily_first(spark, sf):
    ticks = X.table(spark, sf, "events").select(
        F.col("event_type").alias("asset"), X.epoch("ts").alias("ts"),
        F.col("ts").alias("exact"), F.col("value").alias("usd"))
    return P.daily_first(ticks, order=F.struct("exact"))


@query("daily_open", O.with_fx([], f"""
  SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date,
         max(CAST(l_quantity AS DOUBLE)) AS usd FROM lineitem GROUP BY 1, 2"""))
def daily_open(spark, sf):
    """One candle per day and flag, alternating between the two feed shapes."""
    day = X.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("asset"), X.epoch("l_shipdate").alias("sec")).agg(
        F.max("l_quantity").alias("open"))
    sec, opened, other = F.col("sec").cast("double"), F.col("open"), F.lit(-1.0)
    wide = F.col("asset") == "N"
    return P.daily_open(day.select(
        "asset", F.when(wide, F.array(sec, other, other, opened, other, other)).otherwise(
            F.array(sec, opened, other)).alias("candle"),
        F.when(wide, 3).otherwise(1).alias("open_at")))


@query("price_keys", O.with_fx(["fx_moves"], f"""
  SELECT DISTINCT asset, {DAY} AS date FROM fx_moves"""))
def price_keys(spark, sf):
    return P.needed_keys(X.moves(spark, sf), R.EVENT_ASSETS)


@query("price_fill", O.with_fx(["fx_prices"], "SELECT asset, date, usd, source FROM fx_prices"))
def price_fill(spark, sf):
    return R.price_table(spark, sf)


@query("price_missing", O.with_fx(["fx_prices", "fx_ticks"], """
  SELECT asset, date FROM fx_ticks WHERE (asset, date) NOT IN
    (SELECT (asset, date) FROM fx_prices)"""))
def price_missing(spark, sf):
    return P.missing_prices(P.needed_keys(X.moves(spark, sf), R.EVENT_ASSETS),
                            R.price_table(spark, sf))


@query("edges_usd", O.with_fx(["fx_moves", "fx_prices"], """
  SELECT txid, asset, usd_cents, usd_price_date FROM t_usd""", [usd_cte("fx_moves")]))
def edges_usd(spark, sf):
    return P.value_usd(X.moves(spark, sf), R.price_table(spark, sf),
                       X.EVENT_ASSETS_PEGGED).select("txid", "asset", "usd_cents",
                                                     "usd_price_date")


@query("exit_usd", O.with_fx(["fx_facts", "fx_prices"], """
  SELECT next AS address, CAST(sum(usd_cents) AS BIGINT) AS usd_cents,
         CAST(count(usd_cents) AS BIGINT) AS n_valued
  FROM t_usd u JOIN fx_facts f ON f.address = u.next AND f.is_exchange GROUP BY 1""",
                             [*u5_ctes(), usd_cte()]))
def exit_usd(spark, sf):
    return E.exit_usd(R.u5_valued(spark, sf)).select("address", "usd_cents", "n_valued")


@query("order_values", O.with_fx(["fx_moves"], """
  SELECT txid, CASE WHEN asset = 'purchase' THEN raw / 100.0::DOUBLE
    WHEN asset = 'click' THEN (raw / 100.0::DOUBLE) * 2.5::DOUBLE
    ELSE raw / 100.0::DOUBLE END AS order_value FROM fx_moves"""))
def order_values(spark, sf):
    from fundflow.functions.amounts import order_value
    return X.moves(spark, sf).select("txid", order_value(
        F.col("asset"), F.col("value"), {"click": 2.5}, X.EVENT_ASSETS_PEGGED)
        .alias("order_value"))
