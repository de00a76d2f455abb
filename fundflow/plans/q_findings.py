"""Flow summaries, disposition and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.operators import casework as CW
from fundflow.operators import exits as E
from fundflow.operators import findings as G
from fundflow.operators import flows as FL
from fundflow.operators.directory import first_matches
from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.plans.q_trace import customer_ctes, nation_ctes, u5_ctes, usd_cte

U5_USD = [*u5_ctes(), usd_cte()]
CUST_USD = [*customer_ctes(), usd_cte(prices=False)]
NATION_USD = [*nation_ctes(), usd_cte(prices=False)]
U5_FX = ["fx_facts", "fx_prices", "fx_ranked_labels"]

# Designations in file order; 'Binance' stands before 'Binance.US'.
COMPLIANCE = [{"entity": "Kraken", "status": "compliant"},
              {"entity": "Gemini", "status": "compliant"},
              {"entity": "Coinbase", "status": "compliant"},
              {"entity": "Binance", "status": "compliant"},
              {"entity": "Binance.US", "status": "unreachable"},
              {"entity": "Bybit", "status": "non_compliant"}]
_COMPLIANCE_SQL = "(VALUES " + ", ".join(
    f"({i}, '{c['entity']}', '{c['status']}')" for i, c in enumerate(COMPLIANCE)) \
    + ") d(ord, entity, status)"


def _side(wallet, other):
    return f"""
      SELECT trace_id, {wallet} AS address, CAST(sum(usd_cents) AS BIGINT) AS usd_cents,
             bool_and(usd_cents IS NOT NULL) AS usd_complete,
             CAST(count(DISTINCT {other}) AS BIGINT) AS n_counterparties,
             CAST(count(*) AS BIGINT) AS n_movements,
             min(nullif(ts, 0)) AS first_ts, max(nullif(ts, 0)) AS last_ts
      FROM t_usd GROUP BY 1, 2"""


def _terminal(wallet, other):
    """CTEs: summary of one side plus its largest single-asset total."""
    return [("t_side", _side(wallet, other)), ("t_best", f"""
      SELECT trace_id, address, CAST(max(total) AS BIGINT) AS max_total_raw FROM (
        SELECT trace_id, {wallet} AS address, asset, sum(raw) AS total FROM t_usd
        GROUP BY 1, 2, 3) GROUP BY 1, 2"""), ("t_term", """
      SELECT n.*, s.usd_cents AS usd_sum, s.usd_complete, s.last_ts, s.n_counterparties,
             CASE WHEN s.usd_complete AND s.usd_cents <> 0 THEN s.usd_cents END AS usd_cents,
             b.max_total_raw
      FROM t_nodes n LEFT JOIN t_side s ON s.trace_id = n.trace_id AND s.address = n.address
      LEFT JOIN t_best b ON b.trace_id = n.trace_id AND b.address = n.address""")]


U5_TERM = [*U5_USD, *_terminal("dst", "src")]
CUST_TERM = [*CUST_USD, *_terminal("dst", "src")]
NATION_TERM = [*NATION_USD, *_terminal("src", "dst")]
SUMMARY = ["address", "usd_cents", "usd_complete", "n_counterparties", "n_movements",
           "first_ts", "last_ts"]
_SUMMARY_SQL = ", ".join(SUMMARY)


@query("inflow_summary", O.with_fx(U5_FX, f"SELECT {_SUMMARY_SQL} FROM ({_side('dst', 'src')})",
                                   U5_USD))
def inflow_summary(spark, sf):
    return FL.inflow(R.u5_valued(spark, sf).edges).select(*SUMMARY)


@query("outflow_summary", O.with_fx(U5_FX, f"SELECT {_SUMMARY_SQL} FROM ({_side('src', 'dst')})",
                                    U5_USD))
def outflow_summary(spark, sf):
    return FL.outflow(R.u5_valued(spark, sf).edges).select(*SUMMARY)


@query("inflow_totals", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, dst AS address, asset, CAST(sum(raw) AS BIGINT) AS total_raw
  FROM t_usd GROUP BY 1, 2, 3""", CUST_USD))
def inflow_totals(spark, sf):
    return FL.totals_by_asset(R.customers(spark, sf).edges, "to_address").select(
        "trace_id", "address", "asset", "total_raw")


_PAIR = """
  SELECT trace_id, src AS from_address, dst AS to_address, asset,
         CAST(sum(raw) AS BIGINT) AS value_raw, CAST(sum(usd_cents) AS BIGINT) AS usd_cents,
         bool_and(usd_cents IS NOT NULL) AS usd_complete, CAST(count(*) AS BIGINT) AS n_movements
  FROM t_usd GROUP BY 1, 2, 3, 4"""
PAIR_COLUMNS = ["from_address", "to_address", "asset", "value_raw", "usd_cents",
                "usd_complete", "n_movements"]


@query("pair_flows", O.with_fx(U5_FX, f"SELECT {', '.join(PAIR_COLUMNS)} FROM ({_PAIR})", U5_USD))
def pair_flows(spark, sf):
    return FL.pair_flows(R.u5_valued(spark, sf).edges).select(*PAIR_COLUMNS)


@query("wallet_view", O.with_fx(U5_FX, """
  SELECT coalesce(i.address, o.address) AS address, coalesce(i.asset, o.asset) AS asset,
         i.in_raw, o.out_raw, o.labelled_raw,
         CASE WHEN o.out_raw > 0 THEN
           (o.labelled_raw * 200 + o.out_raw) // (o.out_raw * 2) END AS labelled_share_pct
  FROM (SELECT dst AS address, asset, CAST(sum(raw) AS BIGINT) AS in_raw FROM t_edges
        GROUP BY 1, 2) i
  FULL JOIN (SELECT e.src AS address, e.asset, CAST(sum(e.raw) AS BIGINT) AS out_raw,
        CAST(sum(CASE WHEN n.role = 'exchange' THEN e.raw END) AS BIGINT) AS labelled_raw
        FROM t_edges e JOIN t_nodes n ON n.address = e.dst GROUP BY 1, 2) o
    ON o.address = i.address AND o.asset = i.asset""", U5_USD))
def wallet_view(spark, sf):
    run = R.u5_valued(spark, sf)
    return FL.wallet_view(run.edges, run.nodes).select(
        "address", "asset", "in_raw", "out_raw", "labelled_raw", "labelled_share_pct")


@query("wallet_counts", O.with_fx(U5_FX, """
  SELECT coalesce(i.address, o.address) AS address, coalesce(sender_count, 0) AS sender_count,
         coalesce(receiver_count, 0) AS receiver_count
  FROM (SELECT dst AS address, count(DISTINCT src) AS sender_count FROM t_edges GROUP BY 1) i
  FULL JOIN (SELECT src AS address, count(DISTINCT dst) AS receiver_count FROM t_edges
             GROUP BY 1) o ON o.address = i.address""", U5_USD))
def wallet_counts(spark, sf):
    return FL.wallet_counts(R.u5_valued(spark, sf).edges).select(
        "address", "sender_count", "receiver_count")


@query("freeze_schedule", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, dst AS target, txid, src AS from_address, raw AS value_raw,
         row_number() OVER (PARTITION BY trace_id, dst
           ORDER BY coalesce(ts, 0), txid, src, asset, raw) AS seq
  FROM t_usd""", CUST_USD))
def freeze_schedule(spark, sf):
    run = R.customers(spark, sf)
    return FL.freeze_schedule(run.edges, run.nodes).select(
        "trace_id", "target", "txid", "from_address", "value_raw", "seq")


@query("freeze_totals", O.with_fx(U5_FX, """
  SELECT dst AS target, asset, CAST(count(*) AS BIGINT) AS n_movements,
         CAST(sum(raw) AS BIGINT) AS total_raw,
         CASE WHEN bool_and(usd_cents IS NOT NULL) THEN CAST(sum(usd_cents) AS BIGINT) END
           AS usd_cents, min(nullif(ts, 0)) AS first_ts, max(nullif(ts, 0)) AS last_ts
  FROM t_usd GROUP BY 1, 2
  UNION ALL SELECT dst, 'TOTAL', CAST(count(*) AS BIGINT), NULL,
         CASE WHEN bool_and(usd_cents IS NOT NULL) THEN CAST(sum(usd_cents) AS BIGINT) END,
         min(nullif(ts, 0)), max(nullif(ts, 0)) FROM t_usd GROUP BY 1""", U5_USD))
def freeze_totals(spark, sf):
    run = R.u5_valued(spark, sf)
    return FL.freeze_totals(FL.freeze_schedule(run.edges, run.nodes)).select(
        "target", "asset", "n_movements", "total_raw", "usd_cents", "first_ts", "last_ts")


@query("issuer_pick", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, dst AS address, 'USDT' AS issuer_asset,
         CAST(sum(raw) AS BIGINT) AS issuer_total_raw FROM t_usd GROUP BY 1, 2""", CUST_USD))
def issuer_pick(spark, sf):
    return FL.pick_issuer(R.customers(spark, sf).edges).select(
        "trace_id", "address", "issuer_asset", "issuer_total_raw")


def _disposition(backward=False):
    rest = "false" if backward else "at_rest"
    return f"""
      SELECT trace_id, bucket, n, usd_cents, usd_complete,
        CASE WHEN grand > 0 AND usd_complete THEN
          (usd_cents * 2000 + grand) // (grand * 2) END AS share_permille
      FROM (SELECT *, CAST(sum(CASE WHEN usd_complete THEN usd_cents END)
              OVER (PARTITION BY trace_id) AS BIGINT) AS grand FROM (
        SELECT trace_id, bucket, CAST(count(*) AS BIGINT) AS n,
               CAST(coalesce(sum(CASE WHEN usd_complete THEN usd_sum END), 0) AS BIGINT)
                 AS usd_cents, bool_and(usd_complete) AS usd_complete
        FROM (SELECT *, CASE WHEN {rest} THEN 'at rest'
            WHEN role = 'exchange' THEN 'named custodians'
            WHEN role = 'high_activity_service' THEN 'busy services'
            WHEN role = 'sanctioned' THEN 'sanctioned wallets'
            WHEN role = 'mixer' THEN 'mixing services' WHEN role = 'contract' THEN 'contracts'
            WHEN role = 'unexpanded' THEN 'unresolved edges' END AS bucket FROM t_term)
        WHERE bucket IS NOT NULL AND max_total_raw IS NOT NULL GROUP BY 1, 2
        UNION ALL
        SELECT trace_id, 'not examined', CAST(sum(n) AS BIGINT), 0, false FROM (
          SELECT trace_id, count(*) AS n FROM t_cand WHERE status IN ('dust', 'eligible')
          GROUP BY 1
          UNION ALL SELECT trace_id, -count(*) FROM t_edges GROUP BY 1)
        GROUP BY 1 HAVING sum(n) > 0))"""


@query("disposition", O.with_fx(U5_FX, _disposition(), U5_TERM))
def disposition(spark, sf):
    return G.disposition(R.finding_inputs(spark, sf, "u5"))


@query("disposition_many", O.with_fx(["fx_ledger_facts"], _disposition(), CUST_TERM))
def disposition_many(spark, sf):
    return G.disposition(R.finding_inputs(spark, sf, "customers"))


@query("disposition_totals", O.with_fx(U5_FX, """
  SELECT bucket, asset, CAST(sum(raw) AS BIGINT) AS total_raw FROM (
    SELECT n.bucket, e.asset, e.raw FROM t_edges e JOIN (
      SELECT address, CASE WHEN at_rest THEN 'at rest'
        WHEN role = 'exchange' THEN 'named custodians'
        WHEN role = 'sanctioned' THEN 'sanctioned wallets'
        WHEN role = 'mixer' THEN 'mixing services' WHEN role = 'contract' THEN 'contracts'
        WHEN role = 'unexpanded' THEN 'unresolved edges' END AS bucket FROM t_nodes) n
      ON n.address = e.dst WHERE n.bucket IS NOT NULL
    UNION ALL SELECT 'not examined', asset, raw FROM t_cand
      WHERE status IN ('dust', 'eligible')
    UNION ALL SELECT 'not examined', asset, -raw FROM t_edges)
  GROUP BY 1, 2 HAVING bucket <> 'not examined' OR sum(raw) > 0""", U5_USD))
def disposition_totals(spark, sf):
    return G.disposition_totals(R.finding_inputs(spark, sf, "u5")).select(
        "bucket", "asset", "total_raw")


# ------------------------------------------------------------------ findings

SHOWN = ["trace_id", "type", "priority", "address", "usd_cents", "max_total_raw", "related",
         "detail"]


def _rows(kind, priority, where, related="NULL", detail="NULL", join=""):
    return f"""
      SELECT t.trace_id, '{kind}' AS type, {priority} AS priority, t.address, t.usd_cents,
             t.max_total_raw, CAST({related} AS VARCHAR) AS related,
             CAST({detail} AS VARCHAR) AS detail
      FROM t_term t {join} WHERE {where}"""


_SWEEP = """
  SELECT e.trace_id, e.src AS feeder, e.dst AS address, e.txid, e.ts, e.depth, e.asset,
         e.raw AS value_raw, i.in_raw, f.first_ts
  FROM t_usd e
  JOIN t_nodes b ON b.trace_id = e.trace_id AND b.address = e.dst
    AND b.role = 'high_activity_service'
  JOIN t_nodes s ON s.trace_id = e.trace_id AND s.address = e.src AND s.depth > 0
  JOIN (SELECT trace_id, src FROM t_usd GROUP BY 1, 2 HAVING count(*) = 1) lone
    ON lone.trace_id = e.trace_id AND lone.src = e.src
  JOIN (SELECT trace_id, dst, asset, CAST(sum(raw) AS BIGINT) AS in_raw FROM t_usd
        GROUP BY 1, 2, 3) i
    ON i.trace_id = e.trace_id AND i.dst = e.src AND i.asset = e.asset
  JOIN (SELECT trace_id, dst, min(nullif(ts, 0)) AS first_ts FROM t_usd GROUP BY 1, 2) f
    ON f.trace_id = e.trace_id AND f.dst = e.src
  WHERE i.in_raw > 0 AND e.raw * 100 >= i.in_raw * 90
    AND coalesce(CASE WHEN e.ts <> 0 THEN e.ts - f.first_ts <= 259200 END, true)"""

F_SQL = {
    "named_exchange": _rows("named_exchange", 1, "t.is_exchange AND l.label_no = 1",
                            "l.entity", f"""(SELECT min_by(d.status, d.ord)
      FROM {_COMPLIANCE_SQL} WHERE contains(lower(l.entity), lower(d.entity)))""",
                            "JOIN fx_ranked_labels l ON l.address = t.address")
    + " AND t.address IN (SELECT next FROM t_edges)",
    "at_rest": _rows("funds_at_rest", 2, "t.at_rest AND t.max_total_raw IS NOT NULL",
                     detail=f"'since ' || CAST(DATE '1970-01-01' "
                            "+ CAST(t.last_ts // 86400 AS INTEGER) AS VARCHAR)"),
    "agency_flag": _rows("flagged_wallet_contact", 2, "t.depth > 0", "n.n_name", "f.reason",
                         "JOIN fx_flags f ON f.address = t.address "
                         "LEFT JOIN nation n ON n.n_nationkey = f.case_id"),
    "partner_flag": _rows("shared_flag_contact", 2,
                          "t.depth > 0 AND l.category = 'shared_flag'", "l.entity", "l.source",
                          "JOIN fx_labels l ON l.address = t.address"),
    "consolidation": _rows("consolidation_point", 5,
                           "t.n_counterparties >= 2 AND t.role NOT IN "
                           "('exchange', 'high_activity_service', 'victim')",
                           detail="t.n_counterparties || ' funders'"),
    "scam_report": _rows("scam_reported_contact", 5, "t.depth > 0 AND "
                         "l.category = 'scam_report'", "l.entity", "l.source",
                         "JOIN fx_labels l ON l.address = t.address"),
    "sanctioned": _rows("sanctioned_contact", 6, "t.role = 'sanctioned' AND "
                        "l.category = 'sanctioned'", "l.entity",
                        join="JOIN fx_labels l ON l.address = t.address"),
    "mixer": _rows("mixer_contact", 7, "t.role = 'mixer' AND l.category = 'mixer'", "l.entity",
                   join="JOIN fx_labels l ON l.address = t.address"),
    "probable_deposit": _rows("probable_exchange_deposit", 3, "true", "s.feeder",
                              "'sweep tx ' || s.txid", f"""JOIN (
        SELECT *, row_number() OVER (PARTITION BY trace_id, address
          ORDER BY depth, ts NULLS LAST, txid) AS k FROM ({_SWEEP})) s
        ON s.trace_id = t.trace_id AND s.address = t.address AND s.k = 1"""),
    "busy_service": _rows("unidentified_service", 4, f"""t.role = 'high_activity_service'
        AND (t.trace_id, t.address) NOT IN (SELECT trace_id, address FROM ({_SWEEP}))""",
                          detail="t.activity || ' transactions'"),
    "unresolved": """
      SELECT trace_id, 'unresolved_edges' AS type, 9 AS priority,
             CAST(NULL AS VARCHAR) AS address, CAST(NULL AS BIGINT) AS usd_cents,
             CAST(NULL AS BIGINT) AS max_total_raw,
             string_agg(CASE WHEN k <= 10 THEN address END, ', ' ORDER BY k) AS related,
             count(*) || ' wallets' AS detail
      FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY
              CASE WHEN coalesce(usd_sum, 0) <> 0 THEN usd_sum / 100.0::DOUBLE
                   ELSE round(max_total_raw / 100.0::DOUBLE, 6) END DESC, address) AS k
            FROM t_term WHERE role = 'unexpanded' AND max_total_raw IS NOT NULL)
      GROUP BY trace_id""",
}


def _u5(name, build):
    query(f"finding_{name}", O.with_fx(U5_FX + ["fx_flags", "fx_labels"], F_SQL[name], U5_TERM))(
        lambda spark, sf: build(spark, sf, R.finding_inputs(spark, sf, "u5")).select(*SHOWN))


def _exchange(spark, sf, inp):
    return G.named_exchange(inp, E.exits(inp.result), COMPLIANCE)


def _agency(spark, sf, inp):
    return G.flagged_wallet_contact(inp, X.flags(spark, sf), X.cases(spark, sf))


_u5("named_exchange", _exchange)
_u5("agency_flag", _agency)
_u5("partner_flag", lambda spark, sf, i: G.shared_flag_contact(i, X.labels(spark, sf)))
_u5("consolidation", lambda spark, sf, i: G.consolidation_point(i))
_u5("scam_report", lambda spark, sf, i: G.scam_reported_contact(i))
_u5("sanctioned", lambda spark, sf, i: G.sanctioned_contact(i))
_u5("mixer", lambda spark, sf, i: G.mixer_contact(i))
_u5("unresolved", lambda spark, sf, i: G.unresolved_edges(i))


def _customers(name, build):
    query(f"finding_{name}", O.with_fx(["fx_ledger_facts"], F_SQL[name], CUST_TERM))(
        lambda spark, sf: build(R.finding_inputs(spark, sf, "customers")).select(*SHOWN))


def _feeders(inp):
    return G.sweep_feeders(inp.result, inp.incoming)


_customers("at_rest", G.funds_at_rest)
_customers("probable_deposit", lambda i: G.probable_deposit(i, _feeders(i)))
_customers("busy_service", lambda i: G.unidentified_service(i, _feeders(i)))


@query("sweep_feeders", O.with_fx(["fx_ledger_facts"], f"""
  SELECT trace_id, feeder, address, txid, value_raw, in_raw, first_ts FROM ({_SWEEP})""",
                                  CUST_TERM))
def sweep_feeders(spark, sf):
    return _feeders(R.finding_inputs(spark, sf, "customers")).select(
        "trace_id", F.col("from_address").alias("feeder"), F.col("to_address").alias("address"),
        "txid", "value_raw", "in_raw", "first_ts")


@query("finding_busy_source", O.with_fx(["fx_ledger_facts"], _rows(
    "unidentified_service", 4, "t.role = 'high_activity_service'",
    detail="t.activity || ' transactions'"), NATION_TERM))
def finding_busy_source(spark, sf):
    """Backward: every busy wallet counts, without a sweep test."""
    inp = R.finding_inputs(spark, sf, "nations")
    return G.unidentified_service(inp, None).select(*SHOWN)


_RANKED = """
  SELECT trace_id, type, address, related, rank, n_of_type FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, type ORDER BY
             usd_cents DESC NULLS LAST, max_total_raw DESC NULLS LAST, address, related) AS rank,
           count(*) OVER (PARTITION BY trace_id, type) AS n_of_type
    FROM (%s)) WHERE rank <= 10"""
_U5_ALL = " UNION ALL ".join(F_SQL[k] for k in (
    "named_exchange", "at_rest", "agency_flag", "partner_flag", "consolidation", "scam_report",
    "sanctioned", "mixer", "unresolved"))


@query("findings_ranked", O.with_fx(U5_FX + ["fx_flags", "fx_labels"], _RANKED % _U5_ALL,
                                    U5_TERM))
def findings_ranked(spark, sf):
    inp = R.finding_inputs(spark, sf, "u5")
    every = G.all_findings(inp, E.exits(inp.result), X.labels(spark, sf), X.flags(spark, sf),
                           X.cases(spark, sf), compliance=COMPLIANCE)
    return G.rank_findings(every).select(
        "trace_id", "type", "address", "related", F.col("rank").cast("bigint").alias("rank"),
        "n_of_type")


# ------------------------------------------------------------------ casework

_CUSTODIANS = [{"entity": "Kraken", "portal": "portal-k"},
               {"entity": "Binance", "portal": "portal-b"},
               {"entity": "Binance.US", "portal": "portal-bus"},
               {"entity": "Tether", "portal": "portal-t"}]
_CUSTODIAN_SQL = "(VALUES " + ", ".join(
    f"({i}, '{c['entity']}', '{c['portal']}')" for i, c in enumerate(_CUSTODIANS)) \
    + ") d(ord, entity, portal)"
_ROUTES = f"""
  SELECT trace_id, address, route, entity, (SELECT min_by(d.portal, d.ord)
    FROM {_CUSTODIAN_SQL} WHERE contains(lower(r.entity), lower(d.entity))) AS portal
  FROM (SELECT trace_id, address, CASE WHEN custodian IS NOT NULL THEN 'custodian'
          WHEN stable THEN 'issuer' ELSE 'unserved' END AS route,
          CASE WHEN custodian IS NOT NULL THEN custodian WHEN stable THEN 'Tether' END AS entity
        FROM (%s)) r"""


@query("freeze_routes", O.with_fx(U5_FX + ["fx_labels"], _ROUTES % """
  SELECT DISTINCT e.trace_id, e.dst AS address, l.entity AS custodian, false AS stable
  FROM t_edges e LEFT JOIN fx_labels l ON l.address = e.dst AND l.category = 'exchange'""",
                                  U5_USD))
def freeze_routes(spark, sf):
    return CW.freeze_routes(R.u5_valued(spark, sf), _CUSTODIANS).select(
        "trace_id", "address", "route", "entity", "portal")


@query("freeze_routes_many", O.with_fx(["fx_ledger_facts"], _ROUTES % """
  SELECT DISTINCT trace_id, dst AS address, CAST(NULL AS VARCHAR) AS custodian, true AS stable
  FROM t_edges""", CUST_USD))
def freeze_routes_many(spark, sf):
    return CW.freeze_routes(R.customers(spark, sf), _CUSTODIANS).select(
        "trace_id", "address", "route", "entity", "portal")


@query("victim_payments", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, txid, to_address, value_raw, usd_cents, n_payments, recipient_platform
  FROM (SELECT trace_id, txid, dst AS to_address, raw AS value_raw, usd_cents,
          CAST(NULL AS VARCHAR) AS recipient_platform,
          count(*) OVER (PARTITION BY trace_id) AS n_payments, row_number() OVER (
            PARTITION BY trace_id ORDER BY ts, txid, dst, asset) AS k
        FROM t_usd WHERE depth = 1) WHERE k <= 20""", CUST_USD))
def victim_payments(spark, sf):
    return CW.victim_payments(R.customers(spark, sf)).select(
        "trace_id", "txid", "to_address", "value_raw", "usd_cents", "n_payments",
        "recipient_platform")


@query("request_lists", O.with_fx(U5_FX, f"""
  SELECT DISTINCT e.next AS address, k.kind, CASE k.kind WHEN 'asset' THEN e.asset
    WHEN 'txid' THEN e.txid ELSE CAST(DATE '1970-01-01' + CAST(e.ts // 86400 AS INTEGER)
    AS VARCHAR) END AS item
  FROM t_edges e JOIN fx_facts f ON f.address = e.next AND f.is_exchange,
    (VALUES ('asset'), ('txid'), ('date')) k(kind)""", U5_USD))
def request_lists(spark, sf):
    return CW.request_lists(R.u5_valued(spark, sf)).select("address", "kind", "item")


@query("digest_topk", O.with_fx(U5_FX, """
  SELECT rank, txid, value_raw, usd_cents FROM (
    SELECT txid, raw AS value_raw, usd_cents, row_number() OVER (ORDER BY
      CASE WHEN coalesce(usd_cents, 0) <> 0 THEN usd_cents / 100.0::DOUBLE
           ELSE raw / 100.0::DOUBLE END DESC, txid, src, dst, asset) AS rank FROM t_usd)
  WHERE rank <= 250""", U5_USD))
def digest_topk(spark, sf):
    return CW.digest_edges(R.u5_valued(spark, sf)).select(
        F.col("rank").cast("bigint").alias("rank"), "txid", "value_raw", "usd_cents")


@query("digest_nodes", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, rank, address, role FROM (
    SELECT trace_id, address, role, row_number() OVER (
      PARTITION BY trace_id ORDER BY depth, address) AS rank FROM t_nodes)
  WHERE rank <= 150""", CUST_USD))
def digest_nodes(spark, sf):
    return CW.digest_nodes(R.customers(spark, sf)).select(
        "trace_id", F.col("rank").cast("bigint").alias("rank"), "address", "role")


@query("digest_truncation", O.with_fx(U5_FX, """
  SELECT n_nodes, n_edges, greatest(n_edges - 250, 0) AS edges_left_out,
         greatest(n_nodes - 150, 0) AS nodes_left_out
  FROM (SELECT count(*) AS n_nodes FROM t_nodes), (SELECT count(*) AS n_edges FROM t_edges)""",
                                      U5_USD))
def digest_truncation(spark, sf):
    return CW.digest_truncation(R.u5_valued(spark, sf)).drop("trace_id")


@query("address_table", O.with_fx(U5_FX, """
  SELECT address, depth, role, concat_ws(' ', CASE WHEN flagged THEN '[agency flag]' END,
         CASE WHEN shared THEN '[partner flag]' END) AS markers,
         CASE WHEN CAST(substr(address, 2) AS BIGINT) % 6 = 0 THEN 'note ' || address END
           AS note FROM t_nodes""", U5_USD))
def address_table(spark, sf):
    notes = X.wallets(X.moves(spark, sf)).filter("i % 6 = 0").select(
        F.lit(X.CHAIN).alias("chain"), "address",
        F.concat(F.lit("note "), "address").alias("note"))
    return CW.address_table(R.u5_valued(spark, sf), notes).select(
        "address", "depth", "role", "markers", "note")


@query("tx_table", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, depth, txid, ts, src AS from_address, dst AS to_address, usd_cents
  FROM t_usd""", CUST_USD))
def tx_table(spark, sf):
    return CW.tx_table(R.customers(spark, sf)).select(
        "trace_id", "depth", "txid", "ts", "from_address", "to_address", "usd_cents")


@query("directory_match", """
  WITH entries AS (SELECT c_custkey AS ord, substr(c_name, length(c_name) - CAST(c_custkey % 7 AS INTEGER),
                          CAST(1 + c_custkey % 9 AS INTEGER)) AS entity FROM customer),
  names AS (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier
            UNION SELECT p_name FROM part)
  SELECT n.name, m.ord, e.entity FROM (
    SELECT n.name, min(e.ord) AS ord FROM names n JOIN entries e
      ON contains(lower(n.name), lower(e.entity)) GROUP BY 1) m
  JOIN names n ON n.name = m.name JOIN entries e ON e.ord = m.ord""")
def directory_match(spark, sf):
    """A directory of as many entries as there are customers, against all names."""
    customer, k = X.table(spark, sf, "customer"), F.col("c_custkey")
    entries = customer.select(k.alias("ord"), F.substring(
        F.col("c_name"), (F.length("c_name") - k % 7).cast("int"), (1 + k % 9).cast("int")).alias("entity"))
    names = customer.select(F.col("c_name").alias("name")).union(
        X.table(spark, sf, "supplier").select("s_name")).union(X.table(spark, sf, "part").select("p_name"))
    return first_matches(names, "name", entries).select("name", "ord", "entity")


@query("compliance_substring", O.with_fx(["fx_labels"], f"""
  SELECT address, entity, (SELECT min_by(d.entity, d.ord) FROM {_COMPLIANCE_SQL}
    WHERE contains(lower(l.entity), lower(d.entity))) AS matched,
    (SELECT min_by(d.status, d.ord) FROM {_COMPLIANCE_SQL}
    WHERE contains(lower(l.entity), lower(d.entity))) AS status FROM fx_labels l"""))
def compliance_substring(spark, sf):
    from fundflow.functions.text import directory_field, entity_match
    rows = X.labels(spark, sf).withColumn("_m", entity_match(F.col("entity_name"), COMPLIANCE))
    return rows.select("address", F.col("entity_name").alias("entity"),
                       directory_field(F.col("_m"), COMPLIANCE, "entity").alias("matched"),
                       directory_field(F.col("_m"), COMPLIANCE, "status").alias("status"))
