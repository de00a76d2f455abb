"""Clusters, overlays and reductions of the flow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.operators import cluster as C
from fundflow.operators import exits as E
from fundflow.operators import findings as G
from fundflow.operators import flows as FL
from fundflow.operators import graphview as V
from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.plans.q_findings import CUST_USD, NATION_USD, SHOWN, U5_FX, U5_USD
from fundflow.session import materialise

# ----------------------------------------------------------------- clusters


@query("coinjoin_like", O.with_fx(["fx_cj_in", "fx_cj_out"], """
  SELECT i.txid, i.n_inputs, o.n_equal FROM
    (SELECT txid, count(DISTINCT address) AS n_inputs FROM fx_cj_in GROUP BY 1) i
    JOIN (SELECT txid, max(n) AS n_equal FROM (SELECT txid, value, count(*) AS n
          FROM fx_cj_out GROUP BY 1, 2) GROUP BY 1) o ON o.txid = i.txid
  WHERE i.n_inputs >= 5 AND o.n_equal >= 3"""))
def coinjoin_like(spark, sf):
    return C.coinjoin_like(X.coinjoin_inputs(spark, sf), X.coinjoin_outputs(spark, sf))


_LINK_CJ = ("cj_link", """
  SELECT i.* FROM fx_cj_in i WHERE txid NOT IN (
    SELECT a.txid FROM (SELECT txid FROM fx_cj_in GROUP BY 1 HAVING count(*) >= 5) a
    JOIN (SELECT txid FROM fx_cj_out GROUP BY txid, value HAVING count(*) >= 3) b
      ON b.txid = a.txid)""")


@query("coinjoin_excluded_links", O.with_fx(["fx_cj_in", "fx_cj_out"], """
  SELECT txid, CAST(count(*) AS BIGINT) AS n_inputs, min(address) AS first FROM cj_link
  GROUP BY 1 HAVING count(*) >= 2""", [_LINK_CJ]))
def coinjoin_excluded_links(spark, sf):
    linking = C.linking_inputs(X.coinjoin_inputs(spark, sf), X.coinjoin_outputs(spark, sf))
    return C.cospend_tx(linking)


_EDGES = ("edges", """
  SELECT DISTINCT f.first AS a, c.address AS b FROM fx_cospend c
  JOIN (SELECT txid, min(address) AS first FROM fx_cospend GROUP BY 1 HAVING count(*) >= 2) f
    ON f.txid = c.txid WHERE c.address <> f.first""")
_COMP = [_EDGES, ("both_ways", "SELECT a, b FROM edges UNION SELECT b, a FROM edges"),
         ("reach", """SELECT a AS address, a AS seen FROM both_ways
  UNION SELECT r.address, w.b FROM reach r JOIN both_ways w ON w.a = r.seen"""),
         ("comp", "SELECT address, min(seen) AS component FROM reach GROUP BY 1")]


@query("cospend_edges", O.with_fx(["fx_cospend"], "SELECT a, b FROM edges", [_EDGES]))
def cospend_edges(spark, sf):
    return C.cospend_edges(X.cospend(spark, sf))


@query("components", O.with_fx(["fx_cospend"], "SELECT address, component FROM comp", _COMP,
                               recursive=True))
def components(spark, sf):
    return R.members(spark, sf)


_EVID = ("evid", """SELECT c.component, t.txid, t.n FROM (
    SELECT txid, count(*) AS n, min(address) AS first FROM fx_cospend GROUP BY 1
    HAVING count(*) >= 2) t JOIN comp c ON c.address = t.first""")
_ROLL = ("roll", """SELECT s.component, s.size, e.evidence_count, CASE WHEN e.wide
    THEN 'low' ELSE 'medium' END AS confidence FROM
    (SELECT component, count(*) AS size FROM comp GROUP BY 1) s
    JOIN (SELECT component, count(*) AS evidence_count, bool_or(n >= 12) AS wide
          FROM evid GROUP BY 1) e ON e.component = s.component""")


@query("cluster_rollup", O.with_fx(["fx_cospend"], "SELECT * FROM roll",
                                   [*_COMP, _EVID, _ROLL], recursive=True))
def cluster_rollup(spark, sf):
    return C.cluster_rollup(R.members(spark, sf), R.cospend(spark, sf))


@query("cluster_listed", O.with_fx(["fx_cospend"], """
  SELECT a.component, a.addresses, e.txids FROM
    (SELECT component, string_agg(address, ',' ORDER BY address) AS addresses FROM (
       SELECT *, row_number() OVER (PARTITION BY component ORDER BY address) AS k FROM comp)
     WHERE k <= 60 GROUP BY 1) a
    JOIN (SELECT component, string_agg(txid, ',' ORDER BY txid) AS txids FROM (
       SELECT *, row_number() OVER (PARTITION BY component ORDER BY txid) AS k FROM evid)
     WHERE k <= 25 GROUP BY 1) e ON e.component = a.component""", [*_COMP, _EVID],
                                   recursive=True))
def cluster_listed(spark, sf):
    return _listed(R.members(spark, sf), R.cospend(spark, sf))


def _listed(members, linking):
    a = C.listed(members, "address", C.LISTED_ADDRESSES)
    e = C.listed(C.evidence_tx(members, linking), "txid", C.LISTED_EVIDENCE)
    return a.join(e, "component").select(
        "component", F.array_join("addresss", ",").alias("addresses"),
        F.array_join("txids", ",").alias("txids"))


# Customers carry labels by number here: exchanges and mixers.
_CLABELS = ("clabels", """
  SELECT 'c' || c_custkey AS address, 'X' || c_custkey % 9 AS entity, 'exchange' AS category
  FROM customer WHERE c_custkey % 11 = 3
  UNION ALL SELECT 'c' || c_custkey, 'M' || c_custkey % 5, 'mixer' FROM customer
  WHERE c_custkey % 13 = 6 AND c_custkey % 11 <> 3""")


def _customer_labels(spark, sf):
    k = F.col("c_custkey")
    exchange = k % 11 == 3
    return X.table(spark, sf, "customer").filter(exchange | (k % 13 == 6)).select(
        F.concat(F.lit("c"), k).alias("address"), F.lit(X.CHAIN).alias("chain"),
        F.when(exchange, F.concat(F.lit("X"), k % 9)).otherwise(
            F.concat(F.lit("M"), k % 5)).alias("entity_name"),
        F.when(exchange, S.EXCHANGE).otherwise(S.MIXER).alias("category"),
        F.lit("rule").alias("source"), F.lit("medium").alias("confidence"))


_TRACED = ("traced", """
  SELECT n.trace_id, c.component, CAST(count(*) AS BIGINT) AS n_traced,
         min(n.address) AS first_traced
  FROM t_nodes n JOIN comp c ON c.address = n.address GROUP BY 1, 2""")
_SERVICE = ("service", """
  SELECT n.trace_id, c.component, min_by(l.entity, n.address) AS service_label
  FROM t_nodes n JOIN comp c ON c.address = n.address
  JOIN clabels l ON l.address = n.address GROUP BY 1, 2""")
_CLUSTERS = [*_COMP, _EVID, _ROLL, _CLABELS, _TRACED, _SERVICE, ("clusters", """
  SELECT t.trace_id, t.component, t.n_traced, t.first_traced, r.size, r.evidence_count,
         r.confidence, s.service_label, 'C' || row_number() OVER (PARTITION BY t.trace_id
           ORDER BY t.n_traced DESC, r.size DESC, t.component) AS cluster_id
  FROM traced t JOIN roll r ON r.component = t.component
  LEFT JOIN service s ON s.trace_id = t.trace_id AND s.component = t.component""")]
_CLUSTER_FX = ["fx_cospend", "fx_ledger_facts"]


@query("cluster_service", O.with_fx(_CLUSTER_FX, "SELECT * FROM service",
                                    [*NATION_USD, *_CLUSTERS], recursive=True))
def cluster_service(spark, sf):
    return C.service_label(R.members(spark, sf), R.nations(spark, sf).nodes,
                           _customer_labels(spark, sf)).drop("chain")


def _clusters(spark, sf):
    return C.clusters(R.members(spark, sf), R.cospend(spark, sf), R.nations(spark, sf).nodes,
                      _customer_labels(spark, sf))


@query("clusters", O.with_fx(_CLUSTER_FX, "SELECT * FROM clusters",
                             [*NATION_USD, *_CLUSTERS], recursive=True))
def clusters(spark, sf):
    return _clusters(spark, sf).select(
        "trace_id", "component", "n_traced", "first_traced", "size", "evidence_count",
        "confidence", "service_label", "cluster_id")


@query("finding_cluster", O.with_fx(_CLUSTER_FX, """
  SELECT trace_id, 'address_cluster' AS type, 5 AS priority, first_traced AS address,
         CAST(NULL AS BIGINT) AS usd_cents, CAST(NULL AS BIGINT) AS max_total_raw,
         service_label AS related,
         cluster_id || ' ' || n_traced || ' ' || confidence AS detail
  FROM clusters WHERE n_traced >= 2""", [*NATION_USD, *_CLUSTERS], recursive=True))
def finding_cluster(spark, sf):
    return G.address_cluster(_clusters(spark, sf)).select(*SHOWN)



# ------------------------------------------------------------------ overlay

_TRACES = ("traces", """
  SELECT CAST(c_nationkey AS BIGINT) AS case_id, c_custkey AS trace_id,
         'c' || c_custkey AS victim FROM customer WHERE c_custkey % 10 <> 0""")
_PRIORITY = """CASE role WHEN 'victim' THEN 0 WHEN 'exchange' THEN 1 WHEN 'sanctioned' THEN 2
  WHEN 'mixer' THEN 3 WHEN 'high_activity_service' THEN 4 WHEN 'contract' THEN 5
  WHEN 'intermediary' THEN 6 WHEN 'unexpanded' THEN 7 ELSE 9 END"""


@query("overlay_nodes", O.with_fx(["fx_ledger_facts"], f"""
  SELECT case_id, address, role, depth, overlay_hits FROM (
    SELECT t.case_id, n.address, n.role, n.depth,
           count(*) OVER (PARTITION BY t.case_id, n.address) AS overlay_hits,
           row_number() OVER (PARTITION BY t.case_id, n.address
             ORDER BY {_PRIORITY}, n.trace_id) AS k
    FROM t_nodes n JOIN traces t ON t.trace_id = n.trace_id) WHERE k = 1""",
                                  [*CUST_USD, _TRACES]))
def overlay_nodes(spark, sf):
    return V.overlay_nodes(R.traces(spark, sf), R.customers(spark, sf).nodes).select(
        "case_id", "address", "role", "depth", "overlay_hits")


@query("overlay_edges", O.with_fx(["fx_ledger_facts"], """
  SELECT case_id, txid, src AS from_address, dst AS to_address, asset,
         min(e.trace_id) AS trace_id
  FROM t_edges e JOIN traces t ON t.trace_id = e.trace_id GROUP BY 1, 2, 3, 4, 5""",
                                  [*CUST_USD, _TRACES]))
def overlay_edges(spark, sf):
    return V.overlay_edges(R.traces(spark, sf), R.customers(spark, sf).edges).select(
        "case_id", "txid", "from_address", "to_address", "asset", "trace_id")


@query("convergence", O.with_fx(["fx_ledger_facts"], """
  SELECT t.case_id, n.address, count(DISTINCT t.victim) AS n_victims,
         count(DISTINCT t.trace_id) AS n_traces
  FROM t_nodes n JOIN traces t ON t.trace_id = n.trace_id
  WHERE (t.case_id, n.address) NOT IN (SELECT case_id, victim FROM traces)
  GROUP BY 1, 2 HAVING count(DISTINCT t.victim) >= 2""", [*CUST_USD, _TRACES]))
def convergence(spark, sf):
    return V.convergence(R.traces(spark, sf), R.customers(spark, sf).nodes).drop("chain")


# ------------------------------------------------------------------ reductions

@query("entity_contract", O.with_fx(U5_FX + ["fx_labels"], """
  SELECT from_id, to_id, asset, CAST(sum(raw) AS BIGINT) AS value_raw,
         CAST(sum(usd_cents) AS BIGINT) AS usd_cents, CAST(count(*) AS BIGINT) AS n_movements
  FROM (SELECT coalesce('entity:' || a.entity, u.src) AS from_id,
               coalesce('entity:' || b.entity, u.dst) AS to_id, u.*
        FROM t_usd u LEFT JOIN ids a ON a.address = u.src LEFT JOIN ids b ON b.address = u.dst)
  WHERE from_id <> to_id GROUP BY 1, 2, 3""", [*U5_USD, ("ids", """
  SELECT n.address, l.entity FROM t_nodes n JOIN fx_labels l ON l.address = n.address
  AND l.category = 'exchange' WHERE n.role = 'exchange'""")]))
def entity_contract(spark, sf):
    run = R.u5_valued(spark, sf)
    return V.contract_entities(FL.pair_flows(run.edges), run.nodes).select(
        "from_id", "to_id", "asset", "value_raw", "usd_cents", "n_movements")


_FLOWS = ("flows", """
  SELECT trace_id, src, dst, asset, CAST(sum(raw) AS BIGINT) AS raw,
         CAST(sum(usd_cents) AS BIGINT) AS usd_cents FROM t_usd GROUP BY 1, 2, 3, 4""")
_PASS = ("pass", """
  SELECT n.trace_id, n.address, i.src AS pred, o.dst AS succ FROM t_nodes n
  JOIN (SELECT trace_id, dst, min(src) AS src FROM flows GROUP BY 1, 2 HAVING count(*) = 1) i
    ON i.trace_id = n.trace_id AND i.dst = n.address
  JOIN (SELECT trace_id, src, min(dst) AS dst FROM flows GROUP BY 1, 2 HAVING count(*) = 1) o
    ON o.trace_id = n.trace_id AND o.src = n.address
  WHERE n.role = 'intermediary' AND i.src <> n.address AND o.dst <> n.address""")
_RUNS = ("runs", """
  SELECT trace_id, address AS first, pred AS head, address AS node, succ, 1 AS position
  FROM pass p WHERE (trace_id, pred) NOT IN (SELECT trace_id, address FROM pass)
  UNION ALL SELECT r.trace_id, r.first, r.head, p.address, p.succ, r.position + 1
  FROM runs r JOIN pass p ON p.trace_id = r.trace_id AND p.address = r.succ""")
_MEMBERS = ("run_members", """
  SELECT trace_id, node AS address, first, position, head, CASE WHEN head = tail THEN last_at
         ELSE tail END AS tail
  FROM (SELECT *, max_by(succ, position) OVER w AS tail, max_by(node, position) OVER w AS last_at,
               max(position) OVER w AS n FROM runs WINDOW w AS (PARTITION BY trace_id, first))
  WHERE head <> tail OR position < n""")
_VIEW = ("view", """
  SELECT trace_id, src, dst, asset, raw, usd_cents, 'flow' AS kind, 0 AS n_members FROM flows f
  WHERE (trace_id, src) NOT IN (SELECT trace_id, address FROM run_members)
    AND (trace_id, dst) NOT IN (SELECT trace_id, address FROM run_members)
  UNION ALL
  SELECT r.trace_id, r.head, r.tail, f.asset, f.raw, f.usd_cents, 'chain', r.n
  FROM (SELECT trace_id, first, min(head) AS head, min(tail) AS tail, count(*) AS n
        FROM run_members GROUP BY 1, 2) r
  JOIN flows f ON f.trace_id = r.trace_id AND f.dst = r.first""")
_CHAIN = [_FLOWS, _PASS, _RUNS, _MEMBERS, _VIEW]


@R.shared
def _chain_members(spark, sf):
    run = R.customers(spark, sf)
    flows = materialise(FL.pair_flows(run.edges), "flows", rebalance=False)
    return flows, materialise(V.chain_members(flows, run.nodes), "chain-members", rebalance=False)


@R.shared
def _chain_view(spark, sf):
    return materialise(V.collapse_chains(*_chain_members(spark, sf)), "chain-view", rebalance=False)


@query("chain_members", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, address, first, CAST(position AS BIGINT) AS position, head, tail
  FROM run_members""", [*CUST_USD, *_CHAIN], recursive=True))
def chain_members(spark, sf):
    return _chain_members(spark, sf)[1].select("trace_id", "address", "first", "position",
                                               "head", "tail")


@query("chain_collapse", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, src AS from_address, dst AS to_address, asset, raw AS value_raw, kind,
         CAST(n_members AS BIGINT) AS n_members FROM view""", [*CUST_USD, *_CHAIN],
                                   recursive=True))
def chain_collapse(spark, sf):
    return _chain_view(spark, sf).select(
        "trace_id", "from_address", "to_address", "asset", "value_raw", "kind", "n_members")


_FOLD = """
  SELECT trace_id, src AS from_address, dst AS to_address, asset, raw AS value_raw, kind,
         CAST(n_members AS BIGINT) AS n_members FROM view v
  WHERE (trace_id, src, dst, asset) NOT IN (SELECT trace_id, src, dst, asset FROM leaf
    WHERE n > 6 AND k > 3) OR kind = 'chain'
  UNION ALL SELECT trace_id, src, 'stub:' || src, asset, CAST(sum(raw) AS BIGINT), 'stub',
         CAST(count(*) AS BIGINT) FROM leaf WHERE n > 6 AND k > 3 GROUP BY 1, 2, 4"""
_LEAF = ("leaf", """
  SELECT v.*, row_number() OVER (PARTITION BY v.trace_id, v.src ORDER BY
             CASE WHEN v.usd_cents IS NOT NULL THEN v.usd_cents / 100.0::DOUBLE
                  ELSE v.raw / 100.0::DOUBLE END DESC, v.dst, v.asset) AS k,
         count(*) OVER (PARTITION BY v.trace_id, v.src) AS n
  FROM view v JOIN t_nodes t ON t.trace_id = v.trace_id AND t.address = v.dst
    AND t.role IN ('intermediary', 'unexpanded')
  JOIN (SELECT trace_id, dst FROM view GROUP BY 1, 2 HAVING count(*) = 1) i
    ON i.trace_id = v.trace_id AND i.dst = v.dst
  WHERE v.kind = 'flow' AND (v.trace_id, v.dst) NOT IN (SELECT trace_id, src FROM view)""")


@query("minor_fold", O.with_fx(["fx_ledger_facts"], _FOLD, [*CUST_USD, *_CHAIN, _LEAF],
                               recursive=True))
def minor_fold(spark, sf):
    run = R.customers(spark, sf)
    return V.fold_minor(_chain_view(spark, sf), run.nodes).select(
        "trace_id", "from_address", "to_address", "asset", "value_raw", "kind", "n_members")


# The same fold with USD and movement counts, which minor_fold does not compare.
_FLOWS_USD = ("flows", _FLOWS[1].replace("AS usd_cents FROM", """AS usd_cents,
         bool_and(usd_cents IS NOT NULL) AS complete, count(*) AS moves FROM"""))
_VIEW_USD = ("view", _VIEW[1].replace("usd_cents, 'flow'", "usd_cents, complete, moves, 'flow'")
             .replace("f.usd_cents, 'chain'", "f.usd_cents, f.complete, f.moves, 'chain'"))


@query("minor_fold_usd", O.with_fx(["fx_ledger_facts"], """
  SELECT trace_id, src AS from_address, dst AS to_address, asset, usd_cents,
         complete AS usd_complete, CAST(moves AS BIGINT) AS n_movements, kind FROM view v
  WHERE (trace_id, src, dst, asset) NOT IN (SELECT trace_id, src, dst, asset FROM leaf
    WHERE n > 6 AND k > 3) OR kind = 'chain'
  UNION ALL SELECT trace_id, src, 'stub:' || src, asset, CAST(sum(usd_cents) AS BIGINT),
         bool_and(complete), CAST(sum(moves) AS BIGINT), 'stub'
  FROM leaf WHERE n > 6 AND k > 3 GROUP BY 1, 2, 4""",
                                   [*CUST_USD, _FLOWS_USD, _PASS, _RUNS, _MEMBERS, _VIEW_USD, _LEAF],
                                   recursive=True))
def minor_fold_usd(spark, sf):
    run = R.customers(spark, sf)
    return V.fold_minor(_chain_view(spark, sf), run.nodes).select(
        "trace_id", "from_address", "to_address", "asset", "usd_cents", "usd_complete",
        "n_movements", "kind")


@query("overlay_exits", O.with_fx(["fx_facts", "fx_ranked_labels"], """
  SELECT CAST(7 AS BIGINT) AS case_id, f.address, l.entity FROM (
    SELECT DISTINCT next AS address FROM t_edges) x
  JOIN fx_facts f ON f.address = x.address AND f.is_exchange
  JOIN fx_ranked_labels l ON l.address = x.address AND l.label_no = 1""", U5_USD))
def overlay_exits(spark, sf):
    run = R.u5_valued(spark, sf)
    traces = run.start.select(F.lit(7).cast("bigint").alias("case_id"), "trace_id", "chain",
                              F.lit("finished").alias("status"),
                              F.col("address").alias("victim"))
    return V.overlay_exits(traces, E.exits(run)).select("case_id", "address", "entity")
