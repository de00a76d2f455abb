"""Building blocks of the SQL statements that check the queries.

They are written from the rules, not from the Spark code: the traces are
unrolled level by level with plain windows, components use recursion.
"""

from __future__ import annotations

FX = {}

FX["fx_moves"] = """
  SELECT CAST(event_id AS VARCHAR) AS txid, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         'u' || user_id AS src, 'u' || json_extract_string(props, '$.k') AS dst,
         event_type AS asset, CAST(round(value * 100) AS BIGINT) AS raw
  FROM events"""

FX["fx_ledger"] = """
  SELECT 'p' || o_orderkey AS txid, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts,
         'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'USDT' AS asset,
         CAST(round(o_totalprice * 100) AS BIGINT) AS raw
  FROM orders
  UNION ALL
  SELECT 's' || o_orderkey,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) + (o_orderkey % 120) * 3600,
         'o' || o_orderkey, 'n' || c_nationkey, 'USDT',
         CAST(round(o_totalprice * 100) AS BIGINT) * (80 + o_orderkey % 21) // 100
  FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderkey % 2 = 1"""

FX["fx_wallets"] = """
  SELECT address, CAST(substr(address, 2) AS BIGINT) AS i
  FROM (SELECT src AS address FROM fx_moves UNION SELECT dst FROM fx_moves)"""

FX["fx_labels"] = """
  SELECT address, 'SDN ' || i AS entity, 'sanctioned' AS category,
         'ofac_sdn' AS source, 'high' AS confidence
  FROM fx_wallets WHERE i % 40 = 9 OR i % 60 = 27
  UNION ALL SELECT address, 'Mixer ' || i, 'mixer', 'tagpack', 'medium'
  FROM fx_wallets WHERE i % 25 = 3
  UNION ALL SELECT address, (['Kraken','Binance','Binance.US','Coinbase','Gemini',
                              'Bybit'])[(i // 10) % 6 + 1], 'exchange', 'seed', 'medium'
  FROM fx_wallets WHERE i % 10 = 7
  UNION ALL SELECT address, 'Report ' || i, 'scam_report', 'blacklist', 'medium'
  FROM fx_wallets WHERE i % 20 = 4
  UNION ALL SELECT address, 'Flagged by X: ' || i, 'shared_flag', 'pack:x', 'medium'
  FROM fx_wallets WHERE i % 35 = 2"""

FX["fx_flags"] = """
  SELECT address, 'reason ' || i AS reason, i % 7 AS case_id FROM fx_wallets
  WHERE i % 30 = 1"""

FX["fx_all_labels"] = """
  SELECT * FROM fx_labels
  UNION ALL SELECT address, 'AGENCY FLAG: ' || reason, 'flagged', 'agency_flag', 'high'
  FROM fx_flags"""

FX["fx_ranked_labels"] = """
  SELECT *, row_number() OVER (
    PARTITION BY address ORDER BY CASE confidence WHEN 'high' THEN 0
      WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, source, entity) AS label_no
  FROM fx_all_labels"""

# One row of facts per labelled wallet of the event graph.
FX["fx_facts"] = """
  SELECT w.address, i % 40 = 9 OR i % 60 = 27 AS is_sanctioned, i % 25 = 3 AS is_mixer,
         i % 10 = 7 AS is_exchange, i % 50 = 12 AS is_contract, i % 30 = 1 AS flagged,
         i % 35 = 2 AS shared, i % 20 = 4 AS scam, CAST(NULL AS BIGINT) AS activity
  FROM fx_wallets w"""

# Ledger wallets carry no labels; only their activity matters.
FX["fx_ledger_facts"] = """
  SELECT address, false AS is_sanctioned, false AS is_mixer, false AS is_exchange,
         false AS is_contract, false AS flagged, false AS shared, false AS scam,
         count(DISTINCT txid) AS activity
  FROM (SELECT src AS address, txid FROM fx_ledger
        UNION ALL SELECT dst, txid FROM fx_ledger) GROUP BY 1"""

FX["fx_ticks"] = """
  SELECT event_type AS asset, CAST(ts AS DATE) AS date, min_by(value, ts) AS usd
  FROM events GROUP BY 1, 2"""

FX["fx_feed1"] = "SELECT * FROM fx_ticks WHERE day(date) % 7 <> 0"

FX["fx_feed2"] = """
  SELECT event_type AS asset, CAST(ts AS DATE) AS date,
         floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) + 0.5)
           / 100.0::DOUBLE AS usd
  FROM events WHERE day(ts) % 14 <> 0 GROUP BY 1, 2"""

FX["fx_prices"] = """
  SELECT asset, date, usd, 'feed1' AS source FROM fx_feed1
  UNION ALL SELECT asset, date, usd, 'feed2' FROM fx_feed2
  WHERE (asset, date) NOT IN (SELECT (asset, date) FROM fx_feed1)"""

FX["fx_cospend"] = """
  SELECT DISTINCT l_suppkey || '|' || CAST(l_shipdate AS DATE) || '|' || l_partkey % 5 AS txid,
         'c' || o_custkey AS address
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

FX["fx_cj_in"] = """
  SELECT DISTINCT l_suppkey || '|' || strftime(l_shipdate, '%Y-%m') AS txid,
         'c' || o_custkey AS address
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

FX["fx_cj_out"] = """
  SELECT l_suppkey || '|' || strftime(l_shipdate, '%Y-%m') AS txid,
         CAST(l_quantity AS BIGINT) AS value FROM lineitem"""

_NEEDS = {
    "fx_wallets": ["fx_moves"], "fx_labels": ["fx_wallets"], "fx_flags": ["fx_wallets"],
    "fx_all_labels": ["fx_labels", "fx_flags"], "fx_ranked_labels": ["fx_all_labels"],
    "fx_facts": ["fx_wallets"], "fx_ledger_facts": ["fx_ledger"],
    "fx_feed1": ["fx_ticks"], "fx_prices": ["fx_feed1", "fx_feed2"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name):
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in out:
            out.append(name)
    for name in names:
        visit(name)
    return out


def with_fx(names: list[str], select: str, extra: list[tuple[str, str]] = (),
            recursive: bool = False) -> str:
    """A statement with the named projections and further CTEs in front."""
    parts = [f"{n} AS ({FX[n]})" for n in _closure(names)]
    parts += [f"{n} AS ({body})" for n, body in extra]
    if not parts:
        return select
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} " + ",\n".join(parts) + "\n" + select


def status_sql(direction: str, dust: int) -> str:
    late = "m.ts > f.bound" if direction == "backward" else "m.ts < f.bound"
    return (f"CASE WHEN m.src = m.dst THEN 'self' WHEN m.raw < {dust} THEN 'dust' "
            f"WHEN coalesce({late}, false) THEN 'time' ELSE 'eligible' END")


def pattern_sql(pattern: str, source: str, group: str) -> str:
    """Rows of ``source`` the pattern follows, with plain windows."""
    if pattern == "thorough":
        return f"SELECT * FROM {source}"
    order = "raw DESC, ts DESC NULLS LAST, txid, next"
    keep = ("rk <= 3 AND 10 * coalesce(before, 0) < 8 * total" if pattern == "rapid"
            else "rk <= 8 AND 20 * raw >= total")
    return f"""
      SELECT * EXCLUDE (rk, total, before, n_all) FROM (
        SELECT *, row_number() OVER (PARTITION BY {group}, asset ORDER BY {order}) AS rk,
          sum(raw) OVER (PARTITION BY {group}, asset) AS total,
          sum(raw) OVER (PARTITION BY {group}, asset ORDER BY {order}
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
          count(*) OVER (PARTITION BY {group}) AS n_all
        FROM {source})
      WHERE n_all <= 1 OR ({keep})"""


def trace_ctes(moves: str, facts: str, seeds: str, direction: str = "forward",
               pattern: str = "balanced", depth: int = 3, dust: int = 100,
               busy: int | None = None, prefix: str = "t",
               focus: str | None = None, cap: int | None = None,
               cap_edges: int | None = None, newest: int | None = None
               ) -> list[tuple[str, str]]:
    """CTEs of an unrolled trace.  Final ones: ``{prefix}_nodes``,
    ``{prefix}_edges``, ``{prefix}_cand``.  ``seeds`` yields (trace_id, address);
    ``focus`` replaces the first level by given eligible rows.  ``cap`` and
    ``cap_edges`` stop a trace inside a level, wallets in order of their value;
    ``newest`` reads only so many transactions that touch a wallet."""
    here, there = ("dst", "src") if direction == "backward" else ("src", "dst")
    pick = "max" if direction == "backward" else "min"
    busy_sql = f"coalesce(activity > {busy}, false)" if busy is not None else "false"
    role = (f"CASE WHEN is_sanctioned THEN 'sanctioned' WHEN is_mixer THEN 'mixer' "
            f"WHEN is_exchange THEN 'exchange' WHEN is_contract THEN 'contract' "
            f"WHEN {busy_sql} THEN 'high_activity_service' ELSE 'intermediary' END")
    fact_cols = ("is_sanctioned", "is_mixer", "is_exchange", "is_contract", "flagged",
                 "shared", "scam")
    facts_sel = ", ".join(f"coalesce(f.{c}, false) AS {c}" for c in fact_cols)
    out = [(f"{prefix}_n0", f"""
      SELECT s.trace_id, s.address, 0 AS depth, CAST(NULL AS BIGINT) AS bound,
             'victim' AS role, {facts_sel}, f.activity, CAST(NULL AS BIGINT) AS worth
      FROM ({seeds}) s LEFT JOIN {facts} f ON f.address = s.address""")]
    limited = cap is not None or cap_edges is not None
    if newest is not None:
        out.append((f"{prefix}_last", f"""
          SELECT address, ts, txid FROM (
            SELECT address, ts, txid, row_number() OVER (PARTITION BY address
                   ORDER BY ts DESC NULLS LAST, txid) AS nth
            FROM (SELECT address, txid, max(ts) AS ts FROM (
                    SELECT src AS address, txid, ts FROM {moves}
                    UNION ALL SELECT dst, txid, ts FROM {moves}) GROUP BY 1, 2))
          WHERE nth = {newest}"""))
    for d in range(depth):
        expandable = "role = 'victim'" if d == 0 else "role = 'intermediary'"
        status, read = status_sql(direction, dust), ""
        if newest is not None:
            read = f"LEFT JOIN {prefix}_last l ON l.address = f.address"
            status = (f"CASE WHEN coalesce(m.ts < l.ts OR (m.ts = l.ts AND m.txid > l.txid), false) "
                      f"THEN 'capped' ELSE {status} END")
        if d == 0 and focus:
            cand = focus
        else:
            cand = f"""
              SELECT f.trace_id, f.address, f.depth, f.bound, m.{there} AS next, m.txid,
                     m.ts, m.asset, m.raw, {status} AS status
              FROM {prefix}_n{d} f JOIN {moves} m ON m.{here} = f.address {read}
              WHERE f.{expandable}"""
        out.append((f"{prefix}_c{d}", cand))
        out.append((f"{prefix}_g{d}",
                    f"SELECT * FROM {prefix}_c{d} WHERE status = 'eligible'"))
        chosen = f"SELECT * FROM {prefix}_g{d}" if d == 0 and focus else \
            pattern_sql(pattern, f"{prefix}_g{d}", "trace_id, address")
        ends = "next AS src, address AS dst" if direction == "backward" \
            else "address AS src, next AS dst"
        drawn = f"""
          SELECT trace_id, address, next, {d + 1} AS depth, txid, ts, {ends}, asset, raw,
                 coalesce(ts, bound) AS bound FROM ({chosen})"""
        seen = " UNION ALL ".join(
            f"SELECT trace_id, address FROM {prefix}_n{k}" for k in range(d + 1))
        if limited:
            held = " UNION ALL ".join(
                [f"SELECT trace_id FROM {prefix}_e{k}" for k in range(1, d + 1)]
                or [f"SELECT trace_id FROM {prefix}_n0 WHERE false"])
            out.append((f"{prefix}_a{d + 1}", drawn))
            out.append((f"{prefix}_w{d}", f"""
              SELECT trace_id, address, row_number() OVER (PARTITION BY trace_id
                     ORDER BY worth DESC NULLS LAST, address) AS pos
              FROM {prefix}_n{d} WHERE NOT is_exchange AND NOT is_sanctioned"""))
            out.append((f"{prefix}_ok{d}", f"""
              SELECT trace_id, address FROM (
                SELECT w.trace_id, w.address,
                  coalesce(k.n, 0) + coalesce(sum(f.n) OVER before, 0) AS nodes,
                  coalesce(h.n, 0) + coalesce(sum(e.n) OVER before, 0) AS edges
                FROM {prefix}_w{d} w
                LEFT JOIN (SELECT trace_id, address, count(*) AS n FROM {prefix}_a{d + 1}
                           GROUP BY 1, 2) e USING (trace_id, address)
                LEFT JOIN (SELECT trace_id, pos, count(*) AS n FROM (
                             SELECT a.trace_id, a.next, min(v.pos) AS pos FROM {prefix}_a{d + 1} a
                             JOIN {prefix}_w{d} v ON v.trace_id = a.trace_id AND v.address = a.address
                             WHERE (a.trace_id, a.next) NOT IN ({seen}) GROUP BY 1, 2)
                           GROUP BY 1, 2) f ON f.trace_id = w.trace_id AND f.pos = w.pos
                LEFT JOIN (SELECT trace_id, count(*) AS n FROM ({seen}) GROUP BY 1) k
                  ON k.trace_id = w.trace_id
                LEFT JOIN (SELECT trace_id, count(*) AS n FROM ({held}) GROUP BY 1) h
                  ON h.trace_id = w.trace_id
                WINDOW before AS (PARTITION BY w.trace_id ORDER BY w.pos
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
              WHERE nodes < {cap if cap is not None else 10**9}
                AND edges < {cap_edges if cap_edges is not None else 10**9}"""))
            drawn = f"""SELECT * FROM {prefix}_a{d + 1}
              WHERE (trace_id, address) IN (SELECT trace_id, address FROM {prefix}_ok{d})"""
        out.append((f"{prefix}_e{d + 1}", drawn))
        out.append((f"{prefix}_n{d + 1}", f"""
          SELECT q.*, {role} AS role FROM (
            SELECT a.*, {facts_sel}, f.activity FROM (
              SELECT trace_id, next AS address, {d + 1} AS depth,
                     CASE WHEN bool_or(bound IS NULL) THEN NULL
                          ELSE {pick}(bound) END AS bound, max(raw) AS worth
              FROM {prefix}_e{d + 1} GROUP BY 1, 2) a
            LEFT JOIN {facts} f ON f.address = a.address
            WHERE (a.trace_id, a.address) NOT IN ({seen})) q"""))
    every = ["trace_id", "address", "depth", "bound", "role", *fact_cols, "activity"]
    cols = ", ".join(every)
    def level(d):
        if not limited or not 0 < d < depth:
            return f"SELECT {cols} FROM {prefix}_n{d}"
        shown = cols.replace(" role,", f""" CASE WHEN NOT is_exchange AND NOT is_sanctioned
          AND (trace_id, address) NOT IN (SELECT trace_id, address FROM {prefix}_ok{d})
          THEN 'unexpanded' ELSE role END AS role,""")
        return f"SELECT {shown} FROM {prefix}_n{d}"
    nodes = " UNION ALL ".join(map(level, range(depth + 1)))
    listed = "false" if newest is None else f"n.address IN (SELECT address FROM {prefix}_last)"
    out.append((f"{prefix}_edges", " UNION ALL ".join(
        f"SELECT * FROM {prefix}_e{d + 1}" for d in range(depth))))
    out.append((f"{prefix}_cand", " UNION ALL ".join(
        f"SELECT * FROM {prefix}_c{d}" for d in range(depth))))
    out.append((f"{prefix}_nodes", f"""
      SELECT n.* EXCLUDE (role),
             CASE WHEN n.role = 'intermediary' AND n.depth = {depth} THEN 'unexpanded'
                  ELSE n.role END AS role,
             n.role = 'intermediary' AND n.depth = {depth} AS max_depth_reached,
             n.role = 'intermediary' AND n.depth < {depth}
               AND coalesce(g.n, 0) = 0 AND NOT {listed} AS at_rest,
             n.role IN ('intermediary', 'victim') AND n.depth < {depth} AND {listed} AS outgoing_txs_capped
      FROM ({nodes}) n LEFT JOIN (
        SELECT trace_id, address, count(*) AS n FROM {prefix}_cand
        WHERE status = 'eligible' GROUP BY 1, 2) g
      ON g.trace_id = n.trace_id AND g.address = n.address"""))
    return out
