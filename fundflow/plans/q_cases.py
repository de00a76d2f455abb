"""Provenance and case tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.operators import casework as CW
from fundflow.operators import exits as E
from fundflow.operators import findings as G
from fundflow.operators import provenance as P
from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.session import scratch_path
from fundflow.plans.q_findings import CUST_TERM, F_SQL, U5_FX, U5_TERM

# ----------------------------------------------------------------- captures


def _captures(spark, sf):
    return X.table(spark, sf, "pages").select(
        F.col("url").alias("cache_key"), F.col("html").cast("binary").alias("body"),
        F.lit("2024-05-01").alias("fetched_utc"), F.col("page_id").alias("seq"))


def _again(spark, sf):
    """Later captures: known pages with another body, and new keys twice."""
    pages = X.table(spark, sf, "pages")
    changed = pages.filter("page_id % 5 = 0").select(
        F.col("url").alias("cache_key"),
        F.concat("html", F.lit("<!-- later -->")).cast("binary").alias("body"),
        F.lit("2024-05-02").alias("fetched_utc"), F.col("page_id").alias("seq"))
    new = pages.select(
        F.concat(F.lit("new:"), F.col("page_id") % 40).alias("cache_key"),
        F.col("html").cast("binary").alias("body"), F.lit("2024-05-02").alias("fetched_utc"),
        F.col("page_id").alias("seq"))
    return changed.unionByName(new)


@query("capture_hash", "SELECT url AS cache_key, sha256(html) AS sha256 FROM pages")
def capture_hash(spark, sf):
    return P.hash_captures(_captures(spark, sf)).select("cache_key", "sha256")


@query("first_capture", """
  SELECT 'new:' || page_id % 40 AS cache_key, min(page_id) AS seq,
         min_by(sha256(html), page_id) AS sha256 FROM pages GROUP BY 1""")
def first_capture(spark, sf):
    return P.hash_captures(P.first_capture(_captures(spark, sf), _again(spark, sf), "seq")) \
        .select("cache_key", "seq", "sha256")


_LOG_SQL = """
  SELECT page_id AS id, page_id % 25 AS trace_id, 'host' || page_id % 6 AS source, url,
         CASE page_id % 8 WHEN 3 THEN 404 WHEN 5 THEN 500 WHEN 6 THEN NULL ELSE 200 END
           AS http_status, CASE WHEN page_id % 5 = 0 THEN sha256(html || '<!-- later -->')
           ELSE sha256(html) END AS sha256, page_id % 3 = 0 AS from_cache,
         CAST(DATE '2024-05-01' + CAST(page_id % 20 AS INTEGER) AS VARCHAR) AS fetched_utc
  FROM pages"""


def _log(spark, sf):
    k, page = F.col("page_id"), X.table(spark, sf, "pages")
    later = F.concat("html", F.lit("<!-- later -->"))
    return page.select(
        k.alias("id"), (k % 25).alias("trace_id"),
        F.concat(F.lit("host"), k % 6).alias("source"), "url",
        F.when(k % 8 == 3, 404).when(k % 8 == 5, 500).when(k % 8 == 6, F.lit(None))
        .otherwise(200).cast("int").alias("http_status"),
        F.when(k % 5 == 0, F.sha2(later, 256)).otherwise(F.sha2("html", 256)).alias("sha256"),
        (k % 3 == 0).alias("from_cache"),
        F.date_add(F.lit("2024-05-01").cast("date"), (k % 20).cast("int")).cast("string")
        .alias("fetched_utc"))


@query("verify_hash", """
  SELECT page_id AS id, url, CASE WHEN page_id % 10 = 7 THEN 'missing'
    WHEN page_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM pages""")
def verify_hash(spark, sf):
    stored = _captures(spark, sf).filter("seq % 10 <> 7")
    return P.verify(stored, _log(spark, sf)).select("id", "url", "verdict")


@query("custody_extract", f"SELECT * FROM ({_LOG_SQL})")
def custody_extract(spark, sf):
    return P.custody_extract(_log(spark, sf))


@query("source_usage", f"""
  SELECT source, CAST(count(*) FILTER (NOT from_cache) AS BIGINT) AS requests,
         CAST(count(*) FILTER (from_cache) AS BIGINT) AS cache_hits,
         CAST(count(*) FILTER (NOT from_cache AND http_status = 404) AS BIGINT) AS not_found,
         CAST(count(*) FILTER (NOT from_cache AND (http_status IS NULL
           OR (http_status >= 400 AND http_status <> 404))) AS BIGINT) AS failures,
         max(fetched_utc) AS last_activity_utc FROM ({_LOG_SQL}) GROUP BY 1""")
def source_usage(spark, sf):
    return CW.source_usage(_log(spark, sf))


@query("manifest", """
  SELECT page_id, sha256(encode(html) || encode(chr(10))) AS sha256,
         CAST(octet_length(encode(html)) + 1 AS BIGINT) AS bytes FROM pages""")
def manifest(spark, sf):
    """Every page as an artefact of its own; the manifest of that folder."""
    path = scratch_path(spark, "artefacts")
    X.write_each(X.table(spark, sf, "pages").select("page_id", F.col("html").alias("value")), "page_id", path, True)
    return P.manifest(spark, path, "part-*").select(
        F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"), "sha256",
        F.col("bytes").cast("bigint").alias("bytes"))


@query("manifest_blocks", """
  SELECT page_id, bytes, count(*) AS n_blocks, sha256(string_agg(h, '' ORDER BY k)) AS root FROM (
    SELECT page_id, octet_length(b) AS bytes, k, sha256(b[k * 512 + 1 : k * 512 + 512]) AS h
    FROM (SELECT page_id, encode(html) || encode(chr(10)) AS b,
                 unnest(range((octet_length(encode(html)) + 512) // 512)) AS k FROM pages))
  GROUP BY 1, 2""")
def manifest_blocks(spark, sf):
    """Roots over blocks of 512 bytes of every page's file."""
    path = scratch_path(spark, "artefacts")
    X.write_each(X.table(spark, sf, "pages").select("page_id", F.col("html").alias("value")), "page_id", path, True)
    return P.block_manifest(spark, path, "part-*", 512).select(
        F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"),
        "bytes", "n_blocks", "root")


# ------------------------------------------------------------------- cases

@query("latest_trace", """
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, max(c_custkey) AS trace_id
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 10 <> 0
  GROUP BY 1, 2""")
def latest_trace(spark, sf):
    return CW.latest_trace(X.cases(spark, sf), R.traces(spark, sf)).select(
        "id", "name", "trace_id")


def _history(cases, exits, *kinds):
    """Counts of a trace's results; ``cases`` gives (case_id, trace_id, t)."""
    found = " UNION ALL ".join(f"SELECT trace_id FROM ({F_SQL[kind]})" for kind in kinds)
    return f"""
  SELECT c.case_id, c.trace_id, coalesce(x.n, 0) AS exits, coalesce(n.n, 0) AS addresses,
         coalesce(f.n, 0) AS findings
  FROM ({cases}) c
  LEFT JOIN (SELECT trace_id, count(*) AS n FROM t_nodes GROUP BY 1) n ON n.trace_id = c.t
  LEFT JOIN (SELECT trace_id, count(*) AS n FROM ({exits}) GROUP BY 1) x ON x.trace_id = c.t
  LEFT JOIN (SELECT trace_id, count(*) AS n FROM ({found}) GROUP BY 1) f ON f.trace_id = c.t"""


_CUSTOMER_HISTORY = O.with_fx(["fx_ledger_facts"], _history(
    "SELECT CAST(c_nationkey AS BIGINT) AS case_id, c_custkey AS trace_id, c_custkey AS t FROM customer",
    "SELECT CAST(NULL AS BIGINT) AS trace_id WHERE false", "at_rest", "consolidation", "unresolved"),
    CUST_TERM)
_EVENT_HISTORY = O.with_fx(U5_FX + ["fx_labels"], _history(
    "SELECT CAST(99 AS BIGINT) AS case_id, CAST(-1 AS BIGINT) AS trace_id, 1 AS t",
    """SELECT n.trace_id FROM t_nodes n JOIN fx_facts a USING (address)
       WHERE a.is_exchange AND n.address IN (SELECT next FROM t_edges)""",
    "consolidation", "sanctioned", "mixer"), U5_TERM)


@query("trace_history", f"""
  SELECT * FROM ({_CUSTOMER_HISTORY}) UNION ALL SELECT * FROM ({_EVENT_HISTORY})""")
def trace_history(spark, sf):
    """The customer traces, and the trace over labelled wallets as case 99."""
    inp, events = (R.finding_inputs(spark, sf, which) for which in ("customers", "u5"))

    def ids(df):
        return df.select("trace_id")

    def moved(df):
        return ids(df).withColumn("trace_id", -F.col("trace_id"))
    ours = (G.funds_at_rest(inp), G.consolidation_point(inp), G.unresolved_edges(inp))
    theirs = (G.consolidation_point(events), G.sanctioned_contact(events), G.mixer_contact(events))
    findings = reduce(DataFrame.unionAll, [*map(ids, ours), *map(moved, theirs)])
    traces = R.traces(spark, sf).select("case_id", "trace_id").unionByName(spark.range(1).select(
        F.lit(99).cast("bigint").alias("case_id"), F.lit(-1).cast("bigint").alias("trace_id")))
    return CW.trace_history(
        traces, ids(inp.result.nodes).unionAll(moved(events.result.nodes)),
        ids(E.exits(inp.result)).unionAll(moved(E.exits(events.result))), findings).select(
        "case_id", "trace_id", "exits", "addresses", "findings")


@query("id_remap", """
  SELECT c_custkey AS trace_id, 5000 + row_number() OVER (ORDER BY c_custkey) AS new_trace_id
  FROM customer WHERE c_nationkey = 3""")
def id_remap(spark, sf):
    mine = R.traces(spark, sf).filter("case_id = 3")
    return P.trace_id_map(mine, 5000)


_CASE_LOG = """
  SELECT page_id AS id, page_id * 7 % 1500 AS trace_id, url FROM pages"""


def _case_tables(spark, sf):
    log = X.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), (F.col("page_id") * 7 % 1500).alias("trace_id"), "url")
    flags = X.flags(spark, sf)
    notes = flags.select("case_id", "chain", "address", F.col("reason").alias("note"))
    return P.export_case(3, X.cases(spark, sf), R.traces(spark, sf), log, notes, flags, flags)


_MINE = "SELECT c_custkey FROM customer WHERE c_nationkey = 3"
_CASE_FLAGS = "SELECT address, reason FROM fx_flags WHERE case_id = 3"


def _parts(tables, **columns):
    """(part, item): the named columns of every table of a case, joined."""
    out = None
    for name, shown in columns.items():
        row = tables[name].select(F.lit(name).alias("part"), F.concat_ws("|", *(
            F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in shown)).alias("item"))
        out = row if out is None else out.unionByName(row)
    return out


@query("case_export", O.with_fx(["fx_flags"], f"""
  SELECT 'custody_log' AS part, id || '|' || trace_id || '|' || url AS item FROM ({_CASE_LOG})
  WHERE trace_id IN ({_MINE})
  UNION ALL SELECT 'traces', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3
  UNION ALL SELECT 'cases', '3|' || n_name FROM nation WHERE n_nationkey = 3
  UNION ALL SELECT 'annotations', '3|' || address || '|' || reason FROM ({_CASE_FLAGS})
  UNION ALL SELECT 'flags', '3|' || address || '|' || reason FROM ({_CASE_FLAGS})
  UNION ALL SELECT 'watches', '3|' || address || '|' || reason FROM ({_CASE_FLAGS})"""))
def case_export(spark, sf):
    """All six tables of a case."""
    return _parts(_case_tables(spark, sf), custody_log=("id", "trace_id", "url"), traces=("trace_id",),
                  cases=("id", "name"), annotations=("case_id", "address", "note"),
                  flags=("case_id", "address", "reason"), watches=("case_id", "address", "reason"))


@query("case_import", O.with_fx(["fx_flags"], f"""
  SELECT 'custody_log' AS part, l.id || '|' || (5000 + m.k) AS item FROM ({_CASE_LOG}) l
  JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM ({_MINE})) m
    ON m.c_custkey = l.trace_id
  UNION ALL SELECT 'traces', '77|' || (5000 + row_number() OVER (ORDER BY c_custkey)) FROM ({_MINE})
  UNION ALL SELECT 'cases', '77|' || n_name FROM nation WHERE n_nationkey = 3
  UNION ALL SELECT 'annotations', '77|' || address || '|' || reason FROM ({_CASE_FLAGS})
  UNION ALL SELECT 'flags', '77|' || address || '|' || reason FROM ({_CASE_FLAGS})
  UNION ALL SELECT 'watches', '77|' || address || '|' || reason FROM ({_CASE_FLAGS})"""))
def case_import(spark, sf):
    """All six tables under new ids."""
    new = P.import_case(_case_tables(spark, sf), 77, 5000)
    return _parts(new, custody_log=("id", "trace_id"), traces=("case_id", "trace_id"),
                  cases=("id", "name"), annotations=("case_id", "address", "note"),
                  flags=("case_id", "address", "reason"), watches=("case_id", "address", "reason"))

