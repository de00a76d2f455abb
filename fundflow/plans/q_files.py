"""File sources and sinks: the given tables are written in the format of a
source and read back by its loader, so the work grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import text as T
from fundflow.operators import exits as E
from fundflow.operators import provenance as P
from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.plans.q_trace import u5_ctes
from fundflow.session import scratch_path
from fundflow.sources import labels as L

PER_FILE = 50
ENTRIES_PER_FILE = 100_000   # of a sanctions list; an XML file is read by one task


@query("sanctions_file", """
  SELECT CASE c_custkey % 4 WHEN 0 THEN '0xab' || c_custkey ELSE 'Ab' || c_custkey END AS address,
         CASE c_custkey % 4 WHEN 0 THEN 'ethereum' WHEN 1 THEN 'bitcoin' WHEN 2 THEN 'zec'
           ELSE 'tron' END AS chain,
         'OFAC SDN: ' || CASE WHEN c_custkey % 3 = 0 THEN 'First ' ELSE '' END || c_name
           AS entity_name
  FROM customer WHERE c_custkey % 5 <> 0""")
def sanctions_file(spark, sf):
    """Identifiers of other kinds stand beside the currency addresses."""
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, "Passport").otherwise(F.concat(
        F.lit("Digital Currency Address - "),
        F.when(k % 4 == 0, "USDC").when(k % 4 == 1, "XBT").when(k % 4 == 2, "ZEC")
        .otherwise("TRX")))
    number = F.when(k % 4 == 0, F.concat(F.lit("0xAb"), k)).otherwise(F.concat(F.lit("Ab"), k))
    ids = F.array(F.struct(F.lit("Tax ID").alias("idType"), F.lit("1").alias("idNumber")),
                  F.struct(kind.alias("idType"), number.alias("idNumber")))
    path = scratch_path(spark, "sdn")
    X.table(spark, sf, "customer").select(
        F.when(k % 3 == 0, "First").alias("firstName"), F.col("c_name").alias("lastName"),
        F.struct(ids.alias("id")).alias("idList")).write.format("xml").option(
        "rowTag", "sdnEntry").option("rootTag", "sdnList").option(
        "maxRecordsPerFile", ENTRIES_PER_FILE).save(path)
    return L.load_sdn(spark, path).select("address", "chain", "entity_name")


@query("tagpack_files", """
  SELECT CASE WHEN t.part = 'B' THEN lower(s_suppkey || t.part) ELSE s_suppkey || t.part END
           AS address,
         CASE WHEN t.part = 'B' THEN 'ethereum' WHEN s_suppkey % 2 = 0 THEN 'bitcoin'
              ELSE 'doge' END AS chain,
         CASE WHEN t.part = 'B' THEN 'Own' ELSE 'Pack ' || s_suppkey END
           || ' [TagPack, as of 2024-01-02]' AS entity_name,
         CASE WHEN t.part = 'B' THEN 'mixer' ELSE 'exchange' END AS category
  FROM supplier, (VALUES ('A'), ('B')) t(part)
  WHERE t.part = 'B' OR s_suppkey % 3 <> 0""")
def tagpack_files(spark, sf):
    """One pack per supplier; one tag inherits the header, one sets its own."""
    k = F.col("s_suppkey").cast("string")
    header = F.concat(
        F.lit("label: Pack "), k, F.lit("\ncurrency: "),
        F.when(F.col("s_suppkey") % 2 == 0, "BTC").otherwise("DOGE"), F.lit("\ncategory: "),
        F.when(F.col("s_suppkey") % 3 == 0, "donation").otherwise("Exchange"),
        F.lit("\nlastmod: 2024-01-02\ntags:\n  - address: "), k,
        F.lit("A\n  - address: "), k,
        F.lit("B\n    label: Own\n    currency: eth\n    category: mixer\n"))
    path = scratch_path(spark, "packs")
    suppliers = X.table(spark, sf, "supplier")
    # a file per pack in one folder: a folder each costs more than the file
    packs = suppliers.groupBy("s_suppkey").agg(F.array_join(F.collect_list(header), "\n").alias("value"))
    packs.select("value").repartition(X.file_tasks(spark)).write.option(
        "maxRecordsPerFile", 1).option(*X.MOVED_BY_TASKS).text(path)
    tags, _ = L.read_tagpacks(spark, path, "*.txt", ".")
    return L.load_tagpacks(tags).select("address", "chain", "entity_name", "category")


def _chunks(spark, df, key, item, wrap):
    """JSON texts of at most PER_FILE items each, one file per chunk."""
    path = scratch_path(spark, "json")
    part = F.floor(F.col(key) / PER_FILE)
    df.groupBy(part.alias("part")).agg(
        wrap(F.sort_array(F.collect_list(item))).alias("value")) \
        .write.partitionBy("part").text(path)
    return path


@query("blacklist_files", """
  SELECT '0xab' || c_custkey AS address, 'ethereum' AS chain, 'scam_report' AS category
  FROM customer""")
def blacklist_files(spark, sf):
    rows = X.table(spark, sf, "customer")
    path = _chunks(spark, rows, "c_custkey", F.concat(F.lit("0xAB"), "c_custkey"), F.to_json)
    return L.load_blacklist(spark, path).select("address", "chain", "category")


@query("seed_files", """
  SELECT CASE WHEN c_custkey % 2 = 0 THEN lower('0xAB' || c_custkey) ELSE 'xAB' || c_custkey END
           AS address, CASE WHEN c_custkey % 2 = 0 THEN 'ethereum' ELSE 'bitcoin' END AS chain,
         c_name AS entity_name, 'exchange' AS category FROM customer""")
def seed_files(spark, sf):
    k = F.col("c_custkey")
    even = k % 2 == 0
    item = F.struct(
        F.concat(F.when(even, "0xAB").otherwise("xAB"), k).alias("address"),
        F.when(even, S.ETHEREUM).otherwise(S.BITCOIN).alias("chain"),
        F.col("c_name").alias("entity"), F.lit(S.EXCHANGE).alias("category"))
    path = _chunks(spark, X.table(spark, sf, "customer"), "c_custkey", item,
                   lambda items: F.to_json(F.struct(items.alias("labels"))))
    return L.load_seed(spark, path).select("address", "chain", "entity_name", "category")


_NATION_ORDER = "row_number() OVER (ORDER BY n_name) - 1"


def _directory(spark, sf, column, *fields):
    items = F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("entity"), *fields)))
    path = scratch_path(spark, "directory")
    X.table(spark, sf, "nation").agg(F.to_json(F.struct(
        F.lit("note").alias("source_note"), items.alias(column))).alias("value")) \
        .write.text(path)
    return path


@query("compliance_file", f"""
  SELECT {_NATION_ORDER} AS ord, n_name AS entity,
         CASE WHEN n_regionkey = 1 THEN 'non_compliant' ELSE 'compliant' END AS status
  FROM nation""")
def compliance_file(spark, sf):
    status = F.when(F.col("n_regionkey") == 1, "non_compliant").otherwise("compliant")
    path = _directory(spark, sf, "designations", status.alias("status"))
    rows = L.load_compliance(spark, path)
    return rows.select(F.col("ord").cast("bigint").alias("ord"), "entity", "status")


@query("custodian_file", f"""
  SELECT * FROM (SELECT {_NATION_ORDER} AS ord, n_name AS entity,
                        'region ' || n_regionkey AS jurisdiction FROM nation)
  WHERE contains(jurisdiction, 'region 2')""")
def custodian_file(spark, sf):
    place = F.concat(F.lit("region "), "n_regionkey")
    path = _directory(spark, sf, "custodians", place.alias("jurisdiction"))
    rows = L.load_custodians(spark, path, "Region 2")
    return rows.select(F.col("ord").cast("bigint").alias("ord"), "entity", "jurisdiction")


@query("explorer_tag_file", """
  SELECT '0x' || lpad(CAST(s_suppkey AS VARCHAR), 40, 'f') AS address,
         CASE WHEN s_suppkey % 2 = 0 THEN 'exchange' ELSE 'scam_report' END AS category,
         CASE WHEN s_suppkey % 2 = 0 THEN 'Wallet, "hot" [explorer tag]'
              ELSE 'explorer ''blocked'' tag: blocked (unverified)' END AS entity_name
  FROM supplier""")
def explorer_tag_file(spark, sf):
    """Three rows per address in one CSV: another network, scam, exchange."""
    k = F.col("s_suppkey")

    def row(chain, label, name):
        return F.struct(chain.alias("chainId"), label.alias("label"), name.alias("nameTag"))
    own = F.when(k % 2 == 0, "kraken").otherwise("some-dex")
    rows = F.array(row(F.lit("56"), F.lit("binance"), F.lit("Other chain")),
                   row(F.lit("1"), F.lit("Blocked"), F.lit("")),
                   row(F.lit("1"), own, F.lit('Wallet, "hot"')))
    path = scratch_path(spark, "tags")
    X.table(spark, sf, "supplier").select(
        F.concat(F.lit("0x"), F.lpad(k.cast("string"), 40, "F")).alias("address"),
        F.explode(rows).alias("r")).select("address", "r.*").write.option(
        "header", "true").option("escape", '"').csv(path)
    return L.load_explorer_tags(spark, path).select("address", "category", "entity_name")


@query("text_forms", """
  SELECT event_id AS id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || ' UTC' AS iso,
         rtrim(rtrim(format('{:,.6f}', value * 1000), '0'), '.') AS amount,
         regexp_replace(regexp_replace(lower('  ' || event_type || ' #' || user_id || '!'),
           '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
         event_type || ' | ' || user_id AS piped, substr(props, 1, 6) AS clipped
  FROM events""")
def text_forms(spark, sf):
    e = X.table(spark, sf, "events")
    name = F.concat(F.lit("  "), "event_type", F.lit(" #"), "user_id", F.lit("!"))
    return e.select(
        F.col("event_id").alias("id"), T.iso_text(X.epoch("ts")).alias("iso"),
        T.amount_text(F.col("value") * 1000).alias("amount"), T.slug(name).alias("slug"),
        T.pipe_join(F.array("event_type", F.col("user_id").cast("string"))).alias("piped"),
        T.clip(F.col("props"), 6).alias("clipped"))


@query("result_export", O.with_fx(["fx_facts"], """
  SELECT 'node' AS part, trace_id, address AS item, role AS note FROM t_nodes
  UNION ALL SELECT 'edge', trace_id, txid, asset FROM t_edges
  UNION ALL SELECT 'exit', trace_id, address, role FROM t_nodes WHERE is_exchange AND depth > 0""",
                                  u5_ctes()))
def result_export(spark, sf):
    """Full result as JSON lines, read back."""
    run = R.u5(spark, sf, S.FORWARD, S.BALANCED)
    path = scratch_path(spark, "export")
    P.export_result(run.nodes, run.edges, E.exits(run), path)

    def part(name, kind, item, note):
        rows = P.read_result(spark, path, name, f"trace_id bigint, {item} string, {note} string")
        return rows.select(F.lit(kind).alias("part"), "trace_id", F.col(item).alias("item"),
                           F.col(note).alias("note"))
    return part("nodes", "node", "address", "role").unionByName(
        part("edges", "edge", "txid", "asset")).unionByName(
        part("exits", "exit", "address", "role"))
