"""Label tables, screening and wallet facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.operators import classify as C
from fundflow.operators import flows as FL
from fundflow.operators import screening as SC
from fundflow.operators import tables as TB
from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.plans.q_trace import u5_ctes
from fundflow.session import scratch_path
from fundflow.sources import labels as L
from fundflow.sources import packs as PK
from fundflow.sources import reports as RP
from fundflow.sources.ledger import address_activity

# --------------------------------------------------------- explorer tags

# Explorer tags by rule: one row per line item, many per supplier address.
_SLUGS = ("binance", "tornado-cash", "take-action", "some-dex", "bridge-exploit", "kraken")
_NAMES = ("Hot Wallet", "Token", "", "Deposit", "Proxy Admin")
_TAGS_SQL = f"""
  SELECT '0x' || lpad(CAST(l_suppkey AS VARCHAR), 40, '0') AS address,
         (['{"','".join(_SLUGS)}'])[CAST((l_orderkey + l_linenumber) % 6 AS INTEGER) + 1] AS slug,
         (['{"','".join(_NAMES)}'])[CAST((l_orderkey * 3 + l_linenumber) % 5 AS INTEGER) + 1]
           AS tag, l_orderkey, l_linenumber, l_partkey
  FROM lineitem"""


def _tags(spark, sf):
    def pick(values, at):
        return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = X.table(spark, sf, "lineitem").select(
        F.concat(F.lit("0x"), F.lpad(F.col("l_suppkey").cast("string"), 40, "0"))
        .alias("address"), pick(_SLUGS, (o + n) % 6).alias("label"),
        pick(_NAMES, (o * 3 + n) % 5).alias("nameTag"), o, n, F.col("l_partkey"))
    return rows.withColumn("ord", F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "label", "nameTag"))


_CATEGORY = """CASE WHEN regexp_matches(name, '(?i)\\b(token|stablecoin|contract|proxy|vesting|airdrop|staking|deployer)\\b')
    THEN 'other' WHEN slug IN ('binance', 'kraken') THEN 'exchange'
    WHEN slug = 'tornado-cash' THEN 'mixer'
    WHEN slug = 'take-action' OR slug LIKE '%-exploit' THEN 'scam_report' ELSE 'other' END"""


@query("labels_best_per_address", f"""
  SELECT address, category, name, slug FROM (
    SELECT *, row_number() OVER (PARTITION BY address ORDER BY CASE category
      WHEN 'exchange' THEN 0 WHEN 'mixer' THEN 1 WHEN 'scam_report' THEN 2 ELSE 3 END,
      l_orderkey, l_linenumber, l_partkey, slug, tag) AS k
    FROM (SELECT *, {_CATEGORY} AS category FROM (
      SELECT *, CASE WHEN tag = '' THEN slug ELSE tag END AS name FROM ({_TAGS_SQL}))))
  WHERE k = 1""")
def labels_best_per_address(spark, sf):
    return L.best_tags(_tags(spark, sf), "ord")


@query("labels_categories", f"""
  SELECT {_CATEGORY} AS category, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT *, CASE WHEN tag = '' THEN slug ELSE tag END AS name FROM ({_TAGS_SQL}))
  GROUP BY 1""")
def labels_categories(spark, sf):
    return _categories(_tags(spark, sf))


def _categories(rows):
    from fundflow.functions.text import tag_category
    name = F.coalesce(F.when(F.col("nameTag") != "", F.col("nameTag")), F.col("label"))
    return rows.groupBy(tag_category(F.col("label"), name).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------- replace, upsert, inventory

@query("labels_replace", O.with_fx(["fx_labels", "fx_wallets"], """
  SELECT address, entity AS entity_name, category, source, confidence FROM fx_labels
  WHERE source <> 'seed'
  UNION ALL SELECT address, 'New ' || max(event_id), 'exchange', 'seed', 'medium'
  FROM (SELECT 'u' || user_id AS address, event_id FROM events)
  GROUP BY 1"""))
def labels_replace(spark, sf):
    """The seed source is replaced by a snapshot that repeats its keys."""
    return _replaced(spark, sf, X.table(spark, sf, "events"))


def _replaced(spark, sf, events):
    fresh = events.select(
        F.concat(F.lit("u"), "user_id").alias("address"), F.lit(X.CHAIN).alias("chain"),
        F.concat(F.lit("New "), "event_id").alias("entity_name"),
        F.lit(S.EXCHANGE).alias("category"), F.lit("medium").alias("confidence"),
        F.col("event_id").alias("seq"))
    return TB.replace_source(X.labels(spark, sf), "seed", fresh).drop("chain")


@query("upsert_latest", """
  SELECT user_id AS k, event_type AS note, seq FROM (
    SELECT user_id, event_type, event_id AS seq, value < 20 AS deleted,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r
    FROM events) WHERE r = 1 AND NOT deleted""")
def upsert_latest(spark, sf):
    """Notes by wallet: the first half is the base, the rest are changes, and a
    small value deletes."""
    rows = X.table(spark, sf, "events").select(
        F.col("user_id").alias("k"), F.col("event_type").alias("note"),
        F.col("event_id").alias("seq"), (F.col("value") < 20).alias("deleted"))
    base = rows.filter("seq % 2 = 0")
    changes = rows.filter("seq % 2 = 1")
    return TB.upsert(base, changes, ["k"], "seq").drop("deleted")


_INV_SQL = """
  SELECT source, CAST(count(*) AS BIGINT) AS n, max(updated_utc) AS last_updated FROM (
    SELECT event_type AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_utc FROM events)
  GROUP BY 1"""


def _dated_labels(spark, sf):
    return X.table(spark, sf, "events").select(
        F.col("event_type").alias("source"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updated_utc"))


@query("labels_inventory", _INV_SQL)
def labels_inventory(spark, sf):
    return TB.label_inventory(_dated_labels(spark, sf))


_CADENCE = {"click": 7, "error": 30, "purchase": 1, "view": 40}


@query("stale_sources", f"""
  SELECT source, n, last_updated, cadence_days, age_seconds FROM (
    SELECT i.*, CAST(c.days AS INTEGER) AS cadence_days,
      CAST(epoch(TIMESTAMP '2024-02-14 00:00:00') - epoch(CAST(last_updated AS TIMESTAMP))
        AS BIGINT) AS age_seconds
    FROM ({_INV_SQL}) i JOIN (VALUES ('click', 7), ('error', 30), ('purchase', 1),
      ('view', 40)) c(source, days) ON c.source = i.source)
  WHERE age_seconds >= cadence_days * 86400""")
def stale_sources(spark, sf):
    return TB.stale_sources(TB.label_inventory(_dated_labels(spark, sf)),
                            "2024-02-14 00:00:00", _CADENCE)


@query("label_attach", O.with_fx(["fx_ranked_labels"], """
  SELECT w.address, l.entity AS entity_name, l.category, l.source, l.label_no
  FROM fx_wallets w LEFT JOIN fx_ranked_labels l ON l.address = w.address"""))
def label_attach(spark, sf):
    wallets = X.wallets(X.moves(spark, sf)).select(F.lit(X.CHAIN).alias("chain"), "address")
    return C.attach_labels(wallets, X.labels(spark, sf), X.flags(spark, sf)).select(
        "address", "entity_name", "category", "source",
        F.col("label_no").cast("bigint").alias("label_no"))


@query("flag_listing", O.with_fx(["fx_flags"], """
  SELECT f.address, f.reason, n.n_name AS case_name FROM fx_flags f
  LEFT JOIN nation n ON n.n_nationkey = f.case_id"""))
def flag_listing(spark, sf):
    flags = X.flags(spark, sf).withColumn("id", F.expr("cast(substring(address, 2) as int)"))
    return TB.flag_list(flags, X.cases(spark, sf)).select("address", "reason", "case_name")


@query("watch_listing", """
  SELECT c_custkey AS id, c_custkey % 5 = 0 AND c_custkey % 10 <> 0 AS open_alert,
         n_name AS case_name FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def watch_listing(spark, sf):
    k = F.col("c_custkey")
    watches = X.table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_nationkey").cast("bigint").alias("case_id"),
        F.when(k % 5 == 0, "{}").alias("alert_json"), (k % 10 == 0).alias("acknowledged"))
    return TB.watch_list(watches, X.cases(spark, sf)).select("id", "open_alert", "case_name")


# ------------------------------------------------------------------ screening

# Real address shapes for the wallets of both ledgers.
_EVM_SQL = "'0xab' || lpad(CAST(i AS VARCHAR), 38, '0')"
_ADDR_SQL = f"""
  SELECT i * 10 AS ord, '  0xAB' || lpad(CAST(i AS VARCHAR), 38, '0') || ' ' AS raw
    FROM fx_wallets
  UNION ALL SELECT i * 10 + 1, {_EVM_SQL} FROM fx_wallets WHERE i % 3 = 0
  UNION ALL SELECT i * 10 + 2, '   ' FROM fx_wallets WHERE i % 5 = 0
  UNION ALL SELECT i * 10 + 3, 'not an address ' || i FROM fx_wallets WHERE i % 7 = 0
  UNION ALL SELECT c_custkey * 10 + 1000004, 'bc1q' || lpad(CAST(c_custkey AS VARCHAR), 36, '0')
    FROM customer"""
_CLEAN = ("clean", f"""
  SELECT chain, kind, CASE WHEN kind = 'address' AND chain = 'ethereum' THEN lower(v) ELSE v END
           AS address, min(ord) AS ord, min_by(v, ord) AS input
  FROM (SELECT ord, trim(raw) AS v,
          CASE WHEN trim(raw) LIKE '0x%' OR trim(raw) LIKE 'bc1q%' THEN 'address'
               ELSE 'unknown' END AS kind,
          CASE WHEN trim(raw) LIKE '0x%' THEN 'ethereum' WHEN trim(raw) LIKE 'bc1q%'
               THEN 'bitcoin' END AS chain FROM ({_ADDR_SQL}))
  WHERE v <> '' GROUP BY 1, 2, 3""")


def _evm(i):
    return F.concat(F.lit("0xab"), F.lpad(i.cast("string"), 38, "0"))


def _pasted(spark, sf):
    w = X.wallets(X.moves(spark, sf))
    i = F.col("i")
    upper = F.concat(F.lit("  0xAB"), F.lpad(i.cast("string"), 38, "0"), F.lit(" "))
    parts = [w.select((i * 10).alias("ord"), upper.alias("raw")),
             w.filter(i % 3 == 0).select((i * 10 + 1).alias("ord"), _evm(i).alias("raw")),
             w.filter(i % 5 == 0).select((i * 10 + 2).alias("ord"), F.lit("   ").alias("raw")),
             w.filter(i % 7 == 0).select((i * 10 + 3).alias("ord"), F.concat(
                 F.lit("not an address "), i.cast("string")).alias("raw"))]
    k = F.col("c_custkey")
    parts.append(X.table(spark, sf, "customer").select(
        (k * 10 + 1000004).alias("ord"),
        F.concat(F.lit("bc1q"), F.lpad(k.cast("string"), 36, "0")).alias("raw")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _evm_keyed(df):
    i = F.expr("cast(substring(address, 2) as bigint)")
    return df.withColumn("address", _evm(i)).withColumn("chain", F.lit(S.ETHEREUM))


@query("inputs_clean", O.with_fx(["fx_wallets"], """
  SELECT chain, address, ord, input, kind FROM clean""", [_CLEAN]))
def inputs_clean(spark, sf):
    return SC.clean_inputs(_pasted(spark, sf)).drop("traceable")


_SCREEN = ("screened", f"""
  SELECT c.*, a.attribution, a.attribution_confidence, coalesce(a.shared, '') AS shared_flags,
         coalesce(a.scam, '') AS scam_lists, f.reason AS agency_flag,
         f.reason IS NOT NULL AS flagged, coalesce(w.i % 9 = 0, false) AS watched,
         CASE WHEN w.i % 4 = 0 THEN w.i % 3 END AS report_count
  FROM clean c LEFT JOIN (SELECT *, {_EVM_SQL} AS evm FROM fx_wallets) w
    ON w.evm = c.address AND c.chain = 'ethereum'
  LEFT JOIN (SELECT address,
      min_by(entity, label_no) FILTER (category IN ('exchange', 'mixer', 'sanctioned')) AS attribution,
      min_by(confidence, label_no) FILTER (category IN ('exchange', 'mixer', 'sanctioned'))
        AS attribution_confidence,
      string_agg(CASE WHEN category = 'shared_flag' THEN entity END, ' | ' ORDER BY label_no) AS shared,
      string_agg(CASE WHEN category = 'scam_report' THEN source END, ' | ' ORDER BY label_no) AS scam
    FROM fx_ranked_labels GROUP BY 1) a ON a.address = w.address
  LEFT JOIN fx_flags f ON f.address = w.address""")
_SCREEN_COLUMNS = ("input", "address", "chain", "kind", "attribution",
                   "attribution_confidence", "shared_flags", "scam_lists", "agency_flag",
                   "flagged", "watched", "report_count")
_SCREEN_FX = ["fx_ranked_labels", "fx_flags"]


def _watches(spark, sf):
    return _evm_keyed(X.wallets(X.moves(spark, sf)).filter("i % 9 = 0"))


def _reports(spark, sf):
    return _evm_keyed(X.wallets(X.moves(spark, sf)).filter("i % 4 = 0").withColumn(
        "report_count", F.col("i") % 3))


@R.shared
def _screened(spark, sf):
    return SC.screen(SC.clean_inputs(_pasted(spark, sf)), _evm_keyed(X.labels(spark, sf)),
                     _evm_keyed(X.flags(spark, sf)), _watches(spark, sf), _reports(spark, sf))


@query("screen_bulk", O.with_fx(_SCREEN_FX, f"""
  SELECT {', '.join(_SCREEN_COLUMNS)} FROM screened""", [_CLEAN, _SCREEN]))
def screen_bulk(spark, sf):
    rows = _screened(spark, sf)

    def joined(c):
        return F.coalesce(F.array_join(c, " | "), F.lit("")).alias(c)
    return rows.withColumns({c: joined(c) for c in ("shared_flags", "scam_lists")}).select(
        *_SCREEN_COLUMNS)


@query("triage_counts", O.with_fx(_SCREEN_FX, """
  SELECT CAST(count(*) AS BIGINT) AS total,
         CAST(count(*) FILTER (attribution IS NOT NULL) AS BIGINT) AS attributed,
         CAST(count(*) FILTER (flagged) AS BIGINT) AS flagged,
         CAST(count(*) FILTER (shared_flags <> '') AS BIGINT) AS shared_flagged,
         CAST(count(*) FILTER (scam_lists <> '') AS BIGINT) AS scam_listed,
         CAST(count(*) FILTER (report_count > 0) AS BIGINT) AS report_hits,
         CAST(count(*) FILTER (kind <> 'address') AS BIGINT) AS unrecognised
  FROM screened""", [_CLEAN, _SCREEN]))
def triage_counts(spark, sf):
    return SC.screen_summary(_screened(spark, sf))


@query("screen_csv", O.with_fx(_SCREEN_FX, """
  SELECT input, address, coalesce(chain, '') AS chain, coalesce(attribution, '') AS attribution,
         coalesce(agency_flag, '') AS agency_flag, shared_flags, scam_lists,
         coalesce(CAST(report_count AS VARCHAR), '') AS chainabuse_reports,
         CASE WHEN watched THEN 'yes' ELSE '' END AS watched,
         CASE WHEN kind = 'address' THEN '' ELSE 'not an address: ' || kind END AS note
  FROM screened""", [_CLEAN, _SCREEN]))
def screen_csv(spark, sf):
    return SC.screen_csv(_screened(spark, sf)).select(
        "input", "address", "chain", "attribution", "agency_flag", "shared_flags",
        "scam_lists", "chainabuse_reports", "watched", "note")


@query("wallet_facts", O.with_fx(["fx_facts"], """
  SELECT f.address, coalesce(f.flagged, false) AS flagged, w.i % 3 = 1 AS watched,
         CASE WHEN w.i % 4 = 0 THEN CAST(w.i % 5 AS BIGINT) END AS report_count,
         a.n AS activity, n.role, n.depth, n.at_rest, c.n_in AS sender_count, c.n_out AS receiver_count,
         CASE WHEN f.is_exchange THEN 'custodian' WHEN coalesce(n.at_rest, false) THEN 'at_rest'
              WHEN w.i % 4 <> 0 THEN 'look_up' ELSE 'continue' END AS next_step
  FROM fx_facts f JOIN fx_wallets w ON w.address = f.address
  LEFT JOIN (SELECT address, count(DISTINCT txid) AS n FROM (
      SELECT src AS address, txid FROM fx_moves UNION SELECT dst, txid FROM fx_moves) GROUP BY 1) a
    ON a.address = f.address
  LEFT JOIN t_nodes n ON n.address = f.address
  LEFT JOIN (SELECT address, count(DISTINCT s) AS n_in, count(DISTINCT r) AS n_out FROM (
      SELECT dst AS address, src AS s, NULL AS r FROM t_edges
      UNION ALL SELECT src, NULL, dst FROM t_edges) GROUP BY 1) c ON c.address = n.address""", u5_ctes()))
def wallet_facts(spark, sf):
    """Watches, report lookups, activity, and each wallet's part in one trace."""
    run = R.u5(spark, sf, S.FORWARD, S.BALANCED)
    wallets = X.wallets(X.moves(spark, sf)).select(F.lit(X.CHAIN).alias("chain"), "address", "i")
    reports = wallets.filter("i % 4 = 0").select(
        "chain", "address", (F.col("i") % 5).cast("bigint").alias("report_count"))
    return SC.wallet_facts(
        wallets.drop("i"), X.labels(spark, sf), X.flags(spark, sf), wallets.filter("i % 3 = 1"), reports,
        nodes=run.nodes, counts=FL.wallet_counts(run.edges),
        activity=address_activity(R.moves(spark, sf))).select(
        "address", F.col("agency_flag").isNotNull().alias("flagged"), "watched", "report_count",
        "activity", "role", "depth", "at_rest", "sender_count", "receiver_count", "next_step")


# -------------------------------------------------------------- packs, reports

_PACK_ITEMS = """
  SELECT 'u' || user_id AS address, count(*) AS n, min(event_type) AS reason,
         strftime(min(ts), '%Y-%m-%d') AS flagged_utc FROM events GROUP BY 1"""


def _pack_flags(spark, sf):
    return X.table(spark, sf, "events").groupBy(
        F.concat(F.lit("u"), "user_id").alias("address")).agg(
        F.min("event_type").alias("reason"),
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("created_utc")).withColumn(
        "chain", F.lit(S.BITCOIN))


@query("pack_export", f"""
  SELECT CAST(count(*) AS BIGINT) AS flag_count, sha256('[' || string_agg(
    '{{"address":"' || address || '","chain":"bitcoin","flagged_utc":"' || flagged_utc
      || '","reason":"' || reason || '"}}', ',' ORDER BY address) || ']') AS sha256
  FROM ({_PACK_ITEMS})""")
def pack_export(spark, sf):
    return PK.export_pack(_pack_flags(spark, sf), "Agency X", "desk", "2024-05-01").select(
        "flag_count", "sha256")


@query("pack_import", f"""
  SELECT address, 'partner Agency X flags it: ' || reason || ', ' || flagged_utc
         AS entity_name, 'pack:agency-x' AS source FROM ({_PACK_ITEMS})""")
def pack_import(spark, sf):
    """Two snapshots of one agency: the older and a tampered one fall away."""
    flags = _pack_flags(spark, sf)
    new = PK.export_pack(flags, "Agency X", "desk", "2024-05-01", parts=3)
    old = PK.export_pack(flags.withColumn("reason", F.lit("old")), "AGENCY X", "", "2024-01-01")
    bad = PK.export_pack(flags, "Agency Y", "", "2024-05-01").withColumn(
        "sha256", F.lit("00"))
    packs = new.unionByName(old).unionByName(bad)
    return PK.pack_labels(packs).select("address", "entity_name", "source")


_REPORTS_SQL = """
  SELECT 'u' || doc_id % 150 AS address, doc_id, source AS category, text FROM documents"""


def _raw_reports(spark, sf):
    docs = X.table(spark, sf, "documents")
    none = F.lit(None)
    report = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("scamCategory"),
        none.cast("string").alias("createdAt"), F.lit(True).alias("trusted"),
        F.lit(False).alias("checked"), F.lit(False).alias("isPrivate"),
        F.col("text").alias("description"),
        none.cast("array<struct<address: string, chain: string, domain: string>>")
        .alias("addresses"),
        none.cast("array<struct<amount: double, asset: string>>").alias("losses"))
    return docs.select(
        F.concat(F.lit("u"), F.col("doc_id") % 150).alias("address"),
        F.lit(S.BITCOIN).alias("chain"), F.lit("2024-05-01T00:00:00").alias("fetched_utc"),
        F.lit(1).cast("bigint").alias("count"), F.array(report).alias("reports"))


@query("keyed_upsert", """
  SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 4 THEN 'note ' || p_size
         ELSE p_name END AS note, CASE WHEN p_partkey % 10 = 4 THEN CAST(9 AS BIGINT)
         ELSE CAST(p_partkey % 3 AS BIGINT) END AS seq FROM part WHERE p_partkey % 10 <> 7""")
def keyed_upsert(spark, sf):
    """Notes kept by part: some change twice, some are taken away, some changes
    are older than what is stored."""
    k = F.col("p_partkey")
    part = X.table(spark, sf, "part")
    table = TB.KeyedTable(scratch_path(spark, "notes"), ("k",), "seq", 16)
    table.create(part.select(k.alias("k"), F.col("p_name").alias("note"), (k % 3).alias("seq")))
    new = F.concat(F.lit("note "), "p_size")

    def change(rows, note, seq, gone=False):
        return rows.select(k.alias("k"), note.alias("note"), F.lit(seq).cast("bigint").alias("seq"),
                           F.lit(gone).alias("deleted"))
    four = part.filter(k % 10 == 4)
    table.upsert(change(four, F.lit("first"), 5).unionByName(change(four, new, 9)).unionByName(
        change(part.filter(k % 10 == 7), F.lit(""), 5, True)))
    table.upsert(change(part.filter(k % 10 == 5), F.lit("late"), -1))
    return table.read(spark).select("k", "note", "seq")


@query("reports_shaped", f"""
  SELECT address, CAST(doc_id AS VARCHAR) AS id, category,
         CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS digest FROM ({_REPORTS_SQL})""")
def reports_shaped(spark, sf):
    return RP.whole_reports(_raw_reports(spark, sf)).select(
        "address", "id", "category", F.length("description").cast("bigint").alias("n_chars"),
        F.sha2("description", 256).alias("digest"))


@query("report_categories", f"""
  SELECT address, category, CAST(count(*) AS BIGINT) AS n FROM ({_REPORTS_SQL}) GROUP BY 1, 2""")
def report_categories(spark, sf):
    return RP.report_categories(RP.whole_reports(_raw_reports(spark, sf))).drop("chain")


@query("report_labels", f"""
  SELECT address, 'scam reports by the public: ' || sum(n) || ', most as '
         || string_agg(category || ' x' || n, ', ' ORDER BY k) FILTER (k <= 4) || '; not verified'
         AS entity_name, false AS deleted FROM (
    SELECT address, category, n, row_number() OVER (PARTITION BY address
      ORDER BY n DESC, category) AS k
    FROM (SELECT address, category, count(*) AS n FROM ({_REPORTS_SQL}) GROUP BY 1, 2))
  GROUP BY 1
  UNION ALL SELECT 'q' || c_custkey, 'scam reports by the public: 0; not verified', true FROM customer""")
def report_labels(spark, sf):
    """Labels of addresses with reports; customers were looked up without any."""
    categories = RP.report_categories(RP.whole_reports(_raw_reports(spark, sf)))
    counts = categories.groupBy("address", "chain").agg(F.sum("n").alias("report_count"))
    clean = X.table(spark, sf, "customer").select(
        F.concat(F.lit("q"), "c_custkey").alias("address"), F.lit(S.BITCOIN).alias("chain"),
        F.lit(0).cast("bigint").alias("report_count"))
    return RP.report_labels(counts.unionByName(clean), categories).select(
        "address", "entity_name", "deleted")


@query("fresh_reports", """
  SELECT event_id FROM events
  WHERE epoch(TIMESTAMP '2024-02-10 00:00:00') - floor(epoch(ts)) < 30 * 86400""")
def fresh_reports(spark, sf):
    rows = X.table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_utc"))
    return RP.fresh_reports(rows, "2024-02-10 00:00:00").select("event_id")
