"""Tables an investigator takes from a trace: routes, payments, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.text import directory_field, entity_match, utc_date
from fundflow.operators import exits as E
from fundflow.operators import flows
from fundflow.operators.trace import NODE_KEY, TraceResult
from fundflow.session import shuffled

PAYMENTS, DIGEST_EDGES, DIGEST_NODES, DIGEST_LABELS = 20, 250, 150, 3


# ---------------------------------------------------------------- freezing

def freeze_routes(result: TraceResult, custodians: list[dict] = (),
                  mode: str = "auto") -> DataFrame:
    """Whom to ask for a freeze, per touched wallet: the custodian of a labelled
    one, else the issuer of its largest freezable stablecoin, else nobody.
    ``mode='issuer'`` forces the issuer.  A backward trace uses the outgoing
    movements of wallets that received nothing."""
    touched = flows.totals_by_asset(result.edges, "to_address")
    issuer = flows.pick_issuer(result.edges)
    if result.params.direction == S.BACKWARD:
        sources = flows.totals_by_asset(result.edges, "from_address").join(
            shuffled(touched.select(*NODE_KEY)), NODE_KEY, "left_anti")
        issuer = issuer.unionByName(flows.pick_issuer(
            result.edges, "from_address").join(sources.select(*NODE_KEY), NODE_KEY,
                                               "left_semi"))
        touched = touched.unionByName(sources)
    rows = touched.select(*NODE_KEY).distinct().join(
        shuffled(result.nodes.select(*NODE_KEY, "role", F.col("exchange_label.entity_name")
                                     .alias("custodian"))), NODE_KEY) \
        .join(shuffled(issuer), NODE_KEY, "left")
    has_issuer = F.col("issuer_asset").isNotNull()
    to_issuer = has_issuer if mode == "issuer" else has_issuer & F.col("custodian").isNull()
    names = F.when(F.col("issuer_asset") == "USDT", S.STABLECOIN_ISSUERS["USDT"]) \
        .when(F.col("issuer_asset") == "USDC", S.STABLECOIN_ISSUERS["USDC"])
    route = F.when(to_issuer, "issuer")
    if mode != "issuer":
        route = route.when(F.col("custodian").isNotNull(), "custodian")
    rows = rows.withColumn("route", route.otherwise("unserved"))
    entity = F.when(F.col("route") == "issuer", names) \
        .when(F.col("route") == "custodian", F.col("custodian"))
    rows = rows.withColumn("entity", entity)
    place = entity_match(F.col("entity"), list(custodians))
    return rows.select(*NODE_KEY, "role", "route", "entity", "issuer_asset",
                       "issuer_total_raw",
                       directory_field(place, list(custodians), "portal").alias("portal"))


def victim_payments(result: TraceResult, per_trace: int | None = PAYMENTS) -> DataFrame:
    """Payments that left the start wallet: first-hop movements, one per
    (transaction, receiver, asset), oldest first, with the receiving platform.
    ``n_payments`` counts all of them, also beyond the listed ones."""
    start = result.start.select("trace_id", "chain", F.col("address").alias("from_address"))
    first = result.edges.filter("depth = 1").join(
        shuffled(start), ["trace_id", "chain", "from_address"], "left_semi")
    key = ["trace_id", "chain", "from_address", "txid", "to_address", "asset"]
    rest = ["ts", "value", "value_raw", "usd_cents"]
    once = first.groupBy(*key).agg(F.max_by(F.struct(*rest), "value_raw").alias("p")) \
        .select(*key, "p.*")
    n = once.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_payments"))
    if per_trace is not None:
        order = Window.partitionBy("trace_id").orderBy(
            F.col("ts").asc_nulls_last(), "txid", "to_address", "asset")
        once = once.withColumn("seq", F.row_number().over(order)) \
            .filter(F.col("seq") <= per_trace)
    platform = result.nodes.filter("is_exchange").select(
        "trace_id", "chain", F.col("address").alias("to_address"),
        F.col("exchange_label.entity_name").alias("recipient_platform"))
    return once.join(shuffled(platform), ["trace_id", "chain", "to_address"], "left") \
        .join(shuffled(n), "trace_id").withColumn("date", utc_date(F.col("ts")))


def request_lists(result: TraceResult) -> DataFrame:
    """What to ask a custodian for, in long form: (exit, kind, item) with the
    distinct assets, transactions and dates of its funding."""
    rows = E.exit_edges(result).select(
        *NODE_KEY, F.explode(F.array(
            F.struct(F.lit("asset").alias("kind"), F.col("asset").alias("item")),
            F.struct(F.lit("txid").alias("kind"), F.col("txid").alias("item")),
            F.struct(F.lit("date").alias("kind"), F.when(
                F.coalesce("ts", F.lit(0)) != 0,
                utc_date(F.col("ts")).cast("string")).alias("item")))).alias("x"))
    return rows.select(*NODE_KEY, "x.kind", "x.item").filter("item is not null").distinct()


# ---------------------------------------------------------------- tables

def with_notes(nodes: DataFrame, annotations: DataFrame, case_id=None) -> DataFrame:
    notes = annotations if case_id is None else annotations.filter(
        F.col("case_id") == case_id)
    return nodes.join(notes.select("chain", "address", "note"), ["chain", "address"], "left")


def address_table(result: TraceResult, annotations: DataFrame | None = None,
                  cluster_ids: DataFrame | None = None) -> DataFrame:
    """Wallets by hop and address, with markers for flags and clusters."""
    rows = result.nodes
    if cluster_ids is not None:
        rows = rows.join(cluster_ids.select(*NODE_KEY, "cluster_id"), NODE_KEY, "left")
    else:
        rows = rows.withColumn("cluster_id", F.lit(None).cast("string"))
    rows = with_notes(rows, annotations) if annotations is not None else \
        rows.withColumn("note", F.lit(None).cast("string"))
    marks = F.concat_ws(" ", F.when(F.col("agency_flagged"), "[agency flag]"),
                        F.when(F.col("shared_flagged"), "[partner flag]"),
                        F.when(F.col("cluster_id").isNotNull(), F.concat(
                            F.lit("[cluster "), "cluster_id", F.lit("]"))))
    return rows.select("trace_id", "depth", "address", "role", marks.alias("markers"),
                       "basis", "note").orderBy("trace_id", "depth", "address")


def tx_table(result: TraceResult) -> DataFrame:
    return result.edges.select(
        "trace_id", "depth", "txid", "ts", "from_address", "to_address", "asset", "value",
        "usd_cents").orderBy("trace_id", "depth", "txid")


def digest_edges(result: TraceResult, top: int = DIGEST_EDGES) -> DataFrame:
    """Largest movements of each trace, by USD if known, else by amount."""
    usd = F.col("usd_cents") / 100.0
    size = F.coalesce(F.when(usd != 0, usd), F.col("value"))
    order = Window.partitionBy("trace_id").orderBy(
        size.desc(), "txid", "from_address", "to_address", "asset")
    return result.edges.withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= top).select(
        "trace_id", "rank", "txid", "from_address", "to_address", "asset", "value",
        "value_raw", "usd_cents", "ts")


def digest_nodes(result: TraceResult, labels: DataFrame | None = None,
                 top: int = DIGEST_NODES, per_node: int = DIGEST_LABELS) -> DataFrame:
    """First wallets by hop and address, each with its three best labels."""
    order = Window.partitionBy("trace_id").orderBy("depth", "address")
    rows = result.nodes.withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= top)
    out = rows.select("trace_id", "rank", "chain", "address", "role", "depth", "flags",
                      "basis")
    if labels is not None:
        from fundflow.operators.screening import label_profile
        best = label_profile(labels).select(
            "chain", "address", F.slice("labels", 1, per_node).alias("labels"))
        out = out.join(best, ["chain", "address"], "left")
    return out


def digest_truncation(result: TraceResult, edges: int = DIGEST_EDGES,
                      nodes: int = DIGEST_NODES) -> DataFrame:
    n_edges = result.edges.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_edges"))
    n_nodes = result.nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n_nodes.join(n_edges, "trace_id", "left").na.fill(0, ["n_edges"]).withColumn(
        "edges_left_out", F.greatest(F.col("n_edges") - edges, F.lit(0))).withColumn(
        "nodes_left_out", F.greatest(F.col("n_nodes") - nodes, F.lit(0)))


def digest_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row, for the text or JSON-lines writer."""
    return rows.select("trace_id", F.to_json(F.struct(*rows.columns)).alias("json"))


# ---------------------------------------------------------------- cases

def latest_trace(cases: DataFrame, traces: DataFrame) -> DataFrame:
    """Each case with its newest finished trace, if any."""
    done = traces.filter("status = 'finished'").groupBy("case_id").agg(
        F.max("trace_id").alias("trace_id"))
    return cases.join(done, cases["id"] == done["case_id"], "left").drop("case_id")


def trace_history(traces: DataFrame, nodes: DataFrame, exit_rows: DataFrame,
                  findings: DataFrame) -> DataFrame:
    """Traces of every case, newest first, with their result counts."""
    def counted(df, name):
        return shuffled(df.groupBy("trace_id").agg(F.count(F.lit(1)).alias(name)))
    return (traces.join(counted(exit_rows, "exits"), "trace_id", "left")
            .join(counted(findings, "findings"), "trace_id", "left")
            .join(counted(nodes, "addresses"), "trace_id", "left")
            .na.fill(0, ["exits", "findings", "addresses"])
            .orderBy(F.col("case_id"), F.col("trace_id").desc()))


def source_usage(custody: DataFrame) -> DataFrame:
    """Requests, cache hits, misses and failures per data source."""
    live = ~F.col("from_cache")
    status = F.col("http_status")
    return custody.groupBy("source").agg(
        F.count_if(live).alias("requests"), F.count_if("from_cache").alias("cache_hits"),
        F.count_if(live & (status == 404)).alias("not_found"),
        F.count_if(live & (status.isNull() | ((status >= 400) & (status != 404))))
        .alias("failures"), F.max("fetched_utc").alias("last_activity_utc"))
