"""Findings: what every branch of a trace ended in, and the money it holds.

All findings share one shape: (trace_id, type, priority, address, title,
usd_cents, max_total_raw, max_amount, related, detail).  ``detail`` states the facts; the
per-asset totals stay in the long tables of ``flows``.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.amounts import display_units
from fundflow.functions.text import directory_field, entity_match, utc_date
from fundflow.operators import flows
from fundflow.operators.trace import NODE_KEY, TraceResult
from fundflow.session import materialise, shuffled

PER_TYPE = 10
SWEEP_PERCENT, SWEEP_GAP_SECONDS = 90, 72 * 3600
COLUMNS = ["trace_id", "type", "priority", "chain", "address", "title", "usd_cents",
           "max_total_raw", "max_amount", "related", "detail"]


def side_summary(edges: DataFrame, wallet: str, other: str) -> DataFrame:
    """USD, completeness, counterparties, dates and largest single-asset total
    of every wallet on one side of the edges."""
    largest = flows.totals_by_asset(edges, wallet).groupBy(*NODE_KEY).agg(
        F.max("total_raw").alias("max_total_raw"), F.max("amount").alias("max_amount"),
        F.round(F.max("total"), 6).alias("max_total"))
    summary = flows.inflow(edges) if wallet == "to_address" else flows.outflow(edges)
    return summary.join(shuffled(largest), NODE_KEY)


class FindingInputs:
    """Nodes with their terminal value (received forward, sent backward),
    written once because a dozen findings read them."""

    def __init__(self, result: TraceResult):
        self.result = result
        self.backward = result.params.direction == S.BACKWARD
        terminal = self.incoming if not self.backward else side_summary(
            result.edges, "from_address", "to_address")
        usd = F.when(F.col("usd_complete") & (F.col("usd_cents") != 0), F.col("usd_cents"))
        self.terminal = terminal
        self.nodes = materialise(result.nodes.join(
            shuffled(terminal).select(*NODE_KEY, usd.alias("usd_cents"), "usd_complete",
                            F.col("usd_cents").alias("usd_sum"), "max_total_raw", "max_total",
                            "max_amount", "last_ts", "n_counterparties"), NODE_KEY, "left"),
            "finding-nodes", rebalance=False)

    @cached_property
    def incoming(self) -> DataFrame:
        """What every wallet received.  Written when first asked for: backward, only
        a sweep test reads it."""
        return materialise(side_summary(self.result.edges, "to_address", "from_address"),
                           "inflow", rebalance=False)


def _finding(rows: DataFrame, kind: str, priority: int, title: str | Column,
             detail: Column | None = None, related: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    title = F.lit(title) if isinstance(title, str) else title
    return rows.select(
        "trace_id", F.lit(kind).alias("type"), F.lit(priority).alias("priority"), "chain",
        "address", title.alias("title"), "usd_cents", "max_total_raw",
        "max_amount", (none if related is None else related).alias("related"),
        (none if detail is None else detail).alias("detail"))


def named_exchange(inp: FindingInputs, exit_rows: DataFrame,
                   compliance: list[dict] = ()) -> DataFrame:
    ends = exit_rows.select(*NODE_KEY, "entity")
    rows = inp.nodes.join(ends, NODE_KEY)
    position = entity_match(F.col("entity"), list(compliance))
    status = directory_field(position, list(compliance), "status")
    lead = "funds came from custodian " if inp.backward else "custodian reached: "
    return _finding(rows, "named_exchange", 1, F.concat(F.lit(lead), F.col("entity")),
                    detail=status, related=F.col("entity"))


def funds_at_rest(inp: FindingInputs) -> DataFrame:
    """Forward only: the value that reached a wallet has not moved on."""
    rows = inp.nodes.filter(F.lit(not inp.backward) & F.col("at_rest")
                            & F.col("max_total_raw").isNotNull())
    return _finding(rows, "funds_at_rest", 2, "value is still at this wallet",
                    detail=F.concat(F.lit("since "),
                                    utc_date(F.col("last_ts")).cast("string")))


def flagged_wallet_contact(inp: FindingInputs, flags: DataFrame,
                           cases: DataFrame) -> DataFrame:
    named = flags.join(cases.select(F.col("id").alias("case_id"),
                                    F.col("name").alias("case_name")), "case_id", "left") \
        .select("chain", "address", "reason", "case_name")
    rows = inp.nodes.filter((F.col("depth") > 0) & F.col("agency_flagged")).join(
        named, ["chain", "address"], "left")
    return _finding(rows, "flagged_wallet_contact", 2, "wallet flagged by this agency",
                    detail=F.col("reason"), related=F.col("case_name"))


def shared_flag_contact(inp: FindingInputs, labels: DataFrame,
                        per_node: int | None = None) -> DataFrame:
    """One finding per partner flag; ``per_node`` limits a report to the first."""
    order = Window.partitionBy("chain", "address").orderBy("source", "entity_name")
    shared = (labels.filter(F.col("category") == S.SHARED_FLAG)
              .select("chain", "address", "entity_name", "source"))
    if per_node is not None:
        shared = shared.withColumn("_n", F.row_number().over(order)) \
            .filter(F.col("_n") <= per_node).drop("_n")
    rows = inp.nodes.filter((F.col("depth") > 0) & F.col("shared_flagged")).join(
        shared, ["chain", "address"])
    return _finding(rows, "shared_flag_contact", 2, "wallet flagged by a partner agency",
                    detail=F.col("source"), related=F.col("entity_name"))


def sweep_feeders(result: TraceResult, incoming: DataFrame) -> DataFrame:
    """Wallets whose only traced movement sends at least 90 % of what they
    received in that asset, within 72 hours of first receiving, to a busy
    wallet.  Equality joins carry the ratio and the gap as residuals.

    A busy wallet may have any number of feeders; the joins run on the feeder,
    which has exactly one outgoing movement, so its key is never hot."""
    edges = result.edges
    start = result.start.select("trace_id", "chain", F.col("address").alias("from_address"))
    lone = edges.groupBy("trace_id", "chain", "from_address").agg(
        F.count(F.lit(1)).alias("_out")).filter("_out = 1").drop("_out")
    busy = result.nodes.filter(F.col("role") == S.HIGH_ACTIVITY).select(
        "trace_id", "chain", F.col("address").alias("to_address"))
    by_feeder = ["trace_id", "chain", "from_address"]
    received = flows.totals_by_asset(edges, "to_address").select(
        "trace_id", "chain", F.col("address").alias("from_address"), "asset",
        F.col("total_raw").alias("in_raw"), F.col("amount").alias("_in"), F.col("total").alias("_near"))
    first = incoming.select("trace_id", "chain", F.col("address").alias("from_address"),
                            "first_ts")
    gap = F.col("ts") - F.col("first_ts")
    in_time = F.coalesce(F.when((F.col("ts") != 0), gap <= SWEEP_GAP_SECONDS), F.lit(True))
    return (edges.join(shuffled(lone), by_feeder, "left_semi")
            .join(shuffled(start), by_feeder, "left_anti")
            .join(shuffled(busy), ["trace_id", "chain", "to_address"], "left_semi")
            .join(shuffled(received), [*by_feeder, "asset"]).join(shuffled(first), by_feeder)
            .filter((F.col("_near") > 0) & in_time & F.coalesce(
                # beyond the range of exact sums the doubles decide
                F.try_multiply(display_units(F.col("value")), F.lit(100))
                >= F.try_multiply("_in", F.lit(SWEEP_PERCENT)),
                F.col("value") * 100 >= F.col("_near") * SWEEP_PERCENT))
            .select("trace_id", "chain", "from_address", "to_address", "txid", "ts",
                    "asset", "value_raw", "in_raw", "first_ts", "depth"))


def probable_deposit(inp: FindingInputs, feeders: DataFrame) -> DataFrame:
    """One finding per busy wallet, naming its first feeder (earliest hop,
    then earliest time, then transaction)."""
    order = F.struct("depth", F.coalesce("ts", F.lit(2**62)).alias("t"), "txid")
    first = feeders.groupBy("trace_id", "chain", F.col("to_address").alias("address")).agg(
        F.min_by(F.struct("from_address", "txid"), order).alias("f"))
    rows = inp.nodes.join(shuffled(first), NODE_KEY)
    return _finding(rows, "probable_exchange_deposit", 3,
                    "heuristic: deposit address swept to a busy wallet",
                    detail=F.concat(F.lit("sweep tx "), F.col("f.txid")),
                    related=F.col("f.from_address"))


def unidentified_service(inp: FindingInputs, feeders: DataFrame) -> DataFrame:
    rows = inp.nodes.filter(F.col("role") == S.HIGH_ACTIVITY)
    if not inp.backward:
        rows = rows.join(shuffled(feeders.select("trace_id", "chain",
                                                 F.col("to_address").alias("address"))),
                         NODE_KEY, "left_anti")
    return _finding(rows, "unidentified_service", 4, "busy service without a name",
                    detail=F.concat(F.col("activity").cast("string"),
                                    F.lit(" transactions")))


def consolidation_point(inp: FindingInputs) -> DataFrame:
    rows = inp.nodes.filter(
        F.lit(not inp.backward) & (F.col("n_counterparties") >= 2)
        & ~F.col("role").isin(S.EXCHANGE, S.HIGH_ACTIVITY, S.VICTIM))
    return _finding(rows, "consolidation_point", 5, "branches merge here",
                    detail=F.concat(F.col("n_counterparties").cast("string"),
                                    F.lit(" funders")))


def scam_reported_contact(inp: FindingInputs) -> DataFrame:
    rows = inp.nodes.filter((F.col("depth") > 0) & F.col("scam_reported"))
    return _finding(rows, "scam_reported_contact", 5, "wallet on a scam report list",
                    detail=F.col("scam_label.source"),
                    related=F.col("scam_label.entity_name"))


def address_cluster(clusters: DataFrame) -> DataFrame:
    """Clusters (trace_id, cluster_id, ...) with two or more traced wallets."""
    rows = clusters.filter("n_traced >= 2").select(
        "trace_id", "chain", F.col("first_traced").alias("address"), "cluster_id",
        "n_traced", "confidence", F.col("service_label"),
        F.lit(None).cast("bigint").alias("usd_cents"),
        F.lit(None).cast("bigint").alias("max_total_raw"),
        F.lit(None).cast("decimal(38,0)").alias("max_amount"))
    title = F.when(F.col("service_label").isNotNull(),
                   F.lit("traced wallets of one service")) \
        .otherwise(F.lit("traced wallets presumed under one owner"))
    return _finding(rows, "address_cluster", 5, title, detail=F.concat_ws(
        " ", F.col("cluster_id"), F.col("n_traced"), F.col("confidence")),
        related=F.col("service_label"))


def role_contact(inp: FindingInputs, role: str, kind: str, priority: int,
                 label: str) -> DataFrame:
    rows = inp.nodes.filter(F.col("role") == role)
    return _finding(rows, kind, priority, f"{role} wallet in the trace",
                    related=F.col(f"{label}.entity_name"))


def sanctioned_contact(inp: FindingInputs) -> DataFrame:
    return role_contact(inp, S.SANCTIONED, "sanctioned_contact", 6, "sanction_label")


def mixer_contact(inp: FindingInputs) -> DataFrame:
    return role_contact(inp, S.MIXER, "mixer_contact", 7, "mixer_label")


def unresolved_edges(inp: FindingInputs, top: int = PER_TYPE) -> DataFrame:
    """One row per trace: how many wallets were left unexamined, and the
    largest of them (the list holds at most ``top`` names)."""
    rows = inp.nodes.filter((F.col("role") == S.UNEXPANDED)
                            & F.col("max_total_raw").isNotNull())
    size = F.coalesce(F.when(F.col("usd_sum") != 0, F.col("usd_sum") / 100.0),
                      F.col("max_total"))
    order = Window.partitionBy("trace_id").orderBy(F.col("_size").desc(), "address")
    best = (rows.withColumn("_size", size)
            .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top)
            .groupBy("trace_id").agg(F.array_join(F.transform(F.sort_array(
                F.collect_list(F.struct("_n", "address"))), lambda x: x["address"]), ", ")
                .alias("related")))
    count = rows.groupBy("trace_id", "chain").agg(F.count(F.lit(1)).alias("_count"))
    return count.join(shuffled(best), "trace_id").select(
        "trace_id", F.lit("unresolved_edges").alias("type"), F.lit(9).alias("priority"),
        "chain", F.lit(None).cast("string").alias("address"),
        F.lit("trail ends not yet resolved").alias("title"),
        F.lit(None).cast("bigint").alias("usd_cents"),
        F.lit(None).cast("bigint").alias("max_total_raw"),
        F.lit(None).cast("decimal(38,0)").alias("max_amount"), "related",
        F.concat(F.col("_count").cast("string"), F.lit(" wallets")).alias("detail"))


def all_findings(inp: FindingInputs, exit_rows: DataFrame, labels: DataFrame,
                 flags: DataFrame, cases: DataFrame, clusters: DataFrame | None = None,
                 compliance: list[dict] = ()) -> DataFrame:
    feeders = sweep_feeders(inp.result, inp.incoming)
    parts = [named_exchange(inp, exit_rows, compliance), funds_at_rest(inp),
             flagged_wallet_contact(inp, flags, cases), shared_flag_contact(inp, labels)]
    if not inp.backward:
        parts.append(probable_deposit(inp, feeders))
    parts += [unidentified_service(inp, feeders), consolidation_point(inp),
              scam_reported_contact(inp)]
    if clusters is not None:
        parts.append(address_cluster(clusters))
    parts += [sanctioned_contact(inp), mixer_contact(inp), unresolved_edges(inp)]
    return reduce(DataFrame.unionByName, parts)


def rank_findings(findings: DataFrame, per_type: int = PER_TYPE) -> DataFrame:
    """The report list: at most ``per_type`` per trace and type, most value
    first.  ``n_of_type`` tells how many there are, so the rest is counted."""
    kinds = ["trace_id", "type"]
    order = Window.partitionBy(*kinds).orderBy(
        F.col("usd_cents").desc_nulls_last(), F.col("max_amount").desc_nulls_last(),
        F.col("address"), F.col("related"))
    findings = materialise(findings, "findings", rebalance=False)  # read twice below
    counted = findings.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n_of_type"))
    top = findings.withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= per_type)
    return top.join(counted, kinds)


BUCKET_OF_ROLE = {
    S.EXCHANGE: "named custodians", S.HIGH_ACTIVITY: "busy services",
    S.SANCTIONED: "sanctioned wallets", S.MIXER: "mixing services",
    S.CONTRACT: "contracts", S.UNEXPANDED: "unresolved edges"}
AT_REST, NOT_EXAMINED = "at rest", "not examined"


def disposition(inp: FindingInputs) -> DataFrame:
    """Where the traced value ended, per trace and bucket, with the USD share
    in per mille.  Pass-through wallets are left out; dust and skipped branches
    form their own bucket.  A bucket with an unvalued wallet has no share.

    Buckets are few, so the share window sees at most eight rows per trace."""
    bucket = F.when(F.col("at_rest") & F.lit(not inp.backward), AT_REST)
    for role, name in BUCKET_OF_ROLE.items():
        bucket = bucket.when(F.col("role") == role, name)
    ended = inp.nodes.filter(F.col("max_total_raw").isNotNull()) \
        .withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    parts = ended.groupBy("trace_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("usd_complete"), F.col("usd_sum"))), F.lit(0))
        .cast("bigint").alias("usd_cents"),
        F.bool_and("usd_complete").alias("usd_complete"))
    skipped = inp.result.accounting.groupBy("trace_id").agg(
        F.sum(F.col("n_dust") + F.col("n_skipped")).alias("n")).filter("n > 0").select(
        "trace_id", F.lit(NOT_EXAMINED).alias("bucket"), "n",
        F.lit(0).cast("bigint").alias("usd_cents"), F.lit(False).alias("usd_complete"))
    every = parts.unionByName(skipped)
    complete = F.when(F.col("usd_complete"), F.col("usd_cents"))
    grand = F.sum(complete).over(Window.partitionBy("trace_id"))
    return every.withColumn("_grand", grand).withColumn(
        "share_permille", F.when(F.col("_grand") > 0, F.floor(
            (complete * 2000 + F.col("_grand")) / (F.col("_grand") * 2))).cast("bigint")) \
        .drop("_grand")


def disposition_totals(inp: FindingInputs) -> DataFrame:
    """Per-asset totals of every bucket (long form)."""
    bucket = F.when(F.col("at_rest") & F.lit(not inp.backward), AT_REST)
    for role, name in BUCKET_OF_ROLE.items():
        bucket = bucket.when(F.col("role") == role, name)
    wallet = inp.result.terminal_column
    ended = inp.result.nodes.withColumn("bucket", bucket).filter("bucket is not null") \
        .select(*NODE_KEY, "bucket")
    parts = flows.totals_by_asset(inp.result.edges, wallet).join(ended, NODE_KEY) \
        .groupBy("trace_id", "bucket", "asset").agg(F.sum("total_raw").alias("total_raw"))
    acc = inp.result.accounting.groupBy("trace_id", "asset").agg(
        F.sum(F.col("dust_raw") + F.col("skipped_raw")).alias("total_raw"),
        F.sum(F.col("n_dust") + F.col("n_skipped")).alias("_n")).filter("_n > 0")
    return parts.unionByName(acc.select(
        "trace_id", F.lit(NOT_EXAMINED).alias("bucket"), "asset", "total_raw"))
