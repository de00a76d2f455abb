"""Bulk screening of address lists against labels, flags, watches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.text import conf_rank, detect, norm_addr, pipe_join, strip
from fundflow.operators.classify import KEY, merge_flags

TRACEABLE_CHAINS = (S.BITCOIN, S.ETHEREUM, S.TRON)
REPORT_SOURCE = "chainabuse"


def clean_inputs(raw: DataFrame, hint: str | None = None) -> DataFrame:
    """Pasted values (``ord``, ``raw``) trimmed, recognised, normalised; one row
    per (chain, address), the first in input order.  A value that is pasted
    very often is reduced by the partial aggregate before any shuffle."""
    value = strip(F.col("raw"))
    rows = raw.filter(F.coalesce(value, F.lit("")) != "").select(
        "ord", value.alias("input"), detect(value).alias("d"))
    chain = F.lit(hint) if hint and hint != "auto" else F.col("d.chain")
    rows = rows.select("ord", "input", F.col("d.kind").alias("kind"), chain.alias("chain"),
                       F.col("d.traceable").alias("_traceable"))
    address = F.when((F.col("kind") == "address") & F.col("chain").isNotNull(),
                     norm_addr(F.col("input"), F.col("chain"))).otherwise(F.col("input"))
    rows = rows.withColumn("address", address).withColumn(
        "traceable", F.col("_traceable")
        & F.coalesce(F.col("chain").isin(*TRACEABLE_CHAINS), F.lit(False)))
    first = F.min_by(F.struct("ord", "input", "kind", "traceable"), "ord")
    return rows.groupBy("chain", "address").agg(first.alias("f")).select(
        "chain", "address", "f.*")


def label_profile(labels: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Per address: best attribution, partner flags, scam lists, all labels.
    Lists hold at most one entry per label source."""
    rows = merge_flags(labels, flags)
    rank = F.struct(conf_rank(F.col("confidence")).alias("r"), "source", "entity_name")
    named = F.col("category").isin(*S.ATTRIBUTION)
    scam = (F.col("category") == S.SCAM_REPORT) & (F.col("source") != REPORT_SOURCE)

    def items(test, value):
        pairs = F.sort_array(F.collect_list(F.when(test, F.struct(rank, value.alias("v")))))
        return F.transform(pairs, lambda x: x["v"])
    text = F.concat("entity_name", F.lit(" ["), "source", F.lit("/"), "confidence",
                    F.lit("]"))
    return rows.groupBy(*KEY).agg(
        F.min_by(F.struct("entity_name", "confidence", "category"), F.when(named, rank))
        .alias("_a"), F.max(named).alias("_named"),
        items(F.lit(True), text).alias("labels"),
        items(F.col("category") == S.SHARED_FLAG, F.col("entity_name")).alias("shared_flags"),
        items(scam, F.col("source")).alias("scam_lists"),
        F.max(F.col("category") == S.EXCHANGE).alias("has_exchange")).select(
        *KEY, F.when(F.col("_named"), F.col("_a.entity_name")).alias("attribution"),
        F.when(F.col("_named"), F.col("_a.confidence")).alias("attribution_confidence"),
        F.when(F.col("_named"), F.col("_a.category")).alias("attribution_category"),
        "labels", "shared_flags", "scam_lists", "has_exchange")


def screen(inputs: DataFrame, labels: DataFrame, flags: DataFrame, watches: DataFrame,
           reports: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """One row per cleaned input.  Values that are no address stay in the list
    with nothing looked up.  No limit on the list length."""
    known = (F.col("kind") == "address") & F.col("chain").isNotNull()
    addresses = inputs.filter(known)
    rest = inputs.filter(~known)
    out = addresses.join(label_profile(labels, flags), KEY, "left") \
        .join(flags.select(*KEY, F.col("reason").alias("agency_flag"),
                           F.lit(True).alias("_flagged")), KEY, "left") \
        .join(watches.select(*KEY, F.lit(True).alias("_watched")), KEY, "left") \
        .join(reports.select(*KEY, F.col("report_count")), KEY, "left")
    if activity is not None:
        out = out.join(activity.select(*KEY, "tx_count", "balance", "unit"), KEY, "left")
    out = out.withColumns({
        "flagged": F.coalesce(F.col("_flagged"), F.lit(False)),
        "watched": F.coalesce(F.col("_watched"), F.lit(False))}).drop(
        "_flagged", "_watched", "has_exchange")
    return out.unionByName(rest.withColumns(
        {"flagged": F.lit(False), "watched": F.lit(False)}), allowMissingColumns=True)


def screen_summary(rows: DataFrame) -> DataFrame:
    def some(column):
        return F.coalesce(F.size(column), F.lit(0)) > 0
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("attribution", F.lit("")) != "").alias("attributed"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(some("shared_flags")).alias("shared_flagged"),
        F.count_if(some("scam_lists")).alias("scam_listed"),
        F.count_if(F.coalesce("report_count", F.lit(0)) > 0).alias("report_hits"),
        F.count_if(F.col("kind") != "address").alias("unrecognised"))


CSV_COLUMNS = ("input", "address", "chain", "attribution", "attribution_confidence",
               "labels", "agency_flag", "shared_flags", "scam_lists",
               "chainabuse_reports", "watched", "tx_count", "balance", "unit", "note")


def screen_csv(rows: DataFrame) -> DataFrame:
    """The fifteen text columns of the screening file; write with
    ``.write.option('header', True).csv(path)``."""
    have = set(rows.columns)

    def text(column):
        return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in have \
            else F.lit("")

    def joined(column):
        return F.coalesce(pipe_join(F.col(column)), F.lit(""))
    note = F.when(F.col("kind") == "address", F.lit("")).otherwise(
        F.concat(F.lit("not an address: "), F.col("kind")))
    return rows.select(
        "input", "address", text("chain").alias("chain"),
        text("attribution").alias("attribution"),
        text("attribution_confidence").alias("attribution_confidence"),
        joined("labels").alias("labels"), text("agency_flag").alias("agency_flag"),
        joined("shared_flags").alias("shared_flags"),
        joined("scam_lists").alias("scam_lists"),
        text("report_count").alias("chainabuse_reports"),
        F.when(F.col("watched"), "yes").otherwise("").alias("watched"),
        text("tx_count").alias("tx_count"), text("balance").alias("balance"),
        text("unit").alias("unit"), note.alias("note"))


NEXT_STEPS = {"custodian": "request the account records from the custodian",
              "at_rest": "watch the wallet and ask for a freeze",
              "look_up": "look up public reports",
              "continue": "trace on from this wallet"}


def wallet_facts(addresses: DataFrame, labels: DataFrame, flags: DataFrame,
                 watches: DataFrame, reports: DataFrame,
                 nodes: DataFrame | None = None, counts: DataFrame | None = None,
                 activity: DataFrame | None = None) -> DataFrame:
    """Everything known about each wallet and the next step it suggests, in the
    order custodian, value at rest, no report lookup yet, otherwise go on.
    ``nodes`` and ``counts`` add the view of one trace."""
    out = addresses.withColumn("address", norm_addr(F.col("address"), F.col("chain"))) \
        .join(label_profile(labels, flags), KEY, "left") \
        .join(flags.select(*KEY, F.col("reason").alias("agency_flag")), KEY, "left") \
        .join(watches.select(*KEY, F.lit(True).alias("watched")), KEY, "left") \
        .join(reports.select(*KEY, "report_count"), KEY, "left")
    if activity is not None:
        out = out.join(activity.select(*KEY, "activity"), KEY, "left")
    rest = F.lit(False)
    if nodes is not None:
        out = out.join(nodes.select("trace_id", *KEY, "role", "depth", "at_rest"), KEY,
                       "left")
        rest = F.coalesce(F.col("at_rest"), F.lit(False))
        if counts is not None:
            out = out.join(counts, ["trace_id", *KEY], "left")
    step = F.when(F.coalesce("has_exchange", F.lit(False)), "custodian") \
        .when(rest, "at_rest").when(F.col("report_count").isNull(), "look_up") \
        .otherwise("continue")
    return out.withColumn("watched", F.coalesce("watched", F.lit(False))) \
        .withColumn("next_step", step)
