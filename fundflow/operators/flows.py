"""Aggregates over traced movements: inflow, outflow, pairs, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import wide
from fundflow.functions.amounts import display_units
from fundflow.functions.skew import number_within
from fundflow.functions.text import utc_date
from fundflow.session import shuffled


def _summary(edges: DataFrame, wallet: str, other: str) -> DataFrame:
    dated = F.when(F.col("ts") != 0, F.col("ts"))
    return edges.groupBy("trace_id", "chain", F.col(wallet).alias("address")).agg(
        F.sum("usd_cents").alias("usd_cents"),
        F.bool_and(F.col("usd_cents").isNotNull()).alias("usd_complete"),
        F.count_distinct(other).alias("n_counterparties"),
        F.count(F.lit(1)).alias("n_movements"),
        F.min(dated).alias("first_ts"), F.max(dated).alias("last_ts"))


def inflow(edges: DataFrame) -> DataFrame:
    """Per trace and wallet: USD, whether every movement is valued, distinct
    funders, first and last time.  A time of zero counts as unknown."""
    return _summary(edges, "to_address", "from_address")


def outflow(edges: DataFrame) -> DataFrame:
    return _summary(edges, "from_address", "to_address")


def totals_by_asset(edges: DataFrame, wallet: str) -> DataFrame:
    """Long form of the per-asset totals of a wallet side."""
    return edges.groupBy("trace_id", "chain", F.col(wallet).alias("address"),
                         "asset").agg(F.sum("value").alias("total"),
                                      F.try_sum("value_raw").alias("total_raw"),
                                      F.try_sum(display_units(F.col("value"))).alias("amount"),
                                      F.count(F.lit(1)).alias("n_movements"))


def exact_totals(moves: DataFrame, *keys: str) -> DataFrame:
    """Exact totals per group as digits, from movements with ``value_limbs``;
    amounts of any width count, none is left out of a sum."""
    return moves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_movements"), F.count("value_limbs").alias("n_exact"),
        wide.to_digits(wide.total(F.col("value_limbs"))).alias("total"),
        wide.to_digits(F.max("value_limbs")).alias("largest"))


def pair_flows(edges: DataFrame) -> DataFrame:
    """One flow per pair of wallets and asset.  The transactions of a flow stay
    rows of ``edges``; a list per pair would be unbounded."""
    return edges.groupBy("trace_id", "chain", "from_address", "to_address", "asset").agg(
        F.sum("value").alias("value"), F.try_sum("value_raw").alias("value_raw"),
        F.sum("usd_cents").alias("usd_cents"),
        F.bool_and(F.col("usd_cents").isNotNull()).alias("usd_complete"),
        F.count(F.lit(1)).alias("n_movements"))


def wallet_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A trace's view of each of its wallets, per asset (long form): value in
    and out, and the share of the outflow that went to a custodian."""
    ends = nodes.filter(F.col("role") == S.EXCHANGE).select(
        "trace_id", "chain", F.col("address").alias("to_address"),
        F.lit(True).alias("_ex"))
    side = ["trace_id", "chain", "address", "asset"]
    came = edges.groupBy("trace_id", "chain", F.col("to_address").alias("address"),
                         "asset").agg(F.try_sum("value_raw").alias("in_raw"))
    went = edges.join(shuffled(ends), ["trace_id", "chain", "to_address"], "left").groupBy(
        "trace_id", "chain", F.col("from_address").alias("address"), "asset").agg(
        F.try_sum("value_raw").alias("out_raw"),
        F.sum(F.when(F.col("_ex"), F.col("value_raw"))).alias("labelled_raw"))
    share = F.when(F.col("out_raw") > 0, F.floor(
        (F.col("labelled_raw") * 200 + F.col("out_raw")) / (F.col("out_raw") * 2)))
    return came.join(went, side, "full").withColumn(
        "labelled_share_pct", share.cast("bigint"))


def wallet_counts(edges: DataFrame) -> DataFrame:
    """Distinct senders and receivers of each wallet."""
    came = edges.groupBy("trace_id", "chain", F.col("to_address").alias("address")).agg(
        F.count_distinct("from_address").alias("sender_count"))
    went = edges.groupBy("trace_id", "chain", F.col("from_address").alias("address")).agg(
        F.count_distinct("to_address").alias("receiver_count"))
    return came.join(went, ["trace_id", "chain", "address"], "full").na.fill(
        0, ["sender_count", "receiver_count"])


TARGET = ["trace_id", "chain", "target"]


def freeze_schedule(edges: DataFrame, targets: DataFrame,
                    wallet: str = "to_address") -> DataFrame:
    """Numbered transaction schedule of every target wallet, oldest first.  The
    day buckets keep a busy wallet spread over many tasks."""
    rows = edges.join(shuffled(targets.select("trace_id", "chain", F.col("address").alias(wallet))),
                      ["trace_id", "chain", wallet], "left_semi") \
        .withColumn("target", F.col(wallet)) \
        .withColumn("_when", F.coalesce("ts", F.lit(0))) \
        .withColumn("_day", utc_date(F.col("_when")))
    numbered = number_within(rows, TARGET, "_day",
                             ["_when", "txid", "from_address", "asset", "value_raw"])
    return numbered.select(*TARGET, "seq", "txid", "ts", "from_address", "to_address",
                           "asset", "value", "value_raw", "usd_cents")


def freeze_totals(schedule: DataFrame) -> DataFrame:
    """Per-asset totals and the TOTAL row of a schedule.  USD is null unless
    every movement is valued.  The date span ignores unknown times."""
    dated = F.when(F.col("ts") != 0, F.col("ts"))
    out = schedule.rollup("trace_id", "chain", "target", "asset").agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("n_movements"),
        F.try_sum("value_raw").alias("total_raw"),
        F.when(F.bool_and(F.col("usd_cents").isNotNull()), F.sum("usd_cents"))
        .alias("usd_cents"), F.min(dated).alias("first_ts"), F.max(dated).alias("last_ts"))
    return out.filter("_level <= 1").withColumn(
        "asset", F.when(F.col("_level") == 1, "TOTAL").otherwise(F.col("asset"))) \
        .withColumn("total_raw", F.when(F.col("_level") == 0, F.col("total_raw"))) \
        .drop("_level")


def pick_issuer(edges: DataFrame, wallet: str = "to_address") -> DataFrame:
    """The freezable stablecoin with the largest total at each wallet."""
    totals = totals_by_asset(edges.filter(F.col("asset").isin(*S.STABLECOIN_ISSUERS)),
                             wallet)
    best = F.max_by(F.struct("asset", "total_raw"), F.struct("total", F.col("asset")))
    return totals.groupBy("trace_id", "chain", "address").agg(best.alias("b")).select(
        "trace_id", "chain", "address", F.col("b.asset").alias("issuer_asset"),
        F.col("b.total_raw").alias("issuer_total_raw"))
