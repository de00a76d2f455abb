"""Custodial exits of a trace: totals, ranking, and the path to each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.amounts import display_units
from fundflow.functions.text import amount_text, directory_field, entity_match, iso_text
from fundflow.operators.directory import first_matches
from fundflow.operators.trace import NODE_KEY, TraceResult
from fundflow.session import materialise, materialise_observed, shuffled


def exit_edges(result: TraceResult) -> DataFrame:
    """Edges that land on (or, backward, come from) a labelled custodian.
    Taken when the edge is drawn, so exits at the depth limit count."""
    custodians = result.nodes.filter("is_exchange").select(*NODE_KEY)
    edges = result.edges.drop("address").withColumnRenamed("next_address", "address")
    return edges.join(shuffled(custodians), NODE_KEY, "left_semi")


def exit_totals(result: TraceResult) -> DataFrame:
    """Long form: one row per exit and asset."""
    return exit_edges(result).groupBy(*NODE_KEY, "asset").agg(
        F.count(F.lit(1)).alias("n_movements"), F.sum("value").alias("total"),
        F.try_sum("value_raw").alias("total_raw"),
        F.try_sum(display_units(F.col("value"))).alias("amount"))


def exits(result: TraceResult, compliance: list[dict] | DataFrame = (),
          entity: str = "label") -> DataFrame:
    """One row per exit.  ``entity='label'`` names the best label of any
    category (so a sanctioned custodian is named by the sanction list);
    ``'exchange_label'`` always names the custodian."""
    column = "label" if entity == "label" else "exchange_label"
    totals = exit_totals(result).groupBy(*NODE_KEY).agg(
        F.max("total").alias("max_total"), F.max("total_raw").alias("max_total_raw"),
        F.max("amount").alias("max_amount"),
        F.sum("n_movements").alias("n_movements"))
    node = result.nodes.select(
        *NODE_KEY, "depth", "role", F.col(f"{column}.entity_name").alias("entity"),
        F.col(f"{column}.confidence").alias("confidence"),
        F.col(f"{column}.source").alias("source"))
    out = totals.join(shuffled(node), NODE_KEY)
    if isinstance(compliance, DataFrame):  # a directory of any size
        status = first_matches(out, "entity", compliance.select(
            "ord", F.col("entity").alias("_listed"), F.coalesce("status", F.lit("")).alias("compliance")),
            "_listed").select("entity", "compliance")
        return out.join(status, "entity", "left")
    position = entity_match(F.col("entity"), list(compliance))
    return out.withColumn("compliance",
                          directory_field(position, list(compliance), "status"))


def exit_usd(result: TraceResult) -> DataFrame:
    """USD of the valued funding of each exit; null when none is valued."""
    return exit_edges(result).groupBy(*NODE_KEY).agg(
        F.sum("usd_cents").alias("usd_cents"),
        F.count("usd_cents").alias("n_valued"))


def rank_exits(exit_rows: DataFrame) -> DataFrame:
    """Largest display amount of a single asset first, then fewest hops."""
    return exit_rows.orderBy("trace_id", F.col("max_amount").desc_nulls_last(),
                             "depth", "address")


def parents(result: TraceResult) -> DataFrame:
    """For every reached wallet the edge of a shortest path that carries most
    value (USD if known).  Edges into a wallet at its own depth come from the
    level before, so one partial aggregate finds it."""
    edges = result.edges
    usd = F.col("usd_cents") / 100.0 if "usd_cents" in edges.columns else F.lit(None)
    order = F.struct(
        F.coalesce(F.when(usd != 0, usd), F.col("value")).alias("v"),
        F.coalesce("ts", F.lit(-1)).alias("ts"), "txid",
        F.col("address").alias("parent"))
    keep = ["txid", "ts", "from_address", "to_address", "asset", "value", "value_raw"]
    keep += [c for c in ("usd_cents",) if c in edges.columns]
    first = result.nodes.select("trace_id", "chain",
                                F.col("address").alias("next_address"), "depth")
    step = F.struct(F.col("address").alias("parent"), *keep)
    return (edges.join(first, ["trace_id", "chain", "next_address", "depth"])
            .groupBy("trace_id", "chain", F.col("next_address").alias("address"))
            .agg(F.max_by(step, order).alias("step")))


def exit_paths(result: TraceResult, ends: DataFrame) -> DataFrame:
    """Hops from the start wallet to every end (trace_id, chain, address), in
    the order the money moved.

    Pointers double: with every round the known stretch of all paths and the
    reach of every wallet's pointer grow twofold, so 25 hops take five rounds.
    """
    tree = materialise(parents(result), "parents")
    depth = result.nodes.select(*NODE_KEY, F.col("depth").alias("n_hops"))
    walk = ends.select(*NODE_KEY).distinct().join(depth, NODE_KEY).filter("n_hops > 0") \
        .withColumn("end_address", F.col("address")).withColumn("back", F.lit(0))
    walk, seen = materialise_observed(walk, "walk", F.max("n_hops").alias("longest"))
    jump = tree.select(*NODE_KEY, F.col("step.parent").alias("to"))
    reach, longest = 1, seen["longest"] or 0
    while reach < longest:
        further = walk.join(jump, NODE_KEY).select(
            "trace_id", "chain", F.col("to").alias("address"), "n_hops", "end_address",
            (F.col("back") + reach).alias("back")).filter(F.col("back") < F.col("n_hops"))
        walk = materialise(walk.unionByName(further), "walk", rebalance=False)
        reach *= 2
        if reach < longest:
            onward = jump.select("trace_id", "chain", F.col("address").alias("to"),
                                 F.col("to").alias("_to"))
            jump = materialise(jump.join(onward, ["trace_id", "chain", "to"])
                               .drop("to").withColumnRenamed("_to", "to"), "jump", rebalance=False)
    backward = result.params.direction == S.BACKWARD
    hop = F.col("back") + 1 if backward else F.col("n_hops") - F.col("back")
    return walk.join(tree, NODE_KEY).select("trace_id", "chain", "end_address", hop.alias("hop"),
                                            "n_hops", "step.*").drop("parent")


def traceroute(paths: DataFrame) -> DataFrame:
    """One line of text per hop, ready for the text writer."""
    usd = F.lit("")
    if "usd_cents" in paths.columns:
        usd = F.coalesce(F.concat(F.lit(" (~$"), F.format_number(
            F.col("usd_cents") / 100.0, 2), F.lit(")")), F.lit(""))
    line = F.concat(
        F.lit("Hop "), F.col("hop"), F.lit(" of "), F.col("n_hops"), F.lit(": "),
        F.col("from_address"), F.lit(" -> "), F.col("to_address"), F.lit("  "),
        amount_text(F.col("value")), F.lit(" "), F.col("asset"), usd,
        F.lit("  tx "), F.col("txid"), F.lit("  "), iso_text(F.col("ts")))
    return paths.select("trace_id", "chain", "end_address", "hop", line.alias("line"))
