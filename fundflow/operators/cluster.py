"""Address clusters by common inputs, over the whole ledger at once.

Inputs are the long tables ``inputs`` (txid, address; distinct) and ``outputs``
(txid, value; one row per output).  A heuristic: excluded transactions are
counted and every cluster keeps its evidence and confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import order as N
from fundflow.functions.skew import join_group_stats
from fundflow.session import materialise_observed, shuffled

COINJOIN_INPUTS, COINJOIN_EQUAL_OUTPUTS = 5, 3
WIDE_INPUTS = 12
LISTED_ADDRESSES, LISTED_EVIDENCE = 60, 25
MAX_ROUNDS = 60


def coinjoin_like(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Transactions with many inputs and several equal outputs."""
    many = inputs.filter("address is not null").groupBy("txid").agg(
        F.count_distinct("address").alias("n_inputs")) \
        .filter(F.col("n_inputs") >= COINJOIN_INPUTS)
    equal = outputs.groupBy("txid", "value").agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy("txid").agg(F.max("_n").alias("n_equal")) \
        .filter(F.col("n_equal") >= COINJOIN_EQUAL_OUTPUTS)
    return many.join(shuffled(equal), "txid")


def linking_inputs(inputs: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Distinct inputs of transactions that may link their inputs."""
    rows = inputs.filter("address is not null").select("txid", "address").distinct()
    if outputs is not None:
        rows = rows.join(shuffled(coinjoin_like(inputs, outputs).select("txid")), "txid", "left_anti")
    return rows


def cospend_tx(linking: DataFrame) -> DataFrame:
    """Per linking transaction: width and smallest input address."""
    return linking.groupBy("txid").agg(
        F.count(F.lit(1)).alias("n_inputs"), F.min("address").alias("first")) \
        .filter("n_inputs >= 2")


def cospend_edges(linking: DataFrame) -> DataFrame:
    """A star per transaction from its smallest address: n - 1 edges, not all
    pairs.  The inputs are dealt by transaction once, for both sides of the join."""
    linking = linking.filter("txid is not null and address is not null").repartition("txid")
    tx = cospend_tx(linking).select("txid", "first")
    return linking.join(shuffled(tx), "txid").filter("address <> first").select(
        F.col("first").alias("a"), F.col("address").alias("b")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges written once, with their number and a checksum."""
    out, seen = materialise_observed(
        edges, "components", F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    return out, (seen["n"], seen["sum"])


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hook every larger neighbour of a node to the smallest one around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("n")) \
        .withColumn("_m", F.least("_m", "u"))
    return join_group_stats(both, least, ["u"], 2 * n).filter("v > u").select(
        F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hook the smaller neighbours of a node, and itself, to their minimum."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("n"))
    rest = join_group_stats(down, least, ["u"], n).filter("v <> _m").select(
        F.col("v").alias("u"), F.col("_m").alias("v"))
    return rest.unionByName(least.select("u", F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(address, component) of every address in ``edges`` (a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014) shrink
    any graph to one star per component in about log(n) rounds.  Only minima
    are aggregated, and they are handed back to hot centres by broadcast, so a
    component holding a third of all addresses does not gather in one task.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"),
                                          F.least("a", "b").alias("v")).distinct()
    current, state = _written(pairs)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        large, (n_large, _) = _written(_large_star(current, state[0]))
        before = state
        current, state = _written(_small_star(large, n_large))
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("address")).distinct()
    return current.select(F.col("u").alias("address"), F.col("v").alias("component")) \
        .unionByName(roots.withColumn("component", F.col("address")))


def cluster_rollup(members: DataFrame, linking: DataFrame) -> DataFrame:
    """Per component: size, evidence count, confidence.  Each transaction lies
    in one component, so counting transactions needs no distinct."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    evidence = evidence_tx(members, linking).groupBy("component").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.max(F.col("n_inputs") >= WIDE_INPUTS).alias("_wide"))
    return size.join(shuffled(evidence), "component").withColumn(
        "confidence", F.when(F.col("_wide"), "low").otherwise("medium")).drop("_wide")


def evidence_tx(members: DataFrame, linking: DataFrame) -> DataFrame:
    """(component, txid, n_inputs) for every linking transaction."""
    return cospend_tx(linking).withColumnRenamed("first", "address").join(
        shuffled(members), "address").select("component", "txid", "n_inputs")


def listed(rows: DataFrame, item: str, limit: int) -> DataFrame:
    """The first ``limit`` items of each component as one sorted array; Spark
    limits per component before the shuffle."""
    order = Window.partitionBy("component").orderBy(item)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit) \
        .groupBy("component").agg(F.sort_array(F.collect_list(item)).alias(f"{item}s"))


def service_label(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Custodian or mixer label of the first traced member (by address) that
    has one; the best-confidence label of that address."""
    from fundflow.operators.classify import address_facts
    named = labels.filter(F.col("category").isin(S.EXCHANGE, S.MIXER))
    best = address_facts(named).select("chain", "address",
                                       F.col("label.entity_name").alias("entity_name"))
    return shuffled(nodes.select("trace_id", "chain", "address")).join(shuffled(members), "address") \
        .join(shuffled(best), ["chain", "address"]).groupBy("trace_id", "chain", "component").agg(
        F.min_by("entity_name", "address").alias("service_label"))


def clusters(members: DataFrame, linking: DataFrame, nodes: DataFrame,
             labels: DataFrame) -> DataFrame:
    """Clusters with a traced member, per trace, numbered C1, C2, ... by traced
    members and size."""
    rollup = cluster_rollup(members, linking)
    traced = shuffled(nodes.select("trace_id", "chain", "address")).join(shuffled(members), "address") \
        .groupBy("trace_id", "chain", "component").agg(
        F.count(F.lit(1)).alias("n_traced"), F.min("address").alias("first_traced"))
    rows = traced.join(shuffled(rollup), "component").join(
        shuffled(service_label(members, nodes, labels)), ["trace_id", "chain", "component"], "left")
    order = [F.col("n_traced").desc(), F.col("size").desc(), F.col("component").asc()]
    line = N.placed(rows, ["trace_id"], order, "clusters")
    return N.running(line, ["trace_id"], {"cluster_no": F.lit(1)}).drop("at") \
        .withColumn("cluster_no", F.col("cluster_no") + 1) \
        .withColumn("cluster_id", F.concat(F.lit("C"), F.col("cluster_no")))
