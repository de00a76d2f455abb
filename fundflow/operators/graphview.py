"""Reductions of a flow graph for reading: overlay of traces, convergence,
entity contraction, chain collapse, folding of minor branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.session import materialise, materialise_observed, shuffled

LEAF_LIMIT, LEAVES_SHOWN = 6, 3


def role_priority(role: Column) -> Column:
    out = None
    for i, name in enumerate(S.ROLE_PRIORITY):
        out = F.when(role == name, i) if out is None else out.when(role == name, i)
    return out.otherwise(9)


# ---------------------------------------------------------------- overlay

def overlay_traces(traces: DataFrame) -> DataFrame:
    """Finished traces (case_id, trace_id, chain, status, victim) on the chain
    that most traces of their case use; ties go to the smaller chain name."""
    done = traces.filter("status = 'finished'")
    count = done.groupBy("case_id", "chain").agg(F.count(F.lit(1)).alias("_n"))
    best = count.groupBy("case_id").agg(
        F.min_by("chain", F.struct(-F.col("_n"), "chain")).alias("chain"))
    return done.join(best, ["case_id", "chain"])


def overlay_nodes(traces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Union of the wallets of a case; a wallet keeps its strongest role.  A
    wallet stands once in a trace, so counting rows counts traces."""
    rows = overlay_traces(traces).select("case_id", "chain", "trace_id").join(
        shuffled(nodes.select("trace_id", "chain", "address", "role", "depth")),
        ["trace_id", "chain"])
    best = F.min_by(F.struct("role", "depth"),
                    F.struct(role_priority(F.col("role")), "trace_id"))
    return rows.groupBy("case_id", "chain", "address").agg(
        best.alias("b"), F.count(F.lit(1)).alias("overlay_hits")).select(
        "case_id", "chain", "address", "b.role", "b.depth", "overlay_hits")


def overlay_edges(traces: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct movements of a case, each from its earliest trace."""
    key = ["case_id", "chain", "txid", "from_address", "to_address", "asset"]
    rows = overlay_traces(traces).select("case_id", "chain", "trace_id").join(
        shuffled(edges), ["trace_id", "chain"])
    first = F.min_by(F.struct("trace_id", "ts", "value", "value_raw"),
                     F.struct("trace_id", "value_raw"))
    return rows.groupBy(*key).agg(first.alias("f")).select(*key, "f.*")


def overlay_exits(traces: DataFrame, exit_rows: DataFrame) -> DataFrame:
    rows = overlay_traces(traces).select("case_id", "chain", "trace_id").join(
        exit_rows, ["trace_id", "chain"])
    return rows.groupBy("case_id", "chain", "address").agg(
        F.min_by(F.struct("trace_id", "entity", "depth"), "trace_id").alias("f")).select(
        "case_id", "chain", "address", "f.*")


def convergence(traces: DataFrame, nodes: DataFrame) -> DataFrame:
    """Wallets reached from two or more different victims of a case."""
    chosen = overlay_traces(traces)
    rows = chosen.select("case_id", "chain", "trace_id", "victim").join(
        shuffled(nodes.select("trace_id", "chain", "address")), ["trace_id", "chain"])
    victims = chosen.select("case_id", "chain", F.col("victim").alias("address")).distinct()
    return rows.groupBy("case_id", "chain", "address").agg(
        F.count_distinct("victim").alias("n_victims"),
        F.count(F.lit(1)).alias("n_traces")) \
        .filter("n_victims >= 2").join(shuffled(victims), ["case_id", "chain", "address"], "left_anti")


# ---------------------------------------------------------------- flow graph

def contract_entities(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flows between display ids: custodian wallets of one entity become one
    end, and movements inside an entity disappear."""
    ids = nodes.filter((F.col("role") == S.EXCHANGE) & F.col("is_exchange")).select(
        "trace_id", "chain", "address",
        F.concat(F.lit("entity:"), F.col("exchange_label.entity_name")).alias("id"))

    def keyed(df, column, out):
        return df.join(ids.select("trace_id", "chain", F.col("address").alias(column),
                                  F.col("id").alias(out)),
                       ["trace_id", "chain", column], "left") \
            .withColumn(out, F.coalesce(out, column))
    rows = keyed(keyed(flows, "from_address", "from_id"), "to_address", "to_id") \
        .filter("from_id <> to_id")
    return rows.groupBy("trace_id", "chain", "from_id", "to_id", "asset").agg(
        F.sum("value_raw").alias("value_raw"), F.sum("usd_cents").alias("usd_cents"),
        F.bool_and("usd_complete").alias("usd_complete"),
        F.sum("n_movements").alias("n_movements"))


def _pass_through(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Intermediaries with exactly one flow in and one flow out."""
    key = ["trace_id", "chain", "address"]
    came = flows.groupBy("trace_id", "chain", F.col("to_address").alias("address")).agg(
        F.count(F.lit(1)).alias("_in"), F.min("from_address").alias("pred"))
    went = flows.groupBy("trace_id", "chain", F.col("from_address").alias("address")).agg(
        F.count(F.lit(1)).alias("_out"), F.min("to_address").alias("succ"))
    return (nodes.filter(F.col("role") == S.INTERMEDIARY).select(*key)
            .join(shuffled(came.filter("_in = 1").drop("_in")), key)
            .join(shuffled(went.filter("_out = 1").drop("_out")), key)
            .filter("pred <> address and succ <> address"))


def chain_members(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every pass-through wallet with the run it lies in: (trace_id, chain,
    address, first, position, head, tail).

    Runs are found by pointer doubling: each round every wallet jumps to the
    wallet its pointer points to, so a run of n wallets needs log2(n) rounds.
    Each pointer target is pointed at once, so no join key repeats.  Closed
    loops without an entry have no first wallet and are left as they are.
    A run that returns to where it started keeps its last wallet visible.
    """
    key = ["trace_id", "chain", "address"]
    rows_left = F.count_if(~F.col("done")).alias("n")
    runs, seen = materialise_observed(_pass_through(flows, nodes), "pass-through",
                                      F.count(F.lit(1)).alias("n"))
    if seen["n"] == 0:
        return runs.select(*key, F.col("address").alias("first"),
                           F.lit(1).cast("bigint").alias("position"),
                           F.col("pred").alias("head"), F.col("succ").alias("tail"))
    inner = runs.select("trace_id", "chain", F.col("address").alias("pred"),
                        F.lit(True).alias("_inner"))
    state = runs.join(shuffled(inner), ["trace_id", "chain", "pred"], "left").select(
        *key, F.when(F.col("_inner"), F.col("pred")).otherwise(F.col("address")).alias("ptr"),
        F.when(F.col("_inner"), 1).otherwise(0).cast("bigint").alias("dist"),
        F.col("_inner").isNull().alias("done"))
    state, left = materialise_observed(state, "pointers", rows_left)
    for _ in range(seen["n"].bit_length() + 1):
        if left["n"] == 0:
            break
        target = state.select("trace_id", "chain", F.col("address").alias("ptr"),
                              F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"),
                              F.col("done").alias("_done"))
        moved = state.filter("not done").join(shuffled(target), ["trace_id", "chain", "ptr"]).select(
            *key, F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"),
            F.col("_done").alias("done"))
        state, left = materialise_observed(state.filter("done").unionByName(moved),
                                           "pointers", rows_left)
    placed = state.filter("done").select(*key, F.col("ptr").alias("first"),
                                         (F.col("dist") + 1).alias("position"))
    rows = placed.join(shuffled(runs), key)
    ends = rows.groupBy("trace_id", "chain", "first").agg(
        F.min_by("pred", "position").alias("head"),
        F.max_by("succ", "position").alias("tail"),
        F.max_by("address", "position").alias("_last"), F.max("position").alias("_n"))
    rows = rows.select(*key, "first", "position").join(shuffled(ends), ["trace_id", "chain", "first"])
    loop = F.col("head") == F.col("tail")
    return rows.filter(~loop | (F.col("position") < F.col("_n"))) \
        .withColumn("tail", F.when(loop, F.col("_last")).otherwise(F.col("tail"))) \
        .drop("_last", "_n")


def collapse_chains(flows: DataFrame, members: DataFrame) -> DataFrame:
    """Flows with every run replaced by one edge (kind 'chain') that carries
    the value and asset of its first segment and the number of wallets.

    Flows meet the members once by each of their ends; the first meeting also
    gives a run its edge, so all flows are dealt twice and not three times."""
    at = ["trace_id", "chain"]
    runs = members.groupBy(*at, "first").agg(
        F.first("head").alias("_head"), F.first("tail").alias("_tail"),
        F.count(F.lit(1)).alias("_n"))
    hidden = members.select(*at, "address").distinct()
    # one row per end of a flow: a hidden wallet, the first of a run, or both
    ends = hidden.withColumn("_hidden", F.lit(True)).join(
        shuffled(runs.withColumnRenamed("first", "address")), [*at, "address"], "full") \
        .withColumnRenamed("address", "to_address")
    entry = F.col("_n").isNotNull()
    rows = flows.join(shuffled(ends), [*at, "to_address"], "left").filter(
        entry | F.col("_hidden").isNull())
    # a flow into a run is its chain; into a first wallet that shows, it is a flow as well
    kinds = F.when(entry & F.col("_hidden").isNull(), F.array(F.lit("flow"), F.lit("chain"))) \
        .when(entry, F.array(F.lit("chain"))).otherwise(F.array(F.lit("flow")))
    chain = F.col("kind") == "chain"
    out = rows.withColumn("kind", F.explode(kinds)).select(
        *at, F.when(chain, F.col("_head")).otherwise(F.col("from_address")).alias("from_address"),
        F.when(chain, F.col("_tail")).otherwise(F.col("to_address")).alias("to_address"),
        "asset", "value", "value_raw", "usd_cents", "usd_complete", "n_movements", "kind",
        F.when(chain, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("n_members"))
    left = hidden.select(*(F.col(c).alias(f"_{c}") for c in (*at, "address")))
    same = (F.col("kind") == "flow") & (F.col("trace_id") == F.col("_trace_id")) \
        & (F.col("chain") == F.col("_chain")) & (F.col("from_address") == F.col("_address"))
    return out.join(shuffled(left), same, "left_anti")


def fold_minor(view: DataFrame, nodes: DataFrame) -> DataFrame:
    """A wallet with more than six dead-end flows keeps the three largest and
    gets one stub edge per asset for the rest, with their number, value, USD and
    movements.  As in a flow, the USD are those known, null where none are, and
    complete where all are.

    The rest is total minus shown, so the flows of a hub are never gathered."""
    at = ["trace_id", "chain"]
    into = view.groupBy(*at, "to_address").agg(F.count(F.lit(1)).alias("_in"))
    leaves_of = nodes.filter(F.col("role").isin(S.INTERMEDIARY, S.UNEXPANDED)).select(
        *at, F.col("address").alias("to_address"))
    leaf = (view.filter("kind = 'flow'").join(shuffled(leaves_of), [*at, "to_address"], "left_semi")
            .join(shuffled(into.filter("_in = 1").drop("_in")), [*at, "to_address"], "left_semi")
            .join(shuffled(view.select(*at, F.col("from_address").alias("to_address"))),
                  [*at, "to_address"], "left_anti"))
    leaf = materialise(leaf, "leaf-flows", rebalance=False)  # used four times below
    parent = [*at, "from_address"]
    size = F.when(F.col("usd_complete"), F.col("usd_cents") / 100.0) \
        .otherwise(F.col("value"))
    order = Window.partitionBy(*parent).orderBy(F.col("_size").desc(), "to_address", "asset")
    counts = leaf.groupBy(*parent).agg(F.count(F.lit(1)).alias("_leaves"))
    front = leaf.withColumn("_size", size).withColumn("_n", F.row_number().over(order)) \
        .filter(F.col("_n") <= LEAF_LIMIT).join(shuffled(counts), parent)
    shown = front.filter((F.col("_leaves") <= LEAF_LIMIT) | (F.col("_n") <= LEAVES_SHOWN)) \
        .select(*view.columns)
    big = counts.filter(F.col("_leaves") > LEAF_LIMIT).select(*parent)

    def sums(prefix):
        return [F.sum("value_raw").alias(f"{prefix}_raw"), F.sum("value").alias(f"{prefix}_value"),
                F.sum("usd_cents").alias(f"{prefix}_usd"), F.count("usd_cents").alias(f"{prefix}_known"),
                F.count_if(~F.coalesce("usd_complete", F.lit(False))).alias(f"{prefix}_partly"),
                F.sum("n_movements").alias(f"{prefix}_moves"), F.count(F.lit(1)).alias(f"{prefix}_n")]
    total = leaf.join(shuffled(big), parent, "left_semi").groupBy(*parent, "asset").agg(*sums("_all"))
    top = front.filter((F.col("_leaves") > LEAF_LIMIT) & (F.col("_n") <= LEAVES_SHOWN)) \
        .groupBy(*parent, "asset").agg(*sums("_top"))

    def rest(of):
        return F.col(f"_all_{of}") - F.coalesce(f"_top_{of}", F.lit(0))
    stub = total.join(shuffled(top), [*parent, "asset"], "left").select(
        *at, "from_address", F.concat(F.lit("stub:"), "from_address").alias("to_address"),
        "asset", rest("value").alias("value"), rest("raw").alias("value_raw"),
        F.when(rest("known") > 0, rest("usd")).alias("usd_cents"),
        (rest("partly") == 0).alias("usd_complete"), rest("moves").alias("n_movements"),
        F.lit("stub").alias("kind"), rest("n").alias("n_members")) \
        .filter("n_members > 0")
    leaf_key = leaf.select(*at, "from_address", "to_address", "asset")
    others = view.join(shuffled(leaf_key), [*at, "from_address", "to_address", "asset"], "left_anti")
    return others.unionByName(shown).unionByName(stub)
