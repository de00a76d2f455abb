"""Bounded, time-consistent, label-stopped traversal of many traces at once.

The traversal runs level by level.  What a wallet does depends on the wallet and
its time bound, not on the trace that reached it, so one level examines every
(wallet, bound) of its frontier once: join it to the ledger, count the state of
every movement, select what the pattern follows.  Traces then meet the selected
movements only; what is written per level is one account per wallet and asset,
the edges, and the new wallets.  The driver holds no rows; it only asks whether
a level produced any edge.

Rules that fix the result independently of execution order:

* the frontier of level d is every wallet first reached at hop d;
* its time bound merges all edges that reached it at that level (earliest
  arrival forward, latest sending backward) and one unknown time unbinds it;
* labelled stops are removed before the ledger join, so the busiest wallets
  never become join keys;
* the start wallet keeps its role and is expanded once.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import order as N
from fundflow.functions.amounts import DUST_TOKEN, order_value
from fundflow.operators import branches as B
from fundflow.operators import classify as C
from fundflow.session import materialise, materialise_observed, shuffled

DEPTH_LIMIT, EXTENDED_DEPTH = 6, 25
PRUNE_WALLETS = 200
BROADCAST_FACTS = 50_000     # more facts, or a wider frontier, are never broadcast
BROADCAST_FRONTIER = 10_000
NODE_KEY = ["trace_id", "chain", "address"]
_MOVE = ["txid", "ts", "asset", "value", "value_raw", "is_self_transfer",
         "transfer_kind"]


@dataclass(frozen=True)
class TraceParams:
    direction: str = S.FORWARD
    pattern: str = S.BALANCED
    max_depth: int = 3
    extended: bool = False
    dust_limits: dict = field(default_factory=dict)
    dust_token: float = DUST_TOKEN
    high_activity: int | None = 500
    newest_n: int | None = None          # off: the whole history is a table
    max_addresses: int | None = None     # off: caps are for single traces
    max_edges: int | None = None
    spot: dict = field(default_factory=dict)
    pegged: tuple = S.STABLECOINS

    def __post_init__(self):
        if self.direction not in (S.FORWARD, S.BACKWARD):
            raise ValueError(f"unknown direction: {self.direction}")
        if self.pattern not in (S.RAPID, S.BALANCED, S.THOROUGH):
            raise ValueError(f"unknown pattern: {self.pattern}")
        if not 1 <= self.max_depth <= DEPTH_LIMIT:
            raise ValueError(f"max_depth must be 1..{DEPTH_LIMIT}")

    def hops(self, focused: bool) -> int:
        if self.extended:
            return EXTENDED_DEPTH
        return self.max_depth + (1 if focused else 0)


@dataclass(frozen=True)
class TraceResult:
    """Tables of one run; every table is keyed by ``trace_id``."""
    params: TraceParams
    nodes: DataFrame
    edges: DataFrame
    accounting: DataFrame
    focus: DataFrame | None = None

    @property
    def start(self) -> DataFrame:
        return self.nodes.filter(F.col("depth") == 0)

    @property
    def terminal_column(self) -> str:
        """End of an edge that faces away from the start wallet."""
        return "from_address" if self.params.direction == S.BACKWARD else "to_address"

    def with_edges(self, edges: DataFrame) -> "TraceResult":
        return replace(self, edges=edges)


# ------------------------------------------------------------ one level

def expand(frontier: DataFrame, movements, direction: str,
           n_frontier: int | None = None) -> DataFrame:
    """Frontier joined to the ledger on its wallet.

    A short frontier is also given to the scan as a list of wallets, which
    prunes buckets, row groups and bloom filters of the stored ledger: a trace
    of one wallet then reads a sliver of it.  Beyond ``PRUNE_WALLETS`` the join
    alone decides; it has no broadcast hint, because the frontier is a written
    table whose measured size selects the strategy, and AQE splits skewed
    wallets of a shuffled join."""
    if hasattr(movements, "expand"):
        return movements.expand(frontier, direction)
    if n_frontier is not None and n_frontier > BROADCAST_FRONTIER:
        return shuffled(frontier).join(ledger_side(movements, direction), ["chain", "address"])
    ledger = ledger_side(movements, direction)
    short = n_frontier is None or n_frontier <= PRUNE_WALLETS
    wallets = short_list(frontier) if short else None
    if wallets is not None:
        ledger = ledger.filter(F.col("address").isin(wallets))
    return frontier.join(ledger, ["chain", "address"])


def short_list(frontier: DataFrame, most: int = PRUNE_WALLETS) -> list[str] | None:
    """The wallets of a frontier when there are at most ``most``, else None.
    Only this many names ever reach the driver."""
    probe = frontier.select("address").limit(most + 1).collect()
    return sorted({r.address for r in probe}) if len(probe) <= most else None


def ledger_side(movements: DataFrame, direction: str, *more: str) -> DataFrame:
    """Movements keyed by the wallet being examined (``address``)."""
    here, there = ("to_address", "from_address") if direction == S.BACKWARD \
        else ("from_address", "to_address")
    kind = F.col("transfer_kind") if "transfer_kind" in movements.columns \
        else F.lit(None).cast("string")
    return movements.select(
        "chain", F.col(here).alias("address"), F.col(there).alias("next_address"),
        *_MOVE[:-1], kind.alias("transfer_kind"), *more)


def arrivals(edges: DataFrame, direction: str) -> DataFrame:
    """Wallets an edge level reaches, with merged time bound and rank value."""
    merged = F.max("bound") if direction == S.BACKWARD else F.min("bound")
    return edges.groupBy("trace_id", "chain", F.col("next_address").alias("address")).agg(
        F.when(F.max(F.col("bound").isNull()), F.lit(None)).otherwise(merged)
        .cast("bigint").alias("bound"),
        F.max("order_value").alias("order_value"))


def not_visited(arrived: DataFrame, levels: list[DataFrame]) -> DataFrame:
    visited = levels[0].select(*NODE_KEY)
    for level in levels[1:]:
        visited = visited.unionByName(level.select(*NODE_KEY))
    return arrived.join(shuffled(visited), NODE_KEY, "left_anti")


def spend_budget(level: DataFrame, drawn: DataFrame, levels: list[DataFrame],
                 edges: list[DataFrame], params: TraceParams) -> tuple[DataFrame, DataFrame | None]:
    """What the size caps let a level draw: its edges, and the wallets
    (trace_id, chain, address) that are left unexpanded, if any.

    Wallets are examined in the order of the value that reached them.  One is
    examined while the wallets and edges the trace holds so far, those found by
    earlier wallets of this level included, are below the caps; a wallet found
    twice counts for the first.  Running sums over the ordered frontier give
    every wallet what came before it, however many wallets one trace has.
    """
    waiting = level.filter(~(F.col("is_exchange") | F.col("is_sanctioned")))
    order = [F.col("order_value").desc_nulls_last(), F.col("chain").asc(), F.col("address").asc()]
    line = N.placed(waiting.select(*NODE_KEY, "order_value"), ["trace_id"], order, "frontier") \
        .select(*NODE_KEY, "at")
    own = drawn.groupBy(*NODE_KEY).agg(F.count(F.lit(1)).alias("own_edges"))
    found = not_visited(drawn.join(shuffled(line), NODE_KEY).select(
        "trace_id", "chain", F.col("next_address").alias("address"), "at"), levels) \
        .groupBy(*NODE_KEY).agg(F.min("at").alias("at")) \
        .select("trace_id", "at", F.lit(1).cast("bigint").alias("new_nodes"))
    sums = N.running(line.join(shuffled(own), NODE_KEY, "left"), ["trace_id"], {
        "new_edges": F.coalesce(F.col("own_edges"), F.lit(0).cast("bigint")),
        "new_nodes": F.lit(0).cast("bigint")}, found)

    def held(frames, name):
        return _union([f.select("trace_id") for f in frames]).groupBy("trace_id").agg(
            F.count(F.lit(1)).alias(name))
    sums = sums.join(shuffled(held(levels, "nodes")), "trace_id")
    sums = sums.join(shuffled(held(edges, "edges")), "trace_id", "left") if edges \
        else sums.withColumn("edges", F.lit(0))
    most = 2**62
    full = (F.col("nodes") + F.col("new_nodes") >= F.lit(params.max_addresses or most)) \
        | (F.coalesce(F.col("edges"), F.lit(0)) + F.col("new_edges") >= F.lit(params.max_edges or most))
    denied, seen = materialise_observed(sums.filter(full).select(*NODE_KEY), "denied",
                                        F.count(F.lit(1)).alias("n"))
    if seen["n"] == 0:
        return drawn, None
    return drawn.join(shuffled(denied), NODE_KEY, "left_anti"), denied


# ------------------------------------------------------------ focus payment

def seed_from_tx(seeds: DataFrame, legs: DataFrame, senders: DataFrame) -> DataFrame:
    """Judge the focus payment of every seed (trace_id, chain, address,
    focus_txid).  Result: one row per trace with ``outcome``:

    ``followed``  the wallet pays in this transaction;
    ``incoming``  it only receives, so the whole wallet is traced instead;
    ``all_change``, ``not_involved``, ``no_movements``  nothing to trace.
    """
    asked = seeds.filter(F.col("focus_txid").isNotNull()) \
        .select(*NODE_KEY, "focus_txid")
    tx = ["chain", "txid"]
    per_leg = asked.join(legs.withColumnRenamed("txid", "focus_txid")
                         .select("chain", "focus_txid", "from_address", "to_address"),
                         ["chain", "focus_txid"], "left")
    own_leg = F.col("to_address") != F.col("address")
    own_leg = own_leg & (~F.col("chain").isin(*S.ACCOUNT_CHAINS)
                         | (F.col("from_address") == F.col("address")))
    judged = per_leg.groupBy(*NODE_KEY, "focus_txid").agg(
        F.count("to_address").alias("n_legs"), F.count_if(own_leg).alias("n_followed"),
        F.max(F.col("to_address") == F.col("address")).alias("receives"))
    payers = senders.select("chain", F.col("txid").alias("focus_txid"),
                            "address").distinct()
    pays = asked.join(payers, ["chain", "focus_txid", "address"], "left_semi") \
        .select("trace_id").withColumn("pays", F.lit(True))
    inputs = payers.groupBy("chain", "focus_txid").agg(
        F.count(F.lit(1)).alias("n_inputs"))
    out = judged.join(pays, "trace_id", "left").join(inputs, ["chain", "focus_txid"], "left")
    pays_col, receives = (F.coalesce(F.col("pays"), F.lit(False)),
                          F.coalesce(F.col("receives"), F.lit(False)))
    return out.withColumn(
        "outcome", F.when(F.col("n_legs") == 0, "no_movements")
        .when(~pays_col & receives, "incoming")
        .when(~pays_col, "not_involved")
        .when(F.col("n_followed") == 0, "all_change").otherwise("followed")) \
        .select(*NODE_KEY, "focus_txid", "outcome", "n_followed", "n_inputs")


def focus_legs(judged: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs of followed focus payments, attributed to the start wallet.  A leg
    without a time takes the latest known time of its transaction."""
    tx_time = legs.groupBy("chain", "txid").agg(F.max("ts").alias("_tx_ts"))
    dated = legs.join(tx_time, ["chain", "txid"]) \
        .withColumn("ts", F.coalesce(F.col("ts"), F.col("_tx_ts")))
    rows = judged.filter(F.col("outcome") == "followed") \
        .withColumnRenamed("focus_txid", "txid").select(*NODE_KEY, "txid") \
        .join(dated, ["chain", "txid"])
    rows = rows.filter((F.col("to_address") != F.col("address"))
                       & (~F.col("chain").isin(*S.ACCOUNT_CHAINS)
                          | (F.col("from_address") == F.col("address"))))
    kind = F.col("transfer_kind") if "transfer_kind" in legs.columns \
        else F.lit(None).cast("string")
    return rows.select(
        *NODE_KEY, F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("bound"),
        F.col("to_address").alias("next_address"), "txid", "ts", "asset", "value",
        "value_raw", F.lit(False).alias("is_self_transfer"),
        kind.alias("transfer_kind"))


# ------------------------------------------------------------ the loop

def trace_many(movements: DataFrame, seeds: DataFrame, facts: DataFrame,
               params: TraceParams | None = None, legs: DataFrame | None = None,
               senders: DataFrame | None = None) -> TraceResult:
    """Trace every seed (trace_id, chain, address[, focus_txid]) at once.

    ``movements`` has the columns of ``schemas.MOVEMENTS``; store it bucketed by
    the wallet column of the direction to keep the ledger join local (see
    ``sources.ledger.write_bucketed``).  It may also be an object with an
    ``expand(frontier, direction)`` method, such as ``sources.utxo.UtxoLedger``.  ``facts`` comes from
    ``classify.address_facts``.  ``legs`` and ``senders`` are needed only when
    seeds carry a ``focus_txid``.
    """
    params = params or TraceParams()
    focused = "focus_txid" in seeds.columns
    hops = params.hops(focused)
    facts, known = materialise_observed(facts.select(*C.KEY, *C.FACT_COLUMNS), "facts",
                                        F.count(F.lit(1)).alias("n"))
    if known["n"] > BROADCAST_FACTS:
        facts = shuffled(facts)

    start = C.classify(
        seeds.select("trace_id", "chain", "address",
                     *(["focus_txid"] if focused else []),
                     F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("bound"),
                     F.lit(None).cast("double").alias("order_value")),
        facts, params.high_activity).withColumn("role", F.lit(S.VICTIM)) \
        .withColumn("expand", F.lit(True))
    judged = None
    if focused:
        if params.direction == S.BACKWARD:
            raise ValueError("a focus payment needs a forward trace")
        judged = materialise(seed_from_tx(seeds, legs, senders), "focus")
        whole = start.filter(F.col("focus_txid").isNull()).select("trace_id").unionByName(
            judged.filter(F.col("outcome") == "incoming").select("trace_id"))
        start = start.join(whole.withColumn("_whole", F.lit(True)), "trace_id", "left") \
            .withColumn("expand", F.coalesce(F.col("_whole"), F.lit(False))) \
            .drop("_whole", "focus_txid")
    first, n = materialise_observed(start, "nodes", _waiting())
    levels, edges, accounts, denied = [first], [], [], []
    newest = None
    if params.newest_n is not None:
        newest = materialise(newest_of(movements, params.newest_n), "newest", rebalance=False)
    beyond = None if newest is None else is_beyond(F.col("last"), F.col("ts"), F.col("txid"))
    status = B.movement_status(params.direction, params.dust_limits, params.dust_token, beyond)
    capped = params.max_addresses is not None or params.max_edges is not None

    for depth in range(hops):
        if depth > 0 and n["waiting"] == 0 and not capped:
            break
        frontier = levels[-1].filter("expand").select(*NODE_KEY, "bound", _since().alias("since"))
        asked = frontier.select(*EXAMINED, "bound").distinct()
        if n["waiting"] > BROADCAST_FRONTIER:   # a wide one is dealt out once, not for both readers
            asked = materialise(asked, "frontier", rebalance=False)
        rows = expand(asked, movements, params.direction, n["waiting"])
        if newest is not None:
            rows = read_newest(rows, newest)
        rows = rows.withColumn("status", status)
        account = materialise(B.account(rows, EXAMINED), "accounts", rebalance=False)
        accounts.append(frontier.drop("bound").join(shuffled(account), EXAMINED)
                        .withColumn("depth", F.lit(depth)))
        chosen = B.select_branches(rows.filter("status = 'eligible'"), EXAMINED, params.pattern,
                                   account)
        chosen = shuffled(frontier.drop("bound")).join(chosen, EXAMINED)
        if depth == 0 and judged is not None:
            paid = focus_legs(judged, legs).withColumn("last", F.lit(None).cast(_LAST)) \
                .withColumn("status", status)
            accounts.append(B.account(paid, NODE_KEY).withColumn("depth", F.lit(0)))
            chosen = chosen.unionByName(paid.filter("status = 'eligible'").select(
                *(c for c in chosen.columns if c in paid.columns)), allowMissingColumns=True)
        # the join above is a shuffle whose slivers AQE merges, so no rebalance deals the edges again
        drawn, n = materialise_observed(_as_edges(chosen, depth, params), "edges",
                                        F.count(F.lit(1)).alias("edges"))
        if capped:
            kept, left = spend_budget(levels[-1], drawn, levels, edges, params)
            if left is not None:
                denied.append(left)
                drawn, n = materialise_observed(kept, "edges", F.count(F.lit(1)).alias("edges"))
        edges.append(drawn)
        if n["edges"] == 0:
            break
        fresh = not_visited(arrivals(drawn, params.direction), levels)
        nodes = C.classify(fresh.withColumn("depth", F.lit(depth + 1)), facts,
                           params.high_activity)
        nodes = nodes.withColumn("expand", F.col("role") == S.INTERMEDIARY)
        level, n = materialise_observed(nodes.select(*first.columns), "nodes", _waiting())
        levels.append(level)

    return _finish(params, hops, levels, accounts, edges, newest, denied, judged)


EXAMINED = ["chain", "address", "since"]
_LAST = "struct<ts:bigint,txid:string>"


def _since():
    """The time bound as a key: no time equals the key of an unbound wallet."""
    return F.coalesce(F.col("bound"), F.lit(-2**63))


def newest_of(movements, n: int) -> DataFrame:
    """For each wallet and kind of transfer with ``n`` transactions or more, the
    n-th newest that touches it on either side (``last``).  Spark keeps n per
    wallet in every task before it shuffles."""
    each = (movements.touching() if hasattr(movements, "touching") else touching(movements)) \
        .groupBy("chain", "address", "kind", "txid").agg(F.max("ts").alias("ts"))
    order = Window.partitionBy("chain", "address", "kind").orderBy(
        F.col("ts").desc_nulls_last(), F.col("txid"))
    return each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n) \
        .filter(F.col("nth") == n).select("chain", "address", "kind",
                                          F.struct("ts", "txid").cast(_LAST).alias("last"))


def touching(movements: DataFrame) -> DataFrame:
    """(chain, txid, ts, kind, address): every wallet on either side of a movement."""
    kind = F.col("transfer_kind") if "transfer_kind" in movements.columns \
        else F.lit(None).cast("string")
    return movements.select(
        "chain", "txid", "ts", F.coalesce(kind, F.lit("")).alias("kind"),
        F.explode(F.array_distinct(F.array("from_address", "to_address"))).alias("address"))


def read_newest(rows: DataFrame, newest: DataFrame) -> DataFrame:
    """Movements with the ``last`` transaction that is read for their wallet."""
    kind = F.coalesce(F.col("transfer_kind"), F.lit(""))
    return rows.withColumn("kind", kind).join(shuffled(newest), ["chain", "address", "kind"], "left").drop("kind")


def is_beyond(last, ts, txid):
    """Older than the last transaction that is read; unknown times are oldest."""
    known = F.coalesce(ts, F.lit(-2**63))
    edge = F.coalesce(last["ts"], F.lit(-2**63))
    return last.isNotNull() & ((known < edge) | ((known == edge) & (txid > last["txid"])))


def _waiting():
    return F.count_if("expand").alias("waiting")


def _as_edges(chosen: DataFrame, depth: int, params: TraceParams) -> DataFrame:
    here, there = F.col("address"), F.col("next_address")
    if params.direction == S.BACKWARD:
        here, there = there, here
    return chosen.select(
        *NODE_KEY, "next_address", F.lit(depth + 1).alias("depth"), "txid", "ts",
        here.alias("from_address"), there.alias("to_address"), "asset", "value",
        "value_raw", F.coalesce(F.col("ts"), F.col("bound")).alias("bound"),
        order_value(F.col("asset"), F.col("value"), params.spot,
                    params.pegged).alias("order_value"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _finish(params, hops, levels, accounts, edges, newest, denied, judged) -> TraceResult:
    nodes, drawn = _union(levels), _union(edges)
    group = [*NODE_KEY, "depth"]
    walked = drawn.withColumn("depth", F.col("depth") - 1)
    spent = None
    if denied:
        spent = _union(denied).withColumn("_denied", F.lit(True))
        accounts = [a.join(shuffled(spent), NODE_KEY, "left_anti") for a in accounts]
    accounting = B.account_followed(
        _union([a.select(*group, "asset", *B.ACCOUNTS) for a in accounts]), walked, group)
    if newest is None:
        accounting = accounting.withColumn("capped", F.lit(False))
    else:
        listed = newest.select("chain", "address").distinct().withColumn("capped", F.lit(True))
        accounting = accounting.join(shuffled(listed), ["chain", "address"], "left") \
            .withColumn("capped", F.coalesce(F.col("capped"), F.lit(False)))
        nodes = nodes.join(shuffled(listed).withColumnRenamed("capped", "_capped"), ["chain", "address"], "left")
    accounting = materialise(accounting, "accounting", rebalance=False)
    per_node = accounting.groupBy(*NODE_KEY).agg(
        F.sum("n_eligible").alias("_eligible"),
        F.max(F.col("n_skipped") > 0).alias("branches_unexamined"))
    if spent is not None:
        nodes = nodes.join(shuffled(spent), NODE_KEY, "left").withColumn(
            "role", F.when(F.col("_denied") & (F.col("role") != S.VICTIM), S.UNEXPANDED)
            .otherwise(F.col("role"))).withColumn(
            "expand", F.col("expand") & F.col("_denied").isNull()).drop("_denied")
    examined = F.col("expand") & (F.col("depth") < hops)
    at_limit = F.col("expand") & (F.col("depth") >= hops)
    capped = examined & F.coalesce(F.col("_capped"), F.lit(False)) if newest is not None \
        else F.lit(False)
    nodes = nodes.join(shuffled(per_node), NODE_KEY, "left")
    nodes = (nodes.withColumns({
        "max_depth_reached": at_limit, "outgoing_txs_capped": capped,
        "branches_unexamined": F.coalesce(F.col("branches_unexamined"), F.lit(False)),
        "at_rest": (examined & (F.col("depth") > 0) & ~capped
                    & (F.coalesce(F.col("_eligible"), F.lit(0)) == 0)),
        "role": F.when(at_limit & (F.col("role") == S.INTERMEDIARY),
                       S.UNEXPANDED).otherwise(F.col("role"))})
             .drop("_eligible", "_capped", "expand", "order_value"))
    rest = "no_funding_found" if params.direction == S.BACKWARD else "no_onward_movements"
    flags = [("agency_flagged", "agency_flagged"), ("shared_flagged", "shared_flagged"),
             ("max_depth_reached", "max_depth_reached"),
             ("outgoing_txs_capped", "outgoing_txs_capped"),
             ("branches_unexamined", "branches_unexamined"), ("at_rest", rest)]
    marks = [F.when(F.col(c), name) for c, name in flags]
    marks += [F.when(F.col("role") == role, name) for role, name in (
        (S.MIXER, "mixer_not_followed"), (S.CONTRACT, "contract_not_followed"),
        (S.HIGH_ACTIVITY, "high_activity_not_expanded"))]
    nodes = nodes.withColumn("flags", F.array_compact(F.array(*marks))) \
        .withColumn("basis", C.basis_of())
    return TraceResult(params, materialise(nodes, "trace-nodes", rebalance=False),
                       drawn.drop("order_value"), accounting, judged)


# ------------------------------------------------------------ reports on a run

def notices(result: TraceResult) -> DataFrame:
    """What the trace left out, per trace: (kind, asset, n, total_raw)."""
    acc = result.accounting

    def part(kind, n, total):
        return acc.groupBy("trace_id", "asset").agg(
            F.sum(n).alias("n"), F.sum(total).alias("total_raw")) \
            .filter(F.col("n") > 0).withColumn("kind", F.lit(kind))
    nothing = F.lit(None).cast("string")
    zero = acc.withColumn("_zero", F.lit(0).cast(acc.schema["dust_raw"].dataType))
    time = zero.groupBy("trace_id").agg(F.sum("n_time").alias("n")) \
        .filter(F.col("n") > 0).withColumn("kind", F.lit("time_skipped"))
    edge = result.nodes.filter(F.col("role") == S.UNEXPANDED).groupBy("trace_id") \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("unexpanded"))
    capped = result.nodes.filter("outgoing_txs_capped").groupBy("trace_id") \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("capped"))
    plain = [d.withColumn("asset", nothing).withColumn("total_raw", F.lit(None).cast(
        acc.schema["dust_raw"].dataType)) for d in (time, edge, capped)]
    out = part("dust", "n_dust", "dust_raw").unionByName(
        part("pattern_skipped", "n_skipped", "skipped_raw"))
    for frame in plain:
        out = out.unionByName(frame.select(*out.columns))
    return out.select("trace_id", "kind", "asset", F.col("n").cast("bigint").alias("n"),
                      "total_raw")


def trace_stats(result: TraceResult, exits: DataFrame) -> DataFrame:
    nodes = result.nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("addresses"))
    edges = result.edges.groupBy("trace_id").agg(F.count(F.lit(1)).alias("edges"))
    ends = exits.groupBy("trace_id").agg(F.count(F.lit(1)).alias("exit_points"))
    return nodes.join(edges, "trace_id", "left").join(ends, "trace_id", "left") \
        .na.fill(0, ["edges", "exit_points"])
