"""Traces and tables that several queries share, computed once per session.

Keyed by application and data folder, so a second query over the same trace
reads the written result instead of walking the ledger again.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.operators import classify, cluster, findings, prices
from fundflow.operators.trace import TraceParams, TraceResult, trace_many
from fundflow.plans import fixtures as X
from fundflow.session import materialise, release_scratch
from fundflow.sources.ledger import SaltedLedger, address_activity

EVENT_ASSETS = ("click", "error", "purchase", "signup", "view")
BUSY = 250              # hot wallets of the ledger
BUSY_CUSTOMER = 15      # customers with many orders, for the backward run
_memo: dict[tuple, object] = {}


def forget(spark: SparkSession | None = None) -> None:
    """Forget shared results; with a session, also delete what they were written to."""
    for kept in _memo.values():
        if isinstance(kept, SaltedLedger):
            kept.drop()
    _memo.clear()
    if spark is not None:
        release_scratch(spark)


def shared(fn):
    @wraps(fn)
    def once(spark: SparkSession, sf: str, *args):
        key = (spark.sparkContext.applicationId, sf, fn.__name__, args)
        if key not in _memo:
            _memo[key] = fn(spark, sf, *args)
        return _memo[key]
    return once


@shared
def moves(spark, sf) -> DataFrame:
    """The event ledger stored as a movements table, as an import would."""
    return materialise(X.moves(spark, sf), "moves", rebalance=False)


@shared
def ledger(spark, sf) -> DataFrame:
    return materialise(X.ledger(spark, sf), "ledger", rebalance=False)


@shared
def stored_ledger(spark, sf, direction: str = S.FORWARD) -> SaltedLedger:
    """The ledger by the wallet of a direction, busy wallets in pieces."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return SaltedLedger.write(ledger(spark, sf), buckets, directions=(direction,))


@shared
def facts(spark, sf) -> DataFrame:
    return materialise(classify.address_facts(
        X.labels(spark, sf), X.flags(spark, sf), X.contracts(spark, sf)), "facts")


@shared
def ledger_facts(spark, sf, busy: int = BUSY) -> DataFrame:
    """Facts of ledger wallets: none is labelled, only the busy ones matter."""
    none = spark.createDataFrame([], S.LABELS)
    # most customers pass a low limit, so a first count would leave nothing out there
    activity = address_activity(ledger(spark, sf), above=busy if busy >= BUSY else None)
    return materialise(classify.address_facts(none, activity=activity, activity_above=busy),
        "ledger-facts")


@shared
def price_table(spark, sf) -> DataFrame:
    needed = prices.needed_keys(X.moves(spark, sf), EVENT_ASSETS)
    return materialise(prices.fill_prices(
        needed, ("feed1", X.price_feed(spark, sf, 1)),
        ("feed2", X.price_feed(spark, sf, 2))), "prices")


def no_prices(spark) -> DataFrame:
    """The ledger moves only a pegged asset, so it needs no price table."""
    return spark.range(1).selectExpr("CAST(NULL AS STRING) AS asset", "CAST(NULL AS DATE) AS date",
                                     "CAST(NULL AS DOUBLE) AS usd").filter(F.lit(False))


def _pegged(edges: DataFrame) -> DataFrame:
    """Valued edges of the ledger.  Its one asset is pegged, so the value is a column
    of the written edges and not worth a second copy of them."""
    return prices.value_usd(edges, no_prices(edges.sparkSession))


def _u5(spark) -> DataFrame:
    return spark.range(1).select(
        F.lit(1).cast("bigint").alias("trace_id"), F.lit(X.CHAIN).alias("chain"),
        F.lit("u5").alias("address"))


def event_params(direction: str, pattern: str, depth: int = 3) -> TraceParams:
    return TraceParams(direction=direction, pattern=pattern, max_depth=depth,
                       high_activity=None, pegged=X.EVENT_ASSETS_PEGGED)


@shared
def u5(spark, sf, direction: str, pattern: str) -> TraceResult:
    return trace_many(moves(spark, sf), _u5(spark), facts(spark, sf),
                      event_params(direction, pattern))


@shared
def u5_valued(spark, sf, direction: str = S.FORWARD,
              pattern: str = S.BALANCED) -> TraceResult:
    run = u5(spark, sf, direction, pattern)
    return run.with_edges(materialise(prices.value_usd(
        run.edges, price_table(spark, sf), X.EVENT_ASSETS_PEGGED), "valued"))


def customer_seeds(spark, sf) -> DataFrame:
    """Every customer that ordered, one trace each."""
    return X.table(spark, sf, "orders").select("o_custkey").distinct().select(
        F.col("o_custkey").alias("trace_id"), F.lit(X.CHAIN).alias("chain"),
        F.concat(F.lit("c"), "o_custkey").alias("address"))


def nation_seeds(spark, sf) -> DataFrame:
    return X.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("trace_id"),
        F.lit(X.CHAIN).alias("chain"), F.concat(F.lit("n"), "n_nationkey").alias("address"))


@shared
def customers(spark, sf, pattern: str = S.THOROUGH) -> TraceResult:
    run = trace_many(stored_ledger(spark, sf), customer_seeds(spark, sf),
                     ledger_facts(spark, sf),
                     TraceParams(pattern=pattern, high_activity=BUSY))
    return run.with_edges(_pegged(run.edges))


@shared
def customers_capped(spark, sf, max_addresses: int, max_edges: int) -> TraceResult:
    return trace_many(stored_ledger(spark, sf), customer_seeds(spark, sf), ledger_facts(spark, sf),
                      TraceParams(pattern=S.THOROUGH, high_activity=BUSY,
                                  max_addresses=max_addresses, max_edges=max_edges))


@shared
def nations(spark, sf) -> TraceResult:
    run = trace_many(stored_ledger(spark, sf, S.BACKWARD), nation_seeds(spark, sf),
                     ledger_facts(spark, sf, BUSY_CUSTOMER),
                     TraceParams(direction=S.BACKWARD, pattern=S.THOROUGH,
                                 high_activity=BUSY_CUSTOMER))
    return run.with_edges(_pegged(run.edges))


def traces(spark, sf) -> DataFrame:
    """The customer traces as cases: one case per nation."""
    custkey = F.col("c_custkey")
    return X.table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("case_id"), custkey.alias("trace_id"),
        F.lit(X.CHAIN).alias("chain"),
        F.when(custkey % 10 == 0, "failed").otherwise("finished").alias("status"),
        F.concat(F.lit("c"), custkey).alias("victim"))


@shared
def cospend(spark, sf) -> DataFrame:
    """The linking inputs, written once for the edges and for the evidence."""
    return materialise(X.cospend(spark, sf), "cospend", rebalance=False)


@shared
def members(spark, sf) -> DataFrame:
    edges = cluster.cospend_edges(cospend(spark, sf))
    return materialise(cluster.components(edges), "members")


@shared
def finding_inputs(spark, sf, which: str) -> findings.FindingInputs:
    run = {"u5": u5_valued, "customers": customers, "nations": nations}[which](spark, sf)
    return findings.FindingInputs(run)
