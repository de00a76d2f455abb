"""The unified movements table: union, activity, storage layout."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.session import materialise, materialise_observed, scratch_path, shuffled

LISTED = 50_000  # more addresses are never broadcast


def movements(*parts: DataFrame) -> DataFrame:
    """Movements of several chains in one schema."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    present = set(both.columns)
    return both.select(*[
        (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
        for name, kind in S.MOVEMENT_COLUMNS.items()])


def address_activity(moves: DataFrame, side: str = "any", above: int | None = None) -> DataFrame:
    """Exact number of transactions per address: touching it (``any``, the
    UTXO rule) or sent by it (``sent``, the account rule).

    With ``above``, of addresses with more than that many only.  One with fewer
    movements cannot have more transactions, so movements are counted first and
    distinct transactions only of the addresses that are left."""
    if side == "sent":
        legs = moves.select("chain", F.col("from_address").alias("address"), "txid")
    else:
        legs = moves.select("chain", "txid", F.explode(
            F.array_distinct(F.array("from_address", "to_address"))).alias("address"))
    if above is not None:
        many, seen = materialise_observed(
            legs.groupBy(F.col("chain").alias("_chain"), F.col("address").alias("_address"))
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > above).drop("_n"),
            "active", F.count(F.lit(1)).alias("n"))
        many = many if seen["n"] <= LISTED else shuffled(many)
        legs = legs.join(many, F.col("chain").eqNullSafe(F.col("_chain"))
                         & F.col("address").eqNullSafe(F.col("_address")), "left_semi")
    counted = legs.groupBy("chain", "address").agg(
        F.count_distinct("txid").alias("activity"))
    return counted if above is None else counted.filter(F.col("activity") > above)


def newest(moves: DataFrame, n: int = 25) -> DataFrame:
    """The n newest transactions that touch each wallet on either side, per kind
    of transfer, as movements seen from the wallet (``address``), and whether
    the list is full (``capped``), so that older ones may be missing."""
    kind = F.coalesce(F.col("transfer_kind"), F.lit("")) if "transfer_kind" in moves.columns \
        else F.lit("")
    legs = moves.withColumn("kind", kind).withColumn("address", F.explode(
        F.array_distinct(F.array("from_address", "to_address"))))
    keys = ["chain", "address", "kind"]
    order = Window.partitionBy(*keys).orderBy(F.col("ts").desc_nulls_last(), F.col("txid"))
    kept = legs.withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= n)
    full = kept.groupBy("chain", "address").agg((F.max("nth") >= n).alias("capped"))
    return kept.drop("kind", "nth").join(full, ["chain", "address"])


def write_bucketed(moves: DataFrame, name: str, wallet: str, buckets: int) -> None:
    """Save a copy partitioned by chain and bucketed by ``wallet``, with bloom
    filters on it.  A forward trace reads the copy bucketed by sender, a
    backward one by receiver; then the ledger side of every hop is not shuffled,
    and a short frontier reads only its own buckets and row groups."""
    (moves.repartition(buckets, wallet).write.mode("overwrite").partitionBy("chain")
     .option(f"parquet.bloom.filter.enabled#{wallet}", "true")
     .bucketBy(buckets, wallet).sortBy(wallet, "ts").saveAsTable(name))


@dataclass(frozen=True)
class SaltedLedger:
    """Movements stored by wallet, the busiest wallets in several pieces.

    Each direction is one table, bucketed by (chain, wallet, salt): the salt of a
    movement is 0, or one of n for a wallet with n times ``per_salt`` movements.
    A hop copies the frontier row of such a wallet to each of its salts and
    joins on all three columns, so the stored side lies ready and half a ledger
    on one wallet is as many pieces as it has ``per_salt`` rows.  ``busy`` lists
    those wallets; there are at most rows / per_salt of them.
    """
    tables: dict
    busy: dict
    movements: DataFrame

    @classmethod
    def write(cls, moves: DataFrame, buckets: int, per_salt: int = 1_000_000,
              directions: tuple = (S.FORWARD, S.BACKWARD)) -> "SaltedLedger":
        tables, busy = {}, {}
        for direction in directions:
            wallet = "to_address" if direction == S.BACKWARD else "from_address"
            many = materialise(
                moves.groupBy("chain", wallet).agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > per_salt)
                .select("chain", wallet, F.ceil(F.col("n") / per_salt).alias("salts")),
                "busy", rebalance=False)
            name = f"ledger_{direction}_{uuid.uuid4().hex}"
            salted = moves.join(F.broadcast(many), ["chain", wallet], "left").withColumn(
                "salt", F.coalesce(F.pmod(F.xxhash64("txid", "from_address", "to_address", "asset"),
                                          "salts"), F.lit(0)).cast("int")).drop("salts")
            (salted.repartition(buckets, "chain", wallet, "salt").write
             .option("compression", "zstd").option("path", scratch_path(moves.sparkSession, name))
             .option(f"parquet.bloom.filter.enabled#{wallet}", "true")
             .bucketBy(buckets, "chain", wallet, "salt").sortBy("chain", wallet, "salt").saveAsTable(name))
            tables[direction], busy[direction] = name, many.withColumnRenamed(wallet, "address")
        return cls(tables, busy, moves)

    def expand(self, frontier: DataFrame, direction: str) -> DataFrame:
        from fundflow.operators.trace import ledger_side
        stored = frontier.sparkSession.table(self.tables[direction])
        pieces = frontier.join(F.broadcast(self.busy[direction]), ["chain", "address"], "left").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)).cast("int") - 1))
        ).drop("salts")
        side = ledger_side(stored, direction, "salt")
        return shuffled(pieces).join(side, ["chain", "address", "salt"]).drop("salt")

    def touching(self) -> DataFrame:
        """(chain, txid, ts, kind, address) of every wallet of every movement."""
        from fundflow.operators.trace import touching
        return touching(self.movements)

    def drop(self) -> None:
        for name in self.tables.values():
            self.movements.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def read_raw(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON-lines responses with an explicit schema; no inference pass."""
    return spark.read.schema(schema).json(path)
