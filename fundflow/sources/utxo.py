"""UTXO transactions to movements, co-spend records and address statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow import schemas as S

ADDRESS = "scriptpubkey_address"


def _inputs() -> Column:
    """Distinct non-null addresses among the inputs of a transaction."""
    return F.array_distinct(F.array_compact(
        F.transform("vin", lambda i: i["prevout"][ADDRESS])))


def _movement(df: DataFrame, asset: str, decimals: int) -> DataFrame:
    return df.select(
        F.lit(S.BITCOIN).alias("chain"), "txid", "ts", "from_address", "to_address",
        F.lit(asset).alias("asset"),
        (F.col("value_raw") / F.lit(float(10**decimals))).alias("value"),
        F.col("value_raw").cast("decimal(38,0)").alias("value_raw"),
        (F.col("from_address") == F.col("to_address")).alias("is_self_transfer"))


def utxo_outgoing(raw: DataFrame, asset: str = "BTC", decimals: int = 8) -> DataFrame:
    """One movement per distinct input address and addressed output.

    Both explodes stay inside the row, so nothing is shuffled.  For tracing use
    ``UtxoLedger``, which pairs only the wallets being examined."""
    rows = raw.select("txid", F.col("status.block_time").alias("ts"), "vout",
                      F.explode(_inputs()).alias("from_address")) \
        .select("txid", "ts", "from_address", F.explode("vout").alias("o"))
    return _movement(rows.select(
        "txid", "ts", "from_address", F.col(f"o.{ADDRESS}").alias("to_address"),
        F.col("o.value").alias("value_raw")).filter("to_address is not null"),
        asset, decimals)


def utxo_incoming(raw: DataFrame, asset: str = "BTC", decimals: int = 8) -> DataFrame:
    """One movement per distinct paid address and input occurrence, carrying
    the full value of that input; coinbase inputs have no address."""
    paid = F.array_distinct(F.array_compact(F.transform("vout", lambda o: o[ADDRESS])))
    rows = raw.select("txid", F.col("status.block_time").alias("ts"), "vin",
                      F.explode(paid).alias("to_address")) \
        .select("txid", "ts", "to_address", F.explode("vin").alias("i"))
    return _movement(rows.select(
        "txid", "ts", "to_address", F.col(f"i.prevout.{ADDRESS}").alias("from_address"),
        F.col("i.prevout.value").alias("value_raw")).filter("from_address is not null"),
        asset, decimals)


def tx_outputs(raw: DataFrame, txids: DataFrame | None = None, asset: str = "BTC",
               decimals: int = 8) -> DataFrame:
    """All addressed outputs of (chosen) transactions; the source is the single
    input address, or the number of input addresses."""
    rows = raw if txids is None else raw.join(txids.select("txid").distinct(), "txid",
                                              "left_semi")
    named = F.array_distinct(F.transform(
        "vin", lambda i: F.coalesce(i["prevout"][ADDRESS], F.lit("coinbase"))))
    source = F.when(F.size(named) == 1, F.element_at(named, 1)).otherwise(
        F.concat(F.size(named).cast("string"), F.lit(" input addresses")))
    legs = rows.select("txid", F.col("status.block_time").alias("ts"),
                       source.alias("from_address"), F.explode("vout").alias("o")) \
        .select("txid", "ts", "from_address", F.col(f"o.{ADDRESS}").alias("to_address"),
                F.col("o.value").alias("value_raw")).filter("to_address is not null")
    return _movement(legs, asset, decimals).withColumn("is_self_transfer", F.lit(False))


def tx_senders(raw: DataFrame) -> DataFrame:
    """(chain, txid, address) of every spender, for judging focus payments."""
    return raw.select(F.lit(S.BITCOIN).alias("chain"), "txid",
                      F.explode(_inputs()).alias("address"))


def tx_cospend(raw: DataFrame) -> DataFrame:
    """One row per transaction: distinct input addresses and output values."""
    return raw.select("txid", _inputs().alias("inputs"),
                      F.transform("vout", lambda o: F.coalesce(o["value"], F.lit(0)))
                      .alias("outputs"))


def cospend_inputs(raw: DataFrame) -> DataFrame:
    return tx_cospend(raw).select("txid", F.explode("inputs").alias("address"))


def cospend_outputs(raw: DataFrame) -> DataFrame:
    return tx_cospend(raw).select("txid", F.explode("outputs").alias("value"))


def utxo_stats(raw: DataFrame) -> DataFrame:
    """Transactions touching an address, total received, balance."""
    received = raw.select("txid", F.explode("vout").alias("o")).select(
        "txid", F.col(f"o.{ADDRESS}").alias("address"), F.col("o.value").alias("funded"),
        F.lit(0).cast("bigint").alias("spent"))
    spent = raw.select("txid", F.explode("vin").alias("i")).select(
        "txid", F.col(f"i.prevout.{ADDRESS}").alias("address"),
        F.lit(0).cast("bigint").alias("funded"), F.col("i.prevout.value").alias("spent"))
    return received.unionByName(spent).filter("address is not null").groupBy("address").agg(
        F.count_distinct("txid").alias("tx_count"),
        F.sum("funded").alias("total_received_raw"),
        (F.sum("funded") - F.sum("spent")).alias("balance_raw"))


@dataclass(frozen=True)
class UtxoLedger:
    """Ledger for traces over raw transactions.  It keeps inputs and outputs
    apart and pairs them only for the wallets of a frontier, so transactions
    with many inputs and outputs never multiply as a whole."""
    raw: DataFrame
    asset: str = "BTC"
    decimals: int = 8

    def expand(self, frontier: DataFrame, direction: str) -> DataFrame:
        outs = self.raw.select("txid", F.col("status.block_time").alias("ts"),
                               F.explode("vout").alias("x")).select(
            "txid", "ts", F.col(f"x.{ADDRESS}").alias("who"), F.col("x.value").alias("v"))
        ins = self.raw.select("txid", F.col("status.block_time").alias("ts"),
                              F.explode("vin").alias("x")).select(
            "txid", "ts", F.col(f"x.prevout.{ADDRESS}").alias("who"),
            F.col("x.prevout.value").alias("v"))
        near, far = (outs, ins) if direction == S.BACKWARD else (ins, outs)
        touched = near.select("txid", F.col("who").alias("address")) \
            .join(frontier.filter(F.col("chain") == S.BITCOIN), "address").distinct()
        rows = touched.join(far.filter("who is not null"), "txid")
        return rows.select(
            *frontier.columns, F.col("who").alias("next_address"), "txid", "ts",
            F.lit(self.asset).alias("asset"),
            (F.col("v") / F.lit(float(10**self.decimals))).alias("value"),
            F.col("v").cast("decimal(38,0)").alias("value_raw"),
            (F.col("who") == F.col("address")).alias("is_self_transfer"),
            F.lit(None).cast("string").alias("transfer_kind"))

    def touching(self) -> DataFrame:
        """(chain, txid, ts, kind, address): every wallet that pays or is paid."""
        who = F.array_distinct(F.array_compact(F.concat(
            F.transform("vin", lambda i: i["prevout"][ADDRESS]),
            F.transform("vout", lambda o: o[ADDRESS]))))
        return self.raw.select(F.lit(S.BITCOIN).alias("chain"), "txid",
                               F.col("status.block_time").alias("ts"), F.lit("").alias("kind"),
                               F.explode(who).alias("address"))
