"""Tron native and token records to movements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.amounts import is_oversize, parse_amount, parse_limbs
from fundflow.functions.text import strip
from fundflow.functions.base58 import base58check

# ---- fixed values --------------------------------------------------------
USDT_CONTRACT = "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"
# ---- end of fixed values -------------------------------------------------


def _seconds():
    return F.when(F.col("block_timestamp") != 0,
                  F.floor(F.col("block_timestamp") / 1000)).cast("bigint")


def tron_native(raw: DataFrame) -> DataFrame:
    """Plain transfers of a positive amount; hex addresses become base58."""
    first = F.get("raw_data.contract", F.lit(0))
    value = first["parameter"]["value"]
    rows = raw.filter(first["type"] == "TransferContract").select(
        F.coalesce("txID", F.lit("")).alias("txid"), _seconds().alias("ts"),
        value["owner_address"].alias("owner"), value["to_address"].alias("dest"),
        value["amount"].alias("amount")) \
        .filter("amount > 0 and owner <> '' and dest <> ''")
    named = rows.withColumn("from_address", base58check("owner")) \
        .withColumn("to_address", base58check("dest")) \
        .filter("from_address is not null and to_address is not null")
    return named.select(
        F.lit(S.TRON).alias("chain"), "txid", "ts", "from_address", "to_address",
        F.lit("TRX").alias("asset"), (F.col("amount") / F.lit(1e6)).alias("value"),
        F.col("amount").cast("decimal(38,0)").alias("value_raw"),
        (F.col("from_address") == F.col("to_address")).alias("is_self_transfer"),
        F.lit(None).cast("string").alias("token_contract"),
        F.lit("native").alias("transfer_kind"), F.lit(False).alias("oversize"),
        F.lit(None).cast("array<bigint>").alias("value_limbs"))


def tron_tokens(raw: DataFrame) -> DataFrame:
    """Token transfers; an amount that is no integer drops the row."""
    contract = F.coalesce("token_info.address", F.lit(""))
    reported = F.coalesce(F.when(F.col("token_info.symbol") != "",
                                 F.col("token_info.symbol")), F.lit("TRC20"))
    vetted = contract == USDT_CONTRACT
    places = F.when(vetted, F.lit(6)).otherwise(
        F.coalesce(F.col("token_info.decimals").try_cast("int"), F.lit(6)))
    amount = F.coalesce("value", F.lit("0"))
    return raw.filter(
        (F.col("type") == "Transfer") & (F.coalesce("from", F.lit("")) != "")
        & (F.coalesce("to", F.lit("")) != "") & strip(amount).rlike("^[0-9]+$")).select(
        F.lit(S.TRON).alias("chain"), F.coalesce("transaction_id", F.lit("")).alias("txid"),
        _seconds().alias("ts"), F.col("from").alias("from_address"),
        F.col("to").alias("to_address"),
        F.when(vetted, "USDT").otherwise(reported).alias("asset"),
        (amount.try_cast("double") / F.pow(F.lit(10.0), places.cast("double")))
        .alias("value"), parse_amount(amount).alias("value_raw"),
        (F.col("from") == F.col("to")).alias("is_self_transfer"),
        contract.alias("token_contract"), F.lit("token").alias("transfer_kind"),
        is_oversize(amount).alias("oversize"), parse_limbs(amount).alias("value_limbs"))
