"""Account-chain records (native, token, indexed transfers) to movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions import wide
from fundflow.functions.amounts import (
    hex_amount, hex_double, is_oversize, parse_amount, parse_limbs)

# ---- fixed values --------------------------------------------------------
TOKEN_REGISTRY = (
    ("0xdac17f958d2ee523a2206206994597c13d831ec7", "USDT", 6),
    ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "USDC", 6),
)
DELEGATION_PREFIX = "0xef0100"
INDEXED_KINDS = ("external", "internal", "erc20")
# ---- end of fixed values -------------------------------------------------


def token_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(TOKEN_REGISTRY), "token_contract string, symbol string, decimals int")


def vetted(contract: Column, symbol: Column, decimals: Column,
           registry=TOKEN_REGISTRY) -> tuple[Column, Column]:
    """Symbol and decimals of a token: the registry's, else the reported ones.
    The registry is a handful of constants, so it is a condition, not a join."""
    for address, name, places in registry:
        symbol = F.when(contract == address, F.lit(name)).otherwise(symbol)
        decimals = F.when(contract == address, F.lit(places)).otherwise(decimals)
    return symbol, decimals


def _low(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def _seconds(column: str) -> Column:
    value = F.col(column).try_cast("bigint")
    return F.when(value != 0, value)


def _movements(df: DataFrame, chain: str) -> DataFrame:
    return df.filter((F.col("from_address") != "") & (F.col("to_address") != "")).select(
        F.lit(chain).alias("chain"), "txid", "ts", "from_address", "to_address", "asset",
        "value", "value_raw",
        (F.col("from_address") == F.col("to_address")).alias("is_self_transfer"),
        "token_contract", "transfer_kind", "oversize", "value_limbs")


def account_native(raw: DataFrame, chain: str = S.ETHEREUM) -> DataFrame:
    """Successful native transfers of a positive value with a receiver.  One
    table serves both directions."""
    raw_value = parse_amount(F.coalesce("value", F.lit("0")))
    rows = raw.filter((F.coalesce("isError", F.lit("0")) != "1")).select(
        F.col("hash").alias("txid"), _seconds("timeStamp").alias("ts"),
        _low("from").alias("from_address"), _low("to").alias("to_address"),
        F.lit("ETH").alias("asset"),
        (F.col("value").try_cast("double") / F.lit(1e18)).alias("value"),
        raw_value.alias("value_raw"), F.lit(None).cast("string").alias("token_contract"),
        F.lit("native").alias("transfer_kind"), is_oversize(F.col("value")).alias("oversize"),
        parse_limbs(F.coalesce("value", F.lit("0"))).alias("value_limbs"))
    return _movements(rows.filter("oversize or value_raw > 0"), chain)


def account_tokens(raw: DataFrame, chain: str = S.ETHEREUM) -> DataFrame:
    """Token transfers; zero-value rows stay.  Unreadable decimals mean 18."""
    contract = _low("contractAddress")
    reported = F.coalesce(F.when(F.col("tokenSymbol") != "", F.col("tokenSymbol")),
                          F.lit("ERC20"))
    symbol, decimals = vetted(contract, reported, F.coalesce(
        F.col("tokenDecimal").try_cast("int"), F.lit(18)))
    amount = F.coalesce("value", F.lit("0"))
    rows = raw.select(
        F.col("hash").alias("txid"), _seconds("timeStamp").alias("ts"),
        _low("from").alias("from_address"), _low("to").alias("to_address"),
        symbol.alias("asset"),
        (amount.try_cast("double") / F.pow(F.lit(10.0), decimals.cast("double")))
        .alias("value"),
        parse_amount(amount).alias("value_raw"), contract.alias("token_contract"),
        F.lit("token").alias("transfer_kind"), is_oversize(amount).alias("oversize"),
        parse_limbs(amount).alias("value_limbs"))
    return _movements(rows, chain)


def indexed_transfers(raw: DataFrame, chain: str = S.ETHEREUM) -> DataFrame:
    """External, internal and token transfers of an index: hex amounts, ISO
    times; values of zero or less are dropped."""
    is_token = F.col("category") == "erc20"
    contract = F.when(is_token, F.lower(F.coalesce("rawContract.address", F.lit(""))))
    hex_places = F.coalesce("rawContract.decimal", F.lit("0x12"))
    places = F.when(hex_places.rlike("^(0x)?[0-9a-fA-F]{1,4}$"), F.conv(
        F.regexp_replace(hex_places, "^0x", ""), 16, 10).cast("int")).otherwise(F.lit(18))
    reported = F.coalesce(F.when(F.col("asset") != "", F.col("asset")), F.lit("ERC20"))
    symbol, decimals = vetted(contract, reported, places)
    symbol = F.when(is_token, symbol).otherwise(F.lit("ETH"))
    decimals = F.when(is_token, decimals).otherwise(F.lit(18))
    amount = F.col("rawContract.value")
    exact, approx = hex_amount(amount), hex_double(amount)
    stamp = F.try_to_timestamp(F.col("metadata.blockTimestamp"))
    rows = raw.filter(F.col("category").isin(*INDEXED_KINDS)).select(
        F.col("hash").alias("txid"), F.unix_seconds(stamp).alias("ts"),
        _low("from").alias("from_address"), _low("to").alias("to_address"),
        symbol.alias("asset"),
        (approx / F.pow(F.lit(10.0), decimals.cast("double"))).alias("value"),
        exact.alias("value_raw"), contract.alias("token_contract"),
        F.when(is_token, "token").otherwise("native").alias("transfer_kind"),
        (exact.isNull() & approx.isNotNull()).alias("oversize"),
        wide.from_hex(amount).alias("value_limbs"))
    return _movements(rows.filter("oversize or value_raw > 0"), chain)


def account_focus(heads: DataFrame, tokens: DataFrame, txids: DataFrame,
                  chain: str = S.ETHEREUM) -> DataFrame:
    """Legs of chosen transactions: the native transfer of the head plus the
    token legs of the same hash that touch its sender."""
    wanted = txids.select(F.lower("txid").alias("txid")).distinct()
    head = heads.withColumn("hash", F.lower("hash")).join(
        wanted.withColumnRenamed("txid", "hash"), "hash", "left_semi")
    native = account_native(head, chain)
    senders = head.select(F.col("hash").alias("txid"), _low("from").alias("_sender"))
    legs = account_tokens(tokens.withColumn("hash", F.lower("hash")), chain) \
        .join(senders, "txid").filter(
        (F.col("from_address") == F.col("_sender"))
        | (F.col("to_address") == F.col("_sender"))).drop("_sender")
    return native.unionByName(legs).withColumn("is_self_transfer", F.lit(False))


def contracts(code: DataFrame, chain: str = S.ETHEREUM) -> DataFrame:
    """Addresses holding contract code; delegated personal wallets do not."""
    text = F.lower(F.coalesce("code", F.lit("")))
    return code.filter(~text.isin("", "0x", "0x0") & ~text.startswith(DELEGATION_PREFIX)) \
        .select(F.lit(chain).alias("chain"), F.lower("address").alias("address"))
