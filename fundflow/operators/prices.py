"""USD valuation by UTC day.  Missing prices are reported, never guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.amounts import peg, usd_cents
from fundflow.functions.text import utc_date


def daily_first(ticks: DataFrame, order: Column | None = None,
                ts: str = "ts") -> DataFrame:
    """First price of each UTC day from (asset, ts seconds, usd) ticks."""
    order = F.struct(ts) if order is None else order
    return ticks.groupBy("asset", utc_date(F.col(ts)).alias("date")).agg(
        F.min_by("usd", order).alias("usd"))


def daily_open(candles: DataFrame) -> DataFrame:
    """Daily open from (asset, candle) where candle is a numeric array: either
    [time, open, ...] or [time, low, high, open, close, volume]; the caller
    names the position of the open in ``open_at``."""
    day = F.element_at("candle", 1).cast("bigint")
    usd = F.try_element_at("candle", F.col("open_at") + 1)
    return candles.filter(day.isNotNull() & usd.isNotNull()).groupBy(
        "asset", utc_date(day).alias("date")).agg(F.max_by(usd, day).alias("usd"))


def needed_keys(edges: DataFrame, priced=S.PRICED_ASSETS) -> DataFrame:
    """Distinct (asset, date) a valuation needs a price for."""
    return edges.filter(F.col("asset").isin(*priced)
                        & (F.coalesce(F.col("ts"), F.lit(0)) != 0)) \
        .select("asset", utc_date(F.col("ts")).alias("date")).distinct()


def fill_prices(needed: DataFrame, *feeds: tuple[str, DataFrame]) -> DataFrame:
    """Price of every needed key from the first feed that has it."""
    tagged = [feed.select("asset", "date", "usd", F.lit(i).alias("priority"),
                          F.lit(name).alias("source"))
              for i, (name, feed) in enumerate(feeds)]
    supplied = reduce(DataFrame.unionByName, tagged)
    best = supplied.filter(F.col("usd").isNotNull()).groupBy("asset", "date").agg(
        F.min_by(F.struct("usd", "source"), "priority").alias("p"))
    return needed.join(best, ["asset", "date"]).select(
        "asset", "date", "p.usd", "p.source")


def missing_prices(needed: DataFrame, prices: DataFrame) -> DataFrame:
    return needed.join(prices, ["asset", "date"], "left_anti")


def value_usd(edges: DataFrame, prices: DataFrame,
              pegged=S.STABLECOINS) -> DataFrame:
    """Edges with ``usd_cents`` (null when no price is known) and the day used.

    The price table has one row per asset and day, so its size is bounded by
    the calendar; the join strategy is still left to its measured size."""
    day = F.when(F.coalesce(F.col("ts"), F.lit(0)) != 0, utc_date(F.col("ts")))
    is_pegged = peg(F.col("asset"), pegged)
    # Movements that need no price can be most of the ledger.  They get keys
    # that match nothing but differ, so they do not pile up on a null key.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("txid"), F.lit(997)))
    key = F.when(~is_pegged & day.isNotNull(), F.col("asset")).otherwise(spread)
    priced = edges.withColumns({"_key": key, "_day": day}).join(
        prices.select(F.col("asset").alias("_asset"), F.col("date").alias("_date"),
                      F.col("usd").alias("_usd")),
        (F.col("_key") == F.col("_asset")) & (F.col("_day") == F.col("_date")), "left")
    price = F.when(is_pegged, F.lit(1.0)).otherwise(F.col("_usd"))
    used = F.when(is_pegged, F.lit("pegged $1.00")) \
        .when(F.col("_usd").isNotNull(), F.col("_day").cast("string"))
    return priced.withColumn("usd_cents", usd_cents(F.col("value"), price)) \
        .withColumn("usd_price_date", used) \
        .drop("_key", "_day", "_asset", "_date", "_usd")
