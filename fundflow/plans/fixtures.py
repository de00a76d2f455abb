"""Ledgers, labels and prices projected from the given tables.

The same definitions exist as SQL text in ``oracle.py``; both sides read the
whole tables.  Amounts are whole cents, times are unix seconds in UTC.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.functions.files import file_tasks, new_folder, write_lines
from fundflow.session import shuffled

CHAIN = "fx"
EVENT_ASSETS_PEGGED = ("purchase",)
ENTITIES = ("Kraken", "Binance", "Binance.US", "Coinbase", "Gemini", "Bybit")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# tasks move their files to the end place themselves, not the driver one by one
MOVED_BY_TASKS = "mapreduce.fileoutputcommitter.algorithm.version", "2"


def write_each(df: DataFrame, key: str, path: str, together: bool = False) -> None:
    """One text file per ``key``, written by the tasks themselves: in a folder of its own or,
    ``together``, in few folders with the key in the file's name, which takes less time and disk."""
    spark = df.sparkSession
    dealt, top = df.repartition(file_tasks(spark), key), new_folder(spark, path)
    if top is None:
        dealt.write.mode("append").option(*MOVED_BY_TASKS).partitionBy(key).text(path)
        return
    line, = (c for c in df.columns if c != key)
    dealt.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("key"),
                 F.col(line).cast("binary").alias("line")).sortWithinPartitions("key", "line").mapInArrow(
        write_lines(top, key, uuid.uuid4().hex, together), "files bigint").write.format("noop").mode("overwrite").save()


def epoch(col: str) -> Column:
    """Seconds of a zone-free timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def _movement(df: DataFrame) -> DataFrame:
    return df.withColumn("chain", F.lit(CHAIN)) \
        .withColumn("value", F.col("value_raw") / F.lit(100.0)) \
        .withColumn("is_self_transfer", F.col("from_address") == F.col("to_address"))


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """Closed wallet graph from ``events``."""
    to = F.get_json_object("props", "$.k")
    return _movement(table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("txid"), epoch("ts").alias("ts"),
        F.concat(F.lit("u"), "user_id").alias("from_address"),
        F.concat(F.lit("u"), to).alias("to_address"),
        F.col("event_type").alias("asset"), cents("value").alias("value_raw")))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Deposits (customer to order) and sweeps (odd orders to a nation)."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", epoch("o_orderdate").alias("ts"),
        cents("o_totalprice").alias("raw"))
    deposits = orders.select(
        F.concat(F.lit("p"), "o_orderkey").alias("txid"), "ts",
        F.concat(F.lit("c"), "o_custkey").alias("from_address"),
        F.concat(F.lit("o"), "o_orderkey").alias("to_address"),
        F.col("raw").alias("value_raw"))
    nation = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    sweeps = orders.filter(F.col("o_orderkey") % 2 == 1).join(shuffled(nation), "o_custkey").select(
        F.concat(F.lit("s"), "o_orderkey").alias("txid"),
        (F.col("ts") + (F.col("o_orderkey") % 120) * 3600).alias("ts"),
        F.concat(F.lit("o"), "o_orderkey").alias("from_address"),
        F.concat(F.lit("n"), "c_nationkey").alias("to_address"),
        F.expr("raw * (80 + o_orderkey % 21) div 100").alias("value_raw"))
    return _movement(deposits.unionByName(sweeps).withColumn("asset", F.lit("USDT")))


def wallets(movements: DataFrame) -> DataFrame:
    return movements.select(F.explode(F.array("from_address", "to_address"))
                            .alias("address")).distinct() \
        .withColumn("i", F.expr("substring(address, 2)").cast("bigint"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Attribution rules on the wallet numbers of ``moves``, in one pass."""
    i = F.col("i")
    entity = F.get(F.array(*[F.lit(e) for e in ENTITIES]),
                   F.floor(i / 10).cast("int") % len(ENTITIES))

    def rule(test, name, category, source, confidence):
        return F.when(test, F.struct(
            name.alias("entity_name"), F.lit(category).alias("category"),
            F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))

    def numbered(prefix):
        return F.concat(F.lit(prefix), i.cast("string"))
    rules = F.array_compact(F.array(
        rule((i % 40 == 9) | (i % 60 == 27), numbered("SDN "), "sanctioned", "ofac_sdn",
             "high"),
        rule(i % 25 == 3, numbered("Mixer "), "mixer", "tagpack", "medium"),
        rule(i % 10 == 7, entity, "exchange", "seed", "medium"),
        rule(i % 20 == 4, numbered("Report "), "scam_report", "blacklist", "medium"),
        rule(i % 35 == 2, numbered("Flagged by X: "), "shared_flag", "pack:x", "medium")))
    return wallets(moves(spark, sf)).select("address", F.explode(rules).alias("l")).select(
        "address", F.lit(CHAIN).alias("chain"), "l.*")


def flags(spark: SparkSession, sf: str) -> DataFrame:
    w = wallets(moves(spark, sf)).filter(F.col("i") % 30 == 1)
    return w.select("address", F.lit(CHAIN).alias("chain"),
                    F.concat(F.lit("reason "), F.col("i").cast("string")).alias("reason"),
                    (F.col("i") % 7).alias("case_id"),
                    F.lit("2024-01-15T00:00:00+00:00").alias("created_utc"))


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    return wallets(moves(spark, sf)).filter(F.col("i") % 50 == 12) \
        .select(F.lit(CHAIN).alias("chain"), "address")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One case per nation."""
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("N-"), "n_nationkey").alias("case_number"))


def price_feed(spark: SparkSession, sf: str, feed: int) -> DataFrame:
    """(asset, date, usd) of one feed, with its own missing days."""
    from fundflow.operators.prices import daily_first
    day = F.col("date")
    if feed == 1:
        ticks = table(spark, sf, "events").select(
            F.col("event_type").alias("asset"), epoch("ts").alias("sec"),
            F.col("value").alias("usd"), "ts")
        out = daily_first(ticks.withColumnRenamed("sec", "ts_seconds"),
                          order=F.struct("ts"), ts="ts_seconds")
        return out.filter(F.dayofmonth(day) % 7 != 0)
    from fundflow.functions.text import utc_date
    out = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("asset"), utc_date(epoch("ts")).alias("date")).agg(
        (F.floor(F.sum(cents("value")) / F.count(F.lit(1)) + 0.5) / 100.0).alias("usd"))
    return out.filter(F.dayofmonth(day) % 14 != 0)


def cospend(spark: SparkSession, sf: str) -> DataFrame:
    """(txid, address) inputs of every line: customers whose lines share supplier,
    day and one of five part bands, which keep the groups narrow."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.concat_ws("|", "l_suppkey", F.to_date("l_shipdate"),
                                  F.col("l_partkey") % 5).alias("txid"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(shuffled(orders), "l_orderkey").select(
        "txid", F.concat(F.lit("c"), "o_custkey").alias("address")).distinct()


def coinjoin_inputs(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", _month_tx().alias("txid"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(shuffled(orders), "l_orderkey").select(
        "txid", F.concat(F.lit("c"), "o_custkey").alias("address")).distinct()


def coinjoin_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        _month_tx().alias("txid"), F.col("l_quantity").cast("bigint").alias("value"))


def _month_tx() -> Column:
    return F.concat_ws("|", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM"))


def raw_utxo(spark: SparkSession, sf: str) -> DataFrame:
    """One transaction per order: the customer pays, its lines receive."""
    no_addr = F.col("l_returnflag") == "N"
    vout = F.struct(
        F.when(~no_addr, F.concat(F.lit("s"), "l_suppkey")).alias("scriptpubkey_address"),
        cents("l_extendedprice").alias("value"))
    outs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(vout)).alias("vout"))
    vin = F.struct(F.struct(
        F.concat(F.lit("c"), "o_custkey").alias("scriptpubkey_address"),
        cents("o_totalprice").alias("value")).alias("prevout"))
    return table(spark, sf, "orders").join(
        outs, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("t"), "o_orderkey").alias("txid"),
        F.struct(epoch("o_orderdate").alias("block_time")).alias("status"),
        F.array(vin).alias("vin"), "vout")
