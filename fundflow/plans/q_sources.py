"""Raw records to movements at table scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.amounts import hex_amount, to_units
from fundflow.operators.flows import exact_totals
from fundflow.functions.text import iso_text
from fundflow.plans import fixtures as X
from fundflow.plans import oracle as O
from fundflow.plans import runs as R
from fundflow.plans.catalog import query
from fundflow.sources import account as A
from fundflow.sources import ledger as L
from fundflow.sources import tron as TR
from fundflow.sources import utxo as U

_OUT = """
  SELECT 't' || o_orderkey AS txid, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts,
         'c' || o_custkey AS payer, CAST(round(o_totalprice * 100) AS BIGINT) AS paid,
         CASE WHEN l_returnflag <> 'N' THEN 's' || l_suppkey END AS payee,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS got
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""


@query("utxo_out", f"""
  SELECT txid, ts, payer AS from_address, payee AS to_address, got AS value_raw
  FROM ({_OUT}) WHERE payee IS NOT NULL""")
def utxo_out(spark, sf):
    return U.utxo_outgoing(X.raw_utxo(spark, sf)).select(
        "txid", "ts", "from_address", "to_address",
        F.col("value_raw").cast("bigint").alias("value_raw"))


@query("utxo_in", f"""
  SELECT DISTINCT txid, ts, payer AS from_address, payee AS to_address, paid AS value_raw
  FROM ({_OUT}) WHERE payee IS NOT NULL""")
def utxo_in(spark, sf):
    return U.utxo_incoming(X.raw_utxo(spark, sf)).select(
        "txid", "ts", "from_address", "to_address",
        F.col("value_raw").cast("bigint").alias("value_raw"))


@query("utxo_stats", f"""
  SELECT address, CAST(count(DISTINCT txid) AS BIGINT) AS tx_count,
         CAST(sum(funded) AS BIGINT) AS total_received_raw,
         CAST(sum(funded) - sum(spent) AS BIGINT) AS balance_raw
  FROM (SELECT payee AS address, txid, got AS funded, 0 AS spent FROM ({_OUT})
        UNION ALL SELECT payer, txid, 0, paid FROM (SELECT DISTINCT txid, payer, paid
          FROM ({_OUT}))) WHERE address IS NOT NULL GROUP BY 1""")
def utxo_stats(spark, sf):
    return U.utxo_stats(X.raw_utxo(spark, sf))


@query("utxo_tx_outputs", f"""
  SELECT txid, payer AS from_address, payee AS to_address, got AS value_raw
  FROM ({_OUT}) WHERE payee IS NOT NULL""")
def utxo_tx_outputs(spark, sf):
    return U.tx_outputs(X.raw_utxo(spark, sf)).select(
        "txid", "from_address", "to_address",
        F.col("value_raw").cast("bigint").alias("value_raw"))


@query("utxo_cospend", f"""
  SELECT txid, payer AS address, CAST(count(*) AS BIGINT) AS n_outputs,
         CAST(sum(got) AS BIGINT) AS out_raw FROM ({_OUT}) GROUP BY 1, 2""")
def utxo_cospend(spark, sf):
    rows = U.tx_cospend(X.raw_utxo(spark, sf))
    return rows.select("txid", F.explode("inputs").alias("address"),
                       F.size("outputs").cast("bigint").alias("n_outputs"),
                       F.aggregate("outputs", F.lit(0).cast("bigint"), lambda a, v: a + v)
                       .alias("out_raw"))


# -------------------------------------------------------------- account chain

_ACCOUNT = """
  SELECT 'h' || o_orderkey AS txid, o_orderkey AS k, '0xa' || o_custkey AS sender,
         CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '0xb' || o_orderkey % 97 END AS receiver,
         CASE WHEN o_orderkey % 7 = 0 THEN 0
              ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents,
         CASE WHEN o_orderkey % 11 = 0 THEN 0
              ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS sec FROM orders"""
_WEI = "0000000000000000"


def _account_base(spark, sf):
    k = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select(
        F.concat(F.lit("h"), k).alias("hash"), k.alias("k"),
        F.concat(F.lit("0xA"), "o_custkey").alias("from"),
        F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("0xB"), k % 97)).alias("to"),
        F.when(k % 7 == 0, F.lit(0).cast("bigint")).otherwise(X.cents("o_totalprice"))
        .alias("cents"),
        F.when(k % 11 == 0, F.lit(0).cast("bigint")).otherwise(X.epoch("o_orderdate"))
        .cast("string").alias("timeStamp"))


@query("account_native", f"""
  SELECT txid, nullif(sec, 0) AS ts, sender AS from_address, receiver AS to_address,
         CAST(cents AS VARCHAR) || '{_WEI}' AS wei
  FROM ({_ACCOUNT}) WHERE receiver <> '' AND cents > 0 AND k % 5 <> 0""")
def account_native(spark, sf):
    raw = _account_base(spark, sf).withColumns({
        "value": F.concat(F.col("cents").cast("string"), F.lit(_WEI)),
        "isError": F.when(F.col("k") % 5 == 0, "1").otherwise("0")})
    return A.account_native(raw).select("txid", "ts", "from_address", "to_address",
                                        F.col("value_raw").cast("string").alias("wei"))


_USDT = A.TOKEN_REGISTRY[0][0]


@query("account_tokens", f"""
  SELECT txid, sender AS from_address, receiver AS to_address,
         CASE k % 3 WHEN 0 THEN 'USDT' WHEN 1 THEN 'TKN' ELSE 'ERC20' END AS asset,
         cents AS value_raw, cents / pow(10.0::DOUBLE, CASE k % 3 WHEN 0 THEN 6 WHEN 1 THEN 8
           ELSE 18 END) AS value FROM ({_ACCOUNT}) WHERE receiver <> ''""")
def account_tokens(spark, sf):
    third = F.col("k") % 3
    raw = _account_base(spark, sf).withColumns({
        "contractAddress": F.when(third == 0, _USDT.upper().replace("0X", "0x"))
        .otherwise(F.concat(F.lit("0xC"), third)),
        "tokenSymbol": F.when(third == 1, "TKN").when(third == 0, "fake").otherwise(""),
        "tokenDecimal": F.when(third == 1, "8").when(third == 0, "2").otherwise("many"),
        "value": F.col("cents").cast("string")})
    return A.account_tokens(raw).select(
        "txid", "from_address", "to_address", "asset",
        F.col("value_raw").cast("bigint").alias("value_raw"), "value")


# Three blocks of 26 digits for each token amount, summed apart and carried in SQL.
_BLOCKS = f"""
  SELECT receiver, lpad(CAST(cents AS VARCHAR), 26, '7') AS a, lpad(CAST(k AS VARCHAR), 26, '9') AS b,
         lpad(CAST(cents AS VARCHAR), 26, '8') AS c FROM ({_ACCOUNT}) WHERE receiver <> ''"""


@query("amounts_wide", f"""
  SELECT to_address, n_movements, ltrim(CAST(a AS VARCHAR) || lpad(CAST(b AS VARCHAR), 26, '0')
         || lpad(CAST(c AS VARCHAR), 26, '0'), '0') AS total, largest FROM (
    SELECT receiver AS to_address, CAST(count(*) AS BIGINT) AS n_movements, max(a || b || c) AS largest,
           sum(CAST(c AS HUGEINT)) % 100000000000000000000000000::HUGEINT AS c,
           (sum(CAST(b AS HUGEINT)) + sum(CAST(c AS HUGEINT)) // 100000000000000000000000000::HUGEINT)
             % 100000000000000000000000000::HUGEINT AS b,
           sum(CAST(a AS HUGEINT)) + (sum(CAST(b AS HUGEINT))
             + sum(CAST(c AS HUGEINT)) // 100000000000000000000000000::HUGEINT)
             // 100000000000000000000000000::HUGEINT AS a
    FROM ({_BLOCKS}) GROUP BY 1)""")
def amounts_wide(spark, sf):
    """Token amounts of 78 digits: exact totals and largest amount of every receiver."""
    cents, k = F.col("cents").cast("string"), F.col("k").cast("string")
    raw = _account_base(spark, sf).withColumns({
        "contractAddress": F.lit("0xC"), "tokenSymbol": F.lit("TKN"), "tokenDecimal": F.lit("18"),
        "value": F.concat(F.lpad(cents, 26, "7"), F.lpad(k, 26, "9"), F.lpad(cents, 26, "8"))})
    return exact_totals(A.account_tokens(raw), "to_address").select(
        "to_address", "n_movements", "total", "largest")


@query("indexed_transfers", f"""
  SELECT txid, nullif(sec, 0) AS ts, sender AS from_address, receiver AS to_address,
         cents AS value_raw, CASE WHEN k % 2 = 0 THEN 'ETH' ELSE 'TKN' END AS asset,
         CASE WHEN k % 2 = 0 THEN 'native' ELSE 'token' END AS transfer_kind
  FROM ({_ACCOUNT}) WHERE receiver <> '' AND cents > 0""")
def indexed_transfers(spark, sf):
    even = F.col("k") % 2 == 0
    stamp = F.when(F.col("timeStamp") != "0", F.regexp_replace(
        iso_text(F.col("timeStamp").cast("bigint")), "^(.*) (.*) UTC$", "$1T$2.000Z"))
    raw = _account_base(spark, sf).select(
        F.when(even, "external").otherwise("erc20").alias("category"), "from", "to", "hash",
        F.when(even, "ETH").otherwise("TKN").alias("asset"),
        F.struct(F.concat(F.lit("0x"), F.lower(F.hex("cents"))).alias("value"),
                 F.lit("0xC1").alias("address"), F.lit("0x6").alias("decimal"))
        .alias("rawContract"), F.struct(stamp.alias("blockTimestamp")).alias("metadata"))
    return A.indexed_transfers(raw).select(
        "txid", "ts", "from_address", "to_address",
        F.col("value_raw").cast("bigint").alias("value_raw"), "asset", "transfer_kind")


@query("account_focus", f"""
  SELECT txid, from_address, to_address, asset FROM (
    SELECT txid, sender AS from_address, receiver AS to_address, 'ETH' AS asset FROM ({_ACCOUNT})
    WHERE receiver <> '' AND cents > 0 AND k % 13 = 4
    UNION ALL SELECT txid, sender, receiver, 'TKN' FROM ({_ACCOUNT})
    WHERE receiver <> '' AND k % 13 = 4
    UNION ALL SELECT txid, receiver, sender, 'TKN' FROM ({_ACCOUNT})
    WHERE receiver <> '' AND k % 13 = 4)""")
def account_focus(spark, sf):
    """Token legs out of and into the sender count; a third party's does not."""
    base = _account_base(spark, sf)
    heads = base.withColumns({"value": F.col("cents").cast("string"), "isError": F.lit("0")})
    token = base.withColumns({
        "contractAddress": F.lit("0xC"), "tokenSymbol": F.lit("TKN"),
        "tokenDecimal": F.lit("6"), "value": F.col("cents").cast("string")})
    back = token.withColumn("_f", F.col("from")).withColumn("from", F.col("to")) \
        .withColumn("to", F.col("_f")).drop("_f")
    other = token.withColumn("from", F.lit("0xZ"))
    tokens = token.unionByName(back).unionByName(other)
    wanted = base.filter("k % 13 = 4").select(F.col("hash").alias("txid"))
    return A.account_focus(heads, tokens, wanted).select(
        "txid", "from_address", "to_address", "asset")


@query("contract_registry", """
  SELECT '0x' || s_suppkey AS address FROM supplier WHERE s_suppkey % 4 IN (1, 2)""")
def contract_registry(spark, sf):
    k = F.col("s_suppkey") % 4
    code = X.table(spark, sf, "supplier").select(
        F.concat(F.lit("0X"), "s_suppkey").alias("address"),
        F.when(k == 0, "0x").when(k == 3, "0xEF0100aa").otherwise("0x6080").alias("code"))
    return A.contracts(code).select("address")


# ----------------------------------------------------------------------- tron

# Base58check of the address of each number: five limbs of 40 bits, divided by 58
# once for each of the 34 characters.
_BASE58 = """
  b58 AS (
    SELECT n, 0 AS i, '' AS txt, CAST('0x' || substr(h, 1, 10) AS BIGINT) AS a1,
           CAST('0x' || substr(h, 11, 10) AS BIGINT) AS a2, CAST('0x' || substr(h, 21, 10) AS BIGINT) AS a3,
           CAST('0x' || substr(h, 31, 10) AS BIGINT) AS a4, CAST('0x' || substr(h, 41, 10) AS BIGINT) AS a5
    FROM (SELECT n, h || substr(sha256(unhex(sha256(unhex(h)))), 1, 8) AS h FROM (
      SELECT n, '41' || lpad(lower(to_hex(n)), 40, '0') AS h
      FROM (SELECT k AS n FROM acc UNION SELECT k + 1 FROM acc)))
    UNION ALL
    SELECT n, i + 1, substr('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz',
                            CAST(r5 AS INTEGER) + 1, 1) || txt, q1, q2, q3, q4, q5
    FROM (SELECT n, i, txt, a1 // 58 AS q1, a1 % 58 AS r1,
            (r1 * 1099511627776 + a2) // 58 AS q2, (r1 * 1099511627776 + a2) % 58 AS r2,
            (r2 * 1099511627776 + a3) // 58 AS q3, (r2 * 1099511627776 + a3) % 58 AS r3,
            (r3 * 1099511627776 + a4) // 58 AS q4, (r3 * 1099511627776 + a4) % 58 AS r4,
            (r4 * 1099511627776 + a5) // 58 AS q5, (r4 * 1099511627776 + a5) % 58 AS r5
          FROM b58 WHERE i < 34))"""


@query("tron_native", f"""
  WITH RECURSIVE acc AS ({_ACCOUNT}), {_BASE58}
  SELECT txid, nullif(sec, 0) AS ts, cents AS value_raw, k % 2 = 0 AS is_self_transfer,
         f.txt AS from_address, t.txt AS to_address
  FROM acc JOIN b58 f ON f.n = k AND f.i = 34
  JOIN b58 t ON t.n = CASE WHEN k % 2 = 0 THEN k ELSE k + 1 END AND t.i = 34
  WHERE cents > 0 AND k % 5 <> 0""")
def tron_native(spark, sf):
    k = F.col("k")

    def address(n):
        return F.concat(F.lit("41"), F.lpad(F.lower(F.hex(n)), 40, "0"))
    value = F.struct(F.col("cents").alias("amount"), address(k).alias("owner_address"),
                     address(F.when(k % 2 == 0, k).otherwise(k + 1)).alias("to_address"))
    kind = F.when(k % 5 == 0, "TriggerSmartContract").otherwise("TransferContract")
    raw = _account_base(spark, sf).select(
        F.col("hash").alias("txID"),
        (F.col("timeStamp").cast("bigint") * 1000).alias("block_timestamp"),
        F.struct(F.array(F.struct(kind.alias("type"), F.struct(value.alias("value"))
                                  .alias("parameter"))).alias("contract")).alias("raw_data"))
    return TR.tron_native(raw).select(
        "txid", "ts", F.col("value_raw").cast("bigint").alias("value_raw"),
        "is_self_transfer", "from_address", "to_address")


@query("tron_tokens", f"""
  SELECT txid, sender AS from_address, receiver AS to_address, cents AS value_raw,
         CASE WHEN k % 3 = 0 THEN 'USDT' WHEN k % 3 = 1 THEN 'JST' ELSE 'TRC20' END AS asset,
         cents / pow(10.0::DOUBLE, CASE WHEN k % 3 = 1 THEN 4 ELSE 6 END) AS value
  FROM ({_ACCOUNT}) WHERE receiver <> '' AND k % 10 <> 0""")
def tron_tokens(spark, sf):
    third = F.col("k") % 3
    token = F.struct(
        F.when(third == 0, TR.USDT_CONTRACT).otherwise("Tx").alias("address"),
        F.when(third == 0, "fake").when(third == 1, "JST").otherwise("").alias("symbol"),
        F.when(third == 1, "4").when(third == 0, "9").alias("decimals"))
    raw = _account_base(spark, sf).select(
        F.lit("Transfer").alias("type"), F.lower("from").alias("from"),
        F.lower("to").alias("to"), F.col("hash").alias("transaction_id"),
        F.when(F.col("k") % 10 == 0, "n/a").otherwise(F.col("cents").cast("string"))
        .alias("value"), (F.col("timeStamp").cast("bigint") * 1000).alias("block_timestamp"),
        token.alias("token_info"))
    return TR.tron_tokens(raw).select(
        "txid", "from_address", "to_address",
        F.col("value_raw").cast("bigint").alias("value_raw"), "asset", "value")


# --------------------------------------------------------------------- ledger

@query("unified_ledger", O.with_fx(["fx_moves", "fx_ledger"], """
  SELECT asset, CAST(count(*) AS BIGINT) AS n, CAST(sum(raw) AS VARCHAR) AS total,
         CAST(count(DISTINCT src) AS BIGINT) AS senders
  FROM (SELECT * FROM fx_moves UNION ALL SELECT * FROM fx_ledger) GROUP BY 1"""))
def unified_ledger(spark, sf):
    both = L.movements(X.moves(spark, sf), X.ledger(spark, sf))
    return both.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_raw").cast("string").alias("total"),
        F.count_distinct("from_address").alias("senders"))


@query("address_activity", O.with_fx(["fx_ledger_facts"],
                                     "SELECT address, activity FROM fx_ledger_facts"))
def address_activity(spark, sf):
    return L.address_activity(X.ledger(spark, sf)).select("address", "activity")


@query("address_sent_count", O.with_fx(["fx_moves"], """
  SELECT src AS address, count(DISTINCT txid) AS activity FROM fx_moves GROUP BY 1"""))
def address_sent_count(spark, sf):
    return L.address_activity(X.moves(spark, sf), "sent").select("address", "activity")


@query("token_scale", f"""
  SELECT txid, cents AS raw, cents / pow(10.0::DOUBLE, CAST(k % 19 AS INTEGER)) AS value
  FROM ({_ACCOUNT})""")
def token_scale(spark, sf):
    rows = _account_base(spark, sf)
    exact = hex_amount(F.concat(F.lit("0x"), F.hex("cents"))).cast("bigint")
    return rows.select(F.col("hash").alias("txid"), exact.alias("raw"),
                       to_units(F.col("cents"), F.col("k") % 19).alias("value"))


@query("trace_utxo_edges", O.with_fx([], f"""
  SELECT CAST(1 AS BIGINT) AS trace_id, txid, payer AS from_address, payee AS to_address,
         got AS value_raw
  FROM ({_OUT}) WHERE payee IS NOT NULL AND payer = 'c1' AND got >= 10000
  AND payee <> payer"""))
def trace_utxo_edges(spark, sf):
    """One hop over raw transactions, without building pairwise movements."""
    from fundflow.operators.trace import TraceParams, trace_many
    seeds = spark.range(1).select(
        F.lit(1).cast("bigint").alias("trace_id"), F.lit(S.BITCOIN).alias("chain"),
        F.lit("c1").alias("address"))
    run = trace_many(U.UtxoLedger(X.raw_utxo(spark, sf)), seeds, R.facts(spark, sf),
                     TraceParams(pattern=S.THOROUGH, max_depth=1))
    return run.edges.select("trace_id", "txid", "from_address", "to_address",
                            F.col("value_raw").cast("bigint").alias("value_raw"))
