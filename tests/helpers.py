from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.operators import classify
from fundflow.operators.trace import TraceParams, trace_many
from fundflow.session import materialise

MOVE = "txid string, ts bigint, from_address string, to_address string, asset string, value_raw bigint"


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(),
          "double": pa.float64(), "boolean": pa.bool_()}


def frame(spark, rows, ddl):
    """Small table from tuples; through Arrow it stays a local relation."""
    fields = [c.strip().split() for c in ddl.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    table = pa.table({name: pa.array(list(col), _ARROW[kind])
                      for (name, kind), col in zip(fields, columns)})
    return spark.createDataFrame(table)


def movements(spark, rows, chain="fx"):
    df = frame(spark, rows, MOVE)
    return df.withColumns({
        "chain": F.lit(chain), "value": F.col("value_raw") / F.lit(100.0),
        "is_self_transfer": F.col("from_address") == F.col("to_address")})


def label_rows(spark, rows, chain="fx"):
    """rows: (address, entity, category, source, confidence)"""
    return frame(
        spark, [(a, chain, e, c, s, k, "2024-01-01T00:00:00+00:00") for a, e, c, s, k in rows],
        S.LABELS)


def facts(spark, labels=(), contracts=(), activity=(), flags=None):
    return materialise(classify.address_facts(
        label_rows(spark, labels), flags,
        frame(spark, [("fx", a) for a in contracts], "chain string, address string"),
        frame(spark, [("fx", a, n) for a, n in activity],
              "chain string, address string, activity bigint")), "facts", rebalance=False)


def seeds(spark, *addresses, chain="fx"):
    return frame(spark, [(i + 1, chain, a) for i, a in enumerate(addresses)],
                 "trace_id bigint, chain string, address string")


def run(spark, rows, seed="a", labels=(), **params):
    options = {"high_activity": None, "pattern": S.THOROUGH, **params}
    extra = {k: options.pop(k) for k in ("contracts", "activity") if k in options}
    return trace_many(movements(spark, rows), seeds(spark, seed),
                      facts(spark, labels, **extra), TraceParams(**options))


def edge_set(result):
    return {(r.depth, r.txid, r.from_address, r.to_address) for r in result.edges.collect()}


def node_map(result):
    return {r.address: r for r in result.nodes.collect()}
