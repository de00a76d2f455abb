"""Session settings and lineage cutting.

Iterative jobs (hops of a trace, rounds of a component search) cut their
lineage by writing each step as a Parquet table below the folder that the
cluster names in ``spark.checkpoint.dir``.  A written table survives the loss
of executors, is columnar, and gives the next step exact sizes, so Catalyst
and AQE choose broadcast or shuffle joins from measured bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings a job of this package expects.  Sizes are left to the cluster;
# AQE coalesces from a generous shuffle width and splits skewed partitions.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A ledger bucketed by wallet serves joins on (chain, wallet) as it lies.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

def build_session(app_name: str = "fundflow", master: str | None = None,
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables, shared by all executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is unset: name a folder that every "
            "executor can read before running an iterative job")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/fundflow/{app}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
    """Write ``df`` once and read it back, cutting its lineage.

    The rebalance step lets AQE merge near-empty output partitions (a small
    frontier joined to a large ledger leaves one sliver per input split) and
    split oversized ones, so file sizes do not depend on key skew.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.hint("rebalance") if rebalance else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_observed(df: DataFrame, name: str, *metrics: Column,
                         rebalance: bool = False) -> tuple[DataFrame, dict]:
    """Like ``materialise``, and return aggregates of the rows as they were
    written, so a loop learns its size without another job."""
    seen = Observation(name)
    return materialise(df.observe(seen, *metrics), name, rebalance), seen.get


def shuffled(df: DataFrame) -> DataFrame:
    """Rule out a broadcast of ``df`` in the join it enters next.

    The planner infers the size of a few columns of a written table from its
    file size and the width of all its columns, so the keys of a table with
    many empty label columns seem ten times smaller than they are.  Tables that
    grow with the ledger (nodes, edges, accounts, members) meet by shuffle,
    whatever their size seems; only the other side decides otherwise."""
    return df.hint("merge")


def release_scratch(spark: SparkSession) -> bool:
    """Delete the intermediate tables this application wrote."""
    app = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/fundflow/{app}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(path, True)
