"""Joins and numbering that stay balanced when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.session import materialise, shuffled

# A key is hot when it holds more than 1/HOT_SHARE of the rows.  At most
# HOT_SHARE keys can, which bounds the broadcast below whatever the data size.
HOT_SHARE = 1000


def join_group_stats(rows: DataFrame, stats: DataFrame, keys: list[str],
                     n_rows: int, count_col: str = "n") -> DataFrame:
    """Inner-join per-group ``stats`` (one row per key, with its row count) to
    the ``rows`` of the group.

    Hot groups never meet in one shuffle partition: their statistics, at most
    HOT_SHARE rows, are broadcast to wherever their rows already are.  All
    other groups, one row each, are joined by an ordinary shuffle: their written
    table seems small enough for a broadcast with a million groups.
    """
    limit = max(n_rows // HOT_SHARE, 10_000)
    if n_rows <= limit:
        return rows.join(stats.drop(count_col), keys)
    stats = materialise(stats, "group-stats", rebalance=False)
    hot = F.broadcast(stats.filter(F.col(count_col) > limit).drop(count_col))
    cold = stats.filter(F.col(count_col) <= limit).drop(count_col)
    return (rows.join(hot, keys)
            .unionByName(rows.join(hot.select(*keys), keys, "left_anti")
                         .join(shuffled(cold), keys)))


def number_within(df: DataFrame, keys: list[str], bucket: str, order: list,
                  out: str = "seq") -> DataFrame:
    """Row number within ``keys`` ordered by ``bucket`` and then ``order``.

    ``bucket`` is a coarse ordering column (such as the day).  Rows are
    numbered inside (keys, bucket) and shifted by the counts of the earlier
    buckets, so a large group spreads over as many tasks as it has buckets.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, bucket,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(within))
            .join(offsets, [*keys, bucket])
            .withColumn(out, (F.col("_rank") + F.col("_offset")).cast("bigint"))
            .drop("_rank", "_offset"))
