"""Rows that came too late for a stream: found again, counted and added.

A watermarked operator drops what arrives after its watermark and keeps no
count.  So the rows of a stream are also landed as a table (for a file stream
the source folder is that table), and the jobs here compare what the stream gave
with what landed.  They are plain aggregates and joins, so no state grows with
lateness, and running one again gives the same rows.  Give them the landed days
that can still change, not the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.streaming.live import first_by_day, sweep_pairs
from fundflow.streaming.watches import INTERVAL, WATERMARK, activity_windows

WINDOW = ["chain", "address", "window_start"]


def late_activity(landed: DataFrame, finals: DataFrame, watches: DataFrame,
                  interval: str = INTERVAL, watermark: str = WATERMARK) -> DataFrame:
    """Movements of closed intervals that the stream's ``finals`` do not hold:
    one row per interval with the missing number and value.  An interval is
    closed once the newest landed time has passed it by the watermark."""
    newest = landed.agg(F.max("event_time").alias("t")).scalar()
    closed = activity_windows(landed, watches, interval).filter(
        F.col("window_start") + F.expr(f"interval {interval}") <=
        newest - F.expr(f"interval {watermark}"))
    have = finals.select(*WINDOW, F.col("n_movements").alias("_n"), F.col("value_raw").alias("_v"))
    missing = F.col("n_movements") - F.coalesce("_n", F.lit(0))
    return closed.join(have, WINDOW, "left").filter(missing > 0).select(
        *WINDOW, missing.alias("n_movements"),
        (F.col("value_raw") - F.coalesce("_v", F.lit(0))).alias("value_raw"))


def with_late(finals: DataFrame, late: DataFrame) -> DataFrame:
    """Final intervals with their late movements; ``n_late`` says how many."""
    rows = finals.withColumn("n_late", F.lit(0).cast("bigint")).unionByName(
        late.withColumn("n_late", F.col("n_movements")))
    return rows.groupBy(*WINDOW).agg(*(F.sum(c).alias(c) for c in (
        "n_movements", "value_raw", "n_late")))


def late_pulls(landed: DataFrame, streamed: DataFrame, keys: list[str],
               order: list[str]) -> DataFrame:
    """First pulls of a day that the stream has not given: they came late, were
    beaten to it by a later pull, or belong to a day that is still open."""
    first = first_by_day(landed, keys, order)
    return first.join(streamed.select("day", *keys, *order), ["day", *keys, *order], "left_anti")


def late_sweeps(deposits: DataFrame, forwards: DataFrame, busy: DataFrame,
                streamed: DataFrame) -> DataFrame:
    """Sweeps of the landed tables that the stream has not given.  Without the
    bound on forwards before the deposit, which the stream needs to end its state."""
    both = ["chain", "deposit_txid", "sweep_txid", "service_address"]
    return sweep_pairs(deposits, forwards, busy).join(streamed.select(*both), both, "left_anti")
