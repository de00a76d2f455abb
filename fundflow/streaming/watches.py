"""Watched wallets on a stream: alerts on change, activity per interval."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Executors get these functions by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


WATERMARK = "1 hour"
INTERVAL = "30 minutes"

ALERT_SCHEMA = ("chain string, address string, ts bigint, before_count bigint, "
                "after_count bigint, before_balance string, after_balance string, late boolean")
STATE_SCHEMA = "tx_count bigint, balance string, ts bigint, seq bigint"


def _compare(key, batches: Iterator[pd.DataFrame], state: GroupState):
    """Alert whenever a snapshot differs from the one before.  The first one
    only sets the baseline; one older than the baseline is given back as late."""
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    # plain arrays: a wallet has few rows in a lot, and columns of a frame cost more than they do
    ts, seq = rows["ts"].to_numpy(), rows["seq"].to_numpy()
    line = np.lexsort((seq, ts))
    ts, seq, count = ts[line], seq[line], rows["tx_count"].to_numpy()[line]
    balance = rows["balance"].astype(str).to_numpy(dtype=object)[line]
    past = state.get if state.exists else None
    late = np.zeros(len(ts), dtype=bool)
    if past:
        late = (ts < past[2]) | ((ts == past[2]) & (seq < past[3]))
    new = np.flatnonzero(~late)
    before_count, before_balance = np.zeros_like(count), np.empty(len(ts), dtype=object)
    if past:
        before_count[late], before_balance[late] = past[0], past[1]
    shown = late.copy()
    if len(new):
        before_count[new[1:]], before_balance[new[1:]] = count[new[:-1]], balance[new[:-1]]
        if past:
            before_count[new[0]], before_balance[new[0]] = past[0], past[1]
        known = pd.notna(before_count)
        if not past:
            known[new[0]] = False
        shown |= ~late & known & ((before_count != count) | (before_balance != balance))
        last = new[-1]
        state.update((int(count[last]), balance[last], int(ts[last]), int(seq[last])))
    if shown.any():
        yield pd.DataFrame({
            "chain": key[0], "address": key[1], "ts": ts[shown], "before_count": before_count[shown],
            "after_count": count[shown], "before_balance": before_balance[shown],
            "after_balance": balance[shown], "late": late[shown]})


def watch_alerts(snapshots: DataFrame, watches: DataFrame) -> DataFrame:
    """Alerts of watched wallets from a stream of snapshots (chain, address, ts,
    seq, tx_count, balance as text, failed).  State survives restarts through
    the query's checkpoint; ``open_alerts`` is the view until acknowledgement.

    A failed snapshot changes nothing, so it is dropped before the state.  A
    snapshot older than the wallet's baseline neither alerts nor moves it: it comes
    out with ``late`` set and that baseline beside it.  One wallet's snapshots of one
    micro-batch are compared together: bound them by the size of a trigger
    (``maxFilesPerTrigger`` or the like)."""
    watched = snapshots.filter(~F.col("failed")).drop("failed").join(
        watches.select("chain", "address"), ["chain", "address"])
    return watched.groupBy("chain", "address").applyInPandasWithState(
        _compare, ALERT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def open_alerts(alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """The newest alert of each wallet, unless it was acknowledged: an
    acknowledgement (chain, address, ts) covers alerts up to its time, so only a
    newer movement opens the wallet again.  Late snapshots are no alerts.  Of
    alerts of one second the greater counts after it stay."""
    key = ["chain", "address"]
    rest = [c for c in alerts.columns if c not in (*key, "late")]
    order = F.struct("ts", "after_count", "after_balance", "before_count", "before_balance")
    newest = alerts.filter(~F.col("late")).groupBy(*key).agg(
        F.max_by(F.struct(*rest), order).alias("_a"), F.count(F.lit(1)).alias("n_alerts"))
    seen = acknowledged.groupBy(*key).agg(F.max("ts").alias("_seen"))
    return newest.join(seen, key, "left").filter(
        F.col("_seen").isNull() | (F.col("_a.ts") > F.col("_seen"))).select(
        *key, *[F.col(f"_a.{c}").alias(c) for c in rest], "n_alerts")


def activity_windows(movements: DataFrame, watches: DataFrame,
                     interval: str = INTERVAL) -> DataFrame:
    """Movements per watched wallet and interval, of a batch or a stream."""
    seen = movements.join(watches.select("chain", "address"), ["chain", "address"])
    return seen.groupBy(F.window("event_time", interval), "chain", "address").agg(
        F.count(F.lit(1)).alias("n_movements"), F.sum("value_raw").alias("value_raw")) \
        .select("chain", "address", F.col("window.start").alias("window_start"),
                "n_movements", "value_raw")


def watch_activity(movements: DataFrame, watches: DataFrame, interval: str = INTERVAL,
                   watermark: str = WATERMARK) -> DataFrame:
    """``activity_windows`` of a stream with an ``event_time``; an interval is final
    once the watermark has passed it.  ``late.late_activity`` gives the rest."""
    return activity_windows(movements.withWatermark("event_time", watermark), watches, interval)
