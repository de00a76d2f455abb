"""Screening, capture de-duplication and sweep detection on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.operators.findings import SWEEP_GAP_SECONDS, SWEEP_PERCENT


def live_screen(movements: DataFrame, facts: DataFrame) -> DataFrame:
    """Every new movement that touches a known wallet, with what is known about
    its two ends (stream-static joins; no state)."""
    known = facts.filter("is_sanctioned or is_mixer or is_exchange or scam_reported "
                         "or agency_flagged or shared_flagged")
    marks = F.concat_ws(
        ",", F.when(F.col("agency_flagged"), "agency_flag"),
        F.when(F.col("is_exchange"), "exchange"), F.when(F.col("is_mixer"), "mixer"),
        F.when(F.col("shared_flagged"), "partner_flag"),
        F.when(F.col("is_sanctioned"), "sanctioned"),
        F.when(F.col("scam_reported"), "scam_report"))
    known = known.select("chain", "address", marks.alias("m"))

    def side(df, column, out):
        right = known.select("chain", F.col("address").alias(column), F.col("m").alias(out))
        return df.join(right, ["chain", column], "left")
    rows = side(side(movements, "from_address", "from_hits"), "to_address", "to_hits")
    return rows.filter("from_hits is not null or to_hits is not null")


def dedup_captures(captures: DataFrame, keys: list[str], time: str = "event_time",
                   watermark: str = "1 hour") -> DataFrame:
    """The first pull of each key; the state of a key ends with the watermark.
    Keys seen again later meet the stored table (``provenance.first_capture``)."""
    return captures.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def first_by_day(captures: DataFrame, keys: list[str], order: list[str],
                 time: str = "event_time") -> DataFrame:
    """The first pull of each key and day, by ``order``; on a batch or a stream.
    Which of several pulls of one micro-batch stays depends on the rows alone, and
    a key pulled very often is reduced before the shuffle."""
    rest = [c for c in captures.columns if c not in keys]
    once = captures.groupBy(F.window(time, "1 day").alias("_w"), *keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_c"))
    return once.select(F.to_date("_w.start").alias("day"), *keys,
                       *[F.col(f"_c.{c}").alias(c) for c in rest])


def first_captures(captures: DataFrame, keys: list[str], order: list[str],
                   time: str = "event_time", watermark: str = "1 hour") -> DataFrame:
    """Stream of first pulls, given when the watermark has passed their day.  The
    first day of a key is chosen against the table (``provenance.first_capture``);
    ``late.late_pulls`` adds what came after the watermark."""
    return first_by_day(captures.withWatermark(time, watermark), keys, order, time)


def _sides(deposits: DataFrame, forwards: DataFrame, busy: DataFrame):
    d = deposits.select(
        F.col("chain").alias("d_chain"), F.col("to_address").alias("feeder"),
        F.col("asset").alias("d_asset"), F.col("txid").alias("deposit_txid"),
        F.col("value_raw").alias("in_raw"), F.col("event_time").alias("d_time"))
    return d, forwards.join(
        busy.select("chain", F.col("address").alias("to_address")), ["chain", "to_address"])


def _swept(d: DataFrame, f: DataFrame, gap: str) -> DataFrame:
    return f.join(d, (F.col("chain") == F.col("d_chain"))
                  & (F.col("from_address") == F.col("feeder"))
                  & (F.col("asset") == F.col("d_asset")) & F.expr(gap)) \
        .filter(F.col("value_raw") * 100 >= F.col("in_raw") * SWEEP_PERCENT) \
        .select("chain", "feeder", F.col("to_address").alias("service_address"),
                "deposit_txid", F.col("txid").alias("sweep_txid"), "in_raw", "value_raw")


_GAP = f"event_time <= d_time + interval {SWEEP_GAP_SECONDS} seconds"


def sweep_pairs(deposits: DataFrame, forwards: DataFrame, busy: DataFrame) -> DataFrame:
    """Deposits whose receiver forwards at least 90 % within 72 hours to a busy
    wallet, over whole tables."""
    return _swept(*_sides(deposits, forwards, busy), _GAP)


def sweep_stream(deposits: DataFrame, forwards: DataFrame, busy: DataFrame,
                 watermark: str = "1 hour", early: str = "1 hour") -> DataFrame:
    """``sweep_pairs`` on streams.  Both sides carry a watermark, so the state of a
    pair ends when the gap can no longer be met; ``early`` is how long before the
    deposit a forward may stand.  ``late.late_sweeps`` adds what both leave out."""
    return _swept(*_sides(deposits.withWatermark("event_time", watermark),
                          forwards.withWatermark("event_time", watermark), busy),
                  f"{_GAP} and event_time >= d_time - interval {early}")
