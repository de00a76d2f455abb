"""What happens to the movements of one expanded wallet.

Every movement of an expanded wallet ends in exactly one state, tested in this
order: ``capped`` (older than the newest transactions that are read, where
there is such a limit), ``self`` (change to the same wallet), ``dust``, ``time`` (impossible
order of events) or ``eligible``.  A search pattern then follows some of the
eligible ones; the rest are counted, never dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow import schemas as S
from fundflow.functions.amounts import DUST_TOKEN, display_units, dust_min
from fundflow.session import shuffled

RAPID_BRANCHES, BALANCED_BRANCHES = 3, 8


def is_dust(asset: Column, value: Column, limits=None, token=DUST_TOKEN) -> Column:
    return value < dust_min(asset, limits, token)


def is_out_of_time(ts: Column, bound: Column, direction: str) -> Column:
    """Forward: dated before the money arrived.  Backward: after it was sent.
    An unknown time or an unknown bound always passes."""
    late = ts > bound if direction == S.BACKWARD else ts < bound
    return F.coalesce(late, F.lit(False))


def movement_status(direction: str, limits=None, token=DUST_TOKEN,
                    beyond: Column | None = None) -> Column:
    """State of a movement joined to the ``bound`` of its wallet.  ``beyond``
    marks one that is not among the newest transactions that are read at all."""
    c = F.col
    beyond = F.lit(False) if beyond is None else beyond
    return (F.when(beyond, "capped").when(c("is_self_transfer"), "self")
            .when(is_dust(c("asset"), c("value"), limits, token), "dust")
            .when(is_out_of_time(c("ts"), c("bound"), direction), "time")
            .otherwise("eligible"))


def drop_self(moves: DataFrame) -> DataFrame:
    return moves.filter(~F.col("is_self_transfer"))


def split_dust(moves: DataFrame, limits=None, token=DUST_TOKEN
               ) -> tuple[DataFrame, DataFrame]:
    """Movements worth following, and count and total per asset of the rest."""
    dust = is_dust(F.col("asset"), F.col("value"), limits, token)
    totals = moves.filter(dust).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_dust"), F.try_sum("value_raw").alias("dust_raw"))
    return moves.filter(~dust), totals


def split_time(moves: DataFrame, direction: str) -> tuple[DataFrame, DataFrame]:
    """Movements in a possible order (with ``bound`` joined), and the rest."""
    late = is_out_of_time(F.col("ts"), F.col("bound"), direction)
    return moves.filter(~late), moves.filter(late)


def branch_order() -> list[Column]:
    return [F.col("_amount").desc_nulls_first(), F.col("ts").desc_nulls_last(),
            F.col("txid"), F.col("next_address")]


def select_branches(eligible: DataFrame, group: list[str], pattern: str,
                    totals: DataFrame | None = None) -> DataFrame:
    """Rows of ``eligible`` that the search pattern follows, per group and asset.

    Rapid keeps at most three of the largest movements while the value before
    a row is below 80 % of the total; balanced keeps at most eight that carry
    5 % each; a lone movement is always kept.  Display amounts decide, since
    tokens that share a symbol need not share their decimals.  A movement or a
    total beyond their range is followed, never left out.

    A wallet may hold any share of the ledger: the top rows come from
    ``row_number() <= k``, which Spark limits per group before the shuffle, and
    the totals from a partial aggregate, so no group is gathered in one task.
    ``totals`` (``branch_totals``) may be given when they are known already.
    """
    if pattern == S.THOROUGH:
        return eligible
    keys = [*group, "asset"]
    k = RAPID_BRANCHES if pattern == S.RAPID else BALANCED_BRANCHES
    ranked = Window.partitionBy(*keys).orderBy(*branch_order())
    valued = eligible.withColumn("_amount", display_units(F.col("value")))
    top = valued.withColumn("_rank", F.row_number().over(ranked)) \
        .filter(F.col("_rank") <= k)
    if totals is None:
        totals = valued.groupBy(*keys).agg(
            F.try_sum("_amount").alias("eligible_amount"), F.count(F.lit(1)).alias("n_eligible"))
    totals = totals.select(
        *keys, F.sum("n_eligible").over(Window.partitionBy(*group)).alias("_n_all"),
        F.when(F.col("eligible_amount") == 0, 1).otherwise(F.col("eligible_amount")).alias("_total"))
    rows = top.join(shuffled(totals), keys)
    if pattern == S.RAPID:
        before = Window.partitionBy(*keys).orderBy("_rank").rowsBetween(
            Window.unboundedPreceding, -1)
        rows = rows.withColumn("_before",
                               F.coalesce(F.try_sum("_amount").over(before), F.lit(0)))
        keep = F.try_multiply("_before", F.lit(10)) < F.try_multiply("_total", F.lit(8))
    else:
        keep = F.try_multiply("_amount", F.lit(20)) >= F.col("_total")
    keep = (F.col("_n_all") <= 1) | F.coalesce(keep, F.lit(True))
    return rows.filter(keep).select(*eligible.columns)


ACCOUNTS = ("n_self", "n_dust", "dust_raw", "n_time", "n_eligible", "eligible_raw", "n_capped")


def account(rows: DataFrame, group: list[str]) -> DataFrame:
    """Honest accounting per group and asset of movements with a ``status``: how
    many (and how much) were self transfers, dust, out of time, eligible or
    beyond the newest ones; ``eligible_amount`` is their sum in display units."""
    def n(state):
        return F.count_if(F.col("status") == state)

    def total(state):
        return F.coalesce(F.try_sum(F.when(F.col("status") == state, F.col("value_raw"))),
                          F.lit(0))
    return rows.groupBy(*group, "asset").agg(
        n("self").alias("n_self"), n("dust").alias("n_dust"),
        total("dust").alias("dust_raw"), n("time").alias("n_time"),
        n("eligible").alias("n_eligible"), total("eligible").alias("eligible_raw"),
        n("capped").alias("n_capped"), F.try_sum(F.when(
            F.col("status") == "eligible", display_units(F.col("value")))).alias("eligible_amount"))


def account_followed(accounts: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """Accounts with what was followed and, as the difference, skipped, so that
    nothing can be lost."""
    keys = [*group, "asset"]
    walked = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_followed"),
                                      F.try_sum("value_raw").alias("followed_raw"))
    return (accounts.join(shuffled(walked), keys, "left")
            .withColumn("n_followed", F.coalesce(F.col("n_followed"), F.lit(0)))
            .withColumn("followed_raw", F.coalesce(F.col("followed_raw"), F.lit(0)))
            .withColumn("n_skipped", F.col("n_eligible") - F.col("n_followed"))
            .withColumn("skipped_raw", F.col("eligible_raw") - F.col("followed_raw")))


def unexamined(accounting: DataFrame) -> DataFrame:
    """Branches a pattern chose not to follow, per wallet and asset."""
    return accounting.filter(F.col("n_skipped") > 0)
