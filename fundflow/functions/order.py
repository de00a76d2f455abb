"""Order and running sums over groups of any size.

A window over a group puts the group into one task.  Here a range sort deals the
rows of all groups over partitions whose borders Spark samples from the data,
each row gets its place, and the sums of whole partitions carry from one to the
next, so a group that holds most rows is as many tasks as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.session import materialise

_ROW_BITS = 33  # of monotonically_increasing_id: the row inside its partition


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows, written once, with ``at``: a number that rises in this order."""
    by = [F.col(g).asc_nulls_first() for g in group] + order
    return materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                       .withColumn("at", F.monotonically_increasing_id()), name, rebalance=False)


def running(rows: DataFrame, group: list[str], sums: dict[str, Column],
            more: DataFrame | None = None) -> DataFrame:
    """For rows with ``at`` from ``placed``: per name of ``sums`` the total of
    the group's earlier rows.  No group column may be null.  Rows of ``more``
    (group, ``at`` and any names of ``sums``) are added where they stand, but
    not returned: they need no join to the row of their place."""
    part = F.shiftright("at", _ROW_BITS)
    cut = rows.withColumns({"_part": part, "_own": F.lit(True), **{f"_v_{k}": v for k, v in sums.items()}})
    if more is not None:
        cut = cut.unionByName(more.select(
            *group, "at", part.alias("_part"), F.lit(False).alias("_own"),
            *(F.col(k).alias(f"_v_{k}") for k in sums if k in more.columns)), allowMissingColumns=True)
    whole = cut.groupBy(*group, "_part").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*group, "_part", *(
        F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in sums))
    inside = Window.partitionBy(*group, "_part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    return out.filter("_own").join(carried, [*group, "_part"]).withColumns(
        {k: F.col(k) + F.col(f"_c_{k}") for k in sums}).drop(
        "_part", "_own", *(f"_v_{k}" for k in sums), *(f"_c_{k}" for k in sums))
