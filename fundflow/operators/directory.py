"""Names against an ordered directory of any size.

The first entry, in file order, whose name occurs inside a label decides.  Each
entry is filed under the rarest three letters of its name, so an entry meets
only the labels that hold those letters; labels are cut into their letter
triples once for each different text.  Both sides stay tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct stretches of GRAM letters."""
    last = F.length(text) - GRAM + 1
    return F.when(last > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))) \
        .otherwise(F.array().cast("array<string>"))


def first_matches(names: DataFrame, column: str, directory: DataFrame,
                  entity: str = "entity", order: str = "ord") -> DataFrame:
    """(column, fields of the first matching entry) for every different name
    that matches.  Entries shorter than three letters are few different texts;
    they are compared with every name.  An empty entry matches every name."""
    texts = names.select(column).filter(F.col(column).isNotNull()).distinct() \
        .withColumn("_name", F.lower(column))
    entries = directory.withColumn("_entity", F.lower(F.coalesce(F.col(entity), F.lit("")))) \
        .groupBy("_entity").agg(F.min(order).alias("_ord"))
    long = entries.filter(F.length("_entity") >= GRAM).withColumn("_gram", F.explode(_grams(F.col("_entity"))))
    usual = long.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    filed = long.join(usual, "_gram").groupBy("_entity", "_ord").agg(
        F.min(F.struct("_n", "_gram")).alias("_k")).select("_entity", "_ord", F.col("_k._gram").alias("_gram"))
    by_gram = texts.withColumn("_gram", F.explode(_grams(F.col("_name")))).join(filed, "_gram") \
        .filter(F.contains("_name", "_entity")).select(column, "_ord")
    # one- and two-letter entries: the name's own short stretches are the keys
    short = entries.filter(F.length("_entity") < GRAM)
    stretch = F.array_union(F.split("_name", ""), F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_name") - 1, F.lit(1))),
        lambda i: F.substring(F.col("_name"), i, F.lit(2))))
    keys = F.array_distinct(F.array_union(stretch, F.array(F.lit(""))))
    by_short = texts.withColumn("_entity", F.explode(keys)).join(short, "_entity").select(column, "_ord")
    first = by_gram.unionByName(by_short).groupBy(column).agg(F.min("_ord").alias("_ord"))
    fields = directory.withColumnRenamed(order, "_ord") \
        .withColumn("_nth", F.row_number().over(Window.partitionBy("_ord").orderBy(entity))) \
        .filter("_nth = 1").drop("_nth")
    return first.join(fields, "_ord").withColumnRenamed("_ord", order)
