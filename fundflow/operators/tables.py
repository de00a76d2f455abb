"""Keeping label, flag, watch and note tables: replace, upsert, inventory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.session import materialise

# ---- fixed values: refresh cadence of label sources in days --------------
CADENCE_DAYS = {"eth_labels": 30, "graphsense_tagpack": 30, "ofac_sdn": 7,
                "scamsniffer": 7}
# ---- end of fixed values -------------------------------------------------


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, the one with the highest ``seq``; a partial aggregate,
    so a key with many versions is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def replace_source(labels: DataFrame, source: str, rows: DataFrame,
                   seq: str = "seq") -> DataFrame:
    """All labels with one source replaced by a new snapshot; within it the
    last row (highest ``seq``) of an (address, chain) wins."""
    fresh = latest(rows.withColumn("source", F.lit(source)), ["address", "chain", "source"],
                   seq).drop(seq)
    return labels.filter(F.col("source") != source).unionByName(
        fresh.select(*labels.columns))


def write_by_source(labels: DataFrame, path: str) -> None:
    """Overwrite only the partitions of the sources present in ``labels``."""
    (labels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source").parquet(path))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], seq: str,
           deleted: str = "deleted") -> DataFrame:
    """Newest version per key of base and changes; rows marked ``deleted`` (an
    empty note, a removed flag) take their key away."""
    old = base.withColumn(deleted, F.lit(False)) if deleted not in base.columns else base
    merged = latest(old.unionByName(changes, allowMissingColumns=True), keys, seq)
    return merged.filter(~F.coalesce(F.col(deleted), F.lit(False))).select(*base.columns)


@dataclass(frozen=True)
class KeyedTable:
    """A table kept in buckets of its key, so that a change rewrites only the
    buckets it touches: one changed row of millions costs one bucket.

    Versions compare by ``seq``; at equal ``seq`` a change wins over what is
    stored, and among changes the one whose values sort last.  A row marked
    ``deleted`` takes its key away.
    """
    path: str
    keys: tuple[str, ...]
    seq: str
    buckets: int

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        self._bucketed(rows).repartition("_bucket").write.partitionBy("_bucket").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("_bucket")

    def upsert(self, changes: DataFrame, deleted: str = "deleted") -> list[int]:
        """Apply changes; the buckets that were rewritten."""
        spark = changes.sparkSession
        change = materialise(self._bucketed(changes), "changes", rebalance=False)
        touched = sorted(r[0] for r in change.select("_bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        stored = spark.read.parquet(self.path)
        old = stored.filter(F.col("_bucket").isin(touched)).withColumn(deleted, F.lit(False))
        both = old.withColumn("_new", F.lit(False)).unionByName(
            change.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        rest = [c for c in both.columns if c not in (*self.keys, "_bucket", "_new")]
        version = F.struct(F.col(self.seq), F.col("_new"), *(F.col(c) for c in rest if c != self.seq))
        merged = both.groupBy(*self.keys, "_bucket").agg(F.max(version).alias("_v")).select(
            *self.keys, *(F.col(f"_v.{c}").alias(c) for c in rest), "_bucket")
        kept = materialise(merged.filter(~F.coalesce(F.col(deleted), F.lit(False)))
                           .select(*stored.columns), "merged", rebalance=False)
        (kept.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_bucket").parquet(self.path))
        left = {r[0] for r in kept.select("_bucket").distinct().collect()}
        self._empty(spark, [b for b in touched if b not in left])
        return touched

    def _empty(self, spark: SparkSession, buckets: list[int]) -> None:
        """A bucket without rows is not overwritten: take its folder away."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for bucket in buckets:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bucket={bucket}")
            folder.getFileSystem(conf).delete(folder, True)


def label_inventory(labels: DataFrame) -> DataFrame:
    return labels.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                        F.max("updated_utc").alias("last_updated"))


def stale_sources(inventory: DataFrame, now_utc: str,
                  cadence: dict[str, int] | None = None) -> DataFrame:
    """Sources loaded at least once whose newest row is older than its cadence."""
    days = None
    for name, value in (cadence or CADENCE_DAYS).items():
        days = F.when(F.col("source") == name, value) if days is None \
            else days.when(F.col("source") == name, value)
    age = F.to_timestamp(F.lit(now_utc)).cast("bigint") \
        - F.try_to_timestamp("last_updated").cast("bigint")
    return inventory.withColumn("cadence_days", days).withColumn("age_seconds", age) \
        .filter(F.col("age_seconds") >= F.col("cadence_days") * 86400)


def with_case_names(rows: DataFrame, cases: DataFrame) -> DataFrame:
    names = cases.select(F.col("id").alias("case_id"), F.col("name").alias("case_name"),
                         "case_number")
    return rows.join(names, "case_id", "left")


def flag_list(flags: DataFrame, cases: DataFrame) -> DataFrame:
    """Flags with their case, newest first."""
    return with_case_names(flags, cases).orderBy(F.col("id").desc())


def watch_list(watches: DataFrame, cases: DataFrame) -> DataFrame:
    """Watches with their case; open alerts first, then newest."""
    alert = F.col("alert_json").isNotNull() & ~F.coalesce("acknowledged", F.lit(False))
    return with_case_names(watches, cases).withColumn("open_alert", alert).orderBy(
        F.col("open_alert").desc(), F.col("id").desc())
