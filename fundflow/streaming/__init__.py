"""Structured Streaming forms of watching, screening and capturing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fundflow.session import scratch_path


def run_available(stream: DataFrame, name: str, mode: str = "append",
                  folders: tuple[str, str] | None = None) -> DataFrame:
    """Process everything that is available, then return the sink as a table.
    The same ``folders`` (sink, offsets) go on where an earlier run ended."""
    spark = stream.sparkSession
    out, log = folders or (scratch_path(spark, name), scratch_path(spark, f"{name}-offsets"))
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", out).option("checkpointLocation", log)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_lots(lots: list[DataFrame], name: str, build: Callable[[DataFrame], DataFrame]
             ) -> tuple[DataFrame, DataFrame]:
    """Land each lot of rows and process it before the next one comes, with the
    query stopped and started again in between.  Returns the landed table and what
    the stream that ``build`` makes of it has given."""
    spark, schema = lots[0].sparkSession, lots[0].schema
    landing = scratch_path(spark, f"{name}-landed")
    folders = scratch_path(spark, name), scratch_path(spark, f"{name}-offsets")
    for lot in lots:
        lot.write.mode("append").parquet(landing)
        given = run_available(build(spark.readStream.schema(schema).parquet(landing)), name,
                              folders=folders)
    return spark.read.schema(schema).parquet(landing), given
