"""Structured Streaming over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.eventlog import validated
from ..sources.store import scratch


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Parquet files as they are appended to a folder (or a single file)."""
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(events: DataFrame, late: str = "24 hours", key: str = "id") -> DataFrame:
    """Each event once within a day; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n) for tumbling windows."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n")


def fold(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", keep_valid: bool = False) -> None:
    """Run over all that is there and write it to ``target``; a rerun of a batch replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        rows = validated(batch).filter("valid").drop("valid", "error") if keep_valid else batch
        rows.write.mode("overwrite").parquet(target if mode == "complete" else f"{target}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def materialised(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result over all that is there, as a table in the shared folder."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    fold(stream, f"{base}/out", f"{base}/checkpoint", mode)
    out = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return out.select(*stream.columns)
