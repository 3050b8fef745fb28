"""Streaming twins: the minute fold with a watermark, and recomputation of touched days for late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lower_median


def streaming_minute_fold(readings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Closed one-minute windows of a stream of ts, metric, value: repeats dropped, lower median. State is a minute's readings."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicates(["ts", "metric", "value"])
    folded = rows.groupBy(F.window("ts", "1 minute"), "metric").agg(lower_median("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return folded.select("metric", F.unix_micros("window.start").alias("minute_us"), "value", "n")


def recompute_touched(derive: Callable[[DataFrame], DataFrame], read_all: Callable[[], DataFrame], day: str, sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: derives again the days that a batch touches, from all retained rows, however late they are."""

    def run(batch: DataFrame, _: int) -> None:
        touched = batch.select(day).distinct()
        sink(derive(read_all().join(touched, day, "left_semi")))

    return run


def run_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Appends everything that is there now to an in-memory table."""
    query = stream.writeStream.outputMode("append").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends everything that is there now to Parquet files, exactly once."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def overwrite_days(path: str, day: str) -> Callable[[DataFrame], None]:
    """A sink that replaces the partitions of the days it gets, and no others."""

    def sink(rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return sink
