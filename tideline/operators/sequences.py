"""Runs, gaps, trailing means and chains over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def series_runs(points: DataFrame, max_gap: int, *by: str) -> DataFrame:
    """points: day. Runs of points that are at most max_gap days apart."""
    order = Window.partitionBy(*by).orderBy("day")
    new = F.when(F.datediff("day", F.lag("day").over(order)) > max_gap, 1).otherwise(0)
    runs = points.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy(*by, "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


def trailing_mean(points: DataFrame, days: int, *by: str) -> DataFrame:
    """Mean over the trailing calendar days, where at least half are there and the window starts at or after the first point."""
    number = F.unix_date("day")
    window = Window.partitionBy(*by).orderBy(number).rangeBetween(-(days - 1), 0)
    whole = Window.partitionBy(*by)
    out = points.withColumn("mean", F.avg("value").over(window)).withColumn("present", F.count("value").over(window)).withColumn("first_number", F.min(number).over(whole))
    return out.where((F.col("present") * 2 >= days) & (number - (days - 1) >= F.col("first_number"))).select(*by, "day", "mean", "present")


def gaps(statuses: DataFrame, *by: str, newest: int = 20) -> DataFrame:
    """statuses: day, status, dense in days. Runs of one status other than present, the newest ones of each group; more says that there are others."""
    missing = statuses.where("status <> 'present'")
    number = F.row_number().over(Window.partitionBy(*by, "status").orderBy("day"))
    runs = missing.withColumn("island", F.unix_date("day") - number).groupBy(*by, "status", "island")
    runs = runs.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("first_day"), "status"))
    runs = runs.withColumn("nth", rank).withColumn("more", F.count(F.lit(1)).over(Window.partitionBy(*by)) > newest)
    return runs.where(F.col("nth") <= newest).drop("island", "nth")


def chain_gaps(bundles: DataFrame) -> DataFrame:
    """bundles: device_id, seq, prev. Bundles whose predecessor is not there."""
    there = bundles.select(F.col("device_id").alias("d"), F.col("seq").alias("s"))
    return bundles.where("prev is not null").join(there, (F.col("device_id") == F.col("d")) & (F.col("prev") == F.col("s")), "left_anti")
