"""Interval algebra in whole seconds; ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORN_GAP_S, WORN_LAST_S = 300, 60


def merge(spans: DataFrame, *by: str, bucket: int | None = None) -> DataFrame:
    """spans: low, high. Overlapping or touching spans of a group become one.

    With ``bucket`` (a day, in the unit of low and high) no task holds a whole group: spans are merged within the bucket they start
    in, and of each bucket only two islands, what earlier ones reach into and what reaches furthest, meet those of other buckets.
    """
    spans = spans.where("high > low").select(*by, "low", "high")
    if bucket is None:
        return _islands(spans, by)
    found = _islands(spans.withColumn("bucket", F.floor(F.col("low") / bucket)), (*by, "bucket"))
    reach = found.groupBy(*by, "bucket").agg(F.max("high").alias("top"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a group and bucket
    found = found.join(reach.withColumn("reached", F.max("top").over(before)), [*by, "bucket"])
    found = found.withColumn("kind", F.when(F.col("low") <= F.col("reached"), 1).when(F.col("high") == F.col("top"), 2).otherwise(0))
    alone = F.when(F.col("kind") == 0, F.col("low"))  # islands that touch no other bucket stay by themselves
    edges = found.groupBy(*by, "bucket", "kind", alone.alias("alone")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return _islands(edges.select(*by, "alone", "low", "high"), (*by, "alone")).drop("alone")


def _islands(spans: DataFrame, by: tuple[str, ...]) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*by).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("low") > F.max("high").over(before), 1).otherwise(0)
    marked = spans.withColumn("new", new).withColumn("island", F.sum("new").over(running))
    return marked.groupBy(*by, "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def days_touched(low_s: Column, high_s: Column) -> Column:
    """UTC days of [low, high): the end is exclusive."""
    return F.sequence(F.date_from_unix_date(F.floor(low_s / 86_400).cast("int")), F.date_from_unix_date(F.floor((F.greatest(high_s, low_s + 1) - 1) / 86_400).cast("int")))


def clipped_seconds(spans: DataFrame, bounds: DataFrame, *by: str) -> DataFrame:
    """Seconds of each group's spans inside each day's bounds (day, low_s, high_s). Spans meet bounds by the UTC days they touch."""
    left = spans.withColumn("touch", F.explode(days_touched(F.col("low"), F.col("high"))))
    right = bounds.withColumn("touch", F.explode(days_touched(F.col("low_s"), F.col("high_s"))))
    met = left.join(right, "touch").where("low < high_s and high > low_s").select(*by, "low", "high", "day", "low_s", "high_s").distinct()
    return met.groupBy(*by, "day").agg(F.sum(F.least("high", "high_s") - F.greatest("low", "low_s")).alias("seconds"))


def covered_seconds(spans: DataFrame, bounds: DataFrame, claimed: DataFrame, *by: str) -> DataFrame:
    """Seconds of the union of spans in each day; a claimed day (by, day) counts whole. Spans are merged day by day, however long a group's history."""
    some = clipped_seconds(merge(spans, *by, bucket=86_400), bounds, *by)
    whole = claimed.select(*by, "day").distinct().join(bounds, "day").select(*by, "day", (F.col("high_s") - F.col("low_s")).alias("whole"))
    return some.join(whole, [*by, "day"], "full").select(*by, "day", F.coalesce("whole", "seconds").alias("seconds"))


def worn_spans(readings: DataFrame, *by: str) -> DataFrame:
    """readings: at_s. A reading counts up to the next one if that is at most WORN_GAP_S later, else WORN_LAST_S.

    The next reading is looked for within the UTC day; a day's last one meets the first of the days behind it in a table of a row a day.
    """
    once = readings.select(*by, "at_s", F.floor(F.col("at_s") / 86_400).alias("utc_day")).distinct()
    within = Window.partitionBy(*by, "utc_day").orderBy("at_s")
    days = once.groupBy(*by, "utc_day").agg(F.min("at_s").alias("first_s"))
    days = days.select(*by, "utc_day", F.lead("first_s").over(Window.partitionBy(*by).orderBy("utc_day")).alias("next_day_s"))
    timed = once.withColumn("next_s", F.lead("at_s").over(within)).join(days, [*by, "utc_day"])
    gap = F.coalesce("next_s", "next_day_s") - F.col("at_s")
    return timed.select(*by, F.col("at_s").alias("low"), (F.col("at_s") + F.when(gap <= WORN_GAP_S, gap).otherwise(WORN_LAST_S)).alias("high"))


def completeness(worn: Column, covered: Column) -> Column:
    """Whole percent, 100 at most; null without cover."""
    return F.when(covered > 0, F.least(F.lit(100).cast("long"), F.floor(100 * worn / covered)))
