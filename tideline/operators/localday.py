"""Local days: a reading's offset is the one observed nearest in time.

Offsets become regimes between midpoints of neighbouring observations. A regime is spread over the UTC days it touches, so the
as-of join is an equality join on the day with the midpoints as its condition: no nested loop, and no assumption about
the size of the offset table (Catalyst broadcasts it if it is small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros

DAY_US = 86_400_000_000
ENDLESS = 1 << 62


def regimes(offsets: DataFrame) -> DataFrame:
    """offsets: ts, offset_s and raw_id. low2, high2 (doubled microseconds, low exclusive and high inclusive), offset_s.

    Of several offsets at one instant the one with the largest raw_id holds; a tie in time goes to the earlier offset; equal
    neighbours are one regime. Observations meet their predecessor within their UTC day; only a row a day and the changes found,
    one a regime, are ordered as a whole.
    """
    seen = offsets.where(F.col("ts").isNotNull()).groupBy(micros(F.col("ts")).alias("m")).agg(F.max_by("offset_s", "raw_id").alias("offset_s"))
    seen = seen.withColumn("day", F.floor(F.col("m") / DAY_US))
    within, whole = Window.partitionBy("day").orderBy("m"), Window.orderBy("m")
    lag, lead = F.lag(F.struct("m", "offset_s")).over(within), F.lead("m").over(within)
    kept = seen.withColumn("before", lag).withColumn("next", lead)
    kept = kept.where(F.col("before").isNull() | F.col("next").isNull() | (F.col("before.offset_s") != F.col("offset_s")))  # a day's first and last one, and its changes
    kept = kept.withColumn("before", F.coalesce("before", F.lag(F.struct("m", "offset_s")).over(whole)))
    starts = kept.where(F.col("before").isNull() | (F.col("before.offset_s") != F.col("offset_s"))).select(F.coalesce(F.col("before.m") + F.col("m"), F.lit(-ENDLESS)).alias("low2"), "offset_s")
    return starts.select("low2", F.coalesce(F.lead("low2").over(Window.orderBy("low2")), F.lit(ENDLESS)).alias("high2"), "offset_s")


def with_offset(rows: DataFrame, offsets: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds offset_s (0 where none is known) and assumed_utc.

    Rows before or after the days on which the clock is known to change take the first or last offset from a table of one row; the
    others meet their regime on the UTC day. ``offsets`` may be regimes already, for several tables that meet the same ones.
    """
    found = offsets if "low2" in offsets.columns else regimes(offsets)
    first_day = lambda c: F.floor(c / (2 * DAY_US))
    low_day = F.min(F.when(F.col("low2") > -ENDLESS, first_day(F.col("low2"))))
    high_day = F.max(F.when(F.col("high2") < ENDLESS, first_day(F.col("high2"))))
    edge = found.select(F.coalesce(low_day, F.lit(0)).alias("first_day"), F.coalesce(high_day, F.lit(-1)).alias("last_day"), F.min_by("offset_s", "low2").alias("first_offset"), F.max_by("offset_s", "low2").alias("last_offset"))  # one row
    every = Window.partitionBy()
    found = found.withColumn("first_day", low_day.over(every)).withColumn("last_day", high_day.over(every)).where("first_day <= last_day")
    low = F.when(F.col("low2") == -ENDLESS, F.col("first_day")).otherwise(first_day(F.col("low2")))
    high = F.when(F.col("high2") == ENDLESS, F.col("last_day")).otherwise(first_day(F.col("high2")))
    spread = found.select("low2", "high2", F.col("offset_s").alias("found_offset"), F.explode(F.sequence(low, high)).alias("regime_day"))
    keyed = rows.withColumn("us_", micros(F.col(ts))).crossJoin(F.broadcast(edge)).withColumn("day_", F.floor(F.col("us_") / DAY_US))
    outside = F.when(F.col("day_") > F.col("last_day"), F.col("last_offset")).when(F.col("day_") < F.col("first_day"), F.col("first_offset"))
    keyed = keyed.withColumn("edge_offset", outside)
    # no regime has such a day: rows outside are dealt over many keys
    keyed = keyed.withColumn("day_", F.when(F.col("edge_offset").isNull(), F.col("day_")).otherwise(F.pmod("us_", F.lit(1009)) - (1 << 40))).drop("first_day", "last_day", "first_offset", "last_offset")
    joined = keyed.join(spread, (F.col("day_") == F.col("regime_day")) & (2 * F.col("us_") > F.col("low2")) & (2 * F.col("us_") <= F.col("high2")), "left")
    known = F.coalesce("found_offset", "edge_offset")
    return (
        joined.withColumn("offset_s", F.coalesce(known, F.lit(0)).cast("int")).withColumn("assumed_utc", known.isNull())
        .drop("low2", "high2", "found_offset", "edge_offset", "regime_day", "day_", "us_")
    )


def local_day(ts: Column, offset_s: Column) -> Column:
    return F.date_from_unix_date(F.floor((micros(ts) + offset_s.cast("long") * 1_000_000) / DAY_US).cast("int"))


def with_local_day(rows: DataFrame, offsets: DataFrame, ts: str = "ts") -> DataFrame:
    return with_offset(rows, offsets, ts).withColumn("local_day", local_day(F.col(ts), F.col("offset_s")))


def in_local_days(rows: DataFrame, offsets: DataFrame, first: str, last: str, ts: str = "ts") -> DataFrame:
    """Rows of local days first..last: a UTC range that the scan can use, a day before and two after, then the exact day."""
    near = rows.where((F.col(ts) >= F.lit(first).cast("timestamp") - F.expr("INTERVAL 1 DAY")) & (F.col(ts) < F.lit(last).cast("timestamp") + F.expr("INTERVAL 3 DAYS")))
    return with_local_day(near, offsets, ts).where(F.col("local_day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def day_bounds(days: DataFrame, offsets: DataFrame) -> DataFrame:
    """days: day. day, low_s and high_s: its local midnights as UTC seconds, never falling.

    The offset at a midnight is the one nearest to the UTC midnight of the day's label.
    """
    both = days.select("day").unionByName(days.select(F.date_add("day", 1).alias("day"))).distinct().withColumn("ts", F.col("day").cast("timestamp"))
    at = with_offset(both, offsets).withColumn("low_s", F.unix_date("day").cast("long") * 86_400 - F.col("offset_s"))
    order = Window.orderBy("day")  # a calendar: one row a day
    at = at.withColumn("low_s", F.max("low_s").over(order)).withColumn("high_s", F.lead("low_s").over(order)).select("day", "low_s", "high_s")
    return at.join(days.select("day").distinct(), "day", "left_semi").where("high_s is not null")


def local_today(offsets: DataFrame, now) -> DataFrame:
    """One row: the later of the UTC date and the wearer's local date at ``now``."""
    row = offsets.sparkSession.range(1).select(F.lit(now).cast("timestamp").alias("ts"))
    return with_local_day(row, offsets).select(F.greatest("local_day", F.to_date("ts")).alias("today"))
