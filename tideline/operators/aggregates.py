"""Grouped aggregates over samples, counters and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lower_median, micros, minute_floor
from .selection import medians

STEP_GAP_S = 900
TOLERANCE, RELATIVE = 0.5, 0.005


def sample_day_aggregates(rows: DataFrame) -> DataFrame:
    """Per metric, scope and local day: min, mean, max, count."""
    return rows.groupBy("metric", "scope", "local_day").agg(F.min("value").alias("min_value"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n"))


def daily_reducers(rows: DataFrame, reducers: dict[str, tuple[str, str]]) -> DataFrame:
    """Derived dailies by device: name -> (metric, min | max | avg). Long format, scope local; lineage is the latest reading."""
    wanted = rows.where(F.col("metric").isin(*sorted({m for m, _ in reducers.values()})))
    base = wanted.groupBy("device_id", "local_day", "metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.max_by("raw_id", "ts").alias("raw_id"), F.max("ts").alias("observed"))
    facts = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(m).alias("of"), F.col(how).alias("value")) for name, (m, how) in reducers.items()))
    long = base.select("device_id", "local_day", "metric", "raw_id", "observed", F.explode(facts).alias("f")).where("f.of = metric")
    return long.select(F.col("f.name").alias("metric"), F.lit("local").alias("scope"), "device_id", "local_day", F.col("f.value").alias("value"), "raw_id", "observed")


def charged_drained(rows: DataFrame, gap_s: int = STEP_GAP_S) -> DataFrame:
    """Sums of the rises and falls between consecutive readings of a local day that are at most gap_s apart."""
    order = Window.partitionBy("metric", "device_id", "local_day").orderBy("ts", "value", "raw_id")
    step = F.col("value") - F.lag("value").over(order)
    near = micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(order) <= gap_s * 1_000_000
    stepped = rows.withColumn("step", F.when(near, step).otherwise(0.0))
    return stepped.groupBy("metric", "device_id", "local_day").agg(
        F.sum(F.greatest("step", F.lit(0.0))).alias("charged"), F.sum(F.greatest(-F.col("step"), F.lit(0.0))).alias("drained"), F.count(F.lit(1)).alias("n")
    )


def counter_totals(rows: DataFrame) -> DataFrame:
    """Cumulative counters: the highest of each type and day, summed over types; a reading belongs to the day of ts - 1 s."""
    top = rows.groupBy("device_id", "local_day", "kind").agg(F.max("counter").alias("top"), F.max(F.struct("ts", "raw_id")).alias("last"))
    return top.groupBy("device_id", "local_day").agg(F.sum("top").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("last").getField("raw_id").alias("raw_id"))


def minute_fold(readings: DataFrame, order: str = "raw_id") -> DataFrame:
    """Readings (ts, metric, value, raw_id) without repeats, folded to the lower median of each metric and UTC minute.

    ``order`` ranks records in content order (``dedupe.content_rank``). A reading belongs to the first record that holds it, and a
    minute's raw_id is that of the first record that has a part in it. Repeats are counted once, sentinels are dropped before.
    """
    first = F.min(F.struct(F.col(order).alias("at"), "raw_id"))
    once = readings.groupBy("ts", "metric", "value").agg(first.alias("of"))
    folded = once.withColumn("minute_us", minute_floor(micros(F.col("ts")))).groupBy("metric", "minute_us")
    return folded.agg(lower_median("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("of").getField("raw_id").alias("raw_id"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs: metric, compared_with (null: the metric itself), scope_a, scope_b, a, b. Days, matches, upper median, largest and mean difference."""
    d = F.col("a") - F.col("b")
    match = F.abs(d) <= F.greatest(F.lit(TOLERANCE), RELATIVE * F.abs("b"))
    rows = pairs.withColumn("d", d).withColumn("abs_d", F.abs(d)).withColumn("match", match)
    keys = ["metric", "compared_with", "scope_a", "scope_b"]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("match").alias("matches"), F.max("abs_d").alias("max_abs"), F.avg("d").alias("mean_d")).withColumn("key", F.struct(*keys))
    middle = medians(rows, "abs_d", *keys).select(F.struct(*keys).alias("of"), F.col("upper").alias("median_abs"))
    return sums.join(middle, F.col("key").eqNullSafe(F.col("of")), "left").select(*keys, "n", "matches", "median_abs", "max_abs", "mean_d")


def stream_counts(records: DataFrame, rules: dict[str, str]) -> DataFrame:
    """records: stream, file, and what the rules read. Files, records and drops (by the rules of ``drop_counts``) of each stream."""
    dropped = F.coalesce(*(F.when(F.expr(c), True) for c in rules.values()), F.lit(False))
    return records.groupBy("stream").agg(F.countDistinct("file").alias("files"), F.count_if(~dropped).alias("records"), F.count_if(dropped).alias("dropped"))


def conflict_counts(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """Conflicts that differ in content, however often they were seen."""
    return conflicts.select(*keys).distinct().agg(F.count(F.lit(1)).alias("conflicts"))


def drop_counts(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows each rule (reason -> SQL condition) drops; the first rule that holds counts."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(rules.items()):
        reason = F.when(F.expr(condition), name).otherwise(reason)
    return rows.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
