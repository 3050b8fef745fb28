"""Coverage: which days a metric has values for, and why the others have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import ALL_DAY, NIGHTLY, SESSION_STREAM
from ..operators.sequences import gaps

PRESENT, FAILED, EMPTY, NOT_COVERED = "present", "failed", "source_empty", "not_covered"


def calendar(first, last, spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


COVERED = "covered"


def covered_spans(raw: DataFrame, claims: DataFrame) -> DataFrame:
    """stream, kind, start_ts, end_ts of retained records and of what exports claim. Session streams claim no day."""
    own = raw.where(F.col("stream") != SESSION_STREAM).select("stream", "start_ts", "end_ts")
    claimed = claims.select("stream", F.col("from_day").cast("timestamp").alias("start_ts"), F.date_add("to_day", 1).cast("timestamp").alias("end_ts"))
    return own.unionByName(claimed).select("stream", F.lit(COVERED).alias("kind"), "start_ts", "end_ts")


def failed_spans(failures: DataFrame, raw: DataFrame) -> DataFrame:
    """stream, kind, start_ts, end_ts of failed records: the failure's own span, else its retained record's."""
    kept = raw.select(F.col("raw_id"), F.col("start_ts").alias("raw_start"), F.col("end_ts").alias("raw_end"))
    spans = failures.where(F.col("stream") != SESSION_STREAM).join(kept, "raw_id", "left")
    spans = spans.select("stream", F.coalesce("start_ts", "raw_start").alias("start_ts"), F.coalesce("end_ts", "raw_end", "start_ts", "raw_start").alias("end_ts"))
    return spans.where("start_ts is not null").select("stream", F.lit(FAILED).alias("kind"), "start_ts", "end_ts")


def day_flags(spans: DataFrame, first, last) -> DataFrame:
    """stream, day, covered, failed: which days spans (stream, kind, start_ts, end_ts) touch, in one pass over all of them.

    A span's end is exclusive by a microsecond, but not before its start. Of the spans that start on one day the longest covers the
    others, so no more than a span a stream, kind and day is spread out. Nightly streams share the days that the all-day stream covers.
    """
    low = F.to_date("start_ts")
    high = F.to_date(F.greatest(F.col("start_ts"), F.col("end_ts") - F.expr("INTERVAL 1 MICROSECOND")))
    low, high = F.greatest(low, F.lit(first).cast("date")), F.least(high, F.lit(last).cast("date"))
    longest = spans.where(low <= high).groupBy("stream", "kind", low.alias("low")).agg(F.max(high).alias("high"))
    own = F.array("stream")
    shared = F.when((F.col("stream") == ALL_DAY) & (F.col("kind") == COVERED), F.concat(own, F.array(*map(F.lit, NIGHTLY)))).otherwise(own)
    days = longest.select(F.explode(shared).alias("stream"), "kind", "low", "high").select("stream", "kind", F.explode(F.sequence("low", "high")).alias("day"))
    return days.groupBy("stream", "day").agg(F.bool_or(F.col("kind") == COVERED).alias("covered"), F.bool_or(F.col("kind") == FAILED).alias("failed"))


def covered_days(raw: DataFrame, claims: DataFrame, first, last) -> DataFrame:
    return day_flags(covered_spans(raw, claims), first, last).select("stream", "day")


def failed_days(failures: DataFrame, raw: DataFrame, first, last) -> DataFrame:
    return day_flags(failed_spans(failures, raw), first, last).select("stream", "day")


def statuses(days: DataFrame, pairs: DataFrame, present: DataFrame, flags: DataFrame) -> DataFrame:
    """metric, scope, day, status for every day and pair: present > failed > source_empty > not_covered.

    pairs: metric, scope, stream (what can supply what); present: metric, scope, day; flags: stream, day, covered, failed. The
    calendar, the days with values and the flags meet in one grouping.
    """
    no, yes = F.lit(False), F.lit(True)
    keys = ["metric", "scope", "day"]
    grid = pairs.select("metric", "scope").distinct().crossJoin(days).select(*keys, yes.alias("asked"), no.alias("here"), no.alias("covered"), no.alias("failed"))  # the result itself: a row a pair and day
    here = present.select(*keys, no.alias("asked"), yes.alias("here"), no.alias("covered"), no.alias("failed"))
    known = pairs.join(flags, "stream").select(*keys, no.alias("asked"), no.alias("here"), "covered", "failed")
    rows = grid.unionByName(here).unionByName(known).groupBy(*keys).agg(*(F.bool_or(c).alias(c) for c in ("asked", "here", "covered", "failed")))
    status = F.when(F.col("here"), PRESENT).when(F.col("failed"), FAILED).when(F.col("covered"), EMPTY).otherwise(NOT_COVERED)
    return rows.where("asked").select(*keys, status.alias("status"))


def statuses_on(day, pairs: DataFrame, present: DataFrame, spans: DataFrame) -> DataFrame:
    """metric, scope, status of one day: the calendar and the spans are cut to it first."""
    here = present.where(F.col("day") == F.lit(day).cast("date"))
    return statuses(calendar(day, day, pairs.sparkSession), pairs, here, day_flags(spans, day, day)).select("metric", "scope", "status")


def ledger(rows: DataFrame) -> DataFrame:
    """Days of each status per metric and scope."""
    return rows.groupBy("metric", "scope").agg(*(F.count_if(F.col("status") == s).alias(s) for s in (PRESENT, FAILED, EMPTY, NOT_COVERED)))


def status_gaps(rows: DataFrame) -> DataFrame:
    return gaps(rows, "metric", "scope")


def observed_streams(facts: DataFrame, raw: DataFrame) -> DataFrame:
    """The (metric, scope, stream) triples that stored rows show."""
    return facts.select("metric", "scope", "raw_id").join(raw.select("raw_id", "stream"), "raw_id").select("metric", "scope", "stream").distinct()


def map_drift(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Observed triples that the contract does not declare; session pairs are exempt."""
    return observed.where(F.col("stream") != SESSION_STREAM).join(declared, ["metric", "scope", "stream"], "left_anti")
