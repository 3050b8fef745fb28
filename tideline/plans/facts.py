"""Period facts: a recent window against the person's own baseline, all metrics in one aggregation."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import FACT_SCOPES, SESSION_SCOPES
from ..functions.scalars import confidence, days_before, direction, round_exact, window_days

WINDOW_CAP, BASELINE_CAP = 31, 365
MINIMUM_BASELINE = 3
INSUFFICIENT = "insufficient"


def bounds(as_of: datetime.date, window: int, baseline: int) -> tuple[datetime.date, datetime.date, datetime.date]:
    """(first day of the baseline, first day of the window, as_of); the baseline ends the day before the window."""
    window, baseline = window_days(window, WINDOW_CAP), window_days(baseline, BASELINE_CAP)
    start = days_before(as_of, window - 1)
    return days_before(start, baseline), start, as_of


def latest_stored_day(daily: DataFrame, samples: DataFrame, scopes: tuple[str, ...] = FACT_SCOPES) -> DataFrame:
    """One row, day: the newest stored day of daily values and of samples outside sessions; of session scopes alone, their newest sample.

    daily: day; samples: ts, scope. A sample's day is its UTC day.
    """
    if all(s in SESSION_SCOPES for s in scopes):
        return samples.where(F.col("scope").isin(*scopes)).agg(F.max(F.to_date("ts")).alias("day"))
    ordinary = samples.where(~F.col("scope").isin(*SESSION_SCOPES)).agg(F.max(F.to_date("ts")).alias("day"))
    return daily.agg(F.max("day").alias("day")).unionByName(ordinary).agg(F.max("day").alias("day"))


def day_means(sample_days: DataFrame, digits: int = 2) -> DataFrame:
    """Facts of sample metrics rest on their days' means, rounded as they are shown. sample_days: metric, scope, local_day, mean_value."""
    return sample_days.select("metric", "scope", F.col("local_day").alias("day"), round_exact(F.col("mean_value"), digits).alias("value"))


def period_facts(
    daily: DataFrame, as_of: datetime.date, window: int = 7, baseline: int = 28, requested: DataFrame | None = None, scopes: tuple[str, ...] = FACT_SCOPES, points: bool = False
) -> DataFrame:
    """daily: metric, scope, day, value (a value a day; for samples ``day_means``). One row a metric and scope with values in either range.

    A comparison (baseline_mean, baseline_sd, delta, delta_percent, z, direction) needs values in the window and on
    ``MINIMUM_BASELINE`` days before it; confidence is insufficient without it. z is null where all baseline values are equal. Evidence:
    window_dates and the baseline's bounds, with ``points`` also the window's values. requested (metric) adds a row with scope
    "any" and the reason no_data for each metric without values.
    """
    low, start, end = bounds(as_of, window, baseline)
    rows = daily.where(F.col("day").between(F.lit(low), F.lit(end)) & F.col("scope").isin(*scopes))
    if requested is not None:
        rows = rows.join(requested.select("metric").distinct(), "metric", "left_semi")
    recent = F.col("day") >= F.lit(start)
    here, before = F.when(recent, F.col("value")), F.when(~recent, F.col("value"))
    evidence = {"window_dates": F.array_sort(F.collect_list(F.when(recent, F.col("day"))))}  # at most WINDOW_CAP of them a row
    if points:
        evidence["window_points"] = F.array_sort(F.collect_list(F.when(recent, F.struct("day", "value"))))
    out = rows.groupBy("metric", "scope").agg(
        F.count(here).alias("n_window"), F.count(before).alias("n_baseline"), F.avg(here).alias("value"), F.min(here).alias("window_min"), F.max(here).alias("window_max"),
        F.avg(before).alias("mean"), F.stddev_samp(before).alias("sd"), F.min(before).alias("least"), F.max(before).alias("most"), *(e.alias(c) for c, e in evidence.items()),
    )
    reason = (
        F.when(F.col("n_window") == 0, "no_data_in_window").when(F.col("n_baseline") == 0, "no_baseline").when(F.col("n_baseline") < MINIMUM_BASELINE, "baseline_too_thin").otherwise("ok")
    )
    compared = reason == "ok"
    sd = F.when(F.col("least") == F.col("most"), 0.0).otherwise(F.col("sd"))  # equal values leave rounding errors behind
    delta = F.col("value") - F.col("mean")
    only = lambda c: F.when(compared, c)
    out = out.select(
        "metric", "scope", "n_window", "n_baseline", "value", "window_min", "window_max", only(F.col("mean")).alias("baseline_mean"), only(sd).alias("baseline_sd"), only(delta).alias("delta"),
        only(100 * F.try_divide(delta, F.nullif("mean", F.lit(0.0)))).alias("delta_percent"), only(F.try_divide(delta, F.nullif(sd, F.lit(0.0)))).alias("z"), only(direction(delta)).alias("direction"),
        F.when(compared, confidence(F.col("n_baseline"))).otherwise(INSUFFICIENT).alias("confidence"), reason.alias("reason_code"),
        F.lit(low).alias("baseline_from"), F.lit(days_before(start, 1)).alias("baseline_to"), *evidence,
    )
    if requested is None:
        return out
    none = requested.select("metric").distinct().join(out, "metric", "left_anti")
    none = none.select(
        "metric", F.lit("any" if len(scopes) != 1 else scopes[0]).alias("scope"), F.lit(0).cast("long").alias("n_window"), F.lit(0).cast("long").alias("n_baseline"), F.lit(INSUFFICIENT).alias("confidence"),
        F.lit("no_data").alias("reason_code"), F.lit(low).alias("baseline_from"), F.lit(days_before(start, 1)).alias("baseline_to"),
    )
    return out.unionByName(none, allowMissingColumns=True)
