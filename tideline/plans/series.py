"""Series, calendars, latest values, agreement and exports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contract import DAILY, SAMPLE
from ..functions.scalars import days_before, instant_text, local_clock, lower_median, micros, plain_number, window_days
from ..operators.aggregates import agreement
from ..operators.dedupe import latest
from ..operators.intervals import merge
from ..operators.localday import in_local_days, with_local_day, with_offset
from ..operators.sequences import trailing_mean
from .facts import day_means


MAX_DAILY_DAYS, MAX_SAMPLE_DAYS = 1825, 366
NO_DATA = "no data in this window for any source scope"
SHADED = 24


def series_window(end: datetime.date, days: int, cap: int) -> tuple[datetime.date, datetime.date]:
    return days_before(end, window_days(days, cap) - 1), end


def metric_series(daily: DataFrame, sample_days: DataFrame, metrics: DataFrame, end: datetime.date, days: int = 90, scope: str | None = None) -> DataFrame:
    """Points of metrics (ord, metric, unit, cadence) in the window that ends on ``end``, in contract order.

    daily: metric, scope, day, value; sample_days: as ``sample_day_aggregates`` gives them. A daily metric's point has a value, a sample
    metric's min_value, mean_value, max_value and n. A metric without points in any scope has one row with a note.
    """
    (daily_from, _), (sample_from, _) = series_window(end, days, MAX_DAILY_DAYS), series_window(end, days, MAX_SAMPLE_DAYS)
    stored = chosen(daily, first=daily_from, last=end, scope=scope).join(metrics.where(F.col("cadence") == DAILY), "metric")
    folded = chosen(sample_days.withColumnRenamed("local_day", "day"), first=sample_from, last=end, scope=scope).join(metrics.where(F.col("cadence") == SAMPLE), "metric")
    base = ["ord", "metric", "unit", "cadence", "scope", "day"]
    points = stored.select(*base, "value").unionByName(folded.select(*base, "min_value", "mean_value", "max_value", "n"), allowMissingColumns=True)
    none = metrics.select("ord", "metric", "unit", "cadence").join(points.select("metric").distinct(), "metric", "left_anti")
    both = points.withColumn("note", F.lit(None).cast("string")).unionByName(none.withColumn("note", F.lit(NO_DATA)), allowMissingColumns=True)
    return both.orderBy("ord", "scope", "day")


def label_series(labels: DataFrame, end: datetime.date, days: int = 90, metrics: list[str] | None = None, scope: str | None = None) -> DataFrame:
    """Labels (metric, scope, day, label) in the window; rows of one day are not collapsed."""
    first, last = series_window(end, days, MAX_DAILY_DAYS)
    return chosen(labels, metrics, first, last, scope).select("day", "metric", "scope", "label")


def day_values(daily: DataFrame, sample_days: DataFrame, digits: int = 2) -> DataFrame:
    """metric, scope, day, value for either cadence: the stored value of a day, or the mean of its samples."""
    return daily.select("metric", "scope", "day", "value").unionByName(day_means(sample_days, digits))


def intraday(rows: DataFrame, day) -> DataFrame:
    """Samples of one local day with their local second of the day and fractional hour. rows come from ``in_local_days``."""
    clock = local_clock(F.col("ts").cast("timestamp"), F.col("offset_s"))
    second = F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)
    return rows.where(F.col("local_day") == F.lit(day).cast("date")).select("metric", "scope", "raw_id", "value", F.date_format(clock, "HH:mm").alias("local_minute"), second.alias("local_second"), (second / 3600).alias("hour"))


def metric_calendar(values: DataFrame, statuses: DataFrame, completeness: DataFrame) -> DataFrame:
    """Every day of the statuses with value (null where missing), status and completeness."""
    keys = ["metric", "scope", "day"]
    return statuses.join(values.select(*keys, "value"), keys, "left").join(completeness.select(*keys, "percent"), keys, "left")


def latest_values(daily: DataFrame, keys: tuple[str, ...] = ("metric", "scope")) -> DataFrame:
    return latest(daily, list(keys), ["day", "value"])


def today_board(pairs: DataFrame, newest: DataFrame, now: DataFrame) -> DataFrame:
    """Every contract pair with its latest value, and where there is none its status of today (now: metric, scope, status)."""
    out = pairs.select("metric", "scope").distinct().join(newest, ["metric", "scope"], "left").join(now, ["metric", "scope"], "left")
    return out.select("metric", "scope", "day", "value", F.when(F.col("day").isNull(), F.coalesce("status", F.lit("not_covered"))).alias("status"))


def scope_pairs(daily: DataFrame) -> DataFrame:
    """Values of one metric and day in two scopes; devices pool, so a key with several devices gives their product."""
    a = daily.select("metric", "day", F.col("scope").alias("scope_a"), F.col("value").alias("a"))
    b = daily.select("metric", "day", F.col("scope").alias("scope_b"), F.col("value").alias("b"))
    return a.join(b, ["metric", "day"]).where("scope_a < scope_b").select("metric", F.lit(None).cast("string").alias("compared_with"), "day", "scope_a", "scope_b", "a", "b")


def target_pairs(daily: DataFrame, targets: DataFrame) -> DataFrame:
    """Values of differently named metrics that answer one question. targets: metric, scope_a, compared_with, scope_b."""
    a = daily.select("metric", "day", F.col("scope").alias("scope_a"), F.col("value").alias("a"))
    b = daily.select(F.col("metric").alias("compared_with"), "day", F.col("scope").alias("scope_b"), F.col("value").alias("b"))
    met = a.join(targets, ["metric", "scope_a"]).join(b, ["compared_with", "scope_b", "day"])
    return met.select("metric", "compared_with", "day", "scope_a", "scope_b", "a", "b")


def source_agreement(daily: DataFrame, targets: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """How closely sources agree: scopes of one metric, and comparison targets; with units where metrics (metric, unit) are given."""
    out = agreement(scope_pairs(daily).unionByName(target_pairs(daily, targets)))
    return out if metrics is None else out.join(metrics.select("metric", "unit"), "metric", "left")


def chosen(rows: DataFrame, metrics: list[str] | None = None, first=None, last=None, scope: str | None = None) -> DataFrame:
    """Rows (metric, scope, day) of some metrics, days and scope; what is None does not filter."""
    for value, condition in ((metrics, F.col("metric").isin(*metrics or [])), (first, F.col("day") >= F.lit(first).cast("date")), (last, F.col("day") <= F.lit(last).cast("date")), (scope, F.col("scope") == scope)):
        if value:
            rows = rows.where(condition)
    return rows


def export_long(values: DataFrame, labels: DataFrame, units: DataFrame, **filters) -> DataFrame:
    """Numeric values and labels in one table, values as text (in files in the order LONG). units: metric, unit."""
    numbers = chosen(values, **filters).join(units.select("metric", "unit"), "metric", "left").select("day", "metric", "unit", "scope", plain_number(F.col("value")).alias("value"))
    named = chosen(labels, **filters).select("day", "metric", F.lit("label").alias("unit"), "scope", F.col("label").alias("value"))
    return numbers.unionByName(named)


def export_wide(values: DataFrame, labels: DataFrame, columns: list[str] | None = None, **filters) -> DataFrame:
    """A row a day and a text column ``metric[scope]``, all there are by name unless ``columns`` says which; blanks are null.

    Of several devices the largest value counts.
    """
    cells = chosen(values, **filters).select("day", "metric", "scope", "value").unionByName(chosen(labels, **filters).select("day", "metric", "scope", "label"), allowMissingColumns=True)
    keyed = cells.withColumn("key", F.concat("metric", F.lit("["), "scope", F.lit("]")))
    if columns is None:  # the header of the file: metrics times scopes, bounded by the contract; one of the contract's own saves this pass
        columns = sorted(f"{r.metric}[{r.scope}]" for r in cells.select("metric", "scope").distinct().collect())
    cell = keyed.groupBy("day", "key").agg(F.coalesce(plain_number(F.max("value")), F.max("label")).alias("cell"))
    return cell.groupBy("day").pivot("key", columns).agg(F.max("cell"))


def export_samples(samples: DataFrame, metric: str, unit: str | None = None, start=None, end=None) -> DataFrame:
    """Samples of a metric in the half-open range [start, end), values as text (in files in the order SAMPLES)."""
    rows = samples.where(F.col("metric") == metric)
    rows = rows if start is None else rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    rows = rows if end is None else rows.where(F.col("ts") < F.lit(end).cast("timestamp"))
    return rows.select("ts", plain_number(F.col("value")).alias("value"), "scope", F.lit(unit).alias("unit"))


#: The order of exported files: a plan that goes on with an export needs none.
LONG, WIDE, SAMPLES = ("day", "metric", "scope", "value"), ("day",), ("ts", "scope", "value")


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Part files with a header, sorted over all of them where an order is given; blanks are empty, instants are UTC texts."""
    texts = {c: instant_text(F.col(c)) for c, t in df.dtypes if t == "timestamp"}
    df = df.orderBy(*order) if order else df
    df.withColumns(texts).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def recent_runs(runs: DataFrame, others: int = 5, live: int = 1) -> DataFrame:
    """The newest runs of the live transport and the newest of the rest."""
    mine = F.col("transport").eqNullSafe("ble")
    return runs.where(~mine).orderBy(F.desc("run_id")).limit(others).union(runs.where(mine).orderBy(F.desc("run_id")).limit(live)).distinct()


def activities(rows: DataFrame, limit: int = 20) -> DataFrame:
    """The newest activities, 1 to 200 of them, without identifiers."""
    return rows.orderBy(F.desc("start_ts"), F.desc("activity_id")).limit(max(1, min(limit, 200)))


def sleep_windows(nights: DataFrame, day) -> DataFrame:
    """Hours 0 to 24 of the local day that nights (start_ts, end_ts, offset_s) take up."""
    low = micros(F.lit(day).cast("timestamp"))
    a, b = ((micros(F.col(c)) + F.col("offset_s").cast("long") * 1_000_000 - low) / 3_600_000_000 for c in ("start_ts", "end_ts"))
    return nights.select(F.greatest(a, F.lit(0.0)).alias("low_hour"), F.least(b, F.lit(float(SHADED))).alias("high_hour")).where("low_hour < high_hour")


def metric_chart(points: DataFrame, max_gap: int = 3, rolling_days: int = 7) -> DataFrame:
    """What a chart of daily points (metric, scope, day, value) draws: the run each point belongs to, and the trailing mean where there is one."""
    order = Window.partitionBy("metric", "scope").orderBy("day")
    new = F.when(F.datediff("day", F.lag("day").over(order)) > max_gap, 1).otherwise(0)
    drawn = points.withColumn("new", new).withColumn("run", F.sum("new").over(order)).drop("new")
    mean = trailing_mean(points, rolling_days, "metric", "scope").select("metric", "scope", "day", "mean")
    return drawn.join(mean, ["metric", "scope", "day"], "left")


def axes(points: DataFrame, *by: str, target: int = 5, zero: bool = False) -> DataFrame:
    """The value axis of each group's chart: low and high with a margin, step, ticks, and labels with as many decimals as the step needs.

    A step is 1, 2, 2.5 or 5 times a power of ten that gives about ``target`` ticks; there are at most twice as many and two.
    """
    least = F.least(F.min("value"), F.lit(0.0)) if zero else F.min("value")
    out = points.groupBy(*by).agg(least.alias("a"), F.max("value").alias("b"))
    margin = F.when(F.col("a") < F.col("b"), (F.col("b") - F.col("a")) * 0.08).when(F.col("b") == 0, 1.0).otherwise(F.abs("b") * 0.05)
    out = out.select(*by, (F.col("a") - margin).alias("low"), (F.col("b") + margin).alias("high"))
    raw = (F.col("high") - F.col("low")) / target
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw <= unit, unit).when(raw <= 2 * unit, 2 * unit).when(raw <= 2.5 * unit, 2.5 * unit).when(raw <= 5 * unit, 5 * unit).otherwise(10 * unit)
    out = out.withColumn("step", step)
    first = F.ceil(F.col("low") / F.col("step") - 1e-9)
    last = F.least(F.floor(F.col("high") / F.col("step") + 1e-9), first + 2 * target + 1)
    ticks = F.transform(F.sequence(first, last), lambda k: F.round(k * F.col("step"), 10))
    digits = lambda t: F.when(F.col("step") >= 1, F.format_string("%.0f", t)).when(F.col("step") >= 0.1, F.format_string("%.1f", t)).when(F.col("step") >= 0.01, F.format_string("%.2f", t)).otherwise(F.format_string("%.3f", t))
    return out.withColumn("ticks", ticks).withColumn("labels", F.transform("ticks", digits))


def hypnogram(stages: DataFrame, lanes: tuple[str, ...] = ("awake", "rem", "light", "deep", "unmeasurable")) -> DataFrame:
    """Stages (night, scope, stage, start_ts, end_ts) as lanes and hours since the night's first stage of any scope."""
    origin = stages.groupBy("night").agg(F.min("start_ts").alias("origin_ts"))
    lane = F.array_position(F.array(*map(F.lit, lanes)), F.col("stage")).cast("int") - 1
    hours = lambda c: (micros(F.col(c)) - micros(F.col("origin_ts"))) / 3_600_000_000
    return stages.join(origin, "night").select("night", "scope", lane.alias("lane"), hours("start_ts").alias("from_hour"), hours("end_ts").alias("to_hour"))


def with_begin(events: DataFrame) -> DataFrame:
    """Adds begin_ts to stages known by their ends (night, start_ts, end_ts, stage): the end of the one before, for the first the night's start event."""
    order = Window.partitionBy("night").orderBy("end_ts", "stage")
    return events.withColumn("begin_ts", F.coalesce(F.lag("end_ts").over(order), F.col("start_ts")))


def stage_rows(events: DataFrame) -> DataFrame:
    """Sleep stages from their ends: events (night, start_ts, end_ts, stage) -> night, stage, start_ts, end_ts.

    Without a start event the first is left out; empty stages are left out.
    """
    return with_begin(events).where("begin_ts < end_ts").select("night", "stage", F.col("begin_ts").alias("start_ts"), "end_ts")


def sleep_detail(stages: DataFrame) -> DataFrame:
    """Seconds of each stage by night; asleep is deep + light + rem where any of them is there."""
    seconds = F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")
    sums = [F.sum(F.when(F.col("stage") == s, seconds)).alias(f"{s}_s") for s in ("deep", "light", "rem", "awake")]
    out = stages.groupBy("night").agg(*sums, F.count(F.lit(1)).alias("stages"), F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"))
    parts = [F.col(f"{s}_s") for s in ("deep", "light", "rem")]
    asleep = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))
    return out.withColumn("asleep_s", asleep)


def latest_nights(sessions: DataFrame) -> DataFrame:
    """The sessions (scope, date, ...) of the newest date there is."""
    return sessions.join(sessions.agg(F.max("date").alias("date")), "date", "left_semi")


def sleep_sessions(sessions: DataFrame, stages: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Every source's record of a night with its stages inside it.

    sessions: night, start_ts, end_ts and whatever else; stages: night, stage, start_ts, end_ts. Adds stages, an array in order of time of stage,
    start_ts, end_ts, minutes, and with offsets utc_offset_s (nearest to the session's end, else its start) and start_local and end_local,
    each HH:mm under the offset nearest to it. A night without stages has none; without known offsets local times are null.
    """
    parts = ["start_ts", "stage", "end_ts"]
    minutes = (F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")) / 60
    rows = stages.withColumn("minutes", minutes)
    if offsets is not None:
        for c in ("start", "end"):
            rows = with_offset(rows, offsets, f"{c}_ts").withColumn(f"{c}_local", F.when(~F.col("assumed_utc"), F.date_format(local_clock(F.col(f"{c}_ts"), F.col("offset_s")), "HH:mm"))).drop("offset_s", "assumed_utc")
        parts += ["start_local", "end_local"]
    inner = rows.groupBy("night").agg(F.array_sort(F.collect_list(F.struct(*parts, "minutes"))).alias("stages"))  # a night's stages
    out = sessions.join(inner, "night", "left")
    if offsets is None:
        return out
    anchored = out.withColumn("anchor_ts", F.coalesce("end_ts", "start_ts"))
    return with_offset(anchored, offsets, "anchor_ts").withColumn("utc_offset_s", F.when(F.col("anchor_ts").isNotNull() & ~F.col("assumed_utc"), F.col("offset_s"))).drop("offset_s", "assumed_utc", "anchor_ts")


def live_sessions(spans: DataFrame, offsets: DataFrame, day) -> DataFrame:
    """start_ts, end_ts of the runs of overlapping or touching record spans (start_ts, end_ts) that begin or end on a local day.

    Only spans within some days of it are read; both ends of a span meet the offsets in one join.
    """
    at = F.lit(day).cast("date")
    near = spans.where((F.col("end_ts") >= at.cast("timestamp") - F.expr("INTERVAL 2 DAYS")) & (F.col("start_ts") < at.cast("timestamp") + F.expr("INTERVAL 3 DAYS")))
    # a span without length is a session too, so ends are taken as inclusive
    ends = near.select(micros(F.col("start_ts")).alias("low"), (micros(F.col("end_ts")) + 1).alias("high"), F.explode(F.array("start_ts", "end_ts")).alias("ts"))
    mine = with_local_day(ends, offsets).where(F.col("local_day") == at).select("low", "high").distinct()
    return merge(mine, bucket=86_400_000_000).select(F.timestamp_micros("low").alias("start_ts"), F.timestamp_micros(F.col("high") - 1).alias("end_ts"))


def with_local_ends(sessions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds start_local and end_local (the wearer's clock) to sessions (start_ts, end_ts)."""
    ends = sessions.select("start_ts", "end_ts", F.explode(F.array("start_ts", "end_ts")).alias("ts")).distinct()
    clock = with_offset(ends, offsets).withColumn("local", local_clock(F.col("ts"), F.col("offset_s"))).groupBy("start_ts", "end_ts")
    at = lambda c: F.max(F.when(F.col("ts") == F.col(f"{c}_ts"), F.col("local"))).alias(f"{c}_local")
    return sessions.join(clock.agg(at("start"), at("end")), ["start_ts", "end_ts"], "left")


def session_minutes(sessions: DataFrame, minutes: DataFrame) -> DataFrame:
    """sessions: session, low_us, high_us; minutes: minute_us. Adds minutes: the distinct folded minutes of any metric in each session.

    A minute counts from the first reading's floored minute to the session's end, both inclusive. Sessions and minutes meet by hour.
    """
    hour = 3_600_000_000
    spread = sessions.withColumn("from_us", F.col("low_us") - F.pmod("low_us", F.lit(60_000_000)))
    spread = spread.withColumn("hour", F.explode(F.sequence(F.floor(F.col("from_us") / hour), F.floor(F.col("high_us") / hour))))
    met = minutes.withColumn("hour", F.floor(F.col("minute_us") / hour)).join(spread, "hour").where("minute_us between from_us and high_us")
    counted = met.groupBy("session").agg(F.countDistinct("minute_us").alias("minutes"))
    return sessions.join(counted, "session", "left").withColumn("minutes", F.coalesce("minutes", F.lit(0)))


def live_metrics(minutes: DataFrame, offsets: DataFrame, day, metrics: list[str]) -> DataFrame:
    """ord, metric, minutes and lower median of each folded metric on a local day; metrics without minutes have none. minutes: metric, ts, value."""
    rows = in_local_days(minutes.where(F.col("metric").isin(*metrics)), offsets, str(day), str(day)).groupBy("metric").agg(F.count(F.lit(1)).alias("minutes"), lower_median("value").alias("median"))
    names = minutes.sparkSession.createDataFrame(list(enumerate(metrics)), "ord int, metric string")
    return names.join(rows, "metric", "left").select("ord", "metric", F.coalesce("minutes", F.lit(0)).alias("minutes"), "median")
