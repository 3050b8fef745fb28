"""Every operator of the engine as a query over the generic tables, with the SQL that DuckDB can hold against it."""

from __future__ import annotations

import datetime
import io
import itertools
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as A
from . import contract
from .functions import scalars
from .operators import aggregates, dedupe, intervals, localday, selection, sequences
from .plans import coverage, facts, health, series
from .sources import files, fit, ingest, json_records, store
from .streaming import minute_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["metric", "scope", "day"]


LATER: list = []


def query(sql: str | Callable[[], str] | None = None, views: bool = True):
    """Registers a query under its function's name; sql follows the shared views unless it stands alone."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            LATER.append((f.__name__, sql, views))
        return f

    return add


def local(spark: SparkSession, d: str) -> DataFrame:
    return localday.with_local_day(A.samples(spark, d), A.offsets(spark, d))


# -- local days -----------------------------------------------------------------------------------------------------------


def shown(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Doubles rounded for comparison: sums in another order differ in their last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("SELECT metric, scope, local_day, min(value) AS min_value, round(avg(value), 8) AS mean_value, max(value) AS max_value, count(*) AS n FROM L GROUP BY ALL")
def sample_day_aggregates(spark, d):
    return shown(aggregates.sample_day_aggregates(local(spark, d)), 8, "mean_value")


@query(""", C AS (SELECT *, lag(off) OVER (ORDER BY lo2) IS DISTINCT FROM off AS new FROM REG)
SELECT lo2 AS low2, coalesce(lead(lo2) OVER (ORDER BY lo2), 4611686018427387904) AS high2, off AS offset_s FROM C WHERE new""")
def clock_regimes(spark, d):
    return localday.regimes(A.offsets(spark, d))


@query("SELECT raw_id, local_day, off AS offset_s FROM L")
def local_day_of_sample(spark, d):
    return local(spark, d).select("raw_id", "local_day", "offset_s")


@query("SELECT count(*) AS assumed FROM S")
def assumed_utc_count(spark, d):
    none = A.offsets(spark, d).where("raw_id < 0")
    return localday.with_offset(A.samples(spark, d), none).agg(F.count_if("assumed_utc").alias("assumed"))


@query("""SELECT metric, scope, raw_id, value, strftime(ts + to_seconds(CAST(off AS BIGINT)), '%H:%M') AS local_minute,
CAST(date_part('hour', ts + to_seconds(CAST(off AS BIGINT))) * 3600 + date_part('minute', ts + to_seconds(CAST(off AS BIGINT))) * 60 + date_part('second', ts + to_seconds(CAST(off AS BIGINT))) AS BIGINT) AS local_second
FROM L WHERE local_day = DATE '2024-01-10'""")
def intraday_samples(spark, d):
    rows = localday.in_local_days(A.samples(spark, d), A.offsets(spark, d), "2024-01-10", "2024-01-10")
    return series.intraday(rows, "2024-01-10").withColumn("local_second", F.col("local_second").cast("long")).drop("hour")


@query("""SELECT raw_id, round(date_part('hour', ts + to_seconds(CAST(off AS BIGINT))) + date_part('minute', ts + to_seconds(CAST(off AS BIGINT))) / 60 + floor(date_part('second', ts + to_seconds(CAST(off AS BIGINT)))) / 3600, 4) AS hour
FROM L WHERE local_day = DATE '2024-01-12'""")
def intraday_hours(spark, d):
    rows = localday.in_local_days(A.samples(spark, d), A.offsets(spark, d), "2024-01-12", "2024-01-12")
    return series.intraday(rows, "2024-01-12").select("raw_id", F.round("hour", 4).alias("hour"))


@query(""", B AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM ODAY), (SELECT max(day) + 1 FROM ODAY), INTERVAL 1 DAY)) AS DATE) AS day),
M AS (SELECT day, max(date_diff('day', DATE '1970-01-01', day) * 86400 - off) OVER (ORDER BY day) AS low_s FROM B JOIN REG ON 2 * epoch_us(CAST(day AS TIMESTAMP)) > lo2 AND 2 * epoch_us(CAST(day AS TIMESTAMP)) <= hi2),
N AS (SELECT day, CAST(low_s AS BIGINT) AS low_s, CAST(lead(low_s) OVER (ORDER BY day) AS BIGINT) AS high_s FROM M)
SELECT * FROM N WHERE high_s IS NOT NULL""")
def day_bounds(spark, d):
    days = A.table(spark, d, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return localday.day_bounds(days, A.offsets(spark, d))


# -- aggregates -----------------------------------------------------------------------------------------------------------

EVENTS = ("click", "error", "purchase", "signup", "view")
REDUCERS = {f"{m}_{how}": (m, how) for m in EVENTS for how in ("min", "max", "avg")}


@query("""SELECT metric || '_' || how AS metric, device_id, local_day, CASE how WHEN 'min' THEN low WHEN 'max' THEN high ELSE mean END AS value, raw_id FROM (
SELECT metric, device_id, local_day, min(value) AS low, max(value) AS high, round(avg(value), 8) AS mean, arg_max(raw_id, ts) AS raw_id FROM L GROUP BY ALL), (SELECT unnest(['min', 'max', 'avg']) AS how)""")
def daily_reducers(spark, d):
    return shown(aggregates.daily_reducers(local(spark, d), REDUCERS).select("metric", "device_id", "local_day", "value", "raw_id"), 8, "value")


CHARGES = """, W AS (SELECT {of} AS metric, device_id, local_day, ts, raw_id, us, value FROM L), T AS (SELECT metric, device_id, local_day, CASE WHEN us - lag(us) OVER w <= {gap} THEN value - lag(value) OVER w ELSE 0 END AS step FROM W
WINDOW w AS (PARTITION BY metric, device_id, local_day ORDER BY ts, value, raw_id))
SELECT metric, device_id, local_day, round(sum(greatest(step, 0)), 6) AS charged, round(sum(greatest(-step, 0)), 6) AS drained, count(*) AS n FROM T GROUP BY ALL"""


@query(CHARGES.format(of="metric", gap=86_400_000_000))
def energy_charged_drained(spark, d):
    """The product's gap is 900 s; a device's events of one kind are sparse, so it is a day here."""
    return shown(aggregates.charged_drained(local(spark, d), 86_400), 6, "charged", "drained")


@query(CHARGES.format(of="'energy_reserve'", gap=900_000_000))
def energy_within_the_gap(spark, d):
    """Readings of all kinds together, with the product's gap of 900 s."""
    return shown(aggregates.charged_drained(local(spark, d).withColumn("metric", F.lit("energy_reserve"))), 6, "charged", "drained")


@query(""", T AS (SELECT device_id, metric AS kind, ts, raw_id, CAST(ts - INTERVAL 1 SECOND AS DATE) AS local_day, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY device_id, metric, CAST(ts - INTERVAL 1 SECOND AS DATE) ORDER BY ts, raw_id) AS BIGINT) AS counter FROM S),
K AS (SELECT device_id, local_day, kind, max(counter) AS top, arg_max(raw_id, ts) AS raw_id, max(ts) AS ts FROM T GROUP BY ALL)
SELECT device_id, local_day, CAST(sum(top) AS BIGINT) AS total, count(*) AS kinds, arg_max(raw_id, ts) AS raw_id FROM K GROUP BY ALL""")
def counter_daily_total(spark, d):
    s = A.samples(spark, d).withColumn("local_day", F.to_date(F.col("ts") - F.expr("INTERVAL 1 SECOND"))).withColumnRenamed("metric", "kind")
    w = Window.partitionBy("device_id", "kind", "local_day").orderBy("ts", "raw_id")
    return aggregates.counter_totals(s.withColumn("counter", F.sum(F.round(F.col("value") * 100).cast("long")).over(w)))


@query("SELECT metric, scope, local_day, arg_max(raw_id, ts) AS raw_id, max(ts) AS observed FROM L GROUP BY ALL")
def derived_lineage(spark, d):
    keys = ["metric", "scope", "local_day"]
    return dedupe.latest(local(spark, d).select(*keys, F.col("ts").alias("observed"), "raw_id"), keys, ["observed"])


FOLD = """SELECT metric, us - us % 60000000 AS minute_us, quantile_disc(value, 0.5) AS value, count(*) AS n, arg_min(raw_id, (raw_id % 97, raw_id)) AS raw_id FROM S WHERE value <= 90 GROUP BY ALL"""


def readings(spark, d):
    """Valid readings, a third of them in two overlapping records; content order is not the order of raw_id."""
    s = A.samples(spark, d).where("value <= 90").withColumn("content", F.struct(F.expr("raw_id % 97"), "raw_id"))
    again = s.where("raw_id % 3 = 0").withColumns({"content": F.struct(F.lit(1000).cast("long"), F.col("raw_id") + 10_000_000), "raw_id": F.col("raw_id") + 10_000_000})
    return s.unionByName(again.withColumn("content", F.col("content").cast(s.schema["content"].dataType)))


@query(FOLD)
def minute_fold_lower_median(spark, d):
    return aggregates.minute_fold(readings(spark, d), "content")


@query("""SELECT metric, us - us % 60000000 AS minute_us, quantile_disc(value, 0.5) AS value, count(*) AS n FROM S WHERE ts < TIMESTAMP '2024-01-30' GROUP BY ALL""")
def streaming_minute_fold(spark, d):
    """The fold as a stream over the table; minutes that the watermark has closed, so the last day is left to what is still open."""


    name, folder = f"fold_{uuid.uuid4().hex}", store.scratch_folder(spark)
    rows = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{d}/events.parquet*")
    folded = minute_fold.streaming_minute_fold(rows.select("ts", F.col("event_type").alias("metric"), "value"), "1 second")
    minute_fold.run_to_files(folded, f"{folder}/{name}", f"{folder}/{name}-checkpoint")
    return spark.read.parquet(f"{folder}/{name}").where(F.col("minute_us") < 1_706_572_800_000_000)


@query("""SELECT metric, scope, count(*) AS n, quantile_disc(value, 0.5) AS lower, list_sort(list(value), 'DESC')[CAST((count(*) + 1) // 2 AS INTEGER)] AS upper FROM S GROUP BY ALL""")
def medians(spark, d):
    return selection.medians(A.samples(spark, d), "value", "metric", "scope")


@query("SELECT us, metric, value, min(raw_id) AS raw_id FROM S GROUP BY ALL")
def reading_dedupe(spark, d):
    """Readings that two overlapping records both hold count once, under the first record."""
    s = A.samples(spark, d).select(F.unix_micros("ts").alias("us"), "metric", "value", "raw_id")
    both = s.unionByName(s.where("raw_id % 2 = 0").withColumn("raw_id", F.col("raw_id") + 10_000_000))
    return dedupe.first_write(both, ["us", "metric", "value"], ["raw_id"])


LIVE_VALUES = """, LV AS (SELECT ['heart_rate', 'stress', 'respiration_rate', 'spo2', 'energy_reserve'][raw_id % 5 + 1] AS metric, raw_id % 271 - 10 AS value FROM S)"""


@query(LIVE_VALUES + """ SELECT reason, count(*) AS n FROM (SELECT CASE WHEN metric = 'heart_rate' AND (value <= 0 OR value >= 255) THEN 'heart_rate_zero' WHEN metric = 'stress' AND (value < 0 OR value > 100) THEN 'stress_sentinel'
WHEN metric = 'respiration_rate' AND (value < 0 OR value >= 255) THEN 'respiration_sentinel' WHEN metric = 'spo2' AND (value <= 0 OR value > 100) THEN 'spo2_off_wrist_or_zero'
WHEN metric = 'energy_reserve' AND (value < 0 OR value > 100) THEN 'energy_reserve_out_of_range' END AS reason FROM LV) WHERE reason IS NOT NULL GROUP BY 1""")
def sentinel_drops(spark, d):
    """The live link's own rules."""
    names = ["heart_rate", "stress", "respiration_rate", "spo2", "energy_reserve"]
    rows = A.samples(spark, d).select(A.pick(names, F.col("raw_id") % 5).alias("metric"), (F.col("raw_id") % 271 - 10).alias("value"))
    return aggregates.drop_counts(rows, files.keep_readings(rows)[1])


@query("SELECT stream, count(DISTINCT device_id) AS files, count(*) FILTER (WHERE raw_id % 11 <> 0) AS records, count(*) FILTER (WHERE raw_id % 11 = 0) AS dropped FROM RAW GROUP BY 1")
def stream_counts(spark, d):
    rows = A.raw(spark, d).select("stream", F.col("device_id").alias("file"), "raw_id")
    return aggregates.stream_counts(rows, {"invented": "raw_id % 11 = 0"})


# -- facts ----------------------------------------------------------------------------------------------------------------

AS_OF = datetime.date(1999, 6, 30)
# The rules as the product states them: no values in the window: no comparison; under three days before it: none either.
FACTS = """, F0 AS (SELECT metric, scope, day, day >= DATE '1999-06-24' AS recent, cents / 100 AS v FROM {of} WHERE day BETWEEN DATE '1999-05-27' AND DATE '1999-06-30'),
F1 AS (SELECT metric, scope, count(*) FILTER (WHERE recent) AS n_window, count(*) FILTER (WHERE NOT recent) AS n_baseline, avg(v) FILTER (WHERE recent) AS value, min(v) FILTER (WHERE recent) AS window_min,
  max(v) FILTER (WHERE recent) AS window_max, avg(v) FILTER (WHERE NOT recent) AS bm, stddev_samp(v) FILTER (WHERE NOT recent) AS sd FROM F0 GROUP BY ALL),
F2 AS (SELECT *, CASE WHEN n_window = 0 THEN 'no_data_in_window' WHEN n_baseline = 0 THEN 'no_baseline' WHEN n_baseline < 3 THEN 'baseline_too_thin' ELSE 'ok' END AS reason_code FROM F1)
"""
THIN = """, DT AS (SELECT * FROM D WHERE NOT (metric = '1-URGENT' AND day < DATE '1999-06-24') AND NOT (metric = '2-HIGH' AND day >= DATE '1999-06-24') AND NOT (metric = '3-MEDIUM' AND day < DATE '1999-06-22')
AND NOT (metric = '4-NOT SPECIFIED' AND day < DATE '1999-06-18'))"""


def thinned(spark, d):
    """Daily values with windows and baselines that are empty or thin for some metrics."""
    gone = [("1-URGENT", "day < DATE '1999-06-24'"), ("2-HIGH", "day >= DATE '1999-06-24'"), ("3-MEDIUM", "day < DATE '1999-06-22'"), ("4-NOT SPECIFIED", "day < DATE '1999-06-18'")]
    rows = A.daily(spark, d)
    for metric, condition in gone:
        rows = rows.where(f"NOT (metric = '{metric}' AND {condition})")
    return rows


def some_facts(spark, d, **more):
    return facts.period_facts(thinned(spark, d), AS_OF, **more)


@query(THIN + FACTS.format(of="DT") + """SELECT metric, scope, n_window, n_baseline, CAST(round(value * n_window * 100) AS BIGINT) AS window_cents, window_min, window_max, CASE WHEN reason_code = 'ok' THEN CAST(round(bm * n_baseline * 100) AS BIGINT) END AS baseline_cents,
CASE WHEN reason_code = 'ok' THEN round(sd, 4) END AS baseline_sd, CASE WHEN reason_code = 'ok' THEN round(value - bm, 5) END AS delta, CASE WHEN reason_code = 'ok' THEN round((value - bm) / bm * 100, 6) END AS delta_percent,
CASE WHEN reason_code = 'ok' THEN round((value - bm) / nullif(sd, 0), 6) END AS z FROM F2""")
def period_facts(spark, d):
    f = some_facts(spark, d)
    cents = lambda mean, n: F.round(F.col(mean) * F.col(n) * 100).cast("long")
    return f.select(
        "metric", "scope", "n_window", "n_baseline", cents("value", "n_window").alias("window_cents"), "window_min", "window_max", cents("baseline_mean", "n_baseline").alias("baseline_cents"), F.round("baseline_sd", 4).alias("baseline_sd"),
        F.round("delta", 5).alias("delta"), F.round("delta_percent", 6).alias("delta_percent"), F.round("z", 6).alias("z"),
    )


@query(THIN + FACTS.format(of="DT") + """SELECT metric, scope, CASE WHEN reason_code <> 'ok' THEN 'insufficient' WHEN n_baseline >= 8 THEN 'high' WHEN n_baseline >= 5 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN reason_code = 'ok' THEN CASE WHEN abs(value - bm) < 1e-9 THEN 'unchanged' WHEN value > bm THEN 'higher' ELSE 'lower' END END AS direction FROM F2""")
def facts_confidence(spark, d):
    return some_facts(spark, d).select("metric", "scope", "confidence", "direction")


@query(THIN + FACTS.format(of="DT") + """SELECT metric, scope, reason_code FROM F2 UNION ALL SELECT 'never', 'any', 'no_data'""")
def facts_reason_codes(spark, d):
    asked = A.daily(spark, d).select("metric").distinct().union(spark.range(1).select(F.lit("never")))
    return some_facts(spark, d, requested=asked).select("metric", "scope", "reason_code")


@query(THIN + FACTS.format(of="DT") + """SELECT metric, scope, string_agg(CAST(day AS VARCHAR), ' ' ORDER BY day) AS window_dates, string_agg(CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY day) AS window_cents, DATE '1999-05-27' AS baseline_from, DATE '1999-06-23' AS baseline_to FROM F0 WHERE recent GROUP BY ALL""")
def facts_evidence(spark, d):
    f = some_facts(spark, d, points=True).where("n_window > 0")
    points = F.transform("window_points", lambda p: F.round(p.value * 100).cast("long").cast("string"))
    dates = F.transform("window_dates", lambda x: x.cast("string"))
    return f.select("metric", "scope", F.array_join(dates, " ").alias("window_dates"), F.array_join(points, " ").alias("window_cents"), "baseline_from", "baseline_to")


@query(""", DM AS (SELECT metric, scope, local_day AS day, avg(value) AS v FROM L GROUP BY ALL), W AS (SELECT metric, scope, count(*) FILTER (WHERE day >= DATE '2024-01-24') AS n_window, count(*) FILTER (WHERE day < DATE '2024-01-24') AS n_baseline,
avg(v) FILTER (WHERE day >= DATE '2024-01-24') AS value, avg(v) FILTER (WHERE day < DATE '2024-01-24') AS bm FROM DM WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-30' GROUP BY ALL)
SELECT metric, scope, n_window, n_baseline, CAST(round(value * n_window * 100) AS BIGINT) AS window_cents, CAST(round(bm * n_baseline * 100) AS BIGINT) AS baseline_cents FROM W""")
def sample_facts(spark, d):
    """Facts of sample metrics are means of day means."""
    f = facts.period_facts(facts.day_means(aggregates.sample_day_aggregates(local(spark, d)), 12), datetime.date(2024, 1, 30), baseline=14)
    cents = lambda mean, n: F.round(F.col(mean) * F.col(n) * 100).cast("long")
    return f.select("metric", "scope", "n_window", "n_baseline", cents("value", "n_window").alias("window_cents"), cents("baseline_mean", "n_baseline").alias("baseline_cents"))


@query("SELECT greatest((SELECT max(day) FROM D), (SELECT max(CAST(ts AS DATE)) FROM S)) AS day")
def latest_stored_day(spark, d):
    return facts.latest_stored_day(A.daily(spark, d), A.samples(spark, d))


# -- agreement ------------------------------------------------------------------------------------------------------------

AGREE = """ count(*) AS n, count(*) FILTER (WHERE abs(x.v - y.v) <= greatest(0.5, 0.005 * abs(y.v))) AS matches, round(list_sort(list(abs(x.v - y.v)))[CAST(count(*) // 2 AS INTEGER) + 1], 3) AS median_abs,
round(max(abs(x.v - y.v)), 3) AS max_abs, CAST(round(avg(x.v - y.v) * count(*) * 100) AS BIGINT) AS sum_cents"""
DV = "(SELECT *, cents / 100 AS v FROM D)"
TARGETS = [("1-URGENT", "local", "2-HIGH", "vendor_cloud"), ("3-MEDIUM", "local", "5-LOW", "vendor_cloud")]
PAIRED = f"""SELECT x.metric, CAST(NULL AS VARCHAR) AS compared_with, x.scope AS scope_a, y.scope AS scope_b, {AGREE} FROM {DV} x JOIN {DV} y ON x.metric = y.metric AND x.day = y.day AND x.scope < y.scope GROUP BY ALL"""
TARGETED = f"""SELECT x.metric, t.other AS compared_with, x.scope AS scope_a, y.scope AS scope_b, {AGREE} FROM {DV} x JOIN (VALUES ('1-URGENT', 'local', '2-HIGH', 'vendor_cloud'), ('3-MEDIUM', 'local', '5-LOW', 'vendor_cloud')) t(m, a, other, b)
ON x.metric = t.m AND x.scope = t.a JOIN {DV} y ON t.other = y.metric AND t.b = y.scope AND x.day = y.day GROUP BY ALL"""


def targets(spark):
    return spark.createDataFrame(TARGETS, "metric string, scope_a string, compared_with string, scope_b string")


def compared(df):
    out = shown(df, 3, "median_abs", "max_abs").withColumn("sum_cents", F.round(F.col("mean_d") * F.col("n") * 100).cast("long"))
    return out.drop("mean_d")


@query(f"{PAIRED} UNION ALL {TARGETED}")
def source_agreement(spark, d):
    return compared(series.source_agreement(A.daily(spark, d), targets(spark)))


@query(TARGETED)
def comparison_targets(spark, d):
    return compared(aggregates.agreement(series.target_pairs(A.daily(spark, d), targets(spark))))


@query(f"""SELECT x.metric, x.scope AS scope_a, y.scope AS scope_b, count(*) AS n, round(quantile_disc(-abs(x.v - y.v), 0.5) * -1, 3) AS median_abs FROM {DV} x JOIN {DV} y ON x.metric = y.metric AND x.day = y.day AND x.scope < y.scope GROUP BY ALL""")
def agreement_upper_median(spark, d):
    return shown(aggregates.agreement(series.scope_pairs(A.daily(spark, d))), 3, "median_abs").select("metric", "scope_a", "scope_b", "n", "median_abs")


# -- coverage -------------------------------------------------------------------------------------------------------------


def covered(spark, d):
    return coverage.covered_days(A.raw(spark, d), A.claims(spark, d), A.FIRST, A.LAST)


def failed(spark, d):
    return coverage.failed_days(A.failures(spark, d), A.raw(spark, d), A.FIRST, A.LAST)


def statuses(spark, d):
    daily = A.daily(spark, d)
    return coverage.statuses(coverage.calendar(A.FIRST, A.LAST, spark), A.pairs(spark, d), daily, coverage.day_flags(A.spans(spark, d), A.FIRST, A.LAST))


@query("SELECT stream, day FROM COV")
def coverage_covered(spark, d):
    return covered(spark, d)


@query("SELECT stream, day FROM FAI SEMI JOIN CAL USING (day)")
def coverage_failed(spark, d):
    return failed(spark, d)


@query("SELECT DISTINCT metric, scope, day FROM D")
def coverage_present(spark, d):
    return A.daily(spark, d).select(*KEYS).distinct()


@query("SELECT stream, count(*) AS days FROM COV WHERE stream IN ('fit:sleep', 'fit:hrv', 'fit:skin_temp') GROUP BY 1")
def nightly_borrow(spark, d):
    return covered(spark, d).where(F.col("stream").isin(*contract.NIGHTLY)).groupBy("stream").agg(F.count(F.lit(1)).alias("days"))


@query("SELECT metric, scope, day, status FROM ST")
def coverage_status(spark, d):
    return statuses(spark, d)


@query("""SELECT metric, scope, count(*) FILTER (WHERE status = 'present') AS present, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'source_empty') AS source_empty,
count(*) FILTER (WHERE status = 'not_covered') AS not_covered FROM ST GROUP BY ALL""")
def coverage_ledger(spark, d):
    return coverage.ledger(statuses(spark, d))


@query(""", G AS (SELECT *, date_diff('day', DATE '1970-01-01', day) - row_number() OVER (PARTITION BY metric, scope, status ORDER BY day) AS island FROM ST WHERE status <> 'present'),
R AS (SELECT metric, scope, status, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM G GROUP BY metric, scope, status, island)
SELECT *, count(*) OVER (PARTITION BY metric, scope) > 20 AS more FROM R QUALIFY row_number() OVER (PARTITION BY metric, scope ORDER BY first_day DESC, status) <= 20""")
def coverage_gaps(spark, d):
    return coverage.status_gaps(statuses(spark, d))


@query("""SELECT DISTINCT o_orderpriority AS metric, CASE o_orderstatus WHEN 'O' THEN 'device' WHEN 'F' THEN 'vendor_cloud' ELSE 'local' END AS scope, stream
FROM orders JOIN RAW ON o_orderkey = raw_id WHERE stream <> 'json:live' EXCEPT SELECT metric, scope, stream FROM P""")
def map_drift(spark, d):
    scope = F.when(F.col("o_orderstatus") == "O", "device").when(F.col("o_orderstatus") == "F", "vendor_cloud").otherwise("local")
    rows = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("metric"), scope.alias("scope"), F.col("o_orderkey").alias("raw_id"))
    return coverage.map_drift(coverage.observed_streams(rows, A.raw(spark, d)), A.pairs(spark, d))


@query("SELECT ST.metric, ST.scope, ST.day, cents / 100 AS value, status, CASE WHEN n % 3 = 0 THEN least(100, 100 * (n * 7000) // 50000) END AS percent FROM ST LEFT JOIN D USING (metric, scope, day)")
def metric_calendar(spark, d):
    daily = A.daily(spark, d)
    worn_part = daily.where("n % 3 = 0").select(*KEYS, intervals.completeness(F.col("n") * 7000, F.lit(50_000)).cast("long").alias("percent"))
    return series.metric_calendar(daily, statuses(spark, d), worn_part)


@query("SELECT metric, scope, status FROM ST WHERE day = DATE '1998-03-04'")
def statuses_on(spark, d):
    return coverage.statuses_on("1998-03-04", A.pairs(spark, d), A.daily(spark, d), A.spans(spark, d))


# -- intervals ------------------------------------------------------------------------------------------------------------

SPANS = """, SP AS (SELECT l_suppkey AS device, CAST(epoch(l_shipdate) AS BIGINT) AS low, CAST(epoch(l_shipdate) AS BIGINT) + CAST(l_quantity AS BIGINT) * 7200 AS high FROM lineitem),
M0 AS (SELECT *, max(high) OVER (PARTITION BY device ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM SP WHERE high > low),
M1 AS (SELECT *, sum(CASE WHEN low > before THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM M0),
MS AS (SELECT device, min(low) AS low, max(high) AS high FROM M1 GROUP BY device, island)
"""


def spans(spark, d):
    at = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("device"), at.alias("low"), (at + F.col("l_quantity").cast("long") * 7200).alias("high"))


@query(SPANS + "SELECT device, low, high FROM MS")
def interval_union(spark, d):
    return intervals.merge(spans(spark, d), "device")


def utc_bounds(spark):
    n = F.unix_date("day").cast("long") * 86_400
    return coverage.calendar(A.FIRST, "2002-12-31", spark).select("day", n.alias("low_s"), (n + 86_400).alias("high_s"))


@query(SPANS + """, B AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS day), X AS (SELECT day, epoch(CAST(day AS TIMESTAMP)) AS lo FROM B),
C AS (SELECT device, day, CAST(sum(least(high, lo + 86400) - greatest(low, lo)) AS BIGINT) AS seconds FROM MS JOIN X ON low < lo + 86400 AND high > lo GROUP BY ALL),
W AS (SELECT DISTINCT l_suppkey AS device, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45)
SELECT coalesce(C.device, W.device) AS device, coalesce(C.day, W.day) AS day, CASE WHEN W.device IS NOT NULL THEN 86400 ELSE seconds END AS seconds FROM C FULL JOIN W ON C.device = W.device AND C.day = W.day""")
def covered_seconds(spark, d):
    li = A.table(spark, d, "lineitem")
    claimed = li.where("l_linenumber = 1 and l_quantity > 45").select(F.col("l_suppkey").alias("device"), F.to_date("l_shipdate").alias("day"))
    return intervals.covered_seconds(spans(spark, d), utc_bounds(spark), claimed, "device")


WORN = """, RD AS (SELECT DISTINCT metric, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM S), NX AS (SELECT metric, s, lead(s) OVER (PARTITION BY metric ORDER BY s) - s AS gap FROM RD),
WS AS (SELECT metric, s AS low, s + CASE WHEN gap <= 300 THEN gap ELSE 60 END AS high FROM NX),
WD AS (SELECT metric, day, CAST(sum(least(high, lo + 86400) - greatest(low, lo)) AS BIGINT) AS seconds FROM WS JOIN (SELECT day, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS lo FROM (SELECT day FROM ODAY UNION SELECT day + 1 FROM ODAY)) ON low < lo + 86400 AND high > lo GROUP BY ALL)
"""


def worn(spark, d):
    at = A.samples(spark, d).select("metric", F.unix_seconds(F.date_trunc("second", "ts")).alias("at_s"))
    days = A.table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    days = days.union(days.select(F.date_add("day", 1))).distinct()
    n = F.unix_date("day").cast("long") * 86_400
    return intervals.clipped_seconds(intervals.worn_spans(at, "metric"), days.select("day", n.alias("low_s"), (n + 86_400).alias("high_s")), "metric")


@query(WORN + "SELECT metric, day, seconds FROM WD")
def worn_seconds(spark, d):
    return worn(spark, d)


@query(WORN + "SELECT metric, day, least(100, 100 * seconds // (3600 * (1 + date_diff('day', DATE '1970-01-01', day) % 12))) AS percent FROM WD")
def completeness(spark, d):
    w = worn(spark, d)
    return w.select("metric", "day", intervals.completeness(F.col("seconds"), (1 + F.unix_date("day") % 12) * 3600).alias("percent"))


# -- series, latest, exports ----------------------------------------------------------------------------------------------


METRICS = ("5-LOW", "1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "2-HIGH")
METRIC_SQL = "(VALUES " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(METRICS)) + ") t(ord, metric)"


def ranked(spark):
    """All daily metrics of the tables, and the kinds of events as sample metrics, with a contract order."""
    rows = [(i, m, "cents", contract.DAILY) for i, m in enumerate(METRICS)] + [(10 + i, m, "points", contract.SAMPLE) for i, m in enumerate(EVENTS)] + [(99, "never", "none", contract.DAILY)]
    return spark.createDataFrame(rows, "ord int, metric string, unit string, cadence string")


@query(f"SELECT D.metric, scope, day, cents, ord FROM D JOIN {METRIC_SQL} USING (metric) WHERE day BETWEEN DATE '2001-08-01' - 1824 AND DATE '2001-08-01'")
def metric_series_daily(spark, d):
    out = series.metric_series(A.daily(spark, d), A.samples(spark, d).where("false").select("metric", "scope", F.to_date("ts").alias("local_day"), *(F.lit(0.0).alias(c) for c in ("min_value", "mean_value", "max_value")), F.lit(0).alias("n")),
                               ranked(spark).where("cadence = 'daily' and metric <> 'never'"), datetime.date(2001, 8, 1), 100_000)
    return out.select("metric", "scope", "day", F.round(F.col("value") * 100).cast("long").alias("cents"), "ord")


EVENT_SQL = "(VALUES " + ", ".join(f"({10 + i}, '{m}')" for i, m in enumerate(EVENTS)) + ") t(ord, metric)"


@query(f"""SELECT ord, metric, 'points' AS unit, 'sample' AS cadence, scope, local_day AS day, min(value) AS min_value, round(avg(value), 8) AS mean_value, max(value) AS max_value, count(*) AS n, CAST(NULL AS VARCHAR) AS note
FROM L JOIN {EVENT_SQL} USING (metric) WHERE local_day BETWEEN DATE '2024-01-10' AND DATE '2024-01-29' GROUP BY ALL
UNION ALL SELECT ord, metric, CASE WHEN ord = 99 THEN 'none' ELSE 'cents' END, 'daily', NULL, NULL, NULL, NULL, NULL, NULL, 'no data in this window for any source scope' FROM (SELECT * FROM {METRIC_SQL} UNION ALL SELECT 99, 'never')""")
def metric_series(spark, d):
    """Either cadence in one table; metrics without points in the window have a note."""
    out = series.metric_series(A.daily(spark, d), aggregates.sample_day_aggregates(local(spark, d)), ranked(spark), datetime.date(2024, 1, 29), 20)
    return shown(out.drop("value"), 8, "mean_value")


LABELS = "(SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS metric, 'device' AS scope, o_orderstatus AS label FROM orders)"


def labels(spark, d):
    return A.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("metric"), F.lit("device").alias("scope"), F.col("o_orderstatus").alias("label"))


@query(f"SELECT * FROM {LABELS} WHERE day BETWEEN DATE '2001-08-01' - 1824 AND DATE '2001-08-01'")
def metric_series_labels(spark, d):
    return series.label_series(labels(spark, d), datetime.date(2001, 8, 1), 1825)


@query("""SELECT event_type AS name, CASE event_type WHEN 'click' THEN 'steps' WHEN 'view' THEN 'hrv_status' ELSE event_type END AS asked, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY ALL""", views=False)
def ignored_metrics(spark, d):
    """Names that the contract does not know; two kinds of events are asked for by names that it does."""
    asked = F.when(F.col("event_type") == "click", "steps").when(F.col("event_type") == "view", "hrv_status").otherwise(F.col("event_type"))
    names = A.table(spark, d, "events").groupBy(F.col("event_type").alias("name"), asked.alias("asked")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(contract.metrics(spark).select(F.col("metric").alias("asked")), "asked", "left_anti")


@query("""SELECT metric, scope, max(day) AS day, round(arg_max(cents, day) / 100, 6) AS value FROM D GROUP BY ALL
UNION ALL SELECT metric, scope, day, arg_max(v, day) FROM (SELECT metric, scope, local_day AS day, round(avg(value), 6) AS v FROM L GROUP BY ALL) QUALIFY day = max(day) OVER (PARTITION BY metric, scope)""".replace("arg_max(v, day) FROM", "v FROM"))
def latest_value(spark, d):
    """Of sample metrics the mean of the newest local day."""
    found = series.latest_values(series.day_values(A.daily(spark, d), aggregates.sample_day_aggregates(local(spark, d)), 12))
    return shown(found, 6, "value")


@query("SELECT metric, scope, max(local_day) AS local_day FROM L GROUP BY ALL")
def latest_sample_day(spark, d):
    found = series.latest_values(facts.day_means(aggregates.sample_day_aggregates(local(spark, d))))
    return found.select("metric", "scope", F.col("day").alias("local_day"))


@query("""SELECT t.metric, t.scope, x.day, x.value, CASE WHEN x.day IS NULL THEN ST.status END AS status FROM (SELECT DISTINCT metric, scope FROM P) t
LEFT JOIN (SELECT metric, scope, max(day) AS day, arg_max(cents, day) / 100 AS value FROM D WHERE metric <> '5-LOW' GROUP BY ALL) x USING (metric, scope)
LEFT JOIN ST ON ST.metric = t.metric AND ST.scope = t.scope AND ST.day = DATE '2001-08-01'""")
def today_board(spark, d):
    daily = A.daily(spark, d)
    newest = series.latest_values(daily.where("metric <> '5-LOW'").select("metric", "scope", "day", "value"))
    return series.today_board(A.pairs(spark, d), newest, coverage.statuses_on("2001-08-01", A.pairs(spark, d), daily, A.spans(spark, d)))


RUNS = ", R AS (SELECT o_orderkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ble' WHEN '2-HIGH' THEN NULL ELSE 'file' END AS transport FROM orders)"


@query(RUNS + """ SELECT * FROM (SELECT * FROM R WHERE transport IS DISTINCT FROM 'ble' ORDER BY run_id DESC LIMIT 5) UNION SELECT * FROM (SELECT * FROM R WHERE transport = 'ble' ORDER BY run_id DESC LIMIT 1)""")
def recent_runs(spark, d):
    return series.recent_runs(runs(spark, d))


@query("SELECT raw_id AS activity_id, stream, start_ts FROM RAW ORDER BY start_ts DESC, raw_id DESC LIMIT 20")
def recent_activities(spark, d):
    return series.activities(A.raw(spark, d).select(F.col("raw_id").alias("activity_id"), "stream", "start_ts"))


@query(""", T AS (SELECT metric, scope, day, CASE WHEN date_diff('day', lag(day) OVER w, day) > 3 THEN 1 ELSE 0 END AS new FROM D WINDOW w AS (PARTITION BY metric, scope ORDER BY day)),
U AS (SELECT *, CAST(sum(new) OVER (PARTITION BY metric, scope ORDER BY day) AS BIGINT) AS run FROM T)
SELECT metric, scope, run, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM U GROUP BY ALL""")
def series_runs(spark, d):
    return sequences.series_runs(A.daily(spark, d), 3, "metric", "scope")


MEANS = """, T AS (SELECT metric, scope, day, CAST(sum(cents) OVER w AS BIGINT) AS sum_cents, count(*) OVER w AS present, min(day) OVER (PARTITION BY metric, scope) AS f
FROM D WINDOW w AS (PARTITION BY metric, scope ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)), TM AS (SELECT metric, scope, day, sum_cents, present FROM T WHERE present * 2 >= 7 AND day - 6 >= f)"""


@query(MEANS + " SELECT * FROM TM")
def trailing_mean(spark, d):
    out = sequences.trailing_mean(A.daily(spark, d), 7, "metric", "scope")
    return out.withColumn("sum_cents", F.round(F.col("mean") * F.col("present") * 100).cast("long")).drop("mean")


@query(MEANS + """, RT AS (SELECT metric, scope, day, cents, CASE WHEN date_diff('day', lag(day) OVER w, day) > 3 THEN 1 ELSE 0 END AS new FROM D WINDOW w AS (PARTITION BY metric, scope ORDER BY day))
SELECT RT.metric, RT.scope, RT.day, RT.cents, CAST(sum(new) OVER (PARTITION BY RT.metric, RT.scope ORDER BY RT.day) AS BIGINT) AS run, round(sum_cents / present / 100, 4) AS mean FROM RT LEFT JOIN TM ON RT.metric = TM.metric AND RT.scope = TM.scope AND RT.day = TM.day""")
def metric_chart(spark, d):
    out = series.metric_chart(A.daily(spark, d).select("metric", "scope", "day", "value"))
    return out.select("metric", "scope", "day", F.round(F.col("value") * 100).cast("long").alias("cents"), "run", F.round("mean", 4).alias("mean"))


def named(spark):
    return spark.createDataFrame([(m, "cents") for m in METRICS[:4]], "metric string, unit string")


NUMBER = "CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR) WHEN cents % 10 = 0 THEN printf('%d.%d', cents // 100, cents % 100 // 10) ELSE printf('%d.%02d', cents // 100, cents % 100) END"


@query(f"""SELECT day, metric, CASE metric WHEN '2-HIGH' THEN NULL ELSE 'cents' END AS unit, scope, {NUMBER} AS value FROM D UNION ALL SELECT DISTINCT day, metric, 'label', scope, label FROM {LABELS}""")
def export_long(spark, d):
    return series.export_long(A.daily(spark, d), labels(spark, d).distinct(), named(spark))


@query(f"""SELECT day, metric, 'cents' AS unit, scope, {NUMBER} AS value FROM D WHERE metric IN ('5-LOW', '1-URGENT') AND day >= DATE '1998-01-01' AND day <= DATE '1999-06-30' AND scope = 'device'
UNION ALL SELECT DISTINCT day, metric, 'label', scope, label FROM {LABELS} WHERE metric IN ('5-LOW', '1-URGENT') AND day BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'""")
def export_filtered(spark, d):
    return series.export_long(A.daily(spark, d), labels(spark, d).distinct(), named(spark), metrics=["5-LOW", "1-URGENT"], first="1998-01-01", last="1999-06-30", scope="device")


WIDE = [f"{m}[{scope}]" for m in sorted(METRICS) for scope in ("device", "local", "vendor_cloud")]


@query("SELECT day, " + ", ".join(f"""max(v) FILTER (WHERE k = '{c}') AS "{c}" """ for c in WIDE) + f""" FROM (SELECT day, metric || '[' || scope || ']' AS k, {NUMBER} AS v FROM D
UNION ALL SELECT l.day, l.metric || '[device]', max(label) FROM {LABELS} l LEFT JOIN D ON l.day = D.day AND l.metric = D.metric AND D.scope = 'device' WHERE D.day IS NULL GROUP BY ALL) GROUP BY day""")
def export_wide(spark, d):
    return series.export_wide(A.daily(spark, d), labels(spark, d))


@query("""SELECT ts, CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR) WHEN c % 10 = 0 THEN printf('%d.%d', c // 100, c % 100 // 10) ELSE printf('%d.%02d', c // 100, c % 100) END AS value, scope, 'points' AS unit
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM S) WHERE metric = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'""")
def export_samples(spark, d):
    return series.export_samples(A.samples(spark, d), "click", "points", "2024-01-05", "2024-01-12")


# -- which row stays ------------------------------------------------------------------------------------------------------


def versions(spark, d):
    return A.samples(spark, d).select("metric", "device_id", F.to_date("ts").alias("day"), F.col("ts").alias("observed"), "value", "raw_id")


@query("SELECT metric, device_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, raw_id)) AS value, arg_max(raw_id, (ts, raw_id)) AS raw_id, max(ts) AS observed FROM S GROUP BY ALL")
def upsert_latest_observed(spark, d):
    return dedupe.latest_observed(versions(spark, d), ["metric", "device_id", "day"], "raw_id")


@query("SELECT metric, device_id, CAST(ts AS DATE) AS day, max(raw_id) AS raw_id, arg_max(value, raw_id) AS value FROM S GROUP BY ALL")
def last_write_wins(spark, d):
    return dedupe.last_write(versions(spark, d).drop("observed"), ["metric", "device_id", "day"], ["raw_id"])


@query("SELECT metric, device_id, CAST(ts AS DATE) AS day, min(raw_id) AS raw_id, arg_min(value, raw_id) AS value FROM S GROUP BY ALL")
def first_write_wins(spark, d):
    return dedupe.first_write(versions(spark, d).drop("observed"), ["metric", "device_id", "day"], ["raw_id"])


@query("SELECT device_id, stream, max(CAST(start_ts AS DATE)) AS observed, arg_max(md5(CAST(raw_id AS VARCHAR)), (CAST(start_ts AS DATE), md5(CAST(raw_id AS VARCHAR)))) AS payload_hash FROM RAW GROUP BY ALL")
def conflict_winner(spark, d):
    rows = A.raw(spark, d).select("device_id", "stream", F.to_date("start_ts").alias("observed"), F.md5(F.col("raw_id").cast("string")).alias("payload_hash"))
    return dedupe.conflict_winner(rows, ["device_id", "stream"])


CHAIN = ", C AS (SELECT device_id, raw_id AS seq, lag(raw_id) OVER (PARTITION BY device_id ORDER BY raw_id) AS prev FROM RAW), K AS (SELECT * FROM C WHERE seq % 10 <> 3)"


@query(CHAIN + " SELECT device_id, seq, prev FROM K WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM K AS p WHERE p.device_id = K.device_id AND p.seq = K.prev)")
def chain_gaps(spark, d):
    w = Window.partitionBy("device_id").orderBy("seq")
    chain = A.raw(spark, d).select("device_id", F.col("raw_id").alias("seq")).withColumn("prev", F.lag("seq").over(w))
    return sequences.chain_gaps(chain.where("seq % 10 <> 3"))


@query("SELECT stream, raw_id, d AS digest FROM (SELECT stream, raw_id, CASE WHEN raw_id % 7 > 0 THEN CAST(start_ts AS DATE) END AS day, md5(CAST(raw_id % 50 AS VARCHAR)) AS d FROM RAW) QUALIFY row_number() OVER (PARTITION BY stream ORDER BY day NULLS FIRST, d, raw_id) = 1")
def content_ordered(spark, d):
    """The first record of each stream in content order: those without a start come first."""
    rows = A.raw(spark, d).select("stream", "raw_id", F.when(F.col("raw_id") % 7 > 0, F.to_date("start_ts")).alias("day"), F.md5((F.col("raw_id") % 50).cast("string")).alias("digest"))
    return rows.groupBy("stream").agg(F.min_by(F.struct("raw_id", "digest"), dedupe.content_order("day", "digest", "stream", "raw_id")).alias("r")).select("stream", "r.*")


@query("SELECT DISTINCT stream, a AS from_day, b AS to_day FROM CLAIM")
def claims_once(spark, d):
    """Ranges that several exports claim alike are one."""
    c = A.claims(spark, d)
    return dedupe.first_write(c.unionByName(c).withColumn("run", F.monotonically_increasing_id()), ["stream", "from_day", "to_day"], ["run"]).drop("run")


# -- health ---------------------------------------------------------------------------------------------------------------


@query("SELECT stream, count(*) AS records, min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM RAW GROUP BY 1")
def health_streams(spark, d):
    return health.streams(A.raw(spark, d))


@query("SELECT metric, count(DISTINCT CAST(ts AS DATE)) AS days, min(ts) AS first_ts, max(ts) AS last_ts FROM S GROUP BY 1")
def health_metric_days(spark, d):
    return health.sample_days(A.samples(spark, d))


@query("SELECT metric, scope, count(*) AS n, count(*) FILTER (WHERE day >= DATE '2001-01-01') AS n_recent, min(day) AS first_day, max(day) AS last_day FROM D GROUP BY ALL")
def health_daily_scopes(spark, d):
    return health.daily_scopes(A.daily(spark, d), "2001-01-01")


@query("SELECT raw_id, stream FROM RAW WHERE raw_id % 3 <> 0")
def unsent_records(spark, d):
    r = A.raw(spark, d)
    return health.unsent(r.select("raw_id", "stream"), r.where("raw_id % 3 = 0"), ["raw_id"])


@query("SELECT stream AS direction, device_id AS status, count(*) AS n, CAST(sum(raw_id) AS BIGINT) AS bytes, max(raw_id) AS last_seq FROM RAW GROUP BY ALL")
def bundle_status(spark, d):
    return health.bundle_status(A.raw(spark, d).select(F.col("stream").alias("direction"), F.col("device_id").alias("status"), F.col("raw_id").alias("size"), F.col("raw_id").alias("seq")))


@query("SELECT stream, count(*) FILTER (WHERE raw_id % 5 <> 0) AS successes, count(*) FILTER (WHERE raw_id % 5 = 0) AS failures, max(raw_id) FILTER (WHERE raw_id % 5 <> 0) AS last_ok, CAST(max(raw_id) FILTER (WHERE raw_id % 5 = 0) AS VARCHAR) AS last_error FROM RAW GROUP BY 1")
def stream_provenance(spark, d):
    return health.provenance(A.raw(spark, d).select("stream", F.col("raw_id").alias("at"), (F.col("raw_id") % 5 != 0).alias("ok"), F.col("raw_id").cast("string").alias("detail"))).drop("last_record")


@query("SELECT device_id, raw_id, CAST((sum(raw_id) OVER (PARTITION BY device_id ORDER BY raw_id) - raw_id) // 1000000 AS BIGINT) AS batch FROM RAW")
def push_batches(spark, d):
    return store.batches_by_size(A.raw(spark, d).select("device_id", "raw_id"), 1_000_000, "device_id", "raw_id", "raw_id")


@query("SELECT stream, raw_id, CASE WHEN raw_id % 50 = 0 THEN 1 ELSE 2 END AS version FROM RAW")
def replay_identity(spark, d):
    """A forced replay: what decodes is new, the rows of failing records stay as they were."""
    r, bad = A.raw(spark, d).select("stream", "raw_id"), A.failures(spark, d)
    again = r.join(bad, "raw_id", "left_anti").select("stream", "raw_id", F.lit(2).alias("version"))
    return store.replay(r.withColumn("version", F.lit(1)), again, bad, force=True)


@query("SELECT stream, source_key, payload_hash FROM (SELECT stream, CAST(raw_id AS VARCHAR) AS source_key, sha256(CAST(raw_id // 2 AS VARCHAR)) AS payload_hash, raw_id FROM RAW) WHERE stream LIKE 'json:%' AND raw_id % 4 <> 0 "
       "UNION ALL SELECT arg_min(stream, (stream, source_key)), arg_min(source_key, (stream, source_key)), payload_hash FROM (SELECT stream, CAST(raw_id AS VARCHAR) AS source_key, sha256(CAST(raw_id // 2 AS VARCHAR)) AS payload_hash, raw_id FROM RAW) t WHERE stream LIKE 'fit:%' "
       "AND payload_hash NOT IN (SELECT sha256(CAST(raw_id // 2 AS VARCHAR)) FROM RAW WHERE raw_id % 4 = 0) GROUP BY payload_hash")
def raw_ingest(spark, d):
    r = A.raw(spark, d).select("stream", F.col("raw_id").cast("string").alias("source_key"), F.floor(F.col("raw_id") / 2).cast("string").alias("payload"), "raw_id")
    held = r.where("raw_id % 4 = 0").select("stream", "source_key", F.sha2("payload", 256).alias("payload_hash"))
    return store.new_raw(r.drop("raw_id"), held).select("stream", "source_key", "payload_hash")


@query("SELECT k, v, md5(v) AS digest FROM (SELECT event_id AS k, 'payload ' || event_id AS v FROM events)", views=False)
def packed_bytes(spark, d):
    """Bytes packed and unpacked again."""
    e = A.table(spark, d, "events").select(F.col("event_id").alias("k"), F.concat(F.lit("payload "), "event_id").alias("v"))
    back = e.select("k", "v", scalars.inflate(scalars.deflate(F.col("v").cast("binary"))).alias("b"))
    return back.select("k", "v", F.md5("b").alias("digest"))


#: A third of the samples counts as live here, so that the report has a live block.
HEALTH = """, HS AS (SELECT * EXCLUDE (scope), CASE scope WHEN 'local' THEN 'live' ELSE scope END AS scope FROM S), LIVE AS (SELECT us, CAST(ts + to_seconds(CAST(off AS BIGINT)) AS DATE) AS day FROM HS JOIN REG ON 2 * us > lo2 AND 2 * us <= hi2 WHERE scope = 'live')
SELECT 'streams' AS section, stream AS name, NULL AS scope, count(*) AS n, NULL AS n_recent, CAST(min(start_ts) AS DATE) AS first_day, CAST(max(end_ts) AS DATE) AS last_day, NULL AS detail FROM RAW GROUP BY ALL
UNION ALL SELECT 'samples', metric, NULL, count(DISTINCT CAST(ts AS DATE)), count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE ts >= TIMESTAMP '2024-01-20'), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), NULL FROM HS WHERE scope <> 'live' GROUP BY ALL
UNION ALL SELECT 'daily', metric, scope, count(*), count(*) FILTER (WHERE day >= DATE '2024-01-20'), min(day), max(day), NULL FROM D GROUP BY ALL
UNION ALL SELECT 'sleep', NULL, scope, count(*), NULL, min(night), max(night), NULL FROM (SELECT night, 'device' AS scope FROM SG WHERE start_ts < end_ts GROUP BY 1) GROUP BY ALL
UNION ALL SELECT 'live', 'records', NULL, count(*), NULL, NULL, NULL, NULL FROM RAW WHERE stream = 'json:live' UNION ALL SELECT 'live', 'samples', NULL, count(*), NULL, min_by(day, us), max_by(day, us), NULL FROM LIVE
UNION ALL SELECT 'activities', NULL, NULL, count(*), NULL, NULL, NULL, NULL FROM RAW WHERE stream = 'fit:sleep' UNION ALL SELECT 'offsets', NULL, NULL, count(*), NULL, NULL, NULL, NULL FROM O
UNION ALL SELECT 'agreement', CASE WHEN compared_with IS NULL THEN metric ELSE metric || ' = ' || compared_with END, scope_a || ' / ' || scope_b, n, matches, NULL, NULL, NULL FROM (AGREED)
UNION ALL SELECT 'coverage', metric, scope, count(*), count(*) FILTER (WHERE status = 'present'), NULL, NULL, NULL FROM ST GROUP BY ALL
UNION ALL SELECT 'runs', transport, NULL, count(*), NULL, NULL, NULL, NULL FROM R GROUP BY ALL
UNION ALL SELECT 'recent', transport, NULL, row_number() OVER (ORDER BY run_id DESC), NULL, NULL, NULL, CASE WHEN run_id % 3 <> 0 THEN 'OSError: {path} of {email}, serial {id}, ' || run_id % 1000 END
  FROM (SELECT * FROM (SELECT * FROM R WHERE transport IS DISTINCT FROM 'ble' ORDER BY run_id DESC LIMIT 5) UNION SELECT * FROM (SELECT * FROM R WHERE transport = 'ble' ORDER BY run_id DESC LIMIT 1))
UNION ALL SELECT 'provenance', stream, NULL, count(*) FILTER (raw_id % 5 <> 0), count(*) FILTER (raw_id % 5 = 0), NULL, NULL, 'bad {id} in {path} ' || max(raw_id) FILTER (raw_id % 5 = 0) FROM RAW GROUP BY ALL"""


def runs(spark, d):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "ble").when(F.col("o_orderpriority") == "2-HIGH", None).otherwise("file")
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), name.alias("transport"))


@query(lambda: STAGES + RUNS + HEALTH.replace("AGREED", f"{PAIRED} UNION ALL {TARGETED}"))
def data_health(spark, d):
    """The store's report, all sections."""
    r = A.raw(spark, d)
    sleep = stages(spark, d).select(F.col("night").alias("date"), F.lit("device").alias("scope")).distinct()
    agreed = series.source_agreement(A.daily(spark, d), targets(spark))
    samples = A.samples(spark, d).withColumn("scope", F.when(F.col("scope") == "local", "live").otherwise(F.col("scope")))
    error = F.concat(F.lit("OSError: /home/someone/files/X.FIT of some.one@mail.org, serial 3489012345, "), (F.col("run_id") % 1000).cast("string"))
    failed = runs(spark, d).withColumn("error", F.when(F.col("run_id") % 3 != 0, error))
    detail = F.lit("bad 12345678 in C:\\data\\x.fit,")
    log = r.select("stream", F.col("raw_id").alias("at"), (F.col("raw_id") % 5 != 0).alias("ok"), detail.alias("detail"), F.col("raw_id").cast("string").alias("record"))
    return health.data_health(r, samples, A.daily(spark, d), sleep, r.where("stream = 'fit:sleep'"), A.offsets(spark, d), agreed, coverage.ledger(statuses(spark, d)), failed, "2024-01-20", log)


@query(CHAIN + """ SELECT 'unsent' AS name, count(*) AS n FROM RAW WHERE raw_id % 3 <> 0 UNION ALL SELECT 'bundles ' || stream, count(*) FROM K JOIN RAW ON seq = raw_id GROUP BY ALL UNION ALL SELECT 'conflicts', count(DISTINCT raw_id % 97) FROM RAW
UNION ALL SELECT 'gaps', count(*) FROM K WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM K AS p WHERE p.device_id = K.device_id AND p.seq = K.prev)""")
def sync_status(spark, d):
    r = A.raw(spark, d)
    w = Window.partitionBy("device_id").orderBy("raw_id")
    bundles = r.select(F.col("stream").alias("direction"), "device_id", F.col("raw_id").alias("seq"), F.lag("raw_id").over(w).alias("prev")).where("seq % 10 <> 3")
    return health.sync_status(r.select("raw_id"), r.where("raw_id % 3 = 0"), bundles, r.select((F.col("raw_id") % 97).alias("k")), ["raw_id"])


@query("SELECT count(DISTINCT (stream, raw_id % 97)) AS conflicts FROM RAW")
def conflict_counts(spark, d):
    return aggregates.conflict_counts(A.raw(spark, d).withColumn("k", F.col("raw_id") % 97), ["stream", "k"])


@query("SELECT raw_id, stream, raw_id * 2 AS mark FROM RAW WHERE raw_id % 4 = 0")
def linked_records(spark, d):
    r = A.raw(spark, d).select("raw_id", "stream")
    return store.linked(r, r.where("raw_id % 4 = 0").select("raw_id", (F.col("raw_id") * 2).alias("mark")), ["raw_id"])


@query("SELECT name, metric, scope, raw_id FROM (SELECT 'a' AS name, metric, scope, raw_id FROM S UNION ALL SELECT 'b', metric, scope, raw_id FROM S WHERE raw_id % 2 = 0) WHERE raw_id % 10 <> 7")
def delete_cascade(spark, d):
    s = A.samples(spark, d).select("metric", "scope", "raw_id")
    left = store.delete_cascade({"a": s, "b": s.where("raw_id % 2 = 0")}, s.where("raw_id % 10 = 7").select("raw_id"))
    return ingest.union([df.withColumn("name", F.lit(n)) for n, df in left.items()])


@query("SELECT raw_id, CASE WHEN raw_id % 10 = 7 THEN -value ELSE value END AS value FROM S WHERE raw_id % 20 <> 17")
def replay_record(spark, d):
    """Some records replayed: their rows go and what they decode to now comes, less than before."""
    s = A.samples(spark, d).select("raw_id", "value")
    mine = s.where("raw_id % 10 = 7")
    now = mine.where("raw_id % 20 <> 17").select("raw_id", (-F.col("value")).alias("value"))
    return store.replay_record({"samples": s}, mine.select("raw_id"), {"samples": now})["samples"]


@query("SELECT stream, count(*) AS records, count(*) FILTER (WHERE raw_id % 50 = 0) AS failures, 'broken ' || min(raw_id) FILTER (WHERE raw_id % 50 = 0) AS first_error FROM RAW GROUP BY 1")
def dry_run(spark, d):
    return store.dry_run(A.raw(spark, d).select("stream", "raw_id", F.when(F.col("raw_id") % 50 == 0, F.concat(F.lit("broken "), "raw_id")).alias("error")))


@query("SELECT stream, sha256('payload ' || raw_id) AS payload_hash, 'no decoder for this stream' AS error FROM RAW WHERE stream IN ('json:live', 'json:sleep')")
def undecodable_records(spark, d):
    found = A.raw(spark, d).select("stream", F.col("raw_id").cast("string").alias("source_key"), F.concat(F.lit("payload "), "raw_id").alias("payload"), "start_ts", "end_ts")
    kept, failures = store.keep_undecodable(found, ["fit:monitoring_b", "fit:sleep", "json:uds"])
    return kept.join(failures.select(F.col("raw_id").alias("payload_hash"), "error"), "payload_hash").select("stream", "payload_hash", "error")


@query("SELECT raw_id FROM RAW WHERE raw_id % 13 = 5")
def corrupt_records(spark, d):
    """Retained bytes that no longer have their hash."""
    payload = F.concat(F.lit("payload "), "raw_id")
    r = A.raw(spark, d).select("raw_id", F.when(F.col("raw_id") % 13 == 5, F.lit("changed")).otherwise(payload).alias("payload"), F.sha2(payload, 256).alias("payload_hash"))
    return store.corrupt(r).select("raw_id")


@query("SELECT local_day, metric, device_id, min(value) AS value FROM L WHERE metric = 'click' AND local_day >= DATE '2024-01-20' GROUP BY ALL")
def touched_days(spark, d):
    """Derivation limited to the days that late rows touch."""
    rows = local(spark, d)
    out = []
    late = rows.where("local_day >= DATE '2024-01-20'")
    minute_fold.recompute_touched(lambda r: aggregates.daily_reducers(r, {"click_min": ("click", "min")}), lambda: rows, "local_day", out.append)(late, 0)
    return out[0].select("local_day", F.lit("click").alias("metric"), "device_id", "value")


@query("SELECT device_id, stream, arg_max(h, (CASE WHEN hashed THEN NULL ELSE day END, h)) AS payload_hash FROM (SELECT device_id, stream, CAST(start_ts AS DATE) AS day, md5(CAST(raw_id AS VARCHAR)) AS h, bool_or(stream = 'json:live' OR raw_id % 1000 = 0) OVER (PARTITION BY device_id, stream) AS hashed FROM RAW) GROUP BY ALL"
       .replace("arg_max(h, (CASE WHEN hashed THEN NULL ELSE day END, h))", "arg_max(h, (CASE WHEN hashed THEN DATE '1000-01-01' ELSE day END, h))"))
def conflict_by_hash(spark, d):
    """Winners where some groups go by the hash alone."""
    rows = A.raw(spark, d).select("device_id", "stream", F.to_date("start_ts").alias("observed"), F.md5(F.col("raw_id").cast("string")).alias("payload_hash"), (F.col("stream").eqNullSafe("json:live") | (F.col("raw_id") % 1000 == 0)).alias("hashed_only"))
    return dedupe.conflict_winner(rows, ["device_id", "stream"], F.col("hashed_only")).select("device_id", "stream", "payload_hash")


# -- decoding -------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST('2024-01-01' AS DATE) + CAST(event_id % 300 AS INTEGER) AS date, m AS metric, v AS value FROM (
SELECT event_id, unnest(['steps', 'heart_rate_min', 'active_minutes', 'stress_avg', 'body_battery_high', 'body_battery_low']) AS m,
unnest([event_id % 20000, CASE WHEN user_id % 5 > 0 THEN user_id % 5 END, (event_id % 3600) / 60, event_id % 100, event_id % 90, CASE WHEN event_id % 2 = 0 THEN 7.0 END]) AS v FROM events) WHERE v IS NOT NULL""", views=False)
def json_unpivot(spark, d):
    e = A.table(spark, d, "events")
    stat = lambda kind, v: F.struct(F.lit(kind).alias("bodyBatteryStatType"), v.cast("double").alias("statsValue"))
    low = F.when(F.col("event_id") % 2 == 0, F.lit(7))
    record = F.to_json(
        F.struct(
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 300).cast("int")).cast("string").alias("calendarDate"), (F.col("event_id") % 20000).alias("totalSteps"),
            (F.col("user_id") % 5).alias("minHeartRate"), (F.col("event_id") % 3600).alias("activeSeconds"), F.lit("many").alias("totalDistanceMeters"),
            F.struct(F.array(F.struct(F.lit("TOTAL").alias("type"), (F.col("event_id") % 100).alias("averageStressLevel")), F.struct(F.lit("AWAKE").alias("type"), F.lit(3).cast("long").alias("averageStressLevel"))).alias("aggregatorList")).alias("allDayStress"),
            F.struct(F.array(stat("HIGHEST", F.col("event_id") % 90), stat("LOWEST", low), stat("OTHER", F.col("event_id"))).alias("bodyBatteryStatList")).alias("bodyBattery"),
        )
    )
    return json_records.decode(e.select("event_id", record.alias("record")), "json:uds").drop("scope")


@query("""SELECT date, arg_max(event_id, (morning, ts, event_id)) AS score FROM (SELECT CAST(ts AS DATE) AS date, event_type = 'click' AS morning, ts, event_id FROM events) GROUP BY 1""", views=False)
def readiness_pick(spark, d):
    e = A.table(spark, d, "events")
    record = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("calendarDate"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.when(F.col("event_type") == "click", json_records.MORNING).otherwise("OTHER").alias("inputContext"), F.col("event_id").alias("score")))
    picked = json_records.pick_readiness(e.select(record.alias("record")))
    return json_records.decode(picked.select("record"), "json:readiness").where("metric = 'training_readiness'").select("date", F.col("value").cast("long").alias("score"))


PATHS = [
    "x/DI_CONNECT/DI-Connect-Aggregator/UDSFile_2024-01-01_2024-04-09.json", "x/DI_CONNECT/DI-Connect-Wellness/2024-01-01_2024-04-09_12345_sleepData.json", "x/DI_CONNECT/DI-Connect-Metrics/TrainingReadinessDTO_20240101_20240410_1.json",
    "x/DI_CONNECT/DI-Connect-Metrics/HillScore_20240410_20240101_1.json", "x/DI_CONNECT/DI-Connect-Wellness/1_fitnessAgeData.json", "x/DI_CONNECT/DI-Connect-Other/UDSFile_2024-01-01_2024-04-09.json", "x/DI_CONNECT/DI-Connect-Metrics/EnduranceScore_20241301_20241401.json",
]


def paths(spark, d):
    part = A.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return part.select("k", A.pick(PATHS, F.col("k") % len(PATHS)).alias("path"), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("k") % 60).cast("int")).alias("written_day"))


@query("SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 0 THEN 'json:uds' WHEN 1 THEN 'json:sleep' WHEN 2 THEN 'json:readiness' WHEN 3 THEN 'json:hill' WHEN 4 THEN 'json:fitness_age' WHEN 6 THEN 'json:endurance' END AS stream FROM part", views=False)
def file_router(spark, d):
    return paths(spark, d).select("k", files.stream_of(F.col("path")).alias("stream"))


@query("""SELECT CASE p_partkey % 7 WHEN 0 THEN 'json:uds' WHEN 1 THEN 'json:sleep' ELSE 'json:readiness' END AS stream, DATE '2024-01-01' AS from_day,
CASE p_partkey % 7 WHEN 2 THEN least(DATE '2024-04-10', DATE '2024-03-01' + CAST(p_partkey % 60 AS INTEGER)) ELSE least(DATE '2024-04-09', DATE '2024-03-01' + CAST(p_partkey % 60 AS INTEGER)) END AS to_day, count(*) AS n
FROM part WHERE p_partkey % 7 < 3 GROUP BY ALL""", views=False)
def claimed_windows(spark, d):
    return files.claims(paths(spark, d)).groupBy("stream", "from_day", "to_day").agg(F.count(F.lit(1)).alias("n"))


# -- binary files ---------------------------------------------------------------------------------------------------------

FIT = f" {A.FIT_SQL}"


def fit_rows(spark, d, *decoders):
    """The messages that these decoders read."""
    return fit.timed(fit.messages(A.fit_files(spark, d), fit.wanted_fields(*decoders)))


def kept_fit_rows(spark, d, *decoders):
    """The rows written once, for queries that read them several times."""
    return kept(spark)(fit_rows(spark, d, *decoders))


def user(df):
    return df.withColumn("u", F.col("path").cast("long")).drop("path")


FIT_SAMPLES = """SELECT u, 'heart_rate' AS metric, ts, CAST(e % 120 AS DOUBLE) AS value FROM FT WHERE e % 120 > 0 UNION ALL SELECT u, 'stress', ts, e % 110 - 5 FROM FT WHERE e % 110 >= 5 UNION ALL SELECT u, 'energy_reserve', ts, e % 130 FROM FT WHERE e % 130 <= 100
UNION ALL SELECT u, 'respiration_rate', ts, (e % 400 - 20) / 100 FROM FT WHERE e % 400 >= 20 UNION ALL SELECT u, 'spo2', ts, e % 100 FROM FT WHERE e % 100 > 0 AND r % 3 > 0 UNION ALL SELECT u, 'hrv_rmssd', ts, (e % 2000) / 128 FROM FT"""


@query("WITH" + FIT + " " + FIT_SAMPLES, views=False)
def fit_samples(spark, d):
    """Samples of binary files, half of them with 16-bit time stamps, under the sentinel rules."""
    return user(fit.samples(fit_rows(spark, d, "samples")))


FIT_DAILIES = """, X AS (SELECT u, base, n, unnest(['resting_metabolic_rate', 'resting_heart_rate', 'resting_heart_rate_current_day', 'hrv_weekly_average', 'hrv_last_night_average', 'hrv_last_night_5min_high', 'hrv_baseline_low_upper', 'hrv_baseline_balanced_lower',
'hrv_baseline_balanced_upper', 'skin_temp_nightly', 'skin_temp_deviation', 'skin_temp_7day_deviation', 'vo2max']) AS metric, unnest([1500 + u, u % 3 * 50, 40 + u % 30, (5000 + u) / 128, (5100 + u) / 128, (5200 + u) / 128, (5300 + u) / 128, (5400 + u) / 128, (5500 + u) / 128,
35.5 + u % 8 / 4, u % 5 / 8, (-u + 7 * CAST(ceil(u / 7) AS BIGINT)) / 4, CASE WHEN u % 4 > 0 THEN (400 + u) / 10 ELSE 0 END]::DOUBLE[]) AS value, unnest([0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2]) AS minute FROM FF)"""
FIT_DAILY = """SELECT u, metric, to_timestamp(base + 60 * minute)::TIMESTAMP AS ts, value FROM X WHERE NOT (metric IN ('resting_heart_rate', 'vo2max') AND value = 0)"""


@query("WITH" + FIT + FIT_DAILIES + " " + FIT_DAILY, views=False)
def fit_dailies(spark, d):
    return user(fit.dailies(fit_rows(spark, d, "dailies")))


@query("WITH" + FIT + """ SELECT u, 'hrv_status' AS metric, ['none', 'poor', 'low', 'unbalanced', 'balanced'][u % 5 + 1] AS label FROM FF UNION ALL SELECT u, 'vo2max_sport', ['generic', 'running', 'cycling'][u % 3 + 1] FROM FF WHERE u % 4 > 0""", views=False)
def fit_labels(spark, d):
    return user(fit.labels(kept_fit_rows(spark, d, "labels")).drop("ts"))


@query("WITH" + FIT + """ SELECT u, ts, CASE WHEN r % 2 = 1 THEN 6 ELSE 2 END AS activity_type, r % 7 AS intensity, CASE WHEN r % 2 = 1 THEN 10 * r END AS steps, CAST(CASE WHEN r % 2 = 1 THEN 10 * r ELSE 5 * r END AS DOUBLE) AS cycles, 150 * r / 100 AS distance_m FROM FT""", views=False)
def fit_intervals(spark, d):
    """Counters whose type and intensity come in the composite field."""
    out = user(fit.intervals(fit_rows(spark, d, "intervals")))
    return out.select("u", "ts", "activity_type", F.col("intensity").cast("long").alias("intensity"), "steps", "cycles", "distance_m")


@query("WITH" + FIT + """ SELECT u, to_timestamp(base + 60 * m)::TIMESTAMP AS ts, ahead AS offset_s FROM FF, (SELECT unnest([0, 1]) AS m) WHERE ahead <= 93600""", views=False)
def clock_offsets(spark, d):
    return user(fit.clock_offsets(fit_rows(spark, d, "clock_offsets")))


FIT_NIGHT = """ , G AS (SELECT u, r, ts, (r + u) % 5 AS k, to_timestamp(base)::TIMESTAMP AS start, to_timestamp(base + 60 * (n + 5))::TIMESTAMP AS stop, kind FROM FT JOIN FF USING (u) WHERE r <= 12),
GS AS (SELECT u, ['unmeasurable', 'awake', 'light', 'deep', 'rem'][k + 1] AS stage, coalesce(lag(ts) OVER (PARTITION BY u ORDER BY ts), CASE WHEN kind = 49 THEN start END) AS start_ts, ts AS end_ts FROM G)"""


@query("WITH" + FIT + FIT_NIGHT + " SELECT * FROM GS WHERE start_ts IS NOT NULL", views=False)
def fit_stages(spark, d):
    """Stages of binary files; the start event counts in sleep files alone."""
    return user(fit.sleep_stages(kept_fit_rows(spark, d, "stages")).withColumnRenamed("night", "path"))


@query("WITH" + FIT + FIT_NIGHT + """ , SS AS (SELECT u, min(start_ts) AS a, max(end_ts) AS b, count(*) AS c, sum(date_diff('second', start_ts, end_ts)) FILTER (WHERE stage = 'deep') AS deep, sum(date_diff('second', start_ts, end_ts)) FILTER (WHERE stage = 'light') AS light,
sum(date_diff('second', start_ts, end_ts)) FILTER (WHERE stage = 'rem') AS rem, sum(date_diff('second', start_ts, end_ts)) FILTER (WHERE stage = 'awake') AS awake FROM GS WHERE start_ts IS NOT NULL GROUP BY u)
SELECT u, CASE WHEN kind = 49 THEN to_timestamp(base)::TIMESTAMP ELSE a END AS start_ts, CASE WHEN kind = 49 THEN to_timestamp(base + 60 * (n + 5))::TIMESTAMP ELSE b END AS end_ts, CASE WHEN c > 0 THEN CAST(coalesce(deep, 0) AS BIGINT) END AS deep_s, CASE WHEN c > 0 THEN CAST(coalesce(light, 0) AS BIGINT) END AS light_s,
CASE WHEN c > 0 THEN CAST(coalesce(rem, 0) AS BIGINT) END AS rem_s, CASE WHEN c > 0 THEN CAST(coalesce(awake, 0) AS BIGINT) END AS awake_s, (u + 6) % 100 AS overall_score, u % 90 AS interruptions_score, (u + 11) % 100 AS awakenings_count, 7 * u % 10000 / 100 AS avg_stress FROM FF LEFT JOIN SS USING (u)""", views=False)
def fit_nights(spark, d):
    out = user(fit.sleep_sessions(kept_fit_rows(spark, d, "stages", "sleep_assessments")))
    return out.select("u", "start_ts", "end_ts", "deep_s", "light_s", "rem_s", "awake_s", *(F.col(c).cast("long").alias(c) for c in ("overall_score", "interruptions_score", "awakenings_count")), "avg_stress")


@query("WITH" + FIT + """ SELECT u, to_timestamp(base + 180)::TIMESTAMP AS start_ts, to_timestamp(base + 1800)::TIMESTAMP AS end_ts, u % 6 AS sub_sport, u + 0.5 AS total_elapsed_s, CAST(u AS DOUBLE) AS total_timer_s, CAST(u AS DOUBLE) AS distance_m, u AS calories, CASE WHEN u % 2 = 1 THEN 2.6 ELSE 2.5 END AS avg_speed,
CAST(u AS DOUBLE) AS total_ascent_m, CAST(u // 2 AS DOUBLE) AS total_descent_m FROM FF""", views=False)
def fit_activities(spark, d):
    out = user(fit.activities(fit_rows(spark, d, "activities")))
    return out.select("u", "start_ts", "end_ts", F.col("sub_sport").cast("long").alias("sub_sport"), "total_elapsed_s", "total_timer_s", "distance_m", F.col("calories").cast("long").alias("calories"), "avg_speed", "total_ascent_m", "total_descent_m")


@query("WITH" + FIT + """ SELECT u, CASE kind WHEN 32 THEN 'fit:monitoring_b' WHEN 49 THEN 'fit:sleep' WHEN 68 THEN 'fit:hrv' WHEN 73 THEN 'fit:skin_temp' ELSE 'fit:metrics' END AS stream, CAST(1000 + u AS VARCHAR) AS device_id, to_timestamp(base)::TIMESTAMP AS start_ts,
to_timestamp(base + 60 * greatest(n + CASE WHEN kind = 49 THEN 5 ELSE 0 END, 3))::TIMESTAMP AS end_ts, u % 9 = 8 AS broken FROM FF""", views=False)
def fit_spans(spark, d):
    """Stream, device and span of each file, of those too that break off."""
    return user(fit.identities(fit_rows(spark, d, "identities"))).withColumn("broken", F.col("error").isNotNull()).drop("error")


@query("WITH" + FIT + FIT_NIGHT + """ SELECT reason, count(*) AS n FROM (SELECT 'heart_rate_zero' AS reason FROM FT WHERE e % 120 = 0 UNION ALL SELECT 'stress_sentinel' FROM FT WHERE e % 110 < 5 UNION ALL SELECT 'respiration_sentinel' FROM FT WHERE e % 400 < 20
UNION ALL SELECT 'spo2_off_wrist_or_zero' FROM FT WHERE e % 100 = 0 OR r % 3 = 0 UNION ALL SELECT 'clock_offset_out_of_range' FROM FF, (SELECT unnest([0, 1])) WHERE ahead > 93600 UNION ALL SELECT 'sleep_stage_without_start' FROM GS WHERE start_ts IS NULL) GROUP BY 1""", views=False)
def fit_drops(spark, d):
    return fit.drops(kept_fit_rows(spark, d, "samples", "clock_offsets", "stages", "untimed"))


@query("WITH" + FIT + """ , M AS (SELECT u, n, least(n, 12) AS s FROM FF) SELECT u, message, c AS n FROM (SELECT u, unnest([0, 103, 211, 21, 55, 227, 297, 269, 371, 275, 370, 398, 229, 346, 18]) AS message, unnest([1, 1, 1, 2, n, n, n, n, n, s, 1, 1, 1, 1, 1]) AS c FROM M) UNION ALL SELECT u, -1, 1 FROM FF WHERE u % 9 = 8""", views=False)
def fit_messages(spark, d):
    return user(fit.message_counts(fit.messages(A.fit_files(spark, d), fit.COUNTED)))


def kept(spark):
    """Writes tables that are read more than once to the shared folder."""
    folder, count = f"{store.scratch_folder(spark)}/kept-{uuid.uuid4().hex}", itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{next(count)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def packed(spark, d):
    """path, content of archives that hold the users' files, every second one inside another archive."""

    @F.pandas_udf("binary")
    def pack(path: pd.Series, content: pd.Series) -> pd.Series:
        def one(name: str, data: bytes) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(name, data)
                z.writestr("note.txt", "no file of this kind")
            return out.getvalue()

        return pd.Series([one("inner.zip", one(f"{p}.fit", bytes(c))) if int(p) % 2 else one(f"{p}.FIT", bytes(c)) for p, c in zip(path, content, strict=True)])

    return A.fit_files(spark, d).select(F.concat(F.lit("up/"), "path", F.lit(".zip")).alias("path"), pack("path", "content").alias("content"))


@query("SELECT DISTINCT 'up/' || user_id || '.zip' || CASE WHEN user_id % 2 = 1 THEN '/inner.zip/' || user_id || '.fit' ELSE '/' || user_id || '.FIT' END AS label FROM events", views=False)
def nested_archives(spark, d):
    return files.unzip(packed(spark, d)).select("label")


@query("WITH" + FIT + """, X AS (SELECT u, CASE u % 5 WHEN 0 THEN 'fit:monitoring_b' WHEN 1 THEN 'fit:sleep' WHEN 2 THEN 'fit:hrv' WHEN 3 THEN 'fit:skin_temp' ELSE 'fit:metrics' END AS stream, u % 9 = 8 AS bad FROM FF)
SELECT stream, count(*) FILTER (WHERE NOT bad AND u % 4 > 0) AS records, count(*) FILTER (WHERE bad AND u % 4 > 0) AS failures FROM X WHERE u % 4 > 0 GROUP BY 1""", views=False)
def import_files(spark, d):
    """An import of archives with broken files; a quarter of the files is held already."""
    keep = kept(spark)
    found = keep(packed(spark, d).withColumn("written_day", F.lit(None).cast("date")))
    held = A.fit_files(spark, d).where("cast(path as long) % 4 = 0").select(F.lit("fit").alias("stream"), F.sha2("content", 256).alias("source_key"), F.sha2("content", 256).alias("payload_hash"))
    return ingest.statistics(ingest.import_files(found, held, keep=keep))


FIT_DATED = """, OFFSETS_AT AS (SELECT base + 60 * m AS moment, ahead AS off FROM FF, (SELECT unnest([0, 1]) AS m) WHERE ahead <= 93600 AND u % 9 <> 8),
RG AS (SELECT off, coalesce(lag(moment) OVER (ORDER BY moment) + moment, -4000000000000000000) AS lo2, coalesce(lead(moment) OVER (ORDER BY moment) + moment, 4000000000000000000) AS hi2 FROM OFFSETS_AT),
SA AS (SELECT s.u, metric, ts, value, CAST(ts + to_seconds(off) AS DATE) AS day FROM (""" + FIT_SAMPLES + """) AS s JOIN RG ON 2 * epoch(ts) > lo2 AND 2 * epoch(ts) <= hi2 WHERE u % 9 <> 8),
STEP AS (SELECT u, day, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 900 THEN value - lag(value) OVER w ELSE 0 END AS step FROM SA WHERE metric = 'energy_reserve' WINDOW w AS (PARTITION BY u, day ORDER BY ts)),
COUNTED AS (SELECT u, r, r % 2 AS kind, CAST(moment + to_seconds(off) AS DATE) AS day FROM (SELECT *, ts - INTERVAL 1 SECOND AS moment FROM FT WHERE u % 9 <> 8) JOIN RG ON 2 * epoch(moment) > lo2 AND 2 * epoch(moment) <= hi2),
TOP AS (SELECT u, day, kind, max(r) AS r FROM COUNTED GROUP BY ALL),
LOCAL AS (
  SELECT u, day, unnest(['heart_rate_min', 'heart_rate_max']) AS metric, unnest([min(value), max(value)]) AS value FROM SA WHERE metric = 'heart_rate' GROUP BY u, day
  UNION ALL SELECT u, day, 'stress_avg', printf('%.3f', avg(value))::DOUBLE FROM SA WHERE metric = 'stress' GROUP BY u, day
  UNION ALL SELECT u, day, unnest(['energy_reserve_low', 'energy_reserve_high']), unnest([min(value), max(value)]) FROM SA WHERE metric = 'energy_reserve' GROUP BY u, day
  UNION ALL SELECT u, day, unnest(['energy_reserve_charged', 'energy_reserve_drained']), unnest([coalesce(sum(step) FILTER (step > 0), 0), coalesce(-sum(step) FILTER (step < 0), 0)]) FROM STEP GROUP BY u, day
  UNION ALL SELECT u, day, 'steps', 10 * r FROM TOP WHERE kind = 1 UNION ALL SELECT u, day, 'distance', sum(1.5 * r) FROM TOP GROUP BY u, day),
TOLD AS (SELECT u, metric, ts, value, NULL AS label FROM (""" + FIT_DAILY + """) UNION ALL SELECT u, 'hrv_status', to_timestamp(base + 60)::TIMESTAMP, NULL, ['none', 'poor', 'low', 'unbalanced', 'balanced'][u % 5 + 1] FROM FF
  UNION ALL SELECT u, 'vo2max_sport', to_timestamp(base + 120)::TIMESTAMP, NULL, ['generic', 'running', 'cycling'][u % 3 + 1] FROM FF WHERE u % 4 > 0),
ENDS AS (SELECT u, CASE WHEN kind = 49 THEN to_timestamp(base + 60 * (n + 5))::TIMESTAMP ELSE max(end_ts) FILTER (start_ts IS NOT NULL) END AS ts FROM FF LEFT JOIN (SELECT u, start_ts, end_ts FROM GS) USING (u) WHERE u % 9 <> 8 GROUP BY u, kind, base, n),
NIGHT AS (SELECT u, ts, CAST(ts + to_seconds(off) AS DATE) AS day FROM ENDS LEFT JOIN RG ON 2 * epoch(ts) > lo2 AND 2 * epoch(ts) <= hi2 QUALIFY row_number() OVER (PARTITION BY day ORDER BY u DESC) = 1),
ALL_ROWS AS (SELECT 'sample' AS kind, u, metric, NULL::DATE AS day, ts, value, NULL AS label FROM SA UNION ALL SELECT 'local', u, metric, day, NULL, value, NULL FROM LOCAL
  UNION ALL SELECT 'device', u, metric, CAST(ts + to_seconds(off) AS DATE), NULL, value, label FROM TOLD JOIN RG ON 2 * epoch(ts) > lo2 AND 2 * epoch(ts) <= hi2 WHERE u % 9 <> 8
  UNION ALL SELECT 'night', u, 'overall_score', day, ts, (u + 6) % 100, NULL FROM NIGHT)
SELECT kind, metric, CAST(1000 + u AS VARCHAR) AS device_id, day, ts, round(value::DOUBLE, 6) AS value, label FROM ALL_ROWS"""


@query(lambda: "WITH" + FIT + FIT_NIGHT + FIT_DAILIES + FIT_DATED, views=False)
def imported_facts(spark, d):
    """What a store holds after the users' files came in three imports, the last users' first: samples, dailies, labels and nights, row by row."""
    target = f"{store.scratch_folder(spark)}/store-{uuid.uuid4().hex}"
    found = A.fit_files(spark, d).select(F.concat("path", F.lit(".fit")).alias("path"), "content", F.lit(None).cast("date").alias("written_day"), F.col("path").cast("long").alias("u"))
    third = F.percent_rank().over(Window.orderBy("u"))
    found = kept(spark)(found.withColumn("third", F.floor(third * 2.999)))
    for k in (2, 0, 1):
        ingest.into_store(spark, target, "folder", lambda run, keep, k=k: ingest.import_found(keep(found.where(F.col("third") == k).drop("u", "third")), run, keep))
    t = ingest.tables_of(spark, target)
    no = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind, metric, day, ts, value, label: df.select(kind.alias("kind"), metric.alias("metric"), "device_id", day.alias("day"), ts.alias("ts"), F.round(value.cast("double"), 6).alias("value"), label.alias("label"))
    col = F.col
    return ingest.union([
        row(t["samples"], F.lit("sample"), col("metric"), no("date"), col("ts"), col("value"), no("string")), row(t["daily"], col("scope"), col("metric"), col("day"), no("timestamp"), col("value"), no("string")),
        row(t["labels"], col("scope"), col("metric"), col("day"), no("timestamp"), no("double"), col("label")), row(t["sleep"], F.lit("night"), F.lit("overall_score"), col("date"), col("end_ts"), col("overall_score"), no("string")),
    ])


@query("WITH" + FIT + """, HR AS (SELECT u, CAST(ts + to_seconds(CASE WHEN u % 7 <> 0 THEN (u % 5 - 2) * 3600 ELSE 0 END) AS DATE) AS day, e % 120 AS v FROM FT WHERE e % 120 > 0 AND u % 9 <> 8)
SELECT 'heart_rate_min' AS metric, 'local' AS scope, day, CAST(1000 + u AS VARCHAR) AS device_id, CAST(min(v) AS DOUBLE) AS value FROM HR GROUP BY ALL UNION ALL SELECT 'heart_rate_max', 'local', day, CAST(1000 + u AS VARCHAR), max(v) FROM HR GROUP BY ALL""", views=False)
def imported_heart_rate(spark, d):
    """Derived dailies of an import, device by device: each file states its own clock, so each is imported by itself here."""
    found = A.fit_files(spark, d).withColumn("path", F.concat("path", F.lit(".fit")))
    keep = kept(spark)
    rows = ingest.fit_tables(keep(ingest.fresh_fit(ingest.fit_files(found), spark.createDataFrame([], "payload_hash string"))), keep)
    clock = rows["offsets"].join(rows["raw"].select("raw_id", "device_id"), "raw_id").groupBy("device_id").agg(F.max("offset_s").alias("offset_s"))
    dated = rows["samples"].join(clock, "device_id", "left").withColumn("local_day", localday.local_day(F.col("ts"), F.coalesce("offset_s", F.lit(0))))
    out = aggregates.daily_reducers(dated, {k: v for k, v in ingest.REDUCERS.items() if v[0] == "heart_rate"})
    return out.select("metric", "scope", F.col("local_day").alias("day"), "device_id", "value")


@query("""SELECT user_id AS u, count(*) FILTER (WHERE event_id % 4 > 0) AS readings, user_id % 3 = 0 AS cut_off, md5('{"readings":[' || string_agg('[' || (1700000000 + event_id) || ',"heart_rate",' || (event_id % 200) || ']', ',' ORDER BY event_id) FILTER (WHERE event_id % 4 > 0) || ']}') AS digest
FROM events WHERE user_id % 5 <> 4 GROUP BY ALL""", views=False)
def live_files(spark, d):
    """Live-session files: readings and status lines, a last line cut off in some, and files of another kind."""
    e = A.table(spark, d, "events").select("user_id", "event_id")
    reading = F.to_json(F.struct((F.lit(1_700_000_000) + F.col("event_id")).alias("t"), F.lit("heart_rate").alias("metric"), (F.col("event_id") % 200).alias("value")))
    line = F.when(F.col("event_id") % 4 > 0, reading).otherwise(F.lit('{"status":"ok"}'))
    text = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x.line), "\n").alias("text"))
    tail = F.when(F.col("user_id") % 5 == 4, F.lit('\n{"frame":1}')).when(F.col("user_id") % 3 == 0, F.lit('\n{"t":17000')).otherwise(F.lit("\n"))
    lines = kept(spark)(files.live_lines(text.select(F.col("user_id").cast("string").alias("path"), F.concat("text", tail).alias("text"))))
    records = files.live_records(lines).select("path", F.md5("record").alias("digest"))
    return user(lines.join(records, "path").select("path", F.size("readings").cast("long").alias("readings"), "cut_off", "digest"))


@query("""SELECT user_id AS u, count(*) FILTER (WHERE event_id % 200 > 0) AS readings, user_id % 4 = 1 AS malformed FROM events GROUP BY ALL""", views=False)
def stored_live_records(spark, d):
    """Retained live records read again: valid readings, and records with one that is none."""
    e = A.table(spark, d, "events").select("user_id", "event_id")
    item = F.concat(F.lit("["), (F.lit(1_700_000_000) + F.col("event_id")).cast("string"), F.lit(',"heart_rate",'), (F.col("event_id") % 200).cast("string"), F.lit("]"))
    text = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("text"))
    odd = F.when(F.col("user_id") % 4 == 1, F.lit(',[1700000000,"heart_rate",true]')).otherwise(F.lit(""))
    records = text.select(F.col("user_id").cast("string").alias("raw_id"), F.concat(F.lit('{"readings":['), "text", odd, F.lit("]}")).alias("record"))
    t = ingest.live_tables(records)
    bad = t["failures"].select("raw_id", F.lit(True).alias("malformed"))
    counted = t["readings"].groupBy("raw_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = e.select(F.col("user_id").alias("u"), F.col("user_id").cast("string").alias("raw_id"), "event_id").groupBy("u", "raw_id").agg(F.count_if(F.expr("event_id % 200 > 0")).alias("want"))
    out = all_.join(bad, "raw_id", "left").join(counted, "raw_id", "left")
    return out.select("u", F.when(F.col("malformed"), F.col("want")).otherwise(F.col("n")).alias("readings"), F.coalesce("malformed", F.lit(False)).alias("malformed"))


@query("WITH" + FIT + """ SELECT 'heart_rate' AS metric, count(*) AS n FROM FT WHERE e % 120 > 0 AND u % 9 <> 8 UNION ALL SELECT 'steps', count(*) FROM (SELECT DISTINCT event_id % 300 FROM events)""", views=False)
def reparsed(spark, d):
    """A forced replay of retained records, some of which do not decode."""
    fit_raw = A.fit_files(spark, d).select(F.concat(F.lit("f"), "path").alias("raw_id"), F.lit("fit:monitoring_b").alias("stream"), F.col("content").alias("payload"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 300).cast("int")).cast("string")
    text = F.to_json(F.struct(day.alias("calendarDate"), F.col("event_id").alias("totalSteps")))
    json_raw = A.table(spark, d, "events").select(F.concat(F.lit("j"), "event_id").alias("raw_id"), F.lit("json:uds").alias("stream"), text.cast("binary").alias("payload"))
    t = ingest.reparse(fit_raw.unionByName(json_raw), {}, force=True, keep=kept(spark))
    steps = t["daily"].where("metric = 'steps' and scope = 'vendor_cloud'").groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    return t["samples"].where("metric = 'heart_rate'").groupBy("metric").agg(F.count(F.lit(1)).alias("n")).unionByName(steps)


@query("""SELECT p_partkey AS k, i AS n, CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE p_partkey * 10 + i END AS v, CAST(NULL AS VARCHAR) AS error FROM part, (SELECT unnest([0, 1, 2]::BIGINT[]) AS i) WHERE p_partkey % 4 = 0 AND i = 0 OR p_partkey % 4 = 1 AND i <> 1
UNION ALL SELECT p_partkey, NULL, NULL, 'file is not valid JSON or not a JSON array/object' FROM part WHERE p_partkey % 4 >= 2""", views=False)
def json_files(spark, d):
    """Files with one object, with an array (whose second item is none), with a number, and with broken text."""
    k = F.col("p_partkey")
    one = F.to_json(F.struct(k.alias("v")))
    item = lambda i: F.to_json(F.struct((k * 10 + i).alias("v")))
    text = F.when(k % 4 == 0, one).when(k % 4 == 1, F.concat(F.lit("["), item(0), F.lit(",7,"), item(2), F.lit("]"))).when(k % 4 == 2, F.lit("12")).otherwise(F.substring(one, 1, 4))
    found = files.json_rows(A.table(spark, d, "part").select(k.cast("string").alias("path"), text.cast("binary").alias("content")))
    return found.select(F.col("path").cast("long").alias("k"), F.col("n").cast("long").alias("n"), F.get_json_object("record", "$.v").cast("long").alias("v"), "error")


@query("""SELECT event_id, CAST('2024-01-01' AS DATE) + CAST(event_id % 300 AS INTEGER) AS date, event_id % 9000 AS deep_s, CASE WHEN event_id % 2 = 0 THEN event_id % 700 END AS light_s, event_id % 100 AS overall_score, (event_id + 3) % 100 AS duration_score, (event_id % 1000) / 10 AS avg_stress,
(event_id % 30) / 2 AS avg_respiration, 90 + event_id % 10 AS lowest_spo2, event_id % 5 = 0 AS retro, event_id % 9000 + CASE WHEN event_id % 2 = 0 THEN event_id % 700 ELSE 0 END AS asleep_s, TIMESTAMP '2024-01-01 22:00:00' + to_seconds(event_id % 3600) AS start_ts FROM events""", views=False)
def sleep_records(spark, d):
    """Nights of the export's records."""
    e = A.table(spark, d, "events").select("event_id")
    i = F.col("event_id")
    start = F.date_format(F.timestamp_seconds(F.lit(1_704_146_400) + i % 3600), "yyyy-MM-dd'T'HH:mm:ss'.0'")
    scores = F.struct((i % 100).alias("overallScore"), ((i + 3) % 100).alias("durationScore"))
    record = F.to_json(F.struct(
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")).cast("string").alias("calendarDate"), start.alias("sleepStartTimestampGMT"), (i % 9000).alias("deepSleepSeconds"), F.when(i % 2 == 0, i % 700).alias("lightSleepSeconds"),
        scores.alias("sleepScores"), ((i % 1000) / 10).alias("avgSleepStress"), ((i % 30) / 2).alias("averageRespiration"), F.struct((90 + i % 10).alias("lowestSPO2")).alias("spo2SleepSummary"), (i % 5 == 0).alias("retro"),
    ))
    out = json_records.decode_sleep(e.select("event_id", record.alias("record")), keep=("event_id",))
    longs = ("overall_score", "duration_score", "lowest_spo2")
    return out.select("event_id", "date", "deep_s", "light_s", *(F.col(c).cast("long").alias(c) for c in longs), "avg_stress", "avg_respiration", "retro", "asleep_s", "start_ts")


VALUES = """SELECT stream, event_id, CAST('2024-01-01' AS DATE) + CAST(event_id % 300 AS INTEGER) AS date, m AS metric, v AS value FROM (SELECT event_id, unnest(['json:vo2max', 'json:training_load', 'json:training_load', 'json:training_load', 'json:endurance', 'json:fitness_age', 'json:biometrics']) AS stream,
unnest(['vo2max', 'training_load_acute', 'training_load_chronic', 'training_load_ratio', 'endurance_score', 'fitness_age', 'weight_kg']) AS m,
unnest([CASE WHEN event_id % 50 > 0 THEN event_id % 50 END, event_id % 700, event_id % 900, event_id % 30 / 10, event_id % 8000, event_id % 80, CASE WHEN event_id % 2 = 0 THEN (60000 + event_id) / 1000 ELSE 60 + event_id % 30 END]) AS v FROM events) WHERE v IS NOT NULL"""


def other_records(spark, d):
    """stream, event_id, record of the export's smaller families."""
    i = F.col("event_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")).cast("string")
    status = F.when(i % 3 == 0, F.lit("OPTIMAL")).when(i % 3 == 1, F.lit("Low"))
    weight = F.when(i % 2 == 0, 60_000 + i).otherwise(60 + i % 30)
    each = {
        "json:vo2max": F.struct(day.alias("calendarDate"), (i % 50).alias("vo2MaxValue"), F.lit("RUNNING").alias("sport")),
        "json:training_load": F.struct(day.alias("calendarDate"), (i % 700).alias("dailyTrainingLoadAcute"), (i % 900).alias("dailyTrainingLoadChronic"), (i % 30 / 10).alias("dailyAcuteChronicWorkloadRatio"), status.alias("acwrStatus")),
        "json:endurance": F.struct(day.alias("calendarDate"), (i % 8000).alias("overallScore")), "json:hill": F.struct(day.alias("calendarDate"), (i % 90).alias("overallScore")),
        "json:fitness_age": F.struct(F.concat(day, F.lit("T05:00:00.0")).alias("asOfDateGmt"), (i % 80).alias("currentBioAge")),
        "json:biometrics": F.struct(F.struct(day.alias("calendarDate")).alias("metaData"), F.struct(weight.alias("weight")).alias("weight")),
    }
    rows = F.array(*(F.struct(F.lit(s).alias("stream"), F.to_json(r).alias("record")) for s, r in each.items()))
    return A.table(spark, d, "events").select("event_id", F.inline(rows))


@query(VALUES, views=False)
def record_values(spark, d):
    rows = other_records(spark, d)
    return ingest.union([json_records.decode(rows.where(F.col("stream") == s), s) for s in ("json:vo2max", "json:training_load", "json:endurance", "json:hill", "json:fitness_age", "json:biometrics")]).drop("scope")


@query("""SELECT 'json:vo2max' AS stream, event_id, CAST('2024-01-01' AS DATE) + CAST(event_id % 300 AS INTEGER) AS date, 'vo2max_sport' AS metric, 'running' AS label FROM events
UNION ALL SELECT 'json:training_load', event_id, CAST('2024-01-01' AS DATE) + CAST(event_id % 300 AS INTEGER), 'training_load_status', CASE event_id % 3 WHEN 0 THEN 'optimal' ELSE 'low' END FROM events WHERE event_id % 3 < 2""", views=False)
def record_labels(spark, d):
    rows = other_records(spark, d)
    return ingest.union([json_records.decode_labels(rows.where(F.col("stream") == s), s) for s in ("json:vo2max", "json:training_load", "json:hill")])


# -- sleep and live -------------------------------------------------------------------------------------------------------

STAGES = """, N0 AS (SELECT CAST(ts AS DATE) AS night, CASE user_id % 4 WHEN 0 THEN 'deep' WHEN 1 THEN 'light' WHEN 2 THEN 'rem' ELSE 'awake' END AS stage, date_trunc('second', ts) AS end_ts FROM events),
SG AS (SELECT night, stage, lag(end_ts, 1, CASE WHEN date_part('day', night) % 2 = 0 THEN CAST(night AS TIMESTAMP) END) OVER (PARTITION BY night ORDER BY end_ts, stage) AS start_ts, end_ts FROM N0)
"""


def stages(spark, d):
    e = A.table(spark, d, "events").select(F.to_date("ts").alias("night"), A.pick(["deep", "light", "rem", "awake"], F.col("user_id") % 4).alias("stage"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("end_ts"))
    return series.stage_rows(e.withColumn("start_ts", F.when(F.day("night") % 2 == 0, F.col("night").cast("timestamp"))))


@query(STAGES + "SELECT night, stage, start_ts, end_ts FROM SG WHERE start_ts < end_ts")
def sleep_stages(spark, d):
    return stages(spark, d)


@query(STAGES + """SELECT night, CAST(sum(x) FILTER (WHERE stage = 'deep') AS BIGINT) AS deep_s, CAST(sum(x) FILTER (WHERE stage = 'light') AS BIGINT) AS light_s, CAST(sum(x) FILTER (WHERE stage = 'rem') AS BIGINT) AS rem_s,
CAST(sum(x) FILTER (WHERE stage = 'awake') AS BIGINT) AS awake_s, count(*) AS stages, min(start_ts) AS first_ts, max(end_ts) AS last_ts, CAST(sum(x) FILTER (WHERE stage <> 'awake') AS BIGINT) AS asleep_s
FROM (SELECT *, date_diff('second', start_ts, end_ts) AS x FROM SG WHERE start_ts < end_ts) GROUP BY 1""")
def sleep_detail(spark, d):
    return series.sleep_detail(stages(spark, d))


def nights(spark, d):
    """Sessions of nights in two scopes: a device's, with its stages, and another that begins an hour before."""
    found = series.sleep_detail(stages(spark, d)).withColumnRenamed("first_ts", "start_ts").withColumnRenamed("last_ts", "end_ts").drop("stages")
    other = found.select("night", (F.col("start_ts") - F.expr("INTERVAL 1 HOUR")).alias("start_ts"), "end_ts").where("day(night) % 3 = 0").withColumn("scope", F.lit("vendor_cloud"))
    return found.withColumn("scope", F.lit("device")), other


@query(STAGES + """, SN AS (SELECT * FROM SG WHERE start_ts < end_ts), OFS AS (SELECT lo2, hi2, off FROM REG), SL AS (SELECT SN.*, a.off AS oa, b.off AS ob FROM SN JOIN OFS a ON 2 * epoch_us(start_ts) > a.lo2 AND 2 * epoch_us(start_ts) <= a.hi2 JOIN OFS b ON 2 * epoch_us(end_ts) > b.lo2 AND 2 * epoch_us(end_ts) <= b.hi2),
NT AS (SELECT night, max(end_ts) AS e FROM SN GROUP BY 1)
SELECT SL.night, off AS utc_offset_s, stage, start_ts, end_ts, strftime(start_ts + to_seconds(CAST(oa AS BIGINT)), '%H:%M') AS start_local, strftime(end_ts + to_seconds(CAST(ob AS BIGINT)), '%H:%M') AS end_local, date_diff('second', start_ts, end_ts) AS seconds
FROM SL JOIN NT USING (night) JOIN OFS ON 2 * epoch_us(e) > lo2 AND 2 * epoch_us(e) <= hi2""")
def sleep_sessions(spark, d):
    """Stages inside their sessions, opened again for comparison."""
    out = series.sleep_sessions(nights(spark, d)[0], stages(spark, d), A.offsets(spark, d))
    flat = out.select("night", "utc_offset_s", F.inline("stages"))
    return flat.withColumn("seconds", F.round(F.col("minutes") * 60).cast("long")).drop("minutes")


@query(STAGES + """, NN AS (SELECT night, 'device' AS scope FROM SG WHERE start_ts < end_ts GROUP BY 1), NS AS (SELECT * FROM NN UNION ALL SELECT night, 'vendor_cloud' FROM NN WHERE date_part('day', night) % 3 = 0)
SELECT night AS date, scope FROM NS WHERE night = (SELECT max(night) FROM NS)""")
def latest_night(spark, d):
    a, b = nights(spark, d)
    return series.latest_nights(a.unionByName(b, allowMissingColumns=True).select(F.col("night").alias("date"), "scope"))


@query(STAGES + """, NN AS (SELECT night, 'device' AS scope FROM SG WHERE start_ts < end_ts GROUP BY 1), NS AS (SELECT * FROM NN UNION ALL SELECT night, 'vendor_cloud' FROM NN WHERE date_part('day', night) % 3 = 0)
SELECT scope, count(*) AS n, min(night) AS first_day, max(night) AS last_day FROM NS GROUP BY 1""")
def nights_per_scope(spark, d):
    a, b = nights(spark, d)
    return health.nights(a.unionByName(b, allowMissingColumns=True).select(F.col("night").alias("date"), "scope"))


@query(STAGES + """, SN AS (SELECT * FROM SG WHERE start_ts < end_ts), OG AS (SELECT night, min(start_ts) AS o FROM SN GROUP BY 1)
SELECT night, 'device' AS scope, CASE stage WHEN 'awake' THEN 0 WHEN 'rem' THEN 1 WHEN 'light' THEN 2 WHEN 'deep' THEN 3 END AS lane, date_diff('second', o, start_ts) AS from_s, date_diff('second', o, end_ts) AS to_s FROM SN JOIN OG USING (night)""")
def hypnogram(spark, d):
    out = series.hypnogram(stages(spark, d).withColumn("scope", F.lit("device")))
    return out.select("night", "scope", "lane", *(F.round(F.col(f"{c}_hour") * 3600).cast("long").alias(f"{c}_s") for c in ("from", "to")))


@query(STAGES + """, NT AS (SELECT night, min(start_ts) AS a, max(end_ts) AS b FROM SG WHERE start_ts < end_ts GROUP BY 1), H AS (SELECT date_diff('second', TIMESTAMP '2024-01-10', a) + 3600 AS low, date_diff('second', TIMESTAMP '2024-01-10', b) + 3600 AS high FROM NT)
SELECT greatest(low, 0) AS low_s, least(high, 86400) AS high_s FROM H WHERE greatest(low, 0) < least(high, 86400)""")
def sleep_windows(spark, d):
    """The hours of a local day, an hour ahead of UTC, that nights take up."""
    out = series.sleep_windows(nights(spark, d)[0].withColumn("offset_s", F.lit(3600)), "2024-01-10")
    return out.select(*(F.round(F.col(f"{c}_hour") * 3600).cast("long").alias(f"{c}_s") for c in ("low", "high")))


LIVE = """, V AS (SELECT us AS low, us + 600000000 AS high FROM S WHERE scope = 'device'),
V0 AS (SELECT *, max(high) OVER (ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM V),
V1 AS (SELECT *, sum(CASE WHEN low > before THEN 1 ELSE 0 END) OVER (ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM V0),
LS AS (SELECT min(low) AS low_us, max(high) AS high_us FROM V1 GROUP BY island)
"""


def live_spans(spark, d):
    us = scalars.micros(F.col("ts"))
    return A.samples(spark, d).where("scope = 'device'").select(us.alias("low"), (us + 600_000_000).alias("high"))


def sessions(spark, d):
    return intervals.merge(live_spans(spark, d), bucket=localday.DAY_US).select(F.col("low").alias("low_us"), F.col("high").alias("high_us"))


@query(LIVE + "SELECT low_us, high_us FROM LS")
def live_sessions(spark, d):
    return sessions(spark, d)


@query(LIVE + """, MI AS (SELECT DISTINCT us - us % 60000000 AS minute_us FROM S) SELECT low_us AS session, count(DISTINCT minute_us) AS minutes FROM LS LEFT JOIN MI ON minute_us BETWEEN low_us - low_us % 60000000 AND high_us GROUP BY ALL""")
def session_minutes(spark, d):
    found = series.session_minutes(sessions(spark, d).withColumn("session", F.col("low_us")), aggregates.minute_fold(A.samples(spark, d)))
    return found.select("session", "minutes")


LIVE_DAY = """, SP0 AS (SELECT ts AS a, ts + INTERVAL 600 SECOND AS b FROM S WHERE scope = 'device'),
SP1 AS (SELECT epoch_us(a) AS low, epoch_us(b) AS high FROM SP0 JOIN REG ra ON 2 * epoch_us(a) > ra.lo2 AND 2 * epoch_us(a) <= ra.hi2 JOIN REG rb ON 2 * epoch_us(b) > rb.lo2 AND 2 * epoch_us(b) <= rb.hi2
  WHERE CAST(a + to_seconds(CAST(ra.off AS BIGINT)) AS DATE) = DATE '2024-01-12' OR CAST(b + to_seconds(CAST(rb.off AS BIGINT)) AS DATE) = DATE '2024-01-12'),
V0 AS (SELECT *, max(high) OVER (ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM SP1), V1 AS (SELECT *, sum(CASE WHEN low > before THEN 1 ELSE 0 END) OVER (ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM V0)
, LD AS (SELECT min(low) AS low_us, max(high) AS high_us FROM V1 GROUP BY island)
SELECT low_us, high_us, low_us + CAST(ra.off AS BIGINT) * 1000000 AS low_local, high_us + CAST(rb.off AS BIGINT) * 1000000 AS high_local FROM LD JOIN REG ra ON 2 * low_us > ra.lo2 AND 2 * low_us <= ra.hi2 JOIN REG rb ON 2 * high_us > rb.lo2 AND 2 * high_us <= rb.hi2"""


@query(LIVE_DAY)
def live_day(spark, d):
    """Sessions of one local day: spans that begin or end on it, merged, on both clocks."""
    spans_ = live_spans(spark, d).select(F.timestamp_micros("low").alias("start_ts"), F.timestamp_micros("high").alias("end_ts"))
    found = series.with_local_ends(series.live_sessions(spans_, A.offsets(spark, d), "2024-01-12"), A.offsets(spark, d))
    return found.select(*(F.unix_micros(c).alias(a) for c, a in (("start_ts", "low_us"), ("end_ts", "high_us"), ("start_local", "low_local"), ("end_local", "high_local"))))


@query("""SELECT ord, t.metric, count(value) AS minutes, quantile_disc(value, 0.5) AS median FROM (VALUES (0, 'view'), (1, 'never'), (2, 'click')) t(ord, metric) LEFT JOIN (SELECT * FROM L WHERE local_day = DATE '2024-01-12') x ON t.metric = x.metric GROUP BY ALL""")
def live_metrics(spark, d):
    return series.live_metrics(A.samples(spark, d), A.offsets(spark, d), "2024-01-12", ["view", "never", "click"])


# -- texts and contract ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, {scalars.redact_sql('coalesce(text, $$$$)')} AS t FROM documents)".replace("$$$$", "''"), views=False)
def redact_text(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", scalars.redact(F.coalesce("text", F.lit(""))).alias("text"))
    return t.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), 'idiot|the', '{name}', 'gi')) AS digest FROM documents", views=False)
def scrubbed_names(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.md5(scalars.scrub(F.coalesce("text", F.lit("")), ["the", "idiot"]).cast("binary")).alias("digest"))


@query("""SELECT '{"stream":"' || stream || '","n":' || raw_id || CASE WHEN raw_id % 2 = 0 THEN ',"even":true' ELSE '' END || '}' AS json FROM RAW""")
def records_as_json(spark, d):
    """Absent values have no key; identifiers are left out."""
    r = A.raw(spark, d).select("device_id", "stream", F.col("raw_id").alias("n"), F.when(F.col("raw_id") % 2 == 0, F.lit(True)).alias("even"))
    return store.as_json(r, "device_id")


@query("SELECT greatest(DATE '2024-01-10', CAST(TIMESTAMP '2024-01-10 22:30:00' + to_seconds(CAST(off AS BIGINT)) AS DATE)) AS today FROM REG WHERE 2 * epoch_us(TIMESTAMP '2024-01-10 22:30:00') > lo2 AND 2 * epoch_us(TIMESTAMP '2024-01-10 22:30:00') <= hi2")
def local_today(spark, d):
    return localday.local_today(A.offsets(spark, d), datetime.datetime(2024, 1, 10, 22, 30))


@query(f"SELECT url, md5(t) AS digest FROM (SELECT url, {scalars.mask_label_sql('url')} AS t FROM pages)", views=False)
def mask_label(spark, d):
    return A.table(spark, d, "pages").select("url", F.md5(scalars.mask_label(F.col("url")).cast("binary")).alias("digest"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS text, epoch_us(date_trunc('second', ts)) AS us, CASE WHEN event_id % 3 > 0 THEN epoch_us(date_trunc('second', ts)) END AS parsed FROM events", views=False)
def instants(spark, d):
    """Instants as text and back; texts that are not of the one strict form are none."""
    e = A.table(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    text = scalars.instant_text(F.col("ts"))
    broken = F.when(F.col("event_id") % 6 == 0, F.regexp_replace(text, "T", " ")).when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    back = e.select("event_id", text.alias("text"), F.unix_micros(scalars.instant(text)).alias("us"), F.unix_micros(scalars.instant(broken)).alias("parsed"))
    return back


@query("""WITH R AS (SELECT o_orderpriority AS metric, o_orderstatus AS k, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY ALL), A AS (SELECT metric, k, a - (b - a) * 0.08 AS low, b + (b - a) * 0.08 AS high FROM R WHERE a < b),
U AS (SELECT *, (high - low) / 5 AS raw, pow(10, floor(log10((high - low) / 5))) AS u FROM A), T AS (SELECT *, CASE WHEN raw <= u THEN u WHEN raw <= 2 * u THEN 2 * u WHEN raw <= 2.5 * u THEN 2.5 * u WHEN raw <= 5 * u THEN 5 * u ELSE 10 * u END AS step FROM U)
SELECT metric, k, step, string_agg(CAST(CAST(round(i * step) AS BIGINT) AS VARCHAR), ' ' ORDER BY i) AS labels FROM (SELECT *, unnest(range(CAST(ceil(low / step - 1e-9) AS BIGINT), CAST(floor(high / step + 1e-9) AS BIGINT) + 1)) AS i FROM T) GROUP BY ALL""", views=False)
def chart_axes(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("k"), F.col("o_totalprice").alias("value"))
    return series.axes(o, "metric", "k").select("metric", "k", "step", F.array_join("labels", " ").alias("labels"))


@query("""WITH N AS (SELECT event_id, greatest(event_id * 37, 65536) AS n, CAST(floor(log2(greatest(event_id * 37, 65536))) AS BIGINT) AS e FROM events), B AS (SELECT *, (1 << CAST(e - CAST(floor(log2(e)) AS BIGINT) - 1 AS INTEGER)) AS block FROM N)
SELECT event_id, (n + block - 1) // block * block AS padded FROM B""", views=False)
def padded_lengths(spark, d):
    return A.table(spark, d, "events").select("event_id", scalars.padded_length(F.col("event_id") * 37).alias("padded"))


SUPPLIED = {
    ("device", "fit:hrv"): 8, ("device", "fit:metrics"): 2, ("device", "fit:monitoring_b"): 8, ("device", "fit:skin_temp"): 3, ("device", "fit:sleep"): 2, ("live", "json:live"): 5, ("local", "fit:monitoring_b"): 9,
    ("vendor_cloud", "json:biometrics"): 1, ("vendor_cloud", "json:endurance"): 1, ("vendor_cloud", "json:fitness_age"): 1, ("vendor_cloud", "json:readiness"): 11, ("vendor_cloud", "json:sleep"): 2, ("vendor_cloud", "json:training_load"): 4,
    ("vendor_cloud", "json:uds"): 25, ("vendor_cloud", "json:vo2max"): 2,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{scope}', '{s}', CAST({n} AS BIGINT))" for (scope, s), n in SUPPLIED.items()) + ") t(scope, stream, n)", views=False)
def contract_streams(spark, d):
    """How many metrics each stream supplies to each scope, as counted by hand."""
    supplied = contract.dump(spark).select(F.inline("supplied")).select("scope", F.explode("streams").alias("stream"))
    return supplied.groupBy("scope", "stream").agg(F.count(F.lit(1)).alias("n"))


CONTRACT_UNITS = {
    "bpm": 5, "score": 14, "breaths/min": 4, "%": 9, "ms": 7, "steps": 1, "m": 1, "min": 5, "kcal": 3, "kcal/day": 1, "degC": 3, "mL/kg/min": 1, "h": 1, "load": 2, "ratio": 1, "years": 1, "kg": 1, "mL": 2, "label": 5,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', CAST({n} AS BIGINT))" for u, n in CONTRACT_UNITS.items()) + ") t(unit, n)", views=False)
def contract_metrics(spark, d):
    """How many metrics have each unit, as counted by hand."""
    return contract.metrics(spark).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


for _name, _sql, _views in LATER:
    _sql = _sql() if callable(_sql) else _sql
    ORACLE_SQL[_name] = f"WITH {A.SQL}{_sql}" if _views else _sql
