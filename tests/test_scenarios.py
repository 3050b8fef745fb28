"""Scenarios with answers worked out by hand."""

import datetime as dt
import json

import pytest

from tideline.operators import aggregates, localday, sequences
from tideline.plans import coverage, facts, series
from tideline.sources import ingest, json_records

DAY = dt.date(2025, 6, 15)


def at(day, hour, minute=0, second=0):
    return dt.datetime(2025, 6, day, hour, minute, second)


def offsets(spark, seconds, moment=at(15, 12)):
    return spark.createDataFrame([(moment, seconds, 1)], "ts timestamp, offset_s int, raw_id long")


def readings(spark, rows, metric="stress", scope="device"):
    return spark.createDataFrame([(metric, scope, "d", t, float(v), i) for i, (t, v) in enumerate(rows)], "metric string, scope string, device_id string, ts timestamp, value double, raw_id long")


def test_local_days_and_hours(spark):
    rows = readings(spark, [(at(15, 10), 20), (at(15, 11), 40), (at(15, 22, 30), 60)])
    clock = offsets(spark, 10_800)
    got = {r.local_day.day: (r.min_value, r.mean_value, r.max_value, r.n) for r in aggregates.sample_day_aggregates(localday.with_local_day(rows, clock)).collect()}
    assert got == {15: (20, 30, 40, 2), 16: (60, 60, 60, 1)}
    for day, hours in ((15, [13.0, 14.0]), (16, [1.5])):
        found = series.intraday(localday.in_local_days(rows, clock, f"2025-06-{day}", f"2025-06-{day}"), f"2025-06-{day}")
        assert sorted(r.hour for r in found.collect()) == hours


def test_half_hour_zone(spark):
    rows = readings(spark, [(dt.datetime(2025, 6, 1, 18, 10), 1), (dt.datetime(2025, 6, 1, 18, 40), 2)])
    assert sorted(r.local_day.day for r in localday.with_local_day(rows, offsets(spark, 19_800)).collect()) == [1, 2]


def values(spark, rows):
    return spark.createDataFrame([("resting_heart_rate", "device", d, float(v)) for d, v in rows], "metric string, scope string, day date, value double")


def test_facts(spark):
    window = [(DAY - dt.timedelta(k), 80) for k in range(7)]
    before = [(DAY - dt.timedelta(7 + k), 68 if k % 2 else 72) for k in range(28)]
    r = facts.period_facts(values(spark, window + before), DAY).first()
    assert (r.value, r.baseline_mean, r.delta, round(r.delta_percent, 2), r.confidence, r.direction, r.reason_code) == (80, 70, 10, 14.29, "high", "higher", "ok")
    assert 4 < r.z < 6 and r.n_window == 7 and r.n_baseline == 28
    for rows, reason in ((window + before[:2], "baseline_too_thin"), (window, "no_baseline"), (before, "no_data_in_window")):
        assert facts.period_facts(values(spark, rows), DAY).first().reason_code == reason
    flat = facts.period_facts(values(spark, [(d, 50) for d, _ in window[:1] + before[:6]]), DAY).first()
    assert flat.direction == "unchanged" and flat.z is None


def local(rows):
    return localday.with_local_day(rows, offsets(rows.sparkSession, 0))


def test_step_reducers(spark):
    rows = [(at(15, 10, m), v) for m, v in ((2, 40), (0, 50), (3, 45), (1, 60))]
    r = aggregates.charged_drained(local(readings(spark, rows))).first()
    assert (r.charged, r.drained) == (15, 20)
    r = aggregates.charged_drained(local(readings(spark, [*rows, (at(15, 14, 3), 90), (at(15, 14, 4), 92)]))).first()
    assert (r.charged, r.drained) == (17, 20)


def test_counter_total(spark):
    rows = [("d", DAY, "walking", 7_000, at(15, 20), 1), ("d", DAY, "walking", 7_600, at(16, 0), 2), ("d", DAY, "running", 400, at(15, 9), 3)]
    counters = spark.createDataFrame(rows, "device_id string, local_day date, kind string, counter long, ts timestamp, raw_id long")
    r = aggregates.counter_totals(counters).first()
    assert (r.total, r.kinds, r.raw_id) == (8_000, 2, 2)


def test_live_fold(spark):
    fold = lambda rows: {r.minute_us % 3_600_000_000 // 60_000_000: (r.value, r.n, r.raw_id) for r in aggregates.minute_fold(readings(spark, rows)).collect()}
    got = fold([(at(15, 10, 0, 1), 70), (at(15, 10, 0, 2), 90), (at(15, 10, 0, 3), 80), (at(15, 10, 1, 0), 100), (at(15, 10, 1, 5), 99)])
    assert {m: v for m, (v, _, _) in got.items()} == {0: 80, 1: 99}
    first, second = [(at(15, 10, 0, s), v) for s, v in ((1, 70), (2, 72), (3, 74))], [(at(15, 10, 0, s), v) for s, v in ((2, 72), (3, 74), (4, 76))]
    assert fold(first + second)[0] == (72, 4, 0)


def test_live_sentinels(spark):
    edges = {"heart_rate": (0, 1, 254, 255), "stress": (-1, 0, 100, 101), "respiration_rate": (-1, 0, 254, 255), "spo2": (0, 1, 100, 101), "energy_reserve": (-1, 0, 100, 101), "other": (1, 2)}
    record = json.dumps({"readings": [[60 * k, m, v] for m, vs in edges.items() for k, v in enumerate(vs)]})
    tables = ingest.live_tables(spark.createDataFrame([("r", record)], "raw_id string, record string"))
    assert tables["readings"].count() == 10 and tables["failures"].count() == 0
    assert sorted(r.n for r in tables["drops"].collect()) == [2] * 5


def test_agreement(spark):
    score = [(d, "device", 80.0) for d in range(1, 6)] + [(d, "vendor_cloud", 80.0 if d > 1 else 83.0) for d in range(1, 6)]
    rows = [("sleep_score", s, dt.date(2025, 6, d), v) for d, s, v in score] + [("steps", "local", DAY, 8_000.0), ("steps", "vendor_cloud", DAY, 8_040.0)]
    daily = spark.createDataFrame(rows, "metric string, scope string, day date, value double")
    none = spark.createDataFrame([], "metric string, scope_a string, compared_with string, scope_b string")
    got = {r.metric: r for r in series.source_agreement(daily, none).collect()}
    r = got["sleep_score"]
    assert (r.n, r.matches, r.median_abs, r.max_abs, r.mean_d) == (5, 4, 0, 3, pytest.approx(-0.6))
    assert (got["steps"].n, got["steps"].matches) == (1, 1)


def test_recent_runs(spark):
    transports = {1: "usb", 2: "ble", 3: "usb", 4: "usb", 5: "ble", 6: None, 7: "usb", 8: "ble", 9: "usb", 10: "ble", 11: "usb"}
    got = series.recent_runs(spark.createDataFrame(list(transports.items()), "run_id long, transport string"))
    assert sorted((r.run_id for r in got.collect()), reverse=True) == [11, 10, 9, 7, 6, 4]


def test_gaps_and_trailing_means(spark):
    points = lambda days: spark.createDataFrame([("m", dt.date(2025, 6, d), float(v)) for d, v in days], "metric string, day date, value double")
    assert sequences.series_runs(points([(1, 0), (2, 0), (6, 0), (7, 0)]), 1, "metric").count() == 2
    got = sequences.trailing_mean(points([(d + 1, d) for d in range(10)]), 5, "metric").orderBy("day").collect()
    assert len(got) == 6 and (got[0].day.day, got[0].mean) == (5, 2.0)
    assert sequences.trailing_mean(points([(1, 1), (9, 1)]), 5, "metric").count() == 0


def test_readiness(spark):
    row = lambda day, clock, score, context: json.dumps({"calendarDate": f"2025-06-{day}", "timestamp": f"2025-06-{day}T{clock}:00.0", "score": score, "inputContext": context})
    rows = [row(15, "07:00", 77, json_records.MORNING), row(15, "18:00", 60, "OTHER"), row(15, "07:00", 77, json_records.MORNING), row(16, "06:00", 50, "OTHER"), row(16, "20:00", 55, "OTHER")]
    picked = json_records.pick_readiness(spark.createDataFrame([(r,) for r in rows], "record string"))
    got = json_records.decode(picked.select("record"), "json:readiness").where("metric = 'training_readiness'")
    assert {r.date.day: r.value for r in got.collect()} == {15: 77, 16: 55}


def test_touched_days_keep_the_others(spark):
    """A second batch that starts at noon of the next day leaves the day before as it was."""
    first = [(at(15, 10, m), v) for m, v in ((0, 50), (1, 60))]
    second = [(at(16, 12, m), v) for m, v in ((0, 55), (1, 45), (2, 50))]
    rows = local(readings(spark, first + second, "energy_reserve"))
    touched = local(readings(spark, second, "energy_reserve")).select("local_day").distinct()
    tables = {"samples": readings(spark, first + second, "energy_reserve"), "offsets": offsets(spark, 0), "intervals": spark.createDataFrame([], "raw_id long, ts timestamp, activity_type int, steps long, distance_m double, device_id string")}
    got = {(r.metric, r.day.day): r.value for r in ingest.derive(tables, touched).collect()}
    assert got == {("energy_reserve_high", 16): 55, ("energy_reserve_low", 16): 45, ("energy_reserve_charged", 16): 5, ("energy_reserve_drained", 16): 10}
    assert rows.count() == 5


def test_coverage_of_ten_days(spark):
    """One stream over ten days: days with values, failed ones, one that a span covers, and days of which nothing is known."""
    day = lambda d: dt.datetime(2025, 6, d)
    spans = [("s", "covered", day(1), day(4)), ("s", "failed", day(5), day(6)), ("s", "covered", day(7), day(8)), ("s", "failed", day(7), day(8)), ("s", "covered", day(9), day(10))]
    flags = coverage.day_flags(spark.createDataFrame(spans, "stream string, kind string, start_ts timestamp, end_ts timestamp"), "2025-06-01", "2025-06-10")
    pairs = spark.createDataFrame([("m", "device", "s")], "metric string, scope string, stream string")
    present = spark.createDataFrame([("m", "device", day(d).date()) for d in (1, 2, 3)], "metric string, scope string, day date")
    rows = coverage.statuses(coverage.calendar("2025-06-01", "2025-06-10", spark), pairs, present, flags)
    r = coverage.ledger(rows).first()
    assert (r.present, r.failed, r.source_empty, r.not_covered) == (3, 2, 1, 4)
    assert [g.status for g in coverage.status_gaps(rows).orderBy("first_day").collect()] == ["not_covered", "failed", "not_covered", "failed", "not_covered", "source_empty", "not_covered"]
