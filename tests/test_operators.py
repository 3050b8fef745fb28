"""Operators against hand-made goldens and seeded brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import aggregates, dedupe, intervals, localday, sequences
from tideline.plans import coverage, facts, health, series

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def nearest(t, seen):
    return min(seen, key=lambda x: (abs(x[0] - t), x[0]))[1]


def test_offset_is_the_nearest_one_with_ties_to_the_earlier(spark):
    rng = random.Random(1)
    seen = sorted({rng.randrange(0, 900_000): rng.choice([0, 3600, 19800, -18000]) for _ in range(25)}.items())
    times = [rng.randrange(-100_000, 1_000_000) for _ in range(300)] + [(a + b) // 2 for (a, _), (b, _) in zip(seen, seen[1:])] + [a for a, _ in seen]
    offsets = spark.createDataFrame([(at(s), o, i) for i, (s, o) in enumerate(seen)], "ts timestamp, offset_s int, raw_id long")
    rows = spark.createDataFrame([(at(t), t) for t in times], "ts timestamp, t long")
    got = {r.t: r.offset_s for r in localday.with_offset(rows, offsets).collect()}
    assert got == {t: nearest(t, seen) for t in times}
    assert localday.with_offset(rows, offsets).count() == len(times)


def test_no_offsets_means_utc_and_is_told(spark):
    rows = spark.createDataFrame([(at(0),)], "ts timestamp")
    none = spark.createDataFrame([], "ts timestamp, offset_s int, raw_id long")
    r = localday.with_local_day(rows, none).first()
    assert (r.offset_s, r.assumed_utc, r.local_day) == (0, True, dt.date(2024, 3, 1))


def test_offset_of_one_instant_is_that_of_the_largest_record(spark):
    offsets = spark.createDataFrame([(at(0), 0, 1), (at(0), 3600, 2)], "ts timestamp, offset_s int, raw_id long")
    assert localday.with_offset(spark.createDataFrame([(at(5),)], "ts timestamp"), offsets).first().offset_s == 3600


def test_steps_stop_at_gaps(spark):
    rows = spark.createDataFrame([("m", "d", dt.date(2024, 3, 1), at(t), i, v) for i, (t, v) in enumerate([(0, 50.0), (900, 60.0), (1801, 90.0), (2000, 85.0)])], "metric string, device_id string, local_day date, ts timestamp, raw_id long, value double")
    r = aggregates.charged_drained(rows).first()
    assert (r.charged, r.drained, r.n) == (10.0, 5.0, 4)


@pytest.mark.parametrize("values,low,high", [([1.0], 1, 1), ([1.0, 2.0], 1, 2), ([3.0, 1.0, 2.0], 2, 2), ([4.0, 1.0, 3.0, 2.0], 2, 3), ([1.0, 1.0, 5.0, 5.0], 1, 5)])
def test_medians(spark, values, low, high):
    from tideline.functions.scalars import lower_median, upper_median

    r = spark.createDataFrame([(v,) for v in values], "v double").agg(lower_median("v").alias("low"), upper_median("v").alias("high")).first()
    assert (r.low, r.high) == (low, high)


def test_merge_and_clip_equal_a_loop(spark):
    rng = random.Random(2)
    spans = [(rng.randrange(0, 400_000), rng.randrange(1, 30_000)) for _ in range(60)]
    spans = [(a, a + n) for a, n in spans]
    covered = set()
    for a, b in spans:
        covered.update(range(a // 10, b // 10))
    df = spark.createDataFrame([(1, a // 10 * 10, b // 10 * 10) for a, b in spans], "k int, low long, high long")
    merged = intervals.merge(df, "k")
    assert sum(r.high - r.low for r in merged.collect()) == 10 * len(covered)
    bounds = spark.createDataFrame([(dt.date(1970, 1, 1 + d), d * 86_400 - 3600, (d + 1) * 86_400 - 3600) for d in range(6)], "day date, low_s long, high_s long")
    got = {r.day.day - 1: r.seconds for r in intervals.clipped_seconds(merged, bounds, "k").collect()}
    want = {}
    for x in covered:
        day = (x * 10 + 3600) // 86_400
        want[day] = want.get(day, 0) + 10
    assert got == {k: v for k, v in want.items() if k < 6}


def test_touching_spans_merge_and_worn_gap_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 21, 30)], "k int, low long, high long")
    assert sorted((r.low, r.high) for r in intervals.merge(df, "k").collect()) == [(0, 20), (21, 30)]
    worn = intervals.worn_spans(spark.createDataFrame([(1, 0), (1, 300), (1, 601)], "k int, at_s long"), "k")
    assert sorted((r.low, r.high) for r in worn.collect()) == [(0, 300), (300, 360), (601, 661)]


def test_latest_observed_folds_nulls_in_order(spark):
    def fold(versions):
        kept = None
        for v in sorted(versions):
            if kept is None or v[1] is None or kept[1] is None or v[1] >= kept[1]:
                kept = v
        return kept

    rng = random.Random(3)
    rows = [(k, order, rng.choice([None, 1, 2, 3]), rng.random()) for k in range(40) for order in range(5)]
    df = spark.createDataFrame(rows, "k int, n int, observed int, value double")
    got = {r.k: (r.n, r.observed, r.value) for r in dedupe.latest_observed(df, ["k"], "n").collect()}
    assert got == {k: fold([r[1:] for r in rows if r[0] == k]) for k in range(40)}


def test_trailing_mean_and_runs_equal_a_loop(spark):
    rng = random.Random(4)
    days = sorted(rng.sample(range(80), 45))
    df = spark.createDataFrame([("m", dt.date(2024, 1, 1) + dt.timedelta(d), float(d)) for d in days], "metric string, day date, value double")
    want = {}
    for d in days:
        inside = [x for x in days if d - 6 <= x <= d]
        if len(inside) * 2 >= 7 and d - 6 >= days[0]:
            want[d] = (pytest.approx(sum(inside) / len(inside)), len(inside))
    got = {(r.day - dt.date(2024, 1, 1)).days: (r.mean, r.present) for r in sequences.trailing_mean(df, 7, "metric").collect()}
    assert got == want
    runs = sequences.series_runs(df, 2, "metric").collect()
    assert sum(r.n for r in runs) == len(days)
    assert len(runs) == 1 + sum(b - a > 2 for a, b in zip(days, days[1:]))


def test_status_precedence_and_gaps(spark):
    day = lambda n: dt.date(2024, 1, n)
    days = coverage.calendar("2024-01-01", "2024-01-06", spark)
    pairs = spark.createDataFrame([("m", "device", "a"), ("m", "device", "b")], "metric string, scope string, stream string")
    present = spark.createDataFrame([("m", "device", day(1))], "metric string, scope string, day date")
    flags = [("a", day(1), True, False), ("a", day(2), True, False), ("b", day(3), True, False), ("b", day(2), False, True), ("b", day(4), False, True), ("other", day(6), True, True)]
    present = present.union(spark.createDataFrame([("m", "device", dt.date(2023, 1, 1))], present.schema))  # outside the calendar
    rows = coverage.statuses(days, pairs, present, spark.createDataFrame(flags, "stream string, day date, covered boolean, failed boolean"))
    assert [r.status for r in rows.orderBy("day").collect()] == ["present", "failed", "source_empty", "failed", "not_covered", "not_covered"]
    gaps = coverage.status_gaps(rows).orderBy("first_day").collect()
    assert [(g.status, g.days) for g in gaps] == [("failed", 1), ("source_empty", 1), ("failed", 1), ("not_covered", 2)]
    assert not any(g.more for g in gaps)
    few = sequences.gaps(rows, "metric", "scope", newest=2).collect()
    assert len(few) == 2 and all(g.more for g in few)


def test_span_end_is_exclusive_by_a_microsecond(spark):
    spans = [("s", "covered", at(0), at(86_400)), ("s", "failed", at(3 * 86_400), at(3 * 86_400)), ("fit:monitoring_b", "covered", at(0), at(10)), ("fit:monitoring_b", "failed", at(86_400), at(86_410))]
    flags = coverage.day_flags(spark.createDataFrame(spans, "stream string, kind string, start_ts timestamp, end_ts timestamp"), "2024-02-01", "2024-04-01").collect()
    got = {(r.stream, r.day.day): (r.covered, r.failed) for r in flags}
    nightly = {(s, 1): (True, False) for s in ("fit:monitoring_b", "fit:sleep", "fit:hrv", "fit:skin_temp")}
    assert got == nightly | {("s", 1): (True, False), ("s", 4): (False, True), ("fit:monitoring_b", 2): (False, True)}


def test_facts_edges(spark):
    """The rules as the product states them."""
    day = lambda d: dt.date(2024, 1, d)
    points = {
        "m": [(d, float(d)) for d in (1, 2, 3, 29, 30)], "flat": [(d, 0.1) for d in (1, 2, 3, 30)], "thin": [(1, 1.0), (2, 2.0), (30, 9.0)], "lone": [(29, 4.0)], "quiet": [(d, 5.0) for d in range(1, 12)],
        "zero": [(1, -1.0), (2, 0.0), (3, 1.0), (30, 2.0)],
    }
    rows = [(m, "device", day(d), v) for m, found in points.items() for d, v in found] + [("m", "live", day(30), 99.0)]
    daily = spark.createDataFrame(rows, "metric string, scope string, day date, value double")
    asked = spark.createDataFrame([(m,) for m in (*points, "none")], "metric string")
    got = {r.metric: r for r in facts.period_facts(daily, day(30), 7, 28, asked, points=True).collect()}
    m = got["m"]
    assert (m.value, m.window_min, m.window_max, m.baseline_mean, m.baseline_sd, m.delta, m.direction, m.confidence, m.reason_code) == (29.5, 29, 30, 2, 1, 27.5, "higher", "low", "ok")
    assert m.window_dates == [day(29), day(30)] and [p.value for p in m.window_points] == [29, 30] and (m.baseline_from, m.baseline_to) == (dt.date(2023, 12, 27), day(23))
    assert (got["flat"].z, got["flat"].direction, got["flat"].baseline_sd) == (None, "unchanged", 0)
    assert (got["thin"].reason_code, got["thin"].confidence, got["thin"].delta, got["thin"].direction, got["thin"].baseline_mean, got["thin"].value) == ("baseline_too_thin", "insufficient", None, None, None, 9)
    assert (got["lone"].reason_code, got["lone"].confidence, got["lone"].n_baseline) == ("no_baseline", "insufficient", 0)
    assert (got["quiet"].reason_code, got["quiet"].confidence, got["quiet"].value, got["quiet"].delta) == ("no_data_in_window", "insufficient", None, None)
    assert got["zero"].delta_percent is None and got["zero"].z == 2
    assert (got["none"].reason_code, got["none"].scope, got["none"].confidence) == ("no_data", "any", "insufficient")
    live = facts.period_facts(daily, day(30), scopes=("live",)).collect()
    assert [(r.metric, r.value) for r in live] == [("m", 99.0)]


def test_latest_stored_day_leaves_sessions_out(spark):
    daily = spark.createDataFrame([(dt.date(2024, 3, 1),)], "day date")
    samples = spark.createDataFrame([(at(86_400), "device"), (at(5 * 86_400), "live")], "ts timestamp, scope string")
    assert facts.latest_stored_day(daily, samples).first().day == dt.date(2024, 3, 2)
    assert facts.latest_stored_day(daily, samples, ("live",)).first().day == dt.date(2024, 3, 6)


def test_values_keep_their_fractions(spark):
    rows = spark.createDataFrame([("m", "device", dt.date(2024, 1, 1), 0.004)] * 3 + [("h", "device", dt.date(2024, 1, 1), 1 / 128)], "metric string, scope string, local_day date, value double")
    got = {r.metric: r for r in aggregates.sample_day_aggregates(rows).collect()}
    assert got["m"].mean_value == pytest.approx(0.004) and got["h"].mean_value == 1 / 128
    pairs = spark.createDataFrame([("m", None, "a", "b", 1.004, 1.0)], "metric string, compared_with string, scope_a string, scope_b string, a double, b double")
    r = aggregates.agreement(pairs).first()
    assert r.max_abs == pytest.approx(0.004) and r.mean_d == pytest.approx(0.004)


def test_exports_and_sleep(spark):
    day = dt.date(2024, 1, 1)
    values = spark.createDataFrame([(day, "steps", "device", 5.0), (day, "stress_avg", "local", 2.5), (day, "weight_kg", "vendor_cloud", 71.2345), (day, "spo2", "device", 0.1256)], "day date, metric string, scope string, value double")
    labels = spark.createDataFrame([(day, "hrv_status", "device", "low")], "day date, metric string, scope string, label string")
    units = spark.createDataFrame([("steps", "steps"), ("weight_kg", "kg")], "metric string, unit string")
    got = [(r.metric, r.unit, r.value) for r in series.export_long(values, labels, units).orderBy(*series.LONG).collect()]
    assert got == [("hrv_status", "label", "low"), ("spo2", None, "0.126"), ("steps", "steps", "5"), ("stress_avg", None, "2.5"), ("weight_kg", "kg", "71.234" if got[4][2] == "71.234" else "71.235")]
    assert [r.metric for r in series.export_long(values, labels, units, metrics=["steps", "hrv_status"], scope="device", first=day, last=day).orderBy(*series.LONG).collect()] == ["hrv_status", "steps"]
    wide = series.export_wide(values, labels).orderBy(*series.WIDE).first()
    assert wide.asDict() == {"day": day, "hrv_status[device]": "low", "spo2[device]": "0.126", "steps[device]": "5", "stress_avg[local]": "2.5", "weight_kg[vendor_cloud]": wide["weight_kg[vendor_cloud]"]}
    events = spark.createDataFrame([(1, None, at(60), "light"), (1, None, at(180), "deep"), (1, None, at(180), "rem"), (2, at(0), at(60), "awake")], "night int, start_ts timestamp, end_ts timestamp, stage string")
    stages = series.stage_rows(events)
    assert sorted((r.night, r.stage) for r in stages.collect()) == [(1, "deep"), (2, "awake")]
    detail = {r.night: r for r in series.sleep_detail(stages).collect()}
    assert detail[1].asleep_s == 120 and detail[2].asleep_s is None


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(at(0), None, 'a "b", c'), (at(1), "5", "")], "ts timestamp, value string, label string")
    series.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines()[0] == "ts,value,label" and text.splitlines()[2] == "2024-03-01T00:00:01Z,5,"


def test_merge_by_day_equals_merge_as_a_whole(spark):
    rng = random.Random(8)
    spans = [(1, a, a + rng.choice([1, 5, 40, 400, 90_000, 200_000])) for a in (rng.randrange(0, 2_000_000) for _ in range(60))] + [(2, 86_390, 86_400), (2, 86_400, 86_410), (2, 86_411, 86_412), (3, 0, 400_000), (3, 100_000, 100_010), (3, 399_000, 399_100)]
    df = spark.createDataFrame(spans, "k int, low long, high long")
    plain = sorted(map(tuple, intervals.merge(df, "k").collect()))
    assert sorted(map(tuple, intervals.merge(df, "k", bucket=86_400).collect())) == plain
    assert sorted(map(tuple, intervals.merge(df, bucket=86_400).collect())) == sorted(map(tuple, intervals.merge(df).collect()))


def test_worn_spans_go_over_midnight(spark):
    df = spark.createDataFrame([(1, 86_300), (1, 86_500), (1, 300_000)], "k int, at_s long")
    assert sorted((r.low, r.high) for r in intervals.worn_spans(df, "k").collect()) == [(86_300, 86_500), (86_500, 86_560), (300_000, 300_060)]


def test_regimes_of_many_observations(spark):
    """Observations by the minute over days, with changes inside days, at midnights and none at all."""
    rng = random.Random(12)
    seen, offset = [], 0
    for minute in range(0, 6 * 1440, 7):
        if minute > 2 * 1440 and rng.random() < 0.01 or minute % 1440 < 7 and minute > 4000:
            offset = rng.choice([0, 3600, 7200])
        seen.append((at(60 * minute), offset, minute))
    found = localday.regimes(spark.createDataFrame(seen, "ts timestamp, offset_s int, raw_id long")).orderBy("low2").collect()
    changes = [(a[0], b[0], b[1]) for a, b in zip(seen, seen[1:]) if a[1] != b[1]]
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert [(r.low2, r.offset_s) for r in found] == [(-localday.ENDLESS, 0)] + [(us(a) + us(b), o) for a, b, o in changes]
    assert [r.high2 for r in found] == [r.low2 for r in found[1:]] + [localday.ENDLESS]


def test_first_contributor_in_content_order(spark):
    schema = "metric string, ts timestamp, value double, raw_id string, content struct<start:timestamp,digest:string>"
    rows = [("m", at(1), 5.0, "z", (at(0), "a")), ("m", at(2), 7.0, "a", (at(0), "b")), ("m", at(1), 5.0, "q", (None, "c"))]
    r = aggregates.minute_fold(spark.createDataFrame(rows, schema), "content").collect()
    assert [(x.value, x.n, x.raw_id) for x in r] == [(5.0, 2, "q")]  # nulls come first


def test_summary_hides_what_no_source_covers():
    gaps = [{"metric": "m", "scope": "device", "status": s, "first_day": f"2024-01-0{i}", "last_day": f"2024-01-0{i}"} for i, s in enumerate(["failed", "not_covered", "source_empty"], 1)]
    text = health.summary([{"stream": "s", "records": 2, "first_ts": "a", "last_ts": "b"}], gaps)
    assert "not_covered" not in text and "failed" in text and "source_empty" in text


def test_order_of_arrival_does_not_matter(spark):
    rows = [("m", at(i % 7), float(i % 5), i) for i in range(60)]
    schema = "metric string, ts timestamp, value double, raw_id long"
    a = aggregates.minute_fold(spark.createDataFrame(rows, schema)).collect()
    random.Random(5).shuffle(rows)
    b = aggregates.minute_fold(spark.createDataFrame(rows, schema).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_agreement_tolerance(spark):
    pairs = spark.createDataFrame([("m", None, "device", "local", 100.0, b) for b in (100.0, 100.5, 101.0, 200.0)], "metric string, compared_with string, scope_a string, scope_b string, a double, b double")
    r = aggregates.agreement(pairs).first()
    assert (r.n, r.matches, r.median_abs, r.max_abs) == (4, 2, 1, 100)
    assert aggregates.drop_counts(pairs, {"big": "b > 150", "all": "b > 0"}).where(F.col("reason") == "big").first().n == 1


def test_target_pairs_reads_the_whole_mapping(spark):
    rows = [(f"{m}{i}", scope, 1, float(i)) for i in range(100) for m, scope in (("m", "local"), ("t", "vendor_cloud"))]
    daily = spark.createDataFrame(rows, "metric string, scope string, day int, value double")
    targets = spark.createDataFrame([(f"m{i}", "local", f"t{i}", "vendor_cloud") for i in range(100)], "metric string, scope_a string, compared_with string, scope_b string")
    assert {(r.metric, r.a, r.b) for r in series.target_pairs(daily, targets).collect()} == {(f"m{i}", float(i), float(i)) for i in range(100)}


def test_axes_of_flat_and_small_series(spark):
    rows = [("flat", 50.0), ("flat", 50.0), ("none", 0.0), ("small", 0.011), ("small", 0.052), ("wide", -3.0), ("wide", 12_345.0)]
    got = {r.metric: r for r in series.axes(spark.createDataFrame(rows, "metric string, value double"), "metric").collect()}
    assert (got["flat"].low, got["flat"].high) == (47.5, 52.5) and got["flat"].labels == ["48", "49", "50", "51", "52"]
    assert (got["none"].low, got["none"].high) == (-1, 1) and got["none"].labels == ["-1.0", "-0.5", "0.0", "0.5", "1.0"]
    assert got["small"].step == pytest.approx(0.01) and got["small"].labels == ["0.01", "0.02", "0.03", "0.04", "0.05"]
    assert got["wide"].step == 5000 and got["wide"].ticks == [0, 5000, 10_000]
    zero = series.axes(spark.createDataFrame(rows[:2], "metric string, value double"), "metric", zero=True).first()
    assert zero.low == -4 and zero.high == 54


def test_chart_of_points(spark):
    days = [1, 2, 3, 9, 10, 11, 12, 13, 14]
    rows = [("m", "device", dt.date(2024, 1, d), float(d)) for d in days]
    got = {r.day.day: r for r in series.metric_chart(spark.createDataFrame(rows, "metric string, scope string, day date, value double")).collect()}
    assert [got[d].run for d in days] == [0] * 3 + [1] * 6
    assert {d: r.mean for d, r in got.items() if r.mean is not None} == {12: 10.5, 13: 11.0, 14: 11.5}
