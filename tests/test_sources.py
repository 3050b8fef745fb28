"""Decoders, routing, live files, store and functions."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline import contract
from tideline.functions import scalars
from tideline.sources import files, json_records, store
from tideline.streaming import minute_fold


def records(spark, *items):
    return spark.createDataFrame([(i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate(items)], "raw_id long, record string")


def facts(df):
    return {(r.raw_id, r.metric): r.value for r in df.collect()}


def test_daily_spine(spark):
    day = {
        "calendarDate": "2024-01-02", "totalSteps": 10, "restingHeartRate": 0, "minHeartRate": True, "averageSpo2Value": "97", "activeSeconds": 90,
        "allDayStress": {"aggregatorList": [{"type": "TOTAL", "averageStressLevel": 25}, {"type": "AWAKE", "averageStressLevel": 40}]},
        "bodyBattery": {"chargedValue": 5, "bodyBatteryStatList": [{"bodyBatteryStatType": "HIGHEST", "statsValue": 90}, {"bodyBatteryStatType": "LOWEST", "statsValue": 10}]},
    }
    df = json_records.decode(records(spark, day, {"totalSteps": 3}, {**day, "includesWellnessData": False}, "no json"), "json:uds")
    got = facts(df)
    assert got == {(0, m): v for m, v in {"steps": 10, "active_minutes": 1.5, "stress_avg": 25, "body_battery_charged": 5, "body_battery_high": 90, "body_battery_low": 10}.items()}


def test_other_streams(spark):
    assert facts(json_records.decode(records(spark, {"calendarDate": 1704153600000, "overallScore": 7000}), "json:endurance")) == {(0, "endurance_score"): 7000}
    weights = [{"metaData": {"calendarDate": "2024-01-02T10:00:00.0"}, "weight": {"weight": w}} for w in (70500, 70.5)]
    assert facts(json_records.decode(records(spark, *weights), "json:biometrics")) == {(0, "weight_kg"): 70.5, (1, "weight_kg"): 70.5}
    assert json_records.decode(records(spark, {"calendarDate": "2024-01-02"}), "json:hill").count() == 0
    labels = json_records.decode_labels(records(spark, {"calendarDate": "2024-01-02", "sport": "RUNNING", "vo2MaxValue": 50}), "json:vo2max")
    assert [(r.metric, r.label) for r in labels.collect()] == [("vo2max_sport", "running")]


def test_readiness_prefers_the_morning_then_the_latest(spark):
    def r(stamp, score, context="OTHER", day="2024-01-02"):
        return {"calendarDate": day, "timestamp": stamp, "inputContext": context, "score": score}

    rows = records(spark, r("2024-01-02T09", 1), r("2024-01-02T07", 2, json_records.MORNING), r("2024-01-02T07", 2, json_records.MORNING), r("2024-01-03T01", 3, day="2024-01-03"), r("2024-01-03T05", 4, day="2024-01-03"))
    picked = json_records.pick_readiness(rows.select("record"))
    got = {row.date.day: row.value for row in json_records.decode(picked.select(F.lit(0).alias("raw_id"), "record"), "json:readiness").where("metric = 'training_readiness'").collect()}
    assert got == {2: 2, 3: 4}


def test_sleep_and_short_stamps(spark):
    df = json_records.decode_sleep(records(spark, {"calendarDate": "2024-01-02", "deepSleepSeconds": 60, "sleepScores": {"overallScore": 80}}, {"calendarDate": "2024-01-03", "awakeSleepSeconds": 5}))
    assert {r.date.day: r.asleep_s for r in df.collect()} == {2: 60, 3: None}
    rows = spark.createDataFrame([("f", 0, 65530, None), ("f", 1, None, 65535), ("f", 2, None, 3), ("f", 3, None, 65000)], "file string, n int, full_ts long, ts16 long")
    assert [r.ts_s for r in json_records.expand_16bit(rows, "file", "n").orderBy("n").collect()] == [65530, 65535, 65539, 65000]


@pytest.mark.parametrize("name,window", [("UDSFile_2024-01-01_2024-02-01.json", ("2024-01-01", "2024-02-01")), ("x_20240101_20240201_1.json", ("2024-01-01", "2024-02-01")), ("x_20241301_20241401.json", None), ("x_20240201_20240101.json", None), ("plain.json", None), ("x_120240101_20240201.json", None)])
def test_claimed_window(spark, name, window):
    a, b = spark.createDataFrame([(name,)], "n string").select(*files.claimed_window(F.col("n"))).first()
    assert (None if a is None else (a.isoformat(), b.isoformat())) == window


def test_live_files(spark):
    good = '{"t": 1.5, "metric": "heart_rate", "value": 60}\n{"status": "on"}\n\n'
    rows = [("good", good), ("cut", good + '{"t": 2, "me'), ("frame", good + '{"x": 1}'), ("empty", "\n"), ("bool", '{"t": true, "metric": "heart_rate", "value": 1}'), ("only", '{"stop": 1}'), ("broken", "{")]
    got = {r.path: (len(r.readings), r.cut_off) for r in files.live_lines(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"good": (1, False), "cut": (1, True), "only": (0, False)}
    readings = spark.createDataFrame([("heart_rate", 0), ("heart_rate", 60), ("spo2", 101), ("steps", 5)], "metric string, value long")
    kept, drops = files.keep_readings(readings)
    assert kept.count() == 1 and set(drops) >= {"heart_rate_zero", "spo2_off_wrist_or_zero"}


def test_zip_members(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.fit", b"2")
        z.writestr("a.fit", b"1")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("note.txt", b"x")
    df = files.unzip(spark.createDataFrame([("o.zip", bytearray(outer.getvalue()))], "path string, content binary"))
    assert [(r.label, bytes(r.content)) for r in df.orderBy("label").collect()] == [("o.zip/in.zip/a.fit", b"1"), ("o.zip/in.zip/b.fit", b"2")]


def test_store(spark, tmp_path):
    found = spark.createDataFrame([("fit:hrv", "a", "1"), ("fit:sleep", "b", "1"), ("json:uds", "k", "x"), ("json:uds", "k", "y")], "stream string, source_key string, payload string")
    held = spark.createDataFrame([], "stream string, source_key string, payload_hash string")
    new = store.new_raw(found, held)
    assert sorted(r.source_key for r in new.collect()) == ["a", "k"]
    assert store.new_raw(found, new.select("stream", "source_key", "payload_hash")).count() == 0
    store.write_snapshot({"raw": new}, str(tmp_path / "s1"))
    back = store.read_snapshot(spark, str(tmp_path / "s1"), "raw")
    assert store.manifest({"raw": back}).collect() == store.manifest({"raw": new}).collect()
    bad = spark.createDataFrame([(1,)], "raw_id long")
    kept = spark.createDataFrame([(1, "old"), (2, "old")], "raw_id long, v string")
    with pytest.raises(ValueError):
        store.replay(kept, kept.where("raw_id = 2"), bad)
    assert store.replay(kept, kept.where("raw_id = 2"), bad, force=True).count() == 2


def test_functions(spark):
    def one(c, *args):
        return spark.range(1).select(c.alias("x")).first().x

    text = F.lit("a@b.org saw /home/x/file.fit and 12345678, not 12.3456789 or 123456")
    assert one(scalars.redact(text)) == "{email} saw {path} and {id}, not 12.3456789 or 123456"
    assert one(scalars.instant(F.lit("2024-01-01T00:00:00Z"))) == dt.datetime(2024, 1, 1)
    assert one(scalars.instant(F.lit("2024-01-01 00:00:00"))) is None
    values = spark.createDataFrame([(2.675,), (1.005,), (0.125,)], "v double").select(scalars.round_exact(F.col("v"), 2).alias("r"))
    assert [r.r for r in values.collect()] == [2.67, 1.0, 0.12]
    assert [r[0] for r in spark.range(10).select(scalars.confidence(F.col("id"))).collect()] == ["insufficient"] * 3 + ["low"] * 2 + ["medium"] * 3 + ["high"] * 2
    with pytest.raises(ValueError):
        scalars.parse_day("2024-1-1")
    assert scalars.days_before(dt.date(1, 1, 5), 30) == dt.date(1, 1, 1)
    assert scalars.window_days(0, 31) == 1 and scalars.window_days(99, 31) == 31


def test_contract(spark):
    assert (len(contract.SAMPLE_METRICS), len(contract.DAILY_METRICS), len(contract.LABELS)) == (6, 56, 5)
    assert contract.sort_out(["steps", "x", "hrv_status", "steps"]) == (["steps"], ["hrv_status"], ["x"])
    with pytest.raises(ValueError):
        contract.check_scope("cloud")
    assert contract.streams(spark).where("metric = 'vo2max'").count() == 2
    whole = contract.document(spark).first()
    assert {(x.metric, x.scope, s) for x in (*whole.streams, *whole.session_streams) for s in x.streams} == {tuple(r) for r in contract.streams(spark, True).collect()}
    assert len(whole.metrics) == 62 and len(whole.labels) == 5 and set(whole.conventions) >= {"time", "sources", "coverage"} and {x.scope for x in whole.session_streams} == {"live"}
    assert {m.name: m.target for m in whole.metrics if m.target} == contract.TARGETS and whole.scopes == list(contract.SCOPES) and whole.version == contract.VERSION


def test_streaming_fold_equals_the_batch_fold(spark, tmp_path):
    from tideline.operators.aggregates import minute_fold as fold

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i), "hr", float(i % 11), i) for i in range(400)] + [(dt.datetime(2024, 1, 2), "hr", 1.0, 999)]
    spark.createDataFrame(rows, "ts timestamp, metric string, value double, raw_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, metric string, value double, raw_id long").parquet(str(tmp_path / "in"))
    minute_fold.run_available(minute_fold.streaming_minute_fold(stream), "folded", str(tmp_path / "cp"))
    got = {r.minute_us: (r.value, r.n) for r in spark.table("folded").collect()}
    batch = {r.minute_us: (r.value, r.n) for r in fold(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert set(batch) - set(got) == {max(batch)}


def test_small_operators(spark, tmp_path):
    from tideline.operators.localday import local_today

    assert files.looks_like_export(["a/DI_CONNECT/DI-Connect-Metrics/x.json"]) and not files.looks_like_export(["a/b.fit", "DI_CONNECT"])
    live = files.live_lines(spark.createDataFrame([("p", '{"t": 2, "metric": "b", "value": 1}\n{"t": 1.5, "metric": "a", "value": 3}')], "path string, text string"))
    r = files.live_records(live).first()
    assert r.record == '{"readings":[[1.5,"a",3],[2,"b",1]]}' and len(r.source_key) == 64
    assert (r.start_ts, r.end_ts) == (dt.datetime(1970, 1, 1, 0, 0, 1, 500_000), dt.datetime(1970, 1, 1, 0, 0, 2))
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert files.unseen(names, names.where("name = 'a'")).count() == 1
    old = spark.createDataFrame([(1,)], "raw_id long")
    assert store.upgrade(old, "raw_id long, note string").first().note is None
    with pytest.raises(ValueError):
        store.upgrade(old.withColumn("x", F.lit(1)), "raw_id long")
    store.write_snapshot({"t": old}, str(tmp_path / "a"))
    store.restore(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["t"])
    assert store.verify(spark, str(tmp_path / "b"), store.manifest({"t": old})).isEmpty()
    assert not store.verify(spark, str(tmp_path / "b"), store.manifest({"t": old.union(old)})).isEmpty()
    assert store.as_json(spark.createDataFrame([(1, None, "id")], "a int, b int, serial string"), "serial").first().json == '{"a":1}'
    assert spark.range(1).select(scalars.scrub(F.lit("Ab and aB"), ["ab"])).first()[0] == "{name} and {name}"
    offsets = spark.createDataFrame([(dt.datetime(2024, 1, 1), 10 * 3600, 1)], "ts timestamp, offset_s int, raw_id long")
    assert local_today(offsets, dt.datetime(2024, 1, 1, 20)).first().today == dt.date(2024, 1, 2)


def test_sleep_keeps_every_field(spark):
    scores = {f: 50 + i for i, f in enumerate(json_records.SLEEP_SCORES.values())}
    night = {
        "calendarDate": "2024-01-02", "sleepStartTimestampGMT": "2024-01-01T22:10:00.0", "sleepEndTimestampGMT": "2024-01-02T06:00:30.0", "awakeCount": 2, "avgSleepStress": 14.5, "averageRespiration": 13.5,
        "lowestRespiration": 9.0, "highestRespiration": 18.0, "retro": True, "sleepScores": scores, "spo2SleepSummary": {"averageSPO2": 94.5, "lowestSPO2": 88, "averageHR": 51.5},
    }
    full, bare = json_records.decode_sleep(records(spark, night, {"calendarDate": "2024-01-03"})).orderBy("date").collect()
    assert [full[c] for c in json_records.SLEEP_SCORES] == list(scores.values())
    assert (full.start_ts.isoformat(), full.end_ts.isoformat()) == ("2024-01-01T22:10:00", "2024-01-02T06:00:30")
    assert (full.awakenings_count, full.avg_stress, full.avg_respiration, full.lowest_respiration, full.highest_respiration) == (2, 14.5, 13.5, 9.0, 18.0)
    assert (full.avg_spo2, full.lowest_spo2, full.avg_hr, full.retro) == (94.5, 88, 51.5, True)
    assert not bare.retro and all(v is None for c, v in bare.asDict().items() if c not in ("date", "retro"))


def test_redaction_cases(spark):
    cases = {
        "OSError: /home/someone/files/X.FIT unreadable": "OSError: {path} unreadable", "bad file 'C:\\\\Users\\\\me\\\\a.fit' here".replace("\\\\", "\\"): "bad file '{path}' here", "some.one@mail.org_123456789.fit failed": "{email}_{id}.fit failed",
        "serial 3489012345 rejected": "serial {id} rejected", "12.3456789 and .1234567 and 1234567.5": "12.3456789 and .1234567 and 1234567.5", "1234567 7654321 1111111": "{id} {id} {id}", "ends 1234567.": "ends {id}.",
        "a@b.co@c.de x@y.z1 k@m.co1 @b.co a@.co a@..co u.v@w.x-y.info.": "{email}@c.de x@y.z1 {email}1 @b.co a@.co {email} {email}.", r"C:\\a 1:\b D:\a\\c E:\xF:\y z:\(q)": r"{path}\a 1:\b {path}\c {path} {path}(q)",
        "1234567.x 123456": "{id}.x 123456", "(/a/b) '/c/d' x/y/z /lone": "({path}) '{path}' x/y/z /lone",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want string")
    for r in df.select("text", "want", scalars.redact(F.col("text")).alias("got")).collect():
        assert r.got == r.want, r.text
    masked = spark.range(1).select(scalars.mask_label(F.lit("me@x.org_12.3456789.fit"))).first()[0]
    assert masked == "{email}_12.{id}.fit"


def export_folder(root):
    """A small export: two JSON families, a broken one, an unknown one, an archive of uploads, and a live file beside it."""
    import io
    import json
    import zipfile

    from tideline.sources import fit_writer as W

    base = 1_080_000_000

    def watch(day, serial, hr):
        t = lambda s: (W.U32, base + 86_400 * day + s)
        rows = [(55, {253: t(60 * i), 27: (W.U8, h), 24: (W.BYTE, 6), 3: (W.U32, 100 * (i + 1)), 2: (W.U32, 1000 * (i + 1))}) for i, h in enumerate(hr)]
        return W.write([(0, {0: (W.ENUM, 32), 3: (W.U32Z, serial)}), (103, {253: t(0), 0: (W.U32, base + 86_400 * day + 3600), 5: (W.U16, 1600 + day)}), *rows])

    def zipped(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name.replace("__", "."), data)
        return out.getvalue()

    for d in ("DI-Connect-Aggregator", "DI-Connect-Metrics", "DI-Connect-Uploaded-Files", "DI-Connect-Other"):
        (root / "DI_CONNECT" / d).mkdir(parents=True)
    at = root / "DI_CONNECT"
    (at / "DI-Connect-Aggregator" / "UDSFile_2024-03-20_2024-06-30.json").write_text(json.dumps([{"calendarDate": "2024-03-22", "totalSteps": 900, "minHeartRate": 50}, {"calendarDate": None}, 7]))
    (at / "DI-Connect-Metrics" / "EnduranceScore_20240320_20240330_1.json").write_text("[{broken")
    (at / "DI-Connect-Metrics" / "HillScore_20240320_20240330_1.json").write_text(json.dumps([{"calendarDate": "2024-03-22", "overallScore": 3}]))
    (at / "DI-Connect-Other" / "notes.json").write_text("{}")
    good = watch(0, 7, [60, 0, 80])
    (at / "DI-Connect-Uploaded-Files" / "u.zip").write_bytes(zipped(a__fit=good, b__fit=good, c__fit=watch(1, 7, [70]) [:-4], in__zip=zipped(d__fit=watch(2, 7, [90, 91]))))
    (root / "live-1.jsonl").write_text('{"t": 1711065600, "metric": "heart_rate", "value": 61}\n{"t": 1711065601, "metric": "heart_rate", "value": 0}\n{"status": "x"}\n{"t": 17')


def test_import_of_an_export(spark, tmp_path):
    from tideline.sources import ingest

    root, target = tmp_path / "export", str(tmp_path / "store")
    export_folder(root)
    stats = {r.stream: (r.records, r.failures) for r in ingest.import_path(spark, str(root), target).collect()}
    assert stats == {"fit:monitoring_b": (2, 0), "fit:undecodable": (0, 1), "json:uds": (1, 0), "json:endurance": (0, 1), "json:hill": (1, 0), "json:live": (1, 0)}
    tables = store.current(spark, target)
    plain = lambda df: sorted(str(r.asDict()) for r in df.select(*sorted(df.columns)).collect())
    first = {n: plain(df) for n, df in tables.items()}
    daily = {(r.metric, r.scope, str(r.day)): r.value for r in tables["daily"].collect()}
    assert daily[("steps", "vendor_cloud", "2024-03-22")] == 900 and daily[("heart_rate_min", "vendor_cloud", "2024-03-22")] == 50
    assert daily[("resting_metabolic_rate", "device", "2024-03-22")] == 1600 and daily[("resting_metabolic_rate", "device", "2024-03-24")] == 1602
    assert (daily[("heart_rate_min", "local", "2024-03-22")], daily[("heart_rate_max", "local", "2024-03-22")]) == (60, 80)
    assert (daily[("steps", "local", "2024-03-22")], daily[("distance", "local", "2024-03-22")]) == (300, 30)
    assert {(r.scope, r.value) for r in tables["samples"].where("metric = 'heart_rate'").collect()} == {("device", v) for v in (60, 80, 90, 91)} | {("live", 61)}
    assert {r.reason: r.n for r in tables["drops"].collect()} == {"heart_rate_zero": 1, "live_heart_rate_zero": 1, "live_file_cut_off": 1}
    claims = {(r.stream, str(r.from_day)): str(r.to_day) for r in tables["claims"].collect()}
    assert claims[("json:endurance", "2024-03-20")] == "2024-03-30"
    broken = tables["failures"].where("stream = 'json:endurance'").first()
    assert str(broken.start_ts) == "2024-03-20 12:00:00" and broken.label == "EnduranceScore_{id}_{id}_1.json"
    again = ingest.import_path(spark, str(root), target)  # all of it is held
    assert sum(r.records for r in again.collect()) == 0
    tables = store.current(spark, target)
    assert all(plain(df) == first[n] for n, df in tables.items() if n != "drops")
    assert [(r.transport, r.status) for r in store.runs(spark, target).collect()] == [("export", "done")] * 2
    assert store.corrupt(tables["raw"]).isEmpty()  # the bytes come back as they were
    ingest.reparse_store(spark, target)
    again = store.current(spark, target)
    for name in ("samples", "daily", "labels", "intervals", "sleep", "offsets"):
        assert plain(again[name]) == plain(tables[name].select(*again[name].columns)), name
    bad = tables["raw"].withColumn("payload", F.when(F.col("stream").startswith("fit:"), F.lit(b"broken")).otherwise(F.col("payload")))
    with pytest.raises(ValueError):
        ingest.reparse(bad)
    kept = ingest.reparse(bad, tables, force=True)
    assert kept["samples"].where("scope = 'device'").count() == tables["samples"].where("scope = 'device'").count()


def test_a_cancelled_run_leaves_the_store(spark, tmp_path):
    from tideline.sources import ingest

    root, target = tmp_path / "export", str(tmp_path / "store")
    export_folder(root)
    ingest.import_path(spark, str(root), target, cancelled=lambda: True)
    assert store.current(spark, target) == {}
    assert [r.status for r in store.runs(spark, target).collect()] == ["cancelled"]
    store.begin_run(spark, target, "folder")  # it breaks off
    store.heal(spark, target)
    assert sorted(r.status for r in store.runs(spark, target).collect()) == ["cancelled", "interrupted"]
    assert store.checksums(spark, target).count() >= 3


def test_archive_of_an_export_and_its_own_days(spark, tmp_path):
    import zipfile

    export_folder(tmp_path / "export")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for f in sorted((tmp_path / "export").rglob("*")):
            if f.is_file():
                z.write(f, f.relative_to(tmp_path / "export"))
    (tmp_path / "only").mkdir()
    (tmp_path / "all.zip").rename(tmp_path / "only" / "all.zip")
    found = files.listing(spark, str(tmp_path / "only"))
    assert files.looks_like_export([r.path for r in found.collect()])
    assert found.count() == 6 and found.where("written_day is null").count() == 0


def test_late_rows_replace_their_days_alone(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = lambda n: dt.date(2024, 1, n)
    minute_fold.overwrite_days(path, "day")(spark.createDataFrame([(day(1), 1), (day(2), 2)], "day date, v int"))
    minute_fold.overwrite_days(path, "day")(spark.createDataFrame([(day(2), 5)], "day date, v int"))
    assert sorted((r.day, r.v) for r in spark.read.parquet(path).collect()) == [(day(1), 1), (day(2), 5)]
