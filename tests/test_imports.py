"""Imports in parts, in any order, against one import; commits, leases and runs that break off."""

import datetime as dt
import json
import random

import pytest
from tideline.sources import fit_writer as W
from tideline.sources import ingest, snapshots, store

BASE = 1_080_000_000
DAY = 86_400


def fit_file(serial, start, readings, offset=None, rest=1600):
    """A wellness file: heart rates and counters from a second on, an offset of the clock if there is one."""
    t = lambda s: (W.U32, BASE + start + s)
    clock = [(103, {253: t(0), 0: (W.U32, BASE + start + offset), 5: (W.U16, rest)})] if offset is not None else []
    rows = [(55, {253: t(60 * i), 27: (W.U8, h), 24: (W.BYTE, 6), 3: (W.U32, 10 * (i + 1)), 2: (W.U32, 100 * (i + 1))}) for i, h in enumerate(readings)]
    battery = [(227, {1: t(60 * i), 0: (W.S16, 20 + h % 50), 3: (W.U8, h % 100)}) for i, h in enumerate(readings)]
    return W.write([(0, {0: (W.ENUM, 32), 3: (W.U32Z, serial)}), *clock, *rows, *battery])


def live(start, values):
    return "\n".join(json.dumps({"t": start + 13 * i, "metric": "heart_rate", "value": v}) for i, v in enumerate(values)).encode()


def corpus():
    """name -> bytes. Days in two files, midnights by several clocks, keys told twice, records of one day, sweeps that overlap."""
    metrics, aggregator = "DI_CONNECT/DI-Connect-Metrics/", "DI_CONNECT/DI-Connect-Aggregator/"
    text = lambda x: json.dumps(x).encode()
    unix = 631_065_600 + BASE
    return {
        "a.fit": fit_file(1, 0, [50, 55, 60], offset=3600), "b.fit": fit_file(1, 1800, [90, 100, 0, 70]), "c.fit": fit_file(1, 120, [61, 62]),  # c tells keys of a again
        "d.fit": fit_file(1, 22 * 3600, [80, 81] * 80, offset=7200, rest=1700), "e.fit": fit_file(1, 2 * DAY + 23 * 3600, [40 + i % 30 for i in range(150)]),
        "f.fit": fit_file(1, 3 * DAY, [44, 45], offset=-5 * 3600, rest=1500), "g.fit": fit_file(2, 600, [77, 78, 79]), "h.fit": fit_file(1, 8 * DAY, [66], offset=30 * 60)[:-3],
        metrics + "MetricsMaxMetData_20240320_20240330_1.json": text([{"calendarDate": "2024-03-22", "updateTimestamp": "2024-03-22T05:00:00.0", "vo2MaxValue": 50.0, "sport": "RUNNING"}, {"calendarDate": "2024-03-22", "updateTimestamp": "2024-03-22T09:00:00.0", "vo2MaxValue": 47.5, "sport": "CYCLING"}]),
        metrics + "TrainingReadinessDTO_1.json": text([{"calendarDate": "2024-03-22", "timestamp": "2024-03-22T06:00:00.0", "score": 40, "inputContext": "AFTER_WAKEUP_RESET"}]),
        metrics + "TrainingReadinessDTO_2.json": text([{"calendarDate": "2024-03-22", "timestamp": "2024-03-22T16:00:00.0", "score": 70, "inputContext": "UPDATE"}, {"calendarDate": "2024-03-23", "timestamp": "2024-03-23T16:00:00.0", "score": 71}]),
        metrics + "MetricsAcuteTrainingLoad_1.json": text([{"calendarDate": 1711065600000, "timestamp": 1711100000000 + k, "dailyTrainingLoadAcute": 300 + k, "acwrStatus": "OPTIMAL"} for k in (0, 1)]),
        aggregator + "UDSFile_2024-03-20_2024-03-25.json": text([{"calendarDate": "2024-03-22", "totalSteps": 900, "minHeartRate": 50.0}, {"calendarDate": "2024-03-23", "totalSteps": 901}]),
        "live-1.jsonl": live(unix, [60, 70, 80, 90]), "live-2.jsonl": live(unix + 26, [80, 90, 100]), "live-3.jsonl": live(unix + 50, [30, 31, 0]),
    }


def lay(folder, files, names):
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(files[n])
    return str(folder)


def plain(tables):
    """All rows but the log of drops, values without the last bits of sums."""
    short = lambda v: round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v
    return {n: sorted(str([(c, short(r[c])) for c in sorted(df.columns) if c != "label" or n == "labels"]) for r in df.collect()) for n, df in tables.items() if n not in ("drops", "claims")}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    target = str(root / "store")
    ingest.import_path(spark, lay(root / "in", corpus(), corpus()), target)
    return target, plain(store.current(spark, target))


def test_one_import_has_what_the_files_say(spark, whole):
    tables = store.current(spark, whole[0])
    daily = {(r.metric, r.scope, str(r.day), r.device_id): r.value for r in tables["daily"].collect()}
    assert (daily[("heart_rate_min", "local", "2024-03-22", "1")], daily[("heart_rate_max", "local", "2024-03-22", "1")]) == (50, 100)
    assert daily[("heart_rate_min", "local", "2024-03-22", "2")] == 77 and daily[("training_readiness", "vendor_cloud", "2024-03-22", None)] == 40
    assert (daily[("vo2max", "vendor_cloud", "2024-03-22", None)], daily[("training_load_acute", "vendor_cloud", "2024-03-22", None)]) == (47.5, 301)
    raw = {(r.stream, r.source_key): bytes(r.payload).decode() for r in tables["raw"].where("stream like 'json:%'").collect()}
    assert ("json:vo2max", "2024-03-22|2024-03-22T05:00:00.0") in raw and ("json:training_load", "2024-03-22|1711100000001") in raw
    assert '"vo2MaxValue":50.0' in raw[("json:vo2max", "2024-03-22|2024-03-22T05:00:00.0")]  # numbers as the file has them
    minutes = {r.ts.minute: r.value for r in tables["samples"].where("scope = 'live'").collect()}
    assert minutes == {0: 70, 1: 31}  # of 30 60 70 80 90 100, each once, the lower median
    clash = {(r.ts.minute, r.value) for r in tables["samples"].where("metric = 'heart_rate' and device_id = '1' and scope = 'device' and ts < timestamp'2024-03-22 00:05:00'").collect()}
    assert clash == {(0, 50), (1, 55), (2, 61), (3, 62)}  # the later record has minute 2


@pytest.mark.parametrize("seed", [0, 1])
def test_any_split_and_order_equals_one_import(spark, tmp_path, whole, seed):
    files, rng, target = corpus(), random.Random(seed), str(tmp_path / "store")
    names = [*files]
    rng.shuffle(names)
    cuts = sorted(rng.sample(range(1, len(names)), 2 + seed % 2))
    for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(names)], strict=True)):
        part = names[i:j] + (names[:1] if k else [])  # some come again
        ingest.import_path(spark, lay(tmp_path / f"in{k}", files, part), target)
    got = plain(store.current(spark, target))
    for name, rows in whole[1].items():
        assert got[name] == rows, name
    if seed == 0:
        ingest.reparse_store(spark, target)
        assert {n: r for n, r in plain(store.current(spark, target)).items() if n != "failures"} == {n: r for n, r in got.items() if n != "failures"}


def test_a_day_writes_a_day(spark, tmp_path):
    """What an import writes follows from what it brings, not from what the store holds; data files are shared between commits."""
    target = str(tmp_path / "store")
    year = {f"{d}.fit": fit_file(1, d * DAY, [50 + (d * 7 + i) % 60 for i in range(200)], offset=3600) for d in range(60)}
    ingest.import_path(spark, lay(tmp_path / "in", year, year), target)
    size = lambda run: sum(f.stat().st_size for f in (tmp_path / "store/data").rglob("*.parquet") if run in str(f))
    ingest.import_path(spark, lay(tmp_path / "next", {"x.fit": fit_file(1, 60 * DAY, [70] * 200, offset=3600)}, ["x.fit"]), target)
    first, second = snapshots.commits(spark, target)
    daily = {str(r.day): r.value for r in store.current(spark, target)["daily"].where("metric = 'heart_rate_max'").collect()}
    assert len(daily) == 61 and max(daily) == "2024-05-21"
    rows = lambda run, t: spark.read.parquet(f"{target}/data/{t}/{run}").count()
    assert rows(second.run, "device_samples") == 600 and rows(second.run, "raw_fit") == 1 and rows(second.run, "daily") < 0.1 * rows(first.run, "daily")
    assert size(second.run) < 0.5 * size(first.run) and first.run in second.live["device_samples"]


def test_runs_that_break_off_and_writers_that_meet(spark, tmp_path, monkeypatch, whole):
    files, target = corpus(), str(tmp_path / "store")
    ingest.import_path(spark, lay(tmp_path / "one", files, ["a.fit"]), target)
    before, more = plain(store.current(spark, target)), lay(tmp_path / "two", files, ["b.fit", "live-1.jsonl"])
    write, move = snapshots.Run.write, snapshots.Files.move
    for at in ("raw_json", "device_samples", "daily", "commit"):  # killed at several steps: nothing that readers see has changed

        def killed(self, table, rows, at=at):
            if table == at:
                raise KeyboardInterrupt
            write(self, table, rows)

        def unmoved(self, name, to, at=at):
            if at == "commit" and to.startswith("commits/"):
                raise KeyboardInterrupt
            return move(self, name, to)

        monkeypatch.setattr(snapshots.Run, "write", killed)
        monkeypatch.setattr(snapshots.Files, "move", unmoved)
        with pytest.raises(KeyboardInterrupt):
            ingest.import_path(spark, more, target)
        assert plain(store.current(spark, target)) == before
    monkeypatch.setattr(snapshots.Run, "write", write)
    monkeypatch.setattr(snapshots.Files, "move", move)
    with snapshots.lease(spark, target) as holder:
        with pytest.raises(snapshots.Conflict):
            ingest.import_path(spark, more, target)
        run = snapshots.Run(spark, target, snapshots.latest(snapshots.Files(spark, target)), "feed")
        with pytest.raises(snapshots.Conflict):
            run.commit("someone else")
        run.commit(holder)
    with snapshots.lease(spark, target, seconds=-1):  # ran out: it may be taken over
        ingest.import_path(spark, more, target)
    late = snapshots.Run(spark, target, snapshots.commits(spark, target)[0], "fade")
    with pytest.raises(snapshots.Conflict):
        late.commit()
    ingest.import_path(spark, lay(tmp_path / "rest", files, [n for n in files if n not in ("a.fit", "b.fit", "live-1.jsonl")]), target)
    assert plain(store.current(spark, target)) == whole[1]
    status = [r.status for r in store.runs(spark, target).orderBy("started_at").collect()]
    assert status == ["done", "failed", "failed", "failed", "failed", "done", "done"]
    held = plain(store.current(spark, target))
    assert snapshots.expire(spark, target, keep=1) > 0 and len(snapshots.commits(spark, target)) == 1
    assert plain(store.current(spark, target)) == held


def test_tables_of_many_runs_are_compacted(spark, tmp_path):
    target = str(tmp_path / "store")
    for k in range(4):
        run = snapshots.Run(spark, target, snapshots.latest(snapshots.Files(spark, target)), f"{k:x}")
        run.add("grows", spark.range(k, k + 2))
        run.replace("days", spark.range(10 * k, 10 * k + 3).selectExpr("id", f"cast(id - {9 * k} as int) as {snapshots.DAY}"), range(k, k + 3))
        if k == 3:
            snapshots.compact(run, 2)
        run.commit()
    last = snapshots.latest(snapshots.Files(spark, target))
    assert {len(r) for r in last.live.values()} == {1}
    read = lambda t, days=None: sorted(r.id for r in snapshots.read(spark, target, last, t, days).collect())
    assert read("grows") == [0, 1, 1, 2, 2, 3, 3, 4] and read("days") == [0, 10, 20, 30, 31, 32] and read("days", [1, 4]) == [10, 31]
    snapshots.expire(spark, target, keep=1)
    assert read("days", [1, 4]) == [10, 31]


def test_files_that_arrive_are_imported_once(spark, tmp_path, whole):
    from tideline.streaming import ingestion

    files, folder, target, checkpoint = corpus(), tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    names = sorted(files, reverse=True)
    for k in (0, 1, 2):
        lay(folder, files, names[k::3])
        ingestion.import_arriving(spark, str(folder), target, checkpoint).awaitTermination()
        if k == 1:  # the batch's commit was made, and the checkpoint has not heard of it: it comes again
            held, done = plain(store.current(spark, target)), len(snapshots.commits(spark, target))
            for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):
                f.unlink()
            ingestion.import_arriving(spark, str(folder), target, checkpoint).awaitTermination()
            assert plain(store.current(spark, target)) == held and len(snapshots.commits(spark, target)) == done == 2
    assert plain(store.current(spark, target)) == whole[1]
    assert [r.status for r in store.runs(spark, target).collect()] == ["done"] * 3


def test_a_running_import_can_be_cancelled(spark, tmp_path):
    import threading
    import time

    target, asked, seen = str(tmp_path / "store"), threading.Event(), []

    def slow(run, keep):
        seen.append(run.name)
        run.add("t", spark.range(4).repartition(4).selectExpr("id", "java_method('java.lang.Thread', 'sleep', 60000L + id) as slept"))

    def ask():
        while not seen or not store.progress(spark, seen[0])["running"]:
            time.sleep(0.1)
        asked.set()

    helper, began = threading.Thread(target=ask), time.time()
    helper.start()
    assert ingest.into_store(spark, target, "folder", slow, asked.is_set) is None
    helper.join()
    assert time.time() - began < 50 and store.progress(spark, seen[0])["running"] == 0
    assert [r.status for r in store.runs(spark, target).collect()] == ["cancelled"] and not snapshots.commits(spark, target)
    assert spark.range(3).count() == 3
