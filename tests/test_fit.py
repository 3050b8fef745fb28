"""The FIT reader on files written here byte by byte."""

import datetime as dt
import random
import struct

from tideline.sources import fit

T = 1_080_000_000


def written(*messages, compressed=()):
    """messages: (number, [(field, base type, value)]); little-endian, one definition each."""
    body = b""
    for k, (number, fields) in enumerate(messages):
        body += struct.pack("<BBBHB", 0x40, 0, 0, number, len(fields)) + b"".join(bytes([f, fit.BASE[b][0], b]) for f, b, _ in fields)
        body += (bytes([0x80 | compressed[k]]) if k < len(compressed) and compressed[k] is not None else b"\0") + b"".join(struct.pack("<" + fit.BASE[b][1], v) for _, b, v in fields)
    return struct.pack("<BBHI4sH", 14, 32, 100, len(body), b".FIT", 0) + body + b"\0\0"


def rows(spark, *files):
    df = spark.createDataFrame([(f"f{i}", bytearray(x)) for i, x in enumerate(files)], "path string, content binary")
    return fit.timed(fit.messages(df)).cache()


def at(s):
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=T + s + fit.FIT_EPOCH)


def stamp(s=0):
    return (fit.TIMESTAMP, 0x86, T + s)


def test_samples_sentinels_and_short_stamps(spark):
    data = written(
        (0, [(0, 0x00, 32), (3, 0x8C, 77)]), (103, [stamp(), (0, 0x86, T + 3600), (5, 0x84, 1700)]), (55, [stamp(1), (27, 0x02, 60)]), (55, [(26, 0x84, (T + 61) & 0xFFFF), (27, 0x02, 0)]),
        (55, [(26, 0x84, (T + 62) & 0xFFFF), (27, 0x02, 61)]), (227, [(1, 0x86, T + 70), (0, 0x83, -1), (3, 0x01, 55)]), (297, [stamp(80), (0, 0x83, 1450)]), (269, [stamp(81), (0, 0x02, 97), (2, 0x00, 0)]), (371, [stamp(82), (0, 0x84, 6400)]),
    )
    r = rows(spark, data)
    got = {(x.metric, x.ts): x.value for x in fit.samples(r).collect()}
    assert got == {("heart_rate", at(1)): 60, ("heart_rate", at(62)): 61, ("energy_reserve", at(70)): 55, ("respiration_rate", at(80)): 14.5, ("hrv_rmssd", at(82)): 50}
    assert {x.reason: x.n for x in fit.drops(r).collect()} == {"heart_rate_zero": 1, "stress_sentinel": 1, "spo2_off_wrist_or_zero": 1}
    assert [(x.metric, x.value) for x in fit.dailies(r).collect()] == [("resting_metabolic_rate", 1700)]
    assert [(x.ts, x.offset_s) for x in fit.clock_offsets(r).collect()] == [(at(0), 3600)]
    who = fit.identities(r).first()
    assert (who.stream, who.device_id, who.start_ts, who.end_ts) == ("fit:monitoring_b", "77", at(1), at(70))  # clock messages and plain vitals do not count


def test_sleep_counters_and_activity(spark):
    stages = [(275, [stamp(s), (0, 0x00, level)]) for s, level in ((600, 2), (1200, 3), (1200, 1), (1800, 4))]
    start, stop = ((21, [stamp(t), (0, 0x00, 74), (1, 0x00, k)]) for t, k in ((0, 0), (1900, 1)))
    r = rows(spark, written((0, [(0, 0x00, 49)]), start, *stages, stop), written((275, [stamp(5), (0, 0x00, 2)])), written((0, [(0, 0x00, 32)]), start, (275, [stamp(9), (0, 0x00, 2)]), stop))
    assert {x.path: (x.start_ts, x.end_ts) for x in fit.identities(r).collect()} == {"f0": (at(600), at(1900)), "f1": (at(5), at(5)), "f2": (at(9), at(9))}
    night = fit.sleep_sessions(r).orderBy("path").collect()
    assert [(x.path, x.start_ts, x.end_ts, x.light_s, x.deep_s) for x in night] == [("f0", at(0), at(1900), 600, 0), ("f1", None, None, None, None), ("f2", None, None, None, None)]
    assert {x.reason: x.n for x in fit.drops(r).collect()} == {"sleep_stage_without_start": 2, "sleep_stage_zero_length": 1}
    assert [(x.stage, x.start_ts, x.end_ts) for x in fit.sleep_stages(r).orderBy("end_ts").collect()] == [("light", at(0), at(600)), ("awake", at(600), at(1200)), ("rem", at(1200), at(1800))]
    r = rows(spark, written((55, [stamp(), (5, 0x00, 6), (3, 0x86, 100)]), (55, [stamp(), (5, 0x00, 2), (3, 0x86, 100)]), (18, [stamp(60), (2, 0x86, T), (5, 0x00, 1), (9, 0x86, 12345)])))
    assert {x.activity_type: (x.steps, x.cycles) for x in fit.intervals(r).collect()} == {6: (100, 100.0), 2: (None, 50.0)}
    a = fit.activities(r).first()
    assert (a.start_ts, a.end_ts, a.distance_m) == (at(0), at(60), 123.45)


def test_compressed_stamps(spark):
    data = written((55, [stamp(), (27, 0x02, 60)]), (371, [(0, 0x84, 128)]), (371, [(0, 0x84, 256)]), compressed=(None, (T + 3) & 31, (T + 34) & 31))
    assert [x.ts for x in fit.samples(rows(spark, data)).where("metric = 'hrv_rmssd'").orderBy("ts").collect()] == [at(3), at(34)]


def test_broken_bytes_give_what_came_before(spark):
    good = written((0, [(0, 0x00, 32)]), (55, [stamp(1), (27, 0x02, 60)]))
    rng = random.Random(0)
    noise = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    r = rows(spark, good[:-3], good, b"", good.replace(b".FIT", b".XIT"), *noise, *(good[:14] + x for x in noise))
    bad = {x.path for x in fit.last_known(fit.messages(r.sparkSession.createDataFrame([("f", bytearray(good[:-3]))], "path string, content binary"))).collect()}
    assert bad == {"f"}
    assert fit.samples(r).where("path = 'f1'").count() == 1


def test_sleep_assessment_and_sport_of_vo2max(spark):
    scores = [(k, 0x02, 60 + k) for k in fit.SCORES]
    met = [(229, [(0, 0x86, T + i), (2, 0x84, v), *([(5, 0x00, sport)] if sport is not None else [])]) for i, (v, sport) in enumerate([(453, 1), (0, 2), (400, 99), (400, None)])]
    r = rows(spark, written((346, [(6, 0x02, 1)]), (346, [*scores, (15, 0x84, 1234)])), written((346, [(6, 0x02, 81), (7, 0x02, 0xFF)]), *met))
    full, few = fit.sleep_assessments(r).orderBy("path").collect()
    assert {c: full[c] for c in fit.SCORES.values()} == {c: 60 + k for k, c in fit.SCORES.items()} and full.avg_stress == 12.34
    assert few.overall_score == 81 and few.quality_score is None and few.avg_stress is None
    assert [(x.metric, x.ts, x.label) for x in fit.labels(r).orderBy("ts").collect()] == [("vo2max_sport", at(0), "running"), ("vo2max_sport", at(2), "99")]


def test_composite_type_and_intensity(spark):
    r = rows(spark, written((55, [stamp(), (24, 0x0D, 3 << 5 | 6), (3, 0x86, 100)]), (55, [stamp(1), (24, 0x0D, 1 << 5 | 2), (5, 0x00, 1), (28, 0x02, 4), (3, 0x86, 7)]), (55, [stamp(2), (24, 0x0D, 8)])))
    assert [(x.activity_type, x.intensity, x.steps) for x in fit.intervals(r).orderBy("ts").collect()] == [(6, 3, 100), (1, 4, 7)]


def test_untimed_and_far_messages_are_counted(spark):
    r = rows(spark, written((55, [(26, 0x84, 5), (27, 0x02, 60)]), (55, [stamp(), (27, 0x02, 61)]), (55, [(26, 0x84, (T + 5000) & 0xFFFF), (27, 0x02, 62)])))
    assert {x.reason: x.n for x in fit.drops(r).collect()} == {"monitoring_without_timestamp": 1, "timestamp_16_far_from_reference": 1}
    assert fit.samples(r).count() == 2


def test_files_written_are_files_read(spark):
    from tideline.sources import fit_writer as W

    many = [(55, {253: (W.U32, T + i), 27: (W.U8, 60 + i), **({28: (W.U8, 1)} if i % 2 else {})} | {k: (W.U32, 1) for k in range(100, 100 + i)}) for i in range(40)]  # more definitions than there are places
    r = rows(spark, W.write(many))
    assert fit.samples(r).count() == 40 and fit.identities(r).first().error is None
    assert W.checksum(b"123456789") == 0xBB3D  # the check value of this CRC


def test_unwanted_messages_are_stepped_over(spark):
    """What the decoders make of a file does not depend on what they leave unread, and time stamps of left-out messages still count."""
    from tideline import adapters

    data = adapters.fit_fixture(3, list(range(40)))
    every, some = list(fit.parse(data)), list(fit.parse(data, {55: {27, 26}}))
    assert [(m, c) for m, c, _ in some] == [(m, c) for m, c, _ in every if m == 55]
    assert all(set(f) <= {27, 26, 253} for _, _, f in some) and [f.get(27) for _, _, f in some] == [f.get(27) for m, _, f in every if m == 55]
    df = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    whole, less = (fit.timed(fit.messages(df, w)) for w in (None, fit.wanted_fields()))
    for make in (fit.samples, fit.dailies, fit.labels, fit.clock_offsets, fit.intervals, fit.sleep_stages, fit.sleep_sessions, fit.activities, fit.identities, fit.drops):
        assert sorted(map(str, make(less).collect())) == sorted(map(str, make(whole).collect())), make.__name__


def test_short_stamps_follow_the_clocks_of_messages_left_out(spark):
    """Message 500 is no decoder's, but a 16-bit stamp behind it is completed from its time, also where 65 536 seconds have passed since the last one read."""
    short = [(55, [(26, 0x84, (T + s) & 0xFFFF), (27, 0x02, 60 + k)]) for k, s in enumerate((5, 40_005, 140_005))]
    data = written((55, [stamp(), (27, 0x02, 59)]), short[0], (500, [stamp(40_000)]), short[1], (500, [stamp(140_000)]), short[2])
    df = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    for wanted in (None, fit.wanted_fields(), fit.wanted_fields("samples")):
        assert [(r.ts, r.value) for r in fit.samples(fit.timed(fit.messages(df, wanted))).orderBy("ts").collect()] == [(at(0), 59), (at(5), 60), (at(40_005), 61), (at(140_005), 62)]


def test_each_decoder_reads_what_it_needs(spark):
    from tideline import adapters

    files = [(str(u), bytearray(adapters.fit_fixture(u, list(range(u, u + 20))))) for u in (1, 8, 90_001)]
    df = spark.createDataFrame(files, "path string, content binary")
    whole = fit.timed(fit.messages(df))
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()  # rows are not dealt out again for their time
    makes = [(fit.samples, "samples"), (fit.dailies, "dailies"), (fit.labels, "labels"), (fit.clock_offsets, "clock_offsets"), (fit.intervals, "intervals"), (fit.sleep_stages, "stages"), (fit.activities, "activities")]
    makes += [(fit.identities, "identities"), (fit.sleep_sessions, "stages", "sleep_assessments"), (fit.drops, "samples", "clock_offsets", "stages", "untimed")]
    for make, *names in makes:
        less = fit.timed(fit.messages(df, fit.wanted_fields(*names)))
        assert sorted(map(str, make(less).collect())) == sorted(map(str, make(whole).collect())), make.__name__
