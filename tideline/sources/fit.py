"""FIT files: a minimal parser in Arrow workers, and all rules as DataFrame expressions.

``messages`` turns file bytes into one row a data message with its numeric fields by number; bytes that break give what was
read before and an error row. Everything behind that (scales, sentinels, time stamps, offsets, sleep stages) is columns.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.series import sleep_detail, stage_rows, with_begin
from .json_records import completed_16bit

FIT_EPOCH = 631_065_600
REAL_TIME = 0x10000000  # smaller time stamps count from power-on
OFFSET_LIMIT_S = 26 * 3600
TIMESTAMP = 253
ERROR = -1

# Base types (size, struct code, invalid value) of the protocol.
BASE = {
    0x00: (1, "B", 0xFF), 0x01: (1, "b", 0x7F), 0x02: (1, "B", 0xFF), 0x83: (2, "h", 0x7FFF), 0x84: (2, "H", 0xFFFF), 0x85: (4, "i", 0x7FFFFFFF), 0x86: (4, "I", 0xFFFFFFFF),
    0x88: (4, "f", None), 0x89: (8, "d", None), 0x0A: (1, "B", 0), 0x8B: (2, "H", 0), 0x8C: (4, "I", 0), 0x0D: (1, "B", 0xFF), 0x8E: (8, "q", 0x7FFFFFFFFFFFFFFF),
    0x8F: (8, "Q", 0xFFFFFFFFFFFFFFFF), 0x90: (8, "Q", 0),
}
# Message and field numbers, metric, divisor and condition on the value v (f: the message's fields).
SAMPLES = (
    (55, 27, "heart_rate", 1, "v > 0", "heart_rate_zero"), (227, 0, "stress", 1, "v >= 0", "stress_sentinel"), (227, 3, "energy_reserve", 1, "v BETWEEN 0 AND 100", None),
    (297, 0, "respiration_rate", 100, "v >= 0", "respiration_sentinel"), (269, 0, "spo2", 1, "v > 0 AND coalesce(fields[2], -1) <> 0", "spo2_off_wrist_or_zero"), (371, 0, "hrv_rmssd", 128, "true", None),
)
DAILIES = (
    (103, 5, "resting_metabolic_rate", 1, "v > 0"), (211, 0, "resting_heart_rate", 1, "v > 0"), (211, 1, "resting_heart_rate_current_day", 1, "v > 0"), (370, 0, "hrv_weekly_average", 128, "true"),
    (370, 1, "hrv_last_night_average", 128, "true"), (370, 2, "hrv_last_night_5min_high", 128, "true"), (370, 3, "hrv_baseline_low_upper", 128, "true"), (370, 4, "hrv_baseline_balanced_lower", 128, "true"),
    (370, 5, "hrv_baseline_balanced_upper", 128, "true"), (398, 4, "skin_temp_nightly", 1, "true"), (398, 1, "skin_temp_deviation", 1, "true"), (398, 2, "skin_temp_7day_deviation", 1, "true"), (229, 2, "vo2max", 10, "v > 0"),
)
LOCAL_FIELD = {103: 0, 398: 0, 162: 3}
OWN_TIME = {227: 1, 229: 0, 18: 2, 0: 4}
SHORT_TIME = (55, 26)
FAR_S = 3600
FILE_STREAMS = {32: "fit:monitoring_b", 49: "fit:sleep", 68: "fit:hrv", 73: "fit:skin_temp", 44: "fit:metrics", 4: "fit:activity"}
HRV_STATUS = ("none", "poor", "low", "unbalanced", "balanced")
# The protocol's fields of sleep_assessment and its sports; a sport without a name keeps its number.
ASSESSMENT, MAX_MET = 346, 229
SCORES = {
    6: "overall_score", 7: "quality_score", 4: "duration_score", 8: "recovery_score", 3: "deep_score", 9: "rem_score", 5: "light_score", 1: "awake_time_score",
    2: "awakenings_count_score", 0: "combined_awake_score", 10: "restlessness_score", 14: "interruptions_score", 11: "awakenings_count",
}
STRESS = 15
SPORTS = (
    "generic running cycling transition fitness_equipment swimming basketball soccer tennis american_football training walking cross_country_skiing alpine_skiing snowboarding rowing mountaineering hiking "
    "multisport paddling flying e_biking motorcycling boating driving golf hang_gliding horseback_riding hunting fishing inline_skating rock_climbing sailing ice_skating sky_diving snowshoeing snowmobiling "
    "stand_up_paddleboarding surfing wakeboarding water_skiing kayaking rafting windsurfing kitesurfing tactical jumpmaster boxing floor_climbing baseball"
).split()
STAGES = ("unmeasurable", "awake", "light", "deep", "rem")
STEP_TYPES = (6, 1)
SLEEP_EVENT, SLEEP_FILE = 74, 49
#: Messages whose time counts for a file's span.
TOUCHING = """message IN (0, 18, 55, 370, 398) OR (message = 275 AND fields[0] IS NOT NULL) OR (message = 229 AND fields[2] > 0)
OR (message = 227 AND (fields[3] BETWEEN 0 AND 100 OR fields[0] >= 0))"""


def _by_message(*tables) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for message, field, *_ in itertools.chain(*tables):
        out.setdefault(message, set()).add(field)
    return out


#: The messages that each decoder reads, and their fields beside time stamps.
READ = {
    "identities": {0: {0, 3}, 18: set(), 21: {0, 1}, 55: set(), 227: {0, 3}, 229: {2}, 275: {0}, 370: set(), 398: set()}, "samples": _by_message(SAMPLES, [(269, 2)]), "dailies": _by_message(DAILIES),
    "labels": {370: {6}, MAX_MET: {2, 5}}, "clock_offsets": _by_message(LOCAL_FIELD.items()), "intervals": {55: {2, 3, 4, 5, 19, 24, 28}}, "stages": {0: {0}, 21: {0, 1}, 275: {0}},
    "sleep_assessments": {ASSESSMENT: {*SCORES, STRESS}}, "activities": {18: {5, 6, 7, 8, 9, 11, 14, 16, 17, 22, 23, 124}}, "untimed": {55: set()},
}
#: Every message, without its fields.
COUNTED = dict.fromkeys(range(1 << 16), frozenset())


def wanted_fields(*decoders: str) -> dict[int, set[int]]:
    """The fields that these decoders read, or all of them, by message; time stamps are read of all."""
    out: dict[int, set[int]] = {}
    for name in decoders or READ:
        for message, fields in READ[name].items():
            out.setdefault(message, set()).update(fields)
    for message, field in (*OWN_TIME.items(), SHORT_TIME):
        if message in out:
            out[message].add(field)
    return out


def parse(data: bytes, wanted: dict[int, set[int]] | None = None) -> Iterator[tuple[int, int | None, dict[int, float]]]:
    """(message number, full time stamp in force, numeric fields) of each data message; developer fields are skipped.

    With ``wanted`` (message -> fields) other messages are stepped over, but for their time stamps, and other fields are not read.
    """
    if len(data) < 12 or data[8:12] != b".FIT":
        raise ValueError("no FIT header")
    p, end = data[0], data[0] + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ValueError("the file is cut off")
    kinds: dict[int, tuple[int, struct.Struct, list[tuple[int, float | None]], int]] = {}  # message, its layout, (field, invalid value) of each
    clock: int | None = None
    while p < end:
        head = data[p]
        p += 1
        if head & 0x80:
            local, offset = head >> 5 & 3, head & 31
        else:
            local, offset = head & 15, None
        if head & 0xC0 == 0x40:
            order = ">" if data[p + 1] else "<"
            number, many = struct.unpack_from(order + "H", data, p + 2)[0], data[p + 4]
            fields = [tuple(data[p + 5 + 3 * k : p + 8 + 3 * k]) for k in range(many)]
            p += 5 + 3 * many
            extra = 0
            if head & 0x20:
                extra = sum(data[p + 2 + 3 * k] for k in range(data[p]))
                p += 1 + 3 * data[p]
            layout, read = order, []
            for name, size, base in fields:
                width, code, invalid = BASE.get(base, (0, "", None))
                if width and size == width and (wanted is None or name == TIMESTAMP or name in wanted.get(number, ())):
                    layout += code
                    read.append((name, invalid))
                else:  # arrays and texts are not read
                    layout += f"{size}x"
            kinds[local] = (number, struct.Struct(layout), read, extra)
            continue
        if local not in kinds:
            raise ValueError("a message without a definition")
        number, layout, read, extra = kinds[local]
        if p + layout.size + extra > end:
            raise ValueError("a message is cut off")
        values = {name: float(v) for (name, invalid), v in zip(read, layout.unpack_from(data, p), strict=True) if v != invalid and v == v}
        p += layout.size + extra
        if values.get(TIMESTAMP, 0) >= REAL_TIME:
            clock = int(values[TIMESTAMP])
        elif offset is not None and clock is not None:
            clock += (offset - clock) & 31
            values.setdefault(TIMESTAMP, clock)
        if wanted is None or number in wanted:
            yield number, clock, values


def messages(files: DataFrame, wanted: dict[int, set[int]] | None = None) -> DataFrame:
    """files: path, content. path, n, message, clock (the full time stamp in force), fields (map of number to value), error; an error is a row of message ERROR.

    wanted: the messages and fields to read, all if there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):  # a file's messages are a batch
                found, error = [], None
                try:
                    found.extend((number, clock, list(fields.items())) for number, clock, fields in parse(content, wanted))
                except Exception as e:  # noqa: BLE001 - hostile bytes break in any way; the error is a row
                    error = f"{type(e).__name__}: {e}"
                    found.append((ERROR, None, []))
                many = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * many, pa.string()), pa.array(range(many), pa.int64()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.map_(pa.int32(), pa.float64())), pa.array([None] * (many - 1) + [error] if many else [], pa.string()),
                    ],
                    ["path", "n", "message", "clock", "fields", "error"],
                )

    return files.select("path", "content").mapInArrow(run, "path string, n long, message int, clock long, fields map<int,double>, error string")


def instant(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.cast("long") + FIT_EPOCH)


def timed(rows: DataFrame) -> DataFrame:
    """Adds ts: the message's own time, its time stamp, or its 16-bit stamp completed from the clock, far_s seconds away."""
    own = F.coalesce(*(F.when(F.col("message") == m, F.col("fields")[f]) for m, f in OWN_TIME.items()))
    full = F.col("fields")[TIMESTAMP]
    short = F.when((F.col("message") == SHORT_TIME[0]) & full.isNull(), F.col("fields")[SHORT_TIME[1]].cast("long"))
    seconds = F.when(short.isNotNull(), completed_16bit(short, F.col("clock"))).when(full >= REAL_TIME, full.cast("long"))
    rows = rows.withColumn("ts_s", seconds).withColumn("far_s", F.col("ts_s") - F.col("clock"))
    return rows.withColumn("ts", instant(F.when(F.col("message").isin(*OWN_TIME), own).otherwise(F.col("ts_s")))).drop("ts_s", "clock")


def identities(rows: DataFrame) -> DataFrame:
    """path, stream, device_id by file_id, and the span of what the file tells: of the messages that count, and to the sleep's stop event."""
    name = F.coalesce(*(F.when(F.col("kind") == k, F.lit(s)) for k, s in FILE_STREAMS.items()), F.concat(F.lit("fit:"), F.col("kind").cast("int").cast("string")))
    touched = F.when(F.expr(TOUCHING), F.col("ts"))
    out = rows.groupBy("path").agg(
        _kind().alias("kind"), F.max(F.when(F.col("message") == 0, F.col("fields")[3].cast("long").cast("string"))).alias("device_id"),
        F.min(touched).alias("start_ts"), F.max(touched).alias("end_ts"), F.max_by(F.when(_sleep_event(1), F.col("ts")), F.when(_sleep_event(1), F.col("n"))).alias("stop_ts"), F.max("error").alias("error"),
    )
    end = F.when((F.col("kind") == SLEEP_FILE), F.greatest("end_ts", "stop_ts")).otherwise(F.col("end_ts"))
    return out.select("path", name.alias("stream"), "device_id", "start_ts", end.alias("end_ts"), "error")


def _kind() -> Column:
    return F.max(F.when(F.col("message") == 0, F.col("fields")[0]))


def _sleep_event(kind: int) -> Column:
    """Start (0) or stop (1) of sleep; it counts in sleep files alone."""
    return (F.col("message") == 21) & (F.col("fields")[0] == SLEEP_EVENT) & (F.col("fields")[1] == kind)


def _long(rows: DataFrame, table, conditions: bool = True) -> DataFrame:
    facts = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(metric).alias("metric"), F.col("fields")[f].alias("raw"), F.lit(float(d)).alias("divisor")) for m, f, metric, d, *_ in table))
    out = rows.withColumn("x", F.explode(F.filter(facts, lambda x: (x.m == F.col("message")) & x.raw.isNotNull())))
    out = out.select("path", "n", "ts", "fields", F.col("x.metric").alias("metric"), (F.col("x.raw") / F.col("x.divisor")).alias("v")).where("ts is not null")
    good = " OR ".join(f"(metric = '{t[2]}' AND {t[4]})" for t in table)
    return out.withColumn("good", F.expr(good))


def samples(rows: DataFrame) -> DataFrame:
    return _long(rows, SAMPLES).where("good").select("path", "metric", "ts", F.col("v").alias("value"))


def dailies(rows: DataFrame) -> DataFrame:
    return _long(rows, DAILIES).where("good").select("path", "metric", "ts", F.col("v").alias("value"))


def drops(rows: DataFrame) -> DataFrame:
    """What a rule drops or remarks on, counted by reason. rows come from ``timed``."""
    reason = F.coalesce(*(F.when(F.col("metric") == t[2], t[5]) for t in SAMPLES if t[5]))
    sentinels = _long(rows, SAMPLES).where(~F.col("good")).select(reason.alias("reason"))
    monitoring = rows.where("message = 55")
    untimed = monitoring.where("ts is null").select(F.lit("monitoring_without_timestamp").alias("reason"))
    far = monitoring.where(F.abs("far_s") > FAR_S).select(F.lit("timestamp_16_far_from_reference").alias("reason"))
    apart = _clocks(rows).where(F.abs(F.col("local") - F.col("utc")) > OFFSET_LIMIT_S).select(F.lit("clock_offset_out_of_range").alias("reason"))
    stages = staged(rows).select(F.when(F.col("begin_ts").isNull(), "sleep_stage_without_start").when(F.col("begin_ts") >= F.col("end_ts"), "sleep_stage_zero_length").alias("reason"))
    every = sentinels.unionByName(untimed).unionByName(far).unionByName(apart).unionByName(stages)
    return every.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def labels(rows: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, HRV_STATUS)), (F.col("fields")[6] + 1).cast("int"))
    hrv = rows.where("message = 370 and fields[6] between 0 and 4").select("path", F.lit("hrv_status").alias("metric"), "ts", status.alias("label"))
    number = F.col("fields")[5].cast("int")
    sport = F.coalesce(F.get(F.array(*map(F.lit, SPORTS)), number), F.when(number == 53, "diving"), F.when(number == 254, "all"), number.cast("string"))
    vo2max = rows.where((F.col("message") == MAX_MET) & (F.col("fields")[2] > 0)).select("path", F.lit("vo2max_sport").alias("metric"), "ts", sport.alias("label"))
    return hrv.unionByName(vo2max.where("ts is not null and label is not null"))


def sleep_assessments(rows: DataFrame) -> DataFrame:
    """Scores of each file's night; of several messages the last."""
    last = rows.where(F.col("message") == ASSESSMENT).groupBy("path").agg(F.max_by("fields", "n").alias("f"))
    return last.select("path", *(F.col("f")[k].cast("int").alias(c) for k, c in SCORES.items()), (F.col("f")[STRESS] / 100).alias("avg_stress"))


def _clocks(rows: DataFrame) -> DataFrame:
    local = F.coalesce(*(F.when(F.col("message") == m, F.col("fields")[f]) for m, f in LOCAL_FIELD.items()))
    out = rows.where(F.col("message").isin(*LOCAL_FIELD)).select("path", F.col("fields")[TIMESTAMP].alias("utc"), local.alias("local"))
    return out.where((F.col("utc") >= REAL_TIME) & (F.col("local") >= REAL_TIME))


def clock_offsets(rows: DataFrame) -> DataFrame:
    """path, ts, offset_s from messages that state both clocks; offsets beyond 26 hours and times since power-on are left out."""
    out = _clocks(rows).where(F.abs(F.col("local") - F.col("utc")) <= OFFSET_LIMIT_S)
    return out.select("path", instant(F.col("utc")).alias("ts"), (F.col("local") - F.col("utc")).cast("int").alias("offset_s"))


def intervals(rows: DataFrame) -> DataFrame:
    """Cumulative counters by activity type; cycles are steps for walking and running, half of them otherwise.

    Type and intensity are fields of their own, or parts of the composite field 24: the lower five bits and the upper three.
    """
    f = F.col("fields")
    both = f[24].cast("int")
    kind, cycles, intensity = F.coalesce(f[5].cast("int"), both.bitwiseAND(F.lit(31))), f[3], F.coalesce(f[28].cast("int"), F.shiftright(both, 5))
    out = rows.where("message = 55 and ts is not null and coalesce(fields[5], fields[24]) is not null and coalesce(fields[3], fields[4], fields[2], fields[19]) is not null")
    return out.select(
        "path", "ts", kind.alias("activity_type"), intensity.alias("intensity"), F.when(kind.isin(*STEP_TYPES), cycles).cast("long").alias("steps"), F.when(kind.isin(*STEP_TYPES), cycles).otherwise(cycles / 2).alias("cycles"),
        (f[4] / 1000).alias("active_time_s"), (f[2] / 100).alias("distance_m"), f[19].cast("long").alias("active_calories"),
    )


def staged(rows: DataFrame) -> DataFrame:
    """night (the file), stage, begin_ts, end_ts, start_ts (the start event): stages before rules leave any out."""
    begun = rows.groupBy("path").agg(_kind().alias("kind"), F.max_by(F.when(_sleep_event(0), F.col("ts")), F.when(_sleep_event(0), F.col("n"))).alias("start_ts"))
    begun = begun.select("path", F.when(F.col("kind") == SLEEP_FILE, F.col("start_ts")).alias("start_ts"))
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("fields")[0] + 1).cast("int"))
    ends = rows.where("message = 275 and fields[0] between 0 and 4 and ts is not null").select("path", F.col("ts").alias("end_ts"), stage.alias("stage"))
    return with_begin(ends.join(begun, "path", "left").withColumnRenamed("path", "night"))


def sleep_stages(rows: DataFrame) -> DataFrame:
    """Stages of each file: a stage's time stamp is its end, the first starts at the file's sleep start event."""
    return stage_rows(staged(rows).drop("begin_ts"))


def sleep_sessions(rows: DataFrame) -> DataFrame:
    """One row a file that tells of a night: start, end, seconds of each stage (0 where there are others), scores."""
    event = lambda k: F.max_by(F.when(_sleep_event(k), F.col("ts")), F.when(_sleep_event(k), F.col("n")))
    told = rows.groupBy("path").agg(_kind().alias("kind"), event(0).alias("start_ts"), event(1).alias("end_ts"), F.count_if(F.col("message").isin(ASSESSMENT, 275)).alias("told"))
    mine = F.col("kind") == SLEEP_FILE
    told = told.select("path", F.when(mine, F.col("start_ts")).alias("start_ts"), F.when(mine, F.col("end_ts")).alias("end_ts"), "told").where("told > 0 or start_ts is not null").drop("told")
    stages = sleep_detail(sleep_stages(rows)).withColumnRenamed("night", "path").drop("asleep_s")
    out = told.join(stages, "path", "left").join(sleep_assessments(rows), "path", "left")
    filled = {c: F.when(F.col("stages") > 0, F.coalesce(c, F.lit(0))) for c in ("deep_s", "light_s", "rem_s", "awake_s")}
    return out.withColumns(filled | {"start_ts": F.coalesce("start_ts", "first_ts"), "end_ts": F.coalesce("end_ts", "last_ts")}).drop("first_ts", "last_ts", "stages")


def activities(rows: DataFrame) -> DataFrame:
    f = F.col("fields")
    out = rows.where("message = 18 and ts is not null")
    return out.select(
        "path", F.col("ts").alias("start_ts"), instant(f[TIMESTAMP]).alias("end_ts"), f[5].cast("int").alias("sport"), f[6].cast("int").alias("sub_sport"), (f[7] / 1000).alias("total_elapsed_s"),
        (f[8] / 1000).alias("total_timer_s"), (f[9] / 100).alias("distance_m"), f[11].cast("int").alias("calories"), f[16].cast("int").alias("avg_hr"), f[17].cast("int").alias("max_hr"),
        (F.coalesce(f[124], f[14]) / 1000).alias("avg_speed"), f[22].alias("total_ascent_m"), f[23].alias("total_descent_m"),
    )


def message_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "message").agg(F.count(F.lit(1)).alias("n"))


def last_known(rows: DataFrame) -> DataFrame:
    """What a broken file told before its end: its error with the span and stream so far."""
    return identities(timed(rows)).where("error is not null")


