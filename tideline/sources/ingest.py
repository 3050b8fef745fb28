"""Import: files in, the store's tables out.

Files are routed by name, hashed, and left out where the store holds them; offsets of all files are known before any date is
resolved; facts are decoded, dated by the wearer's clock and reduced to one row a key; derived dailies follow from them. Records are
known by the hash of their bytes (raw_id). Broken files give a failure with what was read of their stream and span, and no facts.

All that is not raw is a function of the set of records alone. ``assemble`` computes it for a set as a whole. ``import_found`` computes it again
for the days that new records touch, from all that the store holds of these days and of those beside them: the days of new samples,
counters and records, and the days that a newly known clock dates otherwise. So records may come in any number of imports, in any order. Where
rows share a key, content decides: the record's start (none first), then its hash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import gmt, mask_label, round_exact
from ..operators import aggregates, dedupe, localday
from . import files as F_
from . import fit, json_records, snapshots, store

NO_SPAN = ("start_ts", "end_ts")
#: Dailies derived from device samples: name, metric, reducer.
REDUCERS = {
    "stress_avg": ("stress", "avg"), "heart_rate_min": ("heart_rate", "min"), "heart_rate_max": ("heart_rate", "max"), "energy_reserve_high": ("energy_reserve", "max"),
    "energy_reserve_low": ("energy_reserve", "min"),
}


Keep = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    """Keeps nothing: what reads a table twice makes it twice. ``store.keeper`` writes such tables once."""
    return df


def union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fit_files(found: DataFrame) -> DataFrame:
    """path, content of FIT files and of those inside uploaded archives; labels hold no addresses and no long numbers."""
    name = F.lower(F.col("path"))
    plain = found.where(name.endswith(".fit")).select("path", "content")
    packed = F_.unzip(found.where(name.endswith(".zip"))).select(F.col("label").alias("path"), "content")
    return plain.unionByName(packed).withColumn("path", mask_label(F.col("path")))


def fresh_fit(found: DataFrame, held: DataFrame) -> DataFrame:
    """raw_id, label, payload of FIT files (path, content) that are not held (payload_hash) yet; a file that occurs twice counts once."""
    hashed = found.withColumn("raw_id", F.sha2("content", 256)).groupBy("raw_id").agg(F.min_by("content", "path").alias("payload"), F.min("path").alias("label"))
    return hashed.join(held.select(F.col("payload_hash").alias("raw_id")).distinct(), "raw_id", "left_anti")


def fit_tables(records: DataFrame, keep: Keep = as_is) -> dict[str, DataFrame]:
    """Tables of FIT records (raw_id, label, payload). A record that breaks off is a failure and gives no facts."""
    rows = keep(fit.timed(fit.messages(records.select(F.col("raw_id").alias("path"), F.col("payload").alias("content")), fit.wanted_fields())))
    known = keep(fit.identities(rows).withColumnRenamed("path", "raw_id"))
    good = known.where("error is null").select("raw_id", "stream", "device_id", *NO_SPAN)
    of = good.select("raw_id", "device_id", F.col("start_ts").alias("record_start"))
    whole = rows.join(good.select(F.col("raw_id").alias("path")), "path", "left_semi")
    named = lambda df: df.withColumnRenamed("path", "raw_id")
    owned = lambda df: named(df).join(of, "raw_id")
    bad = known.where("error is not null").join(records.select("raw_id", "label"), "raw_id")
    device = F.lit("device")
    return {
        "raw": good.withColumns({"payload_hash": F.col("raw_id"), "source_key": F.col("raw_id")}).join(records.select("raw_id", "payload"), "raw_id"),
        "failures": bad.select("raw_id", F.coalesce("stream", F.lit("fit:undecodable")).alias("stream"), *NO_SPAN, "label", "error"),
        "offsets": named(fit.clock_offsets(whole)), "samples": owned(fit.samples(whole)).withColumn("scope", device), "timed_daily": owned(fit.dailies(whole)).withColumn("scope", device),
        "timed_labels": owned(fit.labels(whole)).withColumn("scope", device), "intervals": owned(fit.intervals(whole)), "activities": owned(fit.activities(whole)), "sleep": owned(fit.sleep_sessions(whole)).withColumn("scope", device),
        "stages": fit.sleep_stages(whole).withColumnRenamed("night", "raw_id"), "drops": fit.drops(whole),
    }


def fresh_json(found: DataFrame, held: DataFrame, streams: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw_id, stream, source_key, payload_hash, record, span and day of the export's JSON records (path, content) that are not held; failures).

    A record is held if its stream and key are: of several versions under one key the first stays, in order of path and place. streams: those
    that there are files of, if that is known.
    """
    routed = found.withColumn("stream", F_.stream_of(F.col("path"))).where("stream is not null")
    first, last = F_.claimed_window(F.substring_index("path", "/", -1))
    rows = F_.json_rows(routed).join(routed.select("path", "stream"), "path")
    at = lambda day: day.cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    bad = rows.where("error is not null").select("path", "error").join(routed, "path")
    failures = bad.select(F.sha2("content", 256).alias("raw_id"), "stream", at(first).alias("start_ts"), at(last).alias("end_ts"), mask_label(F.substring_index("path", "/", -1)).alias("label"), "error")
    records = rows.where("error is null").select("stream", "path", "n", "record")
    keyed = union([keyed_records(records.where(F.col("stream") == s), s) for s in (RECORD_STREAMS if streams is None else sorted(streams) or RECORD_STREAMS[:1])])
    first = F.min(F.struct("path", "n", "record", *NO_SPAN, "day")).alias("f")
    once = keyed.groupBy("stream", "source_key").agg(first).select("stream", "source_key", "f.record", *(f"f.{c}" for c in (*NO_SPAN, "day"))).withColumn("payload_hash", F.sha2("record", 256))
    fresh = once.join(held.select("stream", "source_key").distinct(), ["stream", "source_key"], "left_anti")
    return fresh.withColumn("raw_id", F.sha2(F.concat_ws("|", "stream", "source_key", "payload_hash"), 256)), failures


ORDERED = ("record_start", "digest")


def daily_tables(records: DataFrame, stream: str) -> dict[str, DataFrame]:
    """Dated values and labels of a stream's records (raw_id, record, and what they are ordered by); of readiness records those that are a day's."""
    mine = records.select("raw_id", *(c for c in ORDERED if c in records.columns), "record")
    if stream == "json:readiness":
        mine = mine.join(json_records.pick_readiness(mine.select("record")).select("record").distinct(), "record", "left_semi").select(*mine.columns)
    return {"daily": json_records.decode(mine, stream), "labels": json_records.decode_labels(mine, stream).withColumn("scope", F.lit("vendor_cloud"))}


def night_tables(records: DataFrame, stream: str) -> dict[str, DataFrame]:
    keep = ("raw_id", *(c for c in ORDERED if c in records.columns))
    return {"sleep": json_records.decode_sleep(records.select(*keep, "record"), keep=keep).withColumn("scope", F.lit("vendor_cloud"))}


def live_tables(records: DataFrame, stream: str = "json:live") -> dict[str, DataFrame]:
    """Valid readings of live records (raw_id, record), what was dropped, and failures: records whose readings have not the one form."""
    rows = records.select("raw_id", F_.stored_readings(F.col("record")).alias("readings"))
    error = F.lit("live record without readings, or with a malformed one")
    failures = rows.where("readings is null").select("raw_id", F.lit(stream).alias("stream"), F.lit(None).cast("timestamp").alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"), F.lit(None).cast("string").alias("label"), error.alias("error"))
    readings = rows.select("raw_id", F.timestamp_seconds(F.get("readings", F.lit(0)).getField("t")).alias("start_ts"), F.inline("readings"))
    good, rules = F_.keep_readings(readings)
    micro = F.timestamp_micros(F.floor(F.col("t") * 1_000_000).cast("long"))
    return {
        "readings": good.select("raw_id", "start_ts", micro.alias("ts"), "metric", F.col("value").cast("double").alias("value")), "failures": failures,
        "drops": aggregates.drop_counts(readings.dropDuplicates(["t", "metric", "value"]), {f"live_{k}": v for k, v in rules.items()}),
    }


#: What decodes the records of each stream, for imports and replays alike.
DECODERS: dict[str, Callable[[DataFrame, str], dict[str, DataFrame]]] = {**dict.fromkeys(json_records.DECODERS, daily_tables), "json:sleep": night_tables, "json:live": live_tables}
RECORD_STREAMS = (*json_records.DECODERS, "json:sleep")


def ordered(records: DataFrame) -> DataFrame:
    return records.withColumnsRenamed({"start_ts": "record_start", "payload_hash": "digest"})


def json_tables(records: DataFrame, streams: Iterable[str] = RECORD_STREAMS) -> dict[str, DataFrame]:
    """Tables of records (raw_id, stream, record) of all streams but the live one, or of those that there are."""
    parts = [DECODERS[s](records.where(F.col("stream") == s), s) for s in RECORD_STREAMS if s in {*streams, "json:uds", "json:sleep"}]
    out = {name: union([p[name] for p in parts if name in p]) for name in ("daily", "labels", "sleep")}
    return out | {name: out[name].withColumnRenamed("date", "day") for name in ("daily", "labels")}


# What makes a record's key together with its date, and what states its start and end.
STAMPS = {
    "json:vo2max": "$.updateTimestamp", "json:training_load": "$.timestamp", "json:endurance": "$.timestamp", "json:hill": "$.timestamp", "json:fitness_age": "$.createTimestamp",
    "json:biometrics": "$.version", "json:readiness": "$.timestamp",
}
SPANS = {
    "json:uds": ("$.wellnessStartTimeGmt", "$.wellnessEndTimeGmt"), "json:sleep": ("$.sleepStartTimestampGMT", "$.sleepEndTimestampGMT"), "json:fitness_age": ("$.asOfDateGmt",) * 2,
    "json:biometrics": ("$.weight.timestampGMT",) * 2,
}


def moment(text: Column) -> Column:
    """An instant from a GMT text or from epoch milliseconds."""
    millis = F.try_to_number(F.when(text.rlike(r"\A\d{11,14}\z"), text), F.lit("9" * 14)).cast("long")
    return F.coalesce(gmt(text), F.timestamp_millis(millis))


def keyed_records(records: DataFrame, stream: str) -> DataFrame:
    """stream, path, n, source_key, record, start_ts, end_ts, day: keyed by the record's date and its own stamp or version.

    Records without a date are left out, and readiness records without a stamp.
    """
    date = json_records.DECODERS[stream].date if stream in json_records.DECODERS else "$.calendarDate"
    stamp = STAMPS.get(stream)
    span = SPANS.get(stream, (stamp, stamp))
    rows = json_records.parsed(records, "record", [], [*dict.fromkeys(p for p in (date, stamp, *span) if p)])
    day = json_records.calendar_date(json_records._at(date))
    key = F.concat(day.cast("string"), F.lit("|"), F.coalesce(json_records._at(stamp), F.lit(""))) if stamp else day.cast("string")
    complete = day.isNotNull() & (json_records._at(stamp).isNotNull() if stream == "json:readiness" else F.lit(True))
    start, end = (moment(json_records._at(p)) for p in span)
    return rows.where(complete).select("stream", "path", "n", key.alias("source_key"), "record", start.alias("start_ts"), end.alias("end_ts"), day.alias("day"))


def fresh_live(found: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw_id, stream, source_key, start_ts, end_ts, record of live-session files (path, content) that are not held; counts of files cut off or without readings)."""
    texts = found.where(F.lower(F.col("path")).endswith(".jsonl") & F.try_validate_utf8(F.col("content")).isNotNull()).select("path", F.col("content").cast("string").alias("text"))
    lines = F_.live_lines(texts)
    records = F_.live_records(lines.where("size(readings) > 0")).withColumn("stream", F.lit("json:live"))
    records = records.groupBy("stream", "source_key").agg(*(F.first(c).alias(c) for c in ("record", *NO_SPAN)))  # equal keys, equal records
    fresh = records.join(held.select("stream", "source_key").distinct(), ["stream", "source_key"], "left_anti").withColumn("raw_id", F.col("source_key"))
    counts = {"live_file_cut_off": F.count_if("cut_off"), "live_file_without_readings": F.count_if(F.size("readings") == 0)}
    counted = lines.agg(F.array(*(F.struct(F.lit(name).alias("reason"), n.alias("n")) for name, n in counts.items())).alias("c")).select(F.inline("c")).where("n > 0")
    return fresh, counted


def derive(tables: dict[str, DataFrame], touched: DataFrame | None = None, days: Callable[[Column], Column] | None = None) -> DataFrame:
    """Derived dailies of scope local: reducers and charges over device samples, steps and distance from counters.

    The days can be limited to those of a table (touched: local_day), or by a condition.
    """
    offsets = tables["offsets"]
    rows = localday.with_local_day(tables["samples"].where("scope = 'device'"), offsets)
    counters = localday.with_local_day(tables["intervals"].withColumn("at_ts", F.col("ts") - F.expr("INTERVAL 1 SECOND")), offsets, "at_ts").withColumnRenamed("activity_type", "kind")
    if touched is not None:
        rows, counters = (df.join(touched, "local_day", "left_semi") for df in (rows, counters))
    if days is not None:
        rows, counters = (df.where(days(F.col("local_day"))) for df in (rows, counters))
    reduced = aggregates.daily_reducers(rows, REDUCERS).select("metric", "device_id", "local_day", "value", "raw_id", "observed")
    energy = aggregates.charged_drained(rows.where("metric = 'energy_reserve'"))
    last = rows.where("metric = 'energy_reserve'").groupBy("metric", "device_id", "local_day").agg(F.max_by("raw_id", "ts").alias("raw_id"), F.max("ts").alias("observed"))
    charges = energy.join(last, ["metric", "device_id", "local_day"])
    charges = union([charges.select(F.lit(f"energy_reserve_{c}").alias("metric"), "device_id", "local_day", F.col(c).alias("value"), "raw_id", "observed") for c in ("charged", "drained")])
    sums = []
    for name, column in (("steps", "steps"), ("distance", "distance_m")):
        there = counters.where(F.col(column).isNotNull()).withColumn("counter", F.col(column))
        newest = counters.groupBy("device_id", "local_day").agg(F.max_by("raw_id", F.struct("ts", *(c for c in ("record_start",) if c in counters.columns), "raw_id")).alias("raw_id"), F.max("ts").alias("observed"))
        total = aggregates.counter_totals(there).select("device_id", "local_day", F.col("total").cast("double").alias("value"))
        sums.append(total.join(newest, ["device_id", "local_day"]).withColumn("metric", F.lit(name)))
    shown = [df.withColumn("value", round_exact(F.col("value"), 3)) for df in (reduced, charges)]  # stored as they are shown
    out = union([*shown, *sums])
    return out.select("metric", F.lit("local").alias("scope"), F.col("local_day").alias("day"), F.col("value").cast("double").alias("value"), "device_id", "raw_id", "observed")


def raw_rows(records: DataFrame) -> DataFrame:
    """Raw rows of JSON records (raw_id, stream, source_key, record, spans if there are any): the bytes are the record's text."""
    spans = {c: F.lit(None).cast("timestamp") for c in NO_SPAN if c not in records.columns}
    rows = records.withColumns(spans | {"payload": F.col("record").cast("binary"), "payload_hash": F.sha2("record", 256), "device_id": F.lit(None).cast("string")})
    return rows.select("raw_id", "stream", "device_id", *NO_SPAN, "payload_hash", "source_key", "payload")


KEYS = {"samples": ["metric", "ts", "scope", "device_id"], "intervals": ["ts", "activity_type", "device_id"], "sleep": ["date", "scope"], "daily": ["metric", "scope", "day", "device_id"], "labels": ["metric", "scope", "day", "device_id"]}


def single(rows: DataFrame, name: str) -> DataFrame:
    """One row a key: the last in content order."""
    return dedupe.last_write(rows, KEYS[name], [c for c in (*ORDERED, "raw_id") if c in rows.columns])


def with_digest(df: DataFrame) -> DataFrame:
    """FIT records are known by the hash of their bytes."""
    return df.withColumn("digest", F.col("raw_id"))


def readings_once(readings: DataFrame) -> DataFrame:
    """raw_id, start_ts, ts, metric, value: each live reading once, of the first record that holds it."""
    first = readings.groupBy("ts", "metric", "value").agg(F.min(F.struct("start_ts", "raw_id")).alias("of"))
    return first.select("of.raw_id", "of.start_ts", "ts", "metric", "value")


def live_minutes(readings: DataFrame) -> DataFrame:
    folded = aggregates.minute_fold(readings.withColumn("content", dedupe.content_order("start_ts", "raw_id", "metric", "raw_id")), "content")
    return folded.select("metric", F.timestamp_micros("minute_us").alias("ts"), F.lit("live").alias("scope"), F.lit(None).cast("string").alias("device_id"), "raw_id", "value")


def timed_facts(a: dict[str, DataFrame]) -> DataFrame:
    """Dailies and labels that files state for an instant: their day depends on the wearer's clock."""
    values, labels = a["timed_daily"].withColumn("label", F.lit(None).cast("string")), a["timed_labels"].withColumn("value", F.lit(None).cast("double"))
    columns = ["raw_id", "record_start", "device_id", "scope", "metric", "ts", "value", "label"]
    return values.select(*columns).unionByName(labels.select(*columns))


def day_versions(tables: dict[str, DataFrame], timed: DataFrame, nights: DataFrame, b: dict[str, DataFrame], days: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """All versions of daily, labels and sleep from samples, intervals and offsets (tables), facts and nights of files, and tables of JSON records."""
    fine = days if days is not None else lambda day: F.lit(True)
    dated = with_digest(localday.with_local_day(timed, tables["offsets"]).withColumnsRenamed({"ts": "observed", "local_day": "day"})).where(fine(F.col("day")))
    facts = [*KEYS["daily"], "observed", "raw_id", *ORDERED]
    at = {"observed": F.lit(None).cast("timestamp"), "device_id": F.lit(None).cast("string")}
    derived = with_digest(derive(tables, days=days)).withColumn("record_start", F.lit(None).cast("timestamp"))
    daily = [dated.where("value is not null").select(*facts, "value"), b["daily"].withColumns(at).where(fine(F.col("day"))).select(*facts, "value"), derived.select(*facts, "value")]
    labels = [dated.where("label is not null").select(*facts, "label"), b["labels"].withColumns(at).where(fine(F.col("day"))).select(*facts, "label")]
    slept = with_digest(localday.with_local_day(nights, tables["offsets"], "end_ts").withColumnRenamed("local_day", "date").drop("offset_s", "assumed_utc"))
    content = F.struct(*ORDERED, "raw_id")
    return {"daily": union(daily).withColumn("content", content), "labels": union(labels).withColumn("content", content), "sleep": union([slept, b["sleep"]]).where(fine(F.col("date")))}


def day_rows(versions: DataFrame, name: str) -> DataFrame:
    """The version of each key that holds: of dailies and labels the latest observed."""
    rows = single(versions, name) if name == "sleep" else dedupe.latest_observed(versions, KEYS[name], "content").drop("content")
    return rows.drop(*ORDERED)


def assemble(a: dict[str, DataFrame], b: dict[str, DataFrame], c: dict[str, DataFrame], offsets: DataFrame | None = None, keep: Keep = as_is) -> dict[str, DataFrame]:
    """The store's facts from the tables of FIT, JSON and live records: dated by the wearer's clock, one row a key, derived dailies beside them."""
    clock = a["offsets"] if offsets is None else a["offsets"].unionByName(offsets.select("raw_id", "ts", "offset_s")).distinct()
    device = keep(single(a["samples"], "samples"))
    tables = {"offsets": clock, "samples": device, "intervals": keep(single(a["intervals"], "intervals"))}
    days = {name: day_rows(keep(df), name) for name, df in day_versions(tables, timed_facts(a), a["sleep"], b).items()}
    out = tables | days | {"activities": a["activities"].drop("record_start"), "stages": a["stages"]}
    out["samples"] = device.drop("record_start").unionByName(live_minutes(readings_once(c["readings"])))
    return out | {"intervals": out["intervals"].drop("record_start")}


def import_files(found: DataFrame, held: DataFrame | None = None, offsets: DataFrame | None = None, keep: Keep = as_is) -> dict[str, DataFrame]:
    """found: path, content, written_day. The tables of what the store does not hold yet.

    held: stream, source_key, payload_hash of records that are there; offsets: ts, offset_s, raw_id that are known. Tables: raw, failures,
    claims, offsets, samples, daily, labels, intervals, activities, sleep, stages, drops.
    """
    spark = found.sparkSession
    held = spark.createDataFrame([], "stream string, source_key string, payload_hash string") if held is None else held
    (records, broken), (sessions, counted) = fresh_json(found, held), fresh_live(found, held)
    records, sessions = keep(records), keep(sessions)
    a, b, c = fit_tables(keep(fresh_fit(fit_files(found), held)), keep), json_tables(ordered(records)), live_tables(sessions)
    a["offsets"] = keep(a["offsets"])
    return assemble(a, b, c, offsets, keep) | {
        "raw": union([a["raw"], raw_rows(records), raw_rows(sessions)]), "failures": union([a["failures"], broken, c["failures"]]), "claims": F_.claims(found),
        "drops": union([a["drops"], c["drops"], counted]).groupBy("reason").agg(F.sum("n").alias("n")),
    }


def reparse(raw: DataFrame, kept: dict[str, DataFrame] | None = None, force: bool = False, keep: Keep = as_is) -> dict[str, DataFrame]:
    """All facts again from retained records (raw_id, stream, payload; start_ts and payload_hash if there are any). Refused if any fails to decode, unless forced.

    Forced, the facts that failing records left behind (in ``kept``) stay; FIT comes first, so that all offsets are known. Files are decoded
    once with ``keep``, which has their messages and clocks; a table of facts is made from these when it is read.
    """
    missing = {"start_ts": F.lit(None).cast("timestamp"), "payload_hash": F.sha2("payload", 256)}
    raw = raw.withColumns({c: v for c, v in missing.items() if c not in raw.columns})
    text = raw.where(F.col("stream").startswith("json:")).withColumn("record", F.col("payload").cast("string"))
    binary = raw.where(F.col("stream").startswith("fit:")).withColumn("label", F.lit(None).cast("string"))
    a, b, c = fit_tables(binary, keep), json_tables(ordered(text)), live_tables(text.where("stream = 'json:live'"))
    a["offsets"] = keep(a["offsets"])
    failures = union([a["failures"], c["failures"]])
    tables = assemble(a, b, c)
    if failures.isEmpty():
        return tables
    if not force:
        raise ValueError("some records do not decode")
    gone = failures.select("raw_id").distinct()
    return {n: df.unionByName(kept[n].join(gone, "raw_id", "left_semi"), allowMissingColumns=True) if n in (kept or {}) else df for n, df in tables.items()}


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """stream, files, records and failures of an import."""
    seen = tables["raw"].groupBy("stream").agg(F.count(F.lit(1)).alias("records"))
    failed = tables["failures"].groupBy("stream").agg(F.count(F.lit(1)).alias("failures"))
    return seen.join(failed, "stream", "full").select("stream", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("failures", F.lit(0)).alias("failures"))


NO_DAY = -1_000_000
#: The tables that files state or that follow from single records, by the UTC day of this column.
BY_INSTANT = {"device_samples": "ts", "intervals": "ts", "timed": "ts", "nights": "end_ts", "readings": "ts"}
BY_LOCAL_DAY = {"daily": "day", "labels": "day", "sleep": "date"}
CLOCKED = ("device_samples", "intervals", "timed", "nights")


def on_day(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn(snapshots.DAY, F.coalesce(F.unix_date(F.to_date(at)), F.lit(NO_DAY)))


def in_days(days: Iterable[int]) -> Callable[[Column], Column]:
    days = set(days)
    return lambda day: snapshots.within(F.coalesce(F.unix_date(day), F.lit(NO_DAY)), days)


def around(days: Iterable[int], reach: int) -> set[int]:
    return {d + k for d in days for k in range(-reach, reach + 1)}


def redated(old: DataFrame, new: DataFrame, days: set[int]) -> set[int]:
    """Of some UTC days, those on which two sets of offsets, or of regimes, do not tell the same time. Regimes, a row a change of clock, meet a calendar day by day."""
    if not days:
        return set()
    spark = new.sparkSession
    calendar = spark.createDataFrame(pd.DataFrame({"d": sorted(days)}), "d long")
    first, last = 2 * localday.DAY_US * F.col("d"), 2 * localday.DAY_US * (F.col("d") + 1)
    from_day, to_day = (F.lit(d).cast("long") for d in (min(days), max(days)))

    def clock(offsets: DataFrame) -> DataFrame:
        found = offsets if "low2" in offsets.columns else localday.regimes(offsets)
        span = [F.floor(F.col(c) / (2 * localday.DAY_US)) for c in ("low2", "high2")]
        spread = found.where((span[0] <= to_day) & (span[1] >= from_day)).withColumn("d", F.explode(F.sequence(F.greatest(span[0], from_day), F.least(span[1], to_day))))
        met = spread.join(calendar, "d").where((F.col("low2") < last) & (F.col("high2") > first))
        piece = F.struct(F.greatest("low2", first).alias("from2"), "offset_s")
        return met.groupBy("d").agg(F.array_sort(F.collect_list(piece)).alias("clock"))

    none = F.array(F.struct(first.alias("from2"), F.lit(0).alias("offset_s")))  # no offset known: taken for UTC
    both = calendar.join(clock(old).withColumnRenamed("clock", "was"), "d", "left").join(clock(new), "d", "left")
    return {r.d for r in both.where(F.coalesce("was", none) != F.coalesce("clock", none)).select("d").collect()}  # days of a calendar


#: The tables of facts that single records state, and where ``fit_tables`` and ``live_tables`` have them.
PLAIN = ("offsets", "activities", "stages")


def facts_of(a: dict[str, DataFrame], c: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What records state, by table: kept by the UTC day of an instant, or as it is."""
    dated = {"device_samples": a["samples"].select(*KEYS["samples"], "value", "raw_id", "record_start"), "intervals": a["intervals"], "timed": timed_facts(a), "nights": a["sleep"], "readings": c["readings"]}
    return {name: on_day(df, BY_INSTANT[name]) for name, df in dated.items()} | {"offsets": a["offsets"], "activities": a["activities"].drop("record_start"), "stages": a["stages"]}


def write_facts(run: snapshots.Run, facts: dict[str, DataFrame], json_days: DataFrame, keep: Keep, with_fit: bool = True) -> None:
    """Adds new facts to the tables, and computes anew what follows from them on the days that they touch.

    A day is touched by a new fact on it, or by a clock that now tells another time on it. Facts on a UTC day belong to local days that
    are at most the largest offset away.
    """
    spark = run.spark
    before = run.read("offsets")
    before = snapshots.nothing(spark, facts["offsets"].schema) if before is None else before
    stored = set().union(*(run.now.days(t) for t in CLOCKED))
    run.together([functools.partial(run.add, name, facts[name]) for name in PLAIN if with_fit or name not in run.now.schemas])
    new = {name: facts[name] for name in BY_INSTANT}
    seen = union([df.select(F.lit(name).alias("name"), snapshots.DAY).distinct() for name, df in new.items()] + [json_days.select(F.lit("json").alias("name"), snapshots.DAY).distinct()])
    touched: dict[str, set[int]] = {}
    for r in seen.collect():  # days of a calendar
        touched.setdefault(r["name"], set()).add(r[snapshots.DAY])

    def merge(name: str) -> None:
        days = touched.get(name, set())
        old = run.read(name, days)
        rows = new[name] if old is None else old.unionByName(new[name])
        if name == "readings":
            rows = on_day(readings_once(rows), "ts")
        elif name in ("device_samples", "intervals"):
            rows = single(rows, "samples" if name == "device_samples" else name)
        run.replace(name, rows, days)

    run.together([functools.partial(merge, name) for name in BY_INSTANT if touched.get(name) or name not in run.now.schemas])
    offsets = run.read("offsets")
    clock = keep(localday.regimes(offsets))
    moved: set[int] = set()
    furthest: list[int] = []
    run.together([
        lambda: moved.update(redated(before, clock, stored) if with_fit else ()), lambda: furthest.append(int(clock.agg(F.max(F.abs("offset_s"))).first()[0] or 0)),
    ])
    reach = max(1, -(-furthest[0] // 86_400))
    local = around(set().union(moved, *(touched.get(t, set()) for t in CLOCKED)), reach) | touched.get("json", set())
    near = around(local, reach)
    records = run.read("raw_json", local).where("stream != 'json:live'").withColumn("record", F.col("payload").cast("string"))
    streams = {r.stream for r in records.select("stream").distinct().collect()}  # a row a stream
    tables = {"offsets": clock, "samples": run.read("device_samples", near), "intervals": run.read("intervals", near)}
    versions = day_versions(tables, run.read("timed", near).drop(snapshots.DAY), run.read("nights", near).drop(snapshots.DAY), json_tables(ordered(records), streams), in_days(local))

    def settle(name: str) -> None:
        run.replace(name, on_day(day_rows(keep(versions[name]), name), BY_LOCAL_DAY[name]), local)

    steps = [functools.partial(settle, name) for name in versions if local or name not in run.now.schemas]
    live = touched.get("readings", set())
    if live or "live_samples" not in run.now.schemas:
        steps.append(lambda: run.replace("live_samples", on_day(live_minutes(run.read("readings", live)), "ts"), live))
    run.together(steps)


def import_found(found: DataFrame, run: snapshots.Run, keep: Keep) -> DataFrame:
    """Writes into ``run`` what files (path, content, written_day) bring and the store does not hold; returns stream, records and failures.

    Only days that something new touches are written again.
    """
    spark = run.spark
    name = F.lower("path")
    kinds = found.agg(F.count_if(name.endswith(".fit") | name.endswith(".zip")).alias("fit"), F.collect_set(F_.stream_of(F.col("path"))).alias("json"), F.count_if(name.endswith(".jsonl")).alias("live")).first()
    held = [df.select("stream", "source_key", "payload_hash") for df in map(run.read, ("raw_fit", "raw_json")) if df is not None]
    held = union(held) if held else spark.createDataFrame([], "stream string, source_key string, payload_hash string")
    of = lambda there: found if there else found.limit(0)
    (records, broken), (sessions, counted) = fresh_json(of(kinds.json), held, kinds.json), fresh_live(of(kinds.live), held)
    made: dict[str, DataFrame] = {}

    def make(name: str, df: DataFrame, there: object) -> Callable[[], None]:
        return lambda: made.update({name: keep(df) if there else snapshots.nothing(spark, df.schema)})

    run.together([make("fit", fresh_fit(fit_files(of(kinds.fit)), held), kinds.fit), make("json", records, kinds.json), make("live", sessions, kinds.live)])
    a, c = fit_tables(made["fit"], keep if kinds.fit else as_is), live_tables(made["live"])
    days = made["json"].select("raw_id", F.unix_date("day").alias(snapshots.DAY))
    raw_json = raw_rows(made["json"]).join(days, "raw_id").unionByName(on_day(raw_rows(made["live"]), "start_ts"))
    new = {"failures": union([a["failures"], broken, c["failures"]]), "claims": F_.claims(found).distinct()}
    for name, key in (("failures", ["raw_id", "stream"]), ("claims", ["stream", "from_day", "to_day"])):
        old = run.read(name)
        if old is not None:
            old = old.select(*(F.col(k).alias(f"{k}_") for k in key)).distinct()
            new[name] = new[name].join(old, functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key)), "left_anti")
    run.together([functools.partial(lambda name, df: new.update({name: keep(df)}), name, df) for name, df in list(new.items())])
    drops = union([a["drops"], c["drops"], counted]).groupBy("reason").agg(F.sum("n").alias("n"))
    run.together([
        lambda: run.add("raw_fit", a["raw"]), lambda: run.add("raw_json", raw_json.sortWithinPartitions(snapshots.DAY)), lambda: run.add("failures", new["failures"]),
        lambda: run.add("claims", new["claims"]), lambda: run.set("drops", drops),
    ])
    write_facts(run, facts_of(a, c), days, keep, bool(kinds.fit))
    counts = statistics({"raw": union([df.select("stream") for df in (a["raw"], made["json"], made["live"])]), "failures": new["failures"]})
    return spark.createDataFrame(counts.collect(), "stream string, records long, failures long")  # a row a stream


def into_store(spark: SparkSession, target: str, transport: str, work: Callable[[snapshots.Run, Keep], DataFrame], cancelled: Callable[[], bool] = lambda: False, mark: tuple[str, int] | None = None) -> DataFrame | None:
    """One booked run under the store's lease: what ``work`` returns, or None if the run was cancelled or its mark is there already.

    A run that breaks off, is cancelled or loses its lease leaves the store as it was.
    """
    with snapshots.lease(spark, target) as holder:
        store.heal(spark, target)
        base = snapshots.latest(snapshots.Files(spark, target))
        if mark is not None and base.marks.get(mark[0], -1) >= mark[1]:
            return None
        name = store.begin_run(spark, target, transport)
        try:
            run = snapshots.Run(spark, target, base, name, cancelled)
            with store.keeper(spark, target, name) as keep:
                with store.job_group(spark, name, f"{transport} into {target}", cancelled):
                    out = work(run, keep)
                    snapshots.compact(run)
                if mark is not None:
                    run.now.marks[mark[0]] = mark[1]
                run.commit(holder)
        except BaseException as e:
            if isinstance(e, snapshots.Cancelled) or (isinstance(e, Exception) and cancelled()):  # jobs that were interrupted fail
                store.finish_run(spark, target, name, "cancelled", None)
                return None
            store.finish_run(spark, target, name, "failed", f"{type(e).__name__}: {e}")
            raise
        store.finish_run(spark, target, name, "done", None)
        return out


def import_path(spark: SparkSession, path: str, target: str, cancelled: Callable[[], bool] = lambda: False, transport: str | None = None) -> DataFrame:
    """Imports a folder, archive or file into the store at ``target`` and returns its statistics.

    ``cancelled`` is asked again and again, and running jobs are interrupted when it says so.
    """
    found = F_.listing(spark, path)
    export = not found.where(F_.section_of(F.col("path")) != "").isEmpty()
    out = into_store(spark, target, transport or ("export" if export else "folder"), lambda run, keep: import_found(keep(found), run, keep), cancelled)
    return spark.createDataFrame([], "stream string, records long, failures long") if out is None else out


def reparse_store(spark: SparkSession, target: str, force: bool = False) -> None:
    """All facts of the store decoded again from its records, as a run of its own. Refused if a record fails to decode, unless forced.

    Forced, the facts that failing records left behind stay.
    """

    def again(run: snapshots.Run, keep: Keep) -> DataFrame:
        raw = {t: run.read(t) for t in ("raw_fit", "raw_json")}
        live = raw["raw_json"].where("stream = 'json:live'").withColumn("record", F.col("payload").cast("string"))
        a, c = fit_tables(raw["raw_fit"].withColumn("label", F.lit(None).cast("string")), keep), live_tables(live)
        failures = keep(union([a["failures"], c["failures"]]))
        facts = facts_of(a, c)
        if not failures.isEmpty():
            if not force:
                raise ValueError("some records do not decode")
            gone = failures.select("raw_id").distinct()
            facts = {n: df.unionByName(run.read(n).join(gone, "raw_id", "left_semi").select(*df.columns)) for n, df in facts.items()}
        for t in facts.keys() | BY_LOCAL_DAY.keys() | {"live_samples"}:
            run.now.live.pop(t, None), run.now.schemas.pop(t, None)
        write_facts(run, facts, raw["raw_json"].where("stream != 'json:live'").select(snapshots.DAY), keep)
        return failures

    into_store(spark, target, "reparse", again)


def tables_of(spark: SparkSession, target: str, commit: snapshots.Commit | None = None) -> dict[str, DataFrame]:
    """The store's tables as its readers know them."""
    commit = snapshots.latest(snapshots.Files(spark, target)) if commit is None else commit
    if not commit.live:
        return {}
    read = lambda t: snapshots.read(spark, target, commit, t).drop(snapshots.DAY, "record_start")
    samples = read("device_samples")
    out = {"raw": read("raw_fit").unionByName(read("raw_json")), "samples": samples.unionByName(read("live_samples").select(*samples.columns))}
    return out | {t: read(t) for t in ("failures", "claims", "offsets", "intervals", "daily", "labels", "sleep", "activities", "stages", "drops")}
