"""JSON record decoders: one record column in, long facts out, without Python workers.

A stream's decoder is a table of facts (metric, JSON path, least value); ``decode`` reads the paths, drops facts under their
least value and unpivots. Values of another type than number are absent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_date, gmt


@dataclass(frozen=True)
class Decoder:
    date: str
    facts: tuple[tuple[str, str, float | None], ...] = ()
    labels: tuple[tuple[str, str], ...] = ()
    scale: dict[str, float] = field(default_factory=dict)


# Field names of the export's records.
DECODERS = {
    "json:uds": Decoder(
        "$.calendarDate",
        (
            ("steps", "$.totalSteps", None), ("distance", "$.totalDistanceMeters", None), ("resting_heart_rate", "$.restingHeartRate", 1),
            ("resting_heart_rate_current_day", "$.currentDayRestingHeartRate", 1), ("heart_rate_min", "$.minHeartRate", 1), ("heart_rate_max", "$.maxHeartRate", 1),
            ("intensity_minutes_moderate", "$.moderateIntensityMinutes", None), ("intensity_minutes_vigorous", "$.vigorousIntensityMinutes", None),
            ("calories_total", "$.totalKilocalories", None), ("calories_active", "$.activeKilocalories", None), ("calories_bmr", "$.bmrKilocalories", None),
            ("spo2_avg", "$.averageSpo2Value", 1), ("spo2_lowest", "$.lowestSpo2Value", 1),
            ("respiration_avg_waking", "$.respiration.avgWakingRespirationValue", 0), ("respiration_lowest", "$.respiration.lowestRespirationValue", 0),
            ("respiration_highest", "$.respiration.highestRespirationValue", 0), ("body_battery_charged", "$.bodyBattery.chargedValue", None),
            ("body_battery_drained", "$.bodyBattery.drainedValue", None), ("active_minutes", "$.activeSeconds", None), ("highly_active_minutes", "$.highlyActiveSeconds", None),
            ("hydration_ml", "$.hydration.valueInML", None), ("sweat_loss_ml", "$.hydration.sweatLossInML", None),
        ),
        scale={"active_minutes": 60.0, "highly_active_minutes": 60.0},
    ),
    "json:vo2max": Decoder("$.calendarDate", (("vo2max", "$.vo2MaxValue", 0.1),), (("vo2max_sport", "$.sport"),)),
    "json:training_load": Decoder(
        "$.calendarDate",
        (("training_load_acute", "$.dailyTrainingLoadAcute", None), ("training_load_chronic", "$.dailyTrainingLoadChronic", None), ("training_load_ratio", "$.dailyAcuteChronicWorkloadRatio", None)),
        (("training_load_status", "$.acwrStatus"),),
    ),
    "json:endurance": Decoder("$.calendarDate", (("endurance_score", "$.overallScore", None),)),
    "json:hill": Decoder("$.calendarDate"),
    "json:fitness_age": Decoder("$.asOfDateGmt", (("fitness_age", "$.currentBioAge", None),)),
    "json:biometrics": Decoder("$.metaData.calendarDate", (("weight_kg", "$.weight.weight", None),)),
    "json:readiness": Decoder(
        "$.calendarDate",
        (
            ("training_readiness", "$.score", None), ("readiness_factor_sleep", "$.sleepScoreFactorPercent", None), ("readiness_factor_recovery_time", "$.recoveryTimeFactorPercent", None),
            ("readiness_factor_load_ratio", "$.acwrFactorPercent", None), ("readiness_factor_stress_history", "$.stressHistoryFactorPercent", None),
            ("readiness_factor_hrv", "$.hrvFactorPercent", None), ("readiness_factor_sleep_history", "$.sleepHistoryFactorPercent", None),
            ("hrv_weekly_average", "$.hrvWeeklyAverage", 0.1), ("recovery_time", "$.recoveryTime", None),
        ),
        (("training_readiness_level", "$.level"), ("training_readiness_context", "$.inputContext")),
    ),
}
SLEEP_SECONDS = {"deep_s": "$.deepSleepSeconds", "light_s": "$.lightSleepSeconds", "rem_s": "$.remSleepSeconds", "awake_s": "$.awakeSleepSeconds", "unmeasurable_s": "$.unmeasurableSeconds"}
SLEEP_SCORES = {
    "overall_score": "overallScore", "quality_score": "qualityScore", "duration_score": "durationScore", "recovery_score": "recoveryScore", "deep_score": "deepScore", "rem_score": "remScore",
    "light_score": "lightScore", "awakenings_count_score": "awakeningsCountScore", "awake_time_score": "awakeTimeScore", "combined_awake_score": "combinedAwakeScore",
    "restlessness_score": "restfulnessScore", "interruptions_score": "interruptionsScore",
}
SLEEP_COUNTS = {**{c: f"$.sleepScores.{f}" for c, f in SLEEP_SCORES.items()}, "awakenings_count": "$.awakeCount", "lowest_spo2": "$.spo2SleepSummary.lowestSPO2"}
SLEEP_VITALS = {
    "avg_stress": "$.avgSleepStress", "avg_respiration": "$.averageRespiration", "lowest_respiration": "$.lowestRespiration", "highest_respiration": "$.highestRespiration",
    "avg_spo2": "$.spo2SleepSummary.averageSPO2", "avg_hr": "$.spo2SleepSummary.averageHR",
}
SLEEP_TIMES = {"start_ts": "$.sleepStartTimestampGMT", "end_ts": "$.sleepEndTimestampGMT"}
MORNING = "AFTER_WAKEUP_RESET"
LISTED = {
    "$.allDayStress.aggregatorList": "array<struct<type:string,averageStressLevel:double>>",
    "$.bodyBattery.bodyBatteryStatList": "array<struct<bodyBatteryStatType:string,statsValue:double>>",
}


def _schema(types: dict[str, str]) -> str:
    """A struct type that holds the given JSON paths."""
    tree: dict = {}
    for path, kind in types.items():
        *parents, leaf = path.removeprefix("$.").split(".")
        node = tree
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = kind
    ddl = lambda n: n if isinstance(n, str) else "struct<" + ",".join(f"{k}:{ddl(v)}" for k, v in n.items()) + ">"
    return ddl(tree)


def parsed(records: DataFrame, column: str, numbers: list[str], texts: list[str], flags: tuple[str, ...] = (), others: dict[str, str] | None = None) -> DataFrame:
    """Adds parsed_, the record's fields at the given paths, from one pass over the text; a field of another type is null.

    The pass stands in a generator: a filter on its fields is not moved below it, where it would read the text again.
    """
    types = {p: "double" for p in numbers} | {p: "string" for p in texts} | {p: "boolean" for p in flags} | (others or {})
    return records.select("*", F.explode(F.array(F.from_json(column, _schema(types)))).alias("parsed_"))


def _at(path: str) -> Column:
    return F.col("parsed_." + path.removeprefix("$."))


def decode(records: DataFrame, stream: str, column: str = "record") -> DataFrame:
    """Keeps the records' other columns; adds date, metric, value, scope. Records without a date give nothing."""
    d = DECODERS[stream]
    keep = [c for c in records.columns if c != column]
    rows = parsed(records, column, [p for _, p, _ in d.facts], [d.date], ("$.includesWellnessData",), LISTED if stream == "json:uds" else None).withColumn("date", calendar_date(_at(d.date))).where("date is not null")
    if stream == "json:uds":
        rows = rows.where(F.coalesce(_at("$.includesWellnessData"), F.lit(True)))
    facts = [F.struct(F.lit(m).alias("metric"), (_at(p) / d.scale.get(m, 1.0)).alias("value"), F.lit(least).cast("double").alias("least")) for m, p, least in d.facts]
    if stream == "json:biometrics":  # large weights are grams
        w = _at("$.weight.weight")
        facts = [F.struct(F.lit("weight_kg").alias("metric"), F.when(w > 1000, w / 1000).otherwise(w).alias("value"), F.lit(None).cast("double").alias("least"))]
    every = F.array(*facts) if facts else F.array().cast("array<struct<metric:string,value:double,least:double>>")
    if stream == "json:uds":
        stress, battery = (_at(p) for p in LISTED)
        zero, none = F.lit(0.0), F.lit(None).cast("double")
        totals = F.transform(F.filter(F.coalesce(stress, F.array()), lambda x: x.type == "TOTAL"), lambda x: F.struct(F.lit("stress_avg").alias("metric"), x.averageStressLevel.alias("value"), zero.alias("least")))
        name = lambda x: F.when(x.bodyBatteryStatType == "HIGHEST", "body_battery_high").otherwise("body_battery_low")
        stats = F.filter(F.coalesce(battery, F.array()), lambda x: x.bodyBatteryStatType.isin("HIGHEST", "LOWEST"))
        every = F.concat(every, totals, F.transform(stats, lambda x: F.struct(name(x).alias("metric"), x.statsValue.alias("value"), none.alias("least"))))
    out = rows.select(*keep, "date", F.explode(every).alias("f")).where("f.value is not null and (f.least is null or f.value >= f.least)")
    return out.select(*keep, "date", F.col("f.metric").alias("metric"), F.col("f.value").alias("value"), F.lit("vendor_cloud").alias("scope"))


def decode_labels(records: DataFrame, stream: str, column: str = "record") -> DataFrame:
    d = DECODERS[stream]
    keep = [c for c in records.columns if c != column]
    rows = parsed(records, column, [], [d.date, *(p for _, p in d.labels)]).withColumn("date", calendar_date(_at(d.date))).where("date is not null")
    labels = [F.struct(F.lit(m).alias("metric"), F.lower(_at(p)).alias("label")) for m, p in d.labels]
    every = F.array(*labels) if labels else F.array().cast("array<struct<metric:string,label:string>>")
    return rows.select(*keep, "date", F.inline(every)).where("label is not null")


def pick_readiness(records: DataFrame, column: str = "record") -> DataFrame:
    """One record a date: the morning's where there is one, else the latest; repeats of a timestamp are one record."""
    rows = parsed(records, column, [], ["$.calendarDate", "$.timestamp", "$.inputContext"]).withColumn("date", calendar_date(_at("$.calendarDate"))).withColumn("stamp", _at("$.timestamp"))
    rows = rows.where("date is not null and stamp is not null").withColumn("morning", F.coalesce(_at("$.inputContext") == MORNING, F.lit(False)))
    once = rows.groupBy("stamp").agg(F.min(F.struct(F.sha2(F.col(column), 256).alias("digest"), F.col(column), "date", "morning")).alias("r"))
    return once.groupBy("r.date").agg(F.max(F.struct("r.morning", "stamp", F.col(f"r.{column}").alias(column))).alias("b")).select("date", f"b.{column}")


def decode_sleep(records: DataFrame, column: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """One wide row a night; seconds asleep are of the stages that are there."""
    rows = parsed(records, column, [*SLEEP_SECONDS.values(), *SLEEP_COUNTS.values(), *SLEEP_VITALS.values()], ["$.calendarDate", *SLEEP_TIMES.values()], ("$.retro",))
    rows = rows.withColumn("date", calendar_date(_at("$.calendarDate"))).where("date is not null")
    whole = lambda p, kind: F.bround(_at(p), 0).cast(kind)
    rows = rows.select(
        *keep, "date", *(gmt(_at(p)).alias(c) for c, p in SLEEP_TIMES.items()), *(whole(p, "long").alias(c) for c, p in SLEEP_SECONDS.items()), *(whole(p, "int").alias(c) for c, p in SLEEP_COUNTS.items()),
        *(_at(p).alias(c) for c, p in SLEEP_VITALS.items()), F.coalesce(_at("$.retro"), F.lit(False)).alias("retro"),
    )
    some = F.coalesce("deep_s", "light_s", "rem_s").isNotNull()
    return rows.withColumn("asleep_s", F.when(some, F.coalesce("deep_s", F.lit(0)) + F.coalesce("light_s", F.lit(0)) + F.coalesce("rem_s", F.lit(0))))


def completed_16bit(short: Column, full: Column) -> Column:
    """A 16-bit time stamp completed to the instant next to a full one."""
    delta = F.pmod(short - F.pmod(full, F.lit(65536)), F.lit(65536))
    return full + F.when(delta >= 32768, delta - 65536).otherwise(delta)


def expand_16bit(rows: DataFrame, by: str, order: str) -> DataFrame:
    """16-bit time stamps (ts16) completed from the last full one before them in their file (last_full_s)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_full_s", F.last("full_ts", True).over(w))
    return rows.withColumn("ts_s", F.when(F.col("ts16").isNull(), F.col("full_ts")).otherwise(completed_16bit(F.col("ts16"), F.col("last_full_s"))))
