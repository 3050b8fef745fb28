"""The metric contract: names, units, cadences, scopes and the streams that can supply each metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE, DAILY = "sample", "daily"

# Metric names and units.
SAMPLE_METRICS = {
    "heart_rate": "bpm", "stress": "score", "respiration_rate": "breaths/min", "spo2": "%", "hrv_rmssd": "ms", "energy_reserve": "score",
}
DAILY_METRICS = {
    "steps": "steps", "distance": "m", "resting_heart_rate": "bpm", "resting_heart_rate_current_day": "bpm", "heart_rate_min": "bpm",
    "heart_rate_max": "bpm", "stress_avg": "score", "energy_reserve_high": "score", "energy_reserve_low": "score",
    "energy_reserve_charged": "score", "energy_reserve_drained": "score", "spo2_avg": "%", "spo2_lowest": "%",
    "respiration_avg_waking": "breaths/min", "respiration_lowest": "breaths/min", "respiration_highest": "breaths/min",
    "intensity_minutes_moderate": "min", "intensity_minutes_vigorous": "min", "calories_total": "kcal", "calories_active": "kcal",
    "calories_bmr": "kcal", "resting_metabolic_rate": "kcal/day", "sleep_score": "score", "sleep_duration": "min",
    "hrv_weekly_average": "ms", "hrv_last_night_average": "ms", "hrv_last_night_5min_high": "ms", "hrv_baseline_low_upper": "ms",
    "hrv_baseline_balanced_lower": "ms", "hrv_baseline_balanced_upper": "ms", "skin_temp_nightly": "degC", "skin_temp_deviation": "degC",
    "skin_temp_7day_deviation": "degC", "vo2max": "mL/kg/min", "body_battery_high": "score", "body_battery_low": "score",
    "body_battery_charged": "score", "body_battery_drained": "score", "training_readiness": "score", "readiness_factor_sleep": "%",
    "readiness_factor_recovery_time": "%", "readiness_factor_load_ratio": "%", "readiness_factor_stress_history": "%",
    "readiness_factor_hrv": "%", "readiness_factor_sleep_history": "%", "recovery_time": "h", "training_load_acute": "load",
    "training_load_chronic": "load", "training_load_ratio": "ratio", "endurance_score": "score", "fitness_age": "years", "weight_kg": "kg",
    "active_minutes": "min", "highly_active_minutes": "min", "hydration_ml": "mL", "sweat_loss_ml": "mL",
}
LABELS = ("hrv_status", "training_readiness_level", "training_readiness_context", "vo2max_sport", "training_load_status")
SCOPES = ("device", "vendor_cloud", "local", "live")
SESSION_STREAM = "json:live"
SESSION_SCOPES = ("live",)
FACT_SCOPES = tuple(s for s in SCOPES if s not in SESSION_SCOPES)
PER_MINUTE = ("heart_rate", "stress", "respiration_rate", "energy_reserve")
SPARSE = (
    "vo2max", "vo2max_sport", "weight_kg", "fitness_age", "endurance_score", "hydration_ml", "sweat_loss_ml", "hrv_baseline_low_upper",
    "hrv_baseline_balanced_lower", "hrv_baseline_balanced_upper", "resting_metabolic_rate", "spo2", "spo2_avg", "spo2_lowest",
    "training_load_acute", "training_load_chronic", "training_load_ratio", "training_load_status",
)
#: A daily computed here, and the cloud's daily that answers the same question.
TARGETS = {f"energy_reserve_{x}": f"body_battery_{x}" for x in ("high", "low", "charged", "drained")}
# What each stream supplies, by scope.
SUPPLIES: dict[str, dict[str, tuple[str, ...]]] = {
    "fit:monitoring_b": {
        "device": ("heart_rate", "stress", "energy_reserve", "respiration_rate", "spo2", "resting_heart_rate", "resting_heart_rate_current_day", "resting_metabolic_rate"),
        "local": ("steps", "distance", "stress_avg", "heart_rate_min", "heart_rate_max", *TARGETS),
    },
    "fit:sleep": {"device": ("sleep_score", "sleep_duration")},
    "fit:hrv": {"device": ("hrv_rmssd", "hrv_weekly_average", "hrv_last_night_average", "hrv_last_night_5min_high", "hrv_baseline_low_upper", "hrv_baseline_balanced_lower", "hrv_baseline_balanced_upper", "hrv_status")},
    "fit:skin_temp": {"device": ("skin_temp_nightly", "skin_temp_deviation", "skin_temp_7day_deviation")},
    "fit:metrics": {"device": ("vo2max", "vo2max_sport")},
    "json:uds": {
        "vendor_cloud": (
            "steps", "distance", "resting_heart_rate", "resting_heart_rate_current_day", "heart_rate_min", "heart_rate_max", "stress_avg", "spo2_avg", "spo2_lowest",
            "respiration_avg_waking", "respiration_lowest", "respiration_highest", "intensity_minutes_moderate", "intensity_minutes_vigorous", "calories_total",
            "calories_active", "calories_bmr", *TARGETS.values(), "active_minutes", "highly_active_minutes", "hydration_ml", "sweat_loss_ml",
        )
    },
    "json:sleep": {"vendor_cloud": ("sleep_score", "sleep_duration")},
    "json:readiness": {
        "vendor_cloud": (
            "training_readiness", *(m for m in DAILY_METRICS if m.startswith("readiness_factor_")), "hrv_weekly_average", "recovery_time",
            "training_readiness_level", "training_readiness_context",
        )
    },
    "json:vo2max": {"vendor_cloud": ("vo2max", "vo2max_sport")},
    "json:training_load": {"vendor_cloud": ("training_load_acute", "training_load_chronic", "training_load_ratio", "training_load_status")},
    "json:endurance": {"vendor_cloud": ("endurance_score",)},
    "json:fitness_age": {"vendor_cloud": ("fitness_age",)},
    "json:biometrics": {"vendor_cloud": ("weight_kg",)},
    SESSION_STREAM: {"live": ("heart_rate", "stress", "respiration_rate", "spo2", "energy_reserve")},
}
#: Nightly device streams share the all-day stream's days.
NIGHTLY = ("fit:sleep", "fit:hrv", "fit:skin_temp")
ALL_DAY = "fit:monitoring_b"


def unit_for(metric: str) -> str | None:
    return (SAMPLE_METRICS | DAILY_METRICS).get(metric, "label" if metric in LABELS else None)


def cadence_for(metric: str) -> str | None:
    return SAMPLE if metric in SAMPLE_METRICS else DAILY if metric in DAILY_METRICS or metric in LABELS else None


def metrics(spark: SparkSession) -> DataFrame:
    """ord, metric, unit, cadence, sparse, per_minute: one row a contract metric or label."""
    names = [*SAMPLE_METRICS, *DAILY_METRICS, *LABELS]
    return spark.createDataFrame([(i, m, unit_for(m), cadence_for(m), m in SPARSE, m in PER_MINUTE) for i, m in enumerate(names)], "ord int, metric string, unit string, cadence string, sparse boolean, per_minute boolean")


def streams(spark: SparkSession, sessions: bool = False) -> DataFrame:
    """metric, scope, stream."""
    return spark.createDataFrame([(m, scope, s) for s, by in SUPPLIES.items() if sessions or s != SESSION_STREAM for scope, ms in by.items() for m in ms], "metric string, scope string, stream string")


def dump(spark: SparkSession) -> DataFrame:
    """The whole contract: each metric with its unit, cadence, whether it is sparse or by the minute, and the streams of each scope that supply it."""
    supplied = streams(spark, True).groupBy("metric", "scope").agg(F.array_sort(F.collect_list("stream")).alias("streams"))
    supplied = supplied.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("scope", "streams"))).alias("supplied"))
    return metrics(spark).join(supplied, "metric", "left").withColumn("target", F.create_map(*(F.lit(x) for pair in TARGETS.items() for x in pair))[F.col("metric")]).orderBy("ord")


VERSION = 1
#: How to read what this engine gives.
CONVENTIONS = {
    "time": "Instants are UTC. A local day is the day on the wearer's clock, by the offset that was observed nearest in time; UTC where none is known.",
    "missing_values": "A day or reading without a value has no row; sentinels are dropped and counted, never turned into numbers.",
    "sources": "Each value carries its scope: read from the device, stated by the vendor's cloud, computed here, or from a live session. Scopes are never mixed.",
    "privacy": "Identifiers of devices and of raw records are left out of exports; addresses, paths and long numbers are taken out of texts.",
    "coverage": "A day without a value is failed, empty at its source, or not covered, in that order of what is known about it.",
    "completeness": "The share of a day's covered seconds in which the sensor was worn, in whole percent and at most 100.",
}


def document(spark: SparkSession) -> DataFrame:
    """The contract in one row: version, conventions, scopes, per_minute, sparse, streams and session_streams (metric, scope, streams), metrics and labels (name, unit, cadence, target)."""
    listed = lambda of: [(m, scope, sorted(s for s, by in SUPPLIES.items() if (s == SESSION_STREAM) == of and m in by.get(scope, ()))) for m in (*SAMPLE_METRICS, *DAILY_METRICS, *LABELS) for scope in SCOPES]
    entry = lambda m: (m, unit_for(m), cadence_for(m), TARGETS.get(m))
    supplied, item = "array<struct<metric:string,scope:string,streams:array<string>>>", "array<struct<name:string,unit:string,cadence:string,target:string>>"
    schema = f"version int, conventions map<string,string>, scopes array<string>, per_minute array<string>, sparse array<string>, streams {supplied}, session_streams {supplied}, metrics {item}, labels {item}"
    row = (VERSION, CONVENTIONS, list(SCOPES), list(PER_MINUTE), sorted(SPARSE), *([x for x in listed(of) if x[2]] for of in (False, True)), [entry(m) for m in (*SAMPLE_METRICS, *DAILY_METRICS)], [entry(m) for m in LABELS])
    return spark.createDataFrame([row], schema)


def sort_out(names: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(numeric metrics, labels, unknown names), each in order and without repeats."""
    seen = list(dict.fromkeys(names))
    known = SAMPLE_METRICS | DAILY_METRICS
    return [n for n in seen if n in known], [n for n in seen if n in LABELS], [n for n in seen if n not in known and n not in LABELS]


def check_scope(scope: str | None) -> None:
    if scope is not None and scope not in SCOPES:
        raise ValueError(f"scope is one of {', '.join(SCOPES)}")
