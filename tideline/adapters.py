"""The engine's tables as views of generic ones (events, orders, lineitem), for the catalogue, with the same views as SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import fit_writer as W

FIRST, LAST = "1995-01-01", "2001-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", pick(["device", "vendor_cloud", "local"], F.col("user_id") % 3).alias("scope"),
        F.col("user_id").cast("string").alias("device_id"), F.col("event_id").alias("raw_id"),
    )


def offsets(spark: SparkSession, d: str) -> DataFrame:
    day = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    n = F.unix_date("day")
    shift = F.element_at(F.array(*map(F.lit, (0, 3600, 19800, -18000))), (n % 4 + 1).cast("int"))
    return day.select((F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("ts"), shift.alias("offset_s"), n.cast("long").alias("raw_id"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """metric, scope, day, cents, value, n."""
    o = table(spark, d, "orders")
    scope = F.when(F.col("o_orderstatus") == "O", "device").when(F.col("o_orderstatus") == "F", "vendor_cloud").otherwise("local")
    out = o.groupBy(F.col("o_orderpriority").alias("metric"), scope.alias("scope"), F.to_date("o_orderdate").alias("day"))
    return out.agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n")).withColumn("value", F.col("cents") / 100)


STREAMS = ["fit:monitoring_b", "fit:sleep", "json:uds", "json:sleep", "json:live"]


def raw(spark: SparkSession, d: str) -> DataFrame:
    """raw_id, stream, start_ts, end_ts, device_id."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("start_ts"))
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("timestamp").alias("end_ts"))
    rows = o.join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("raw_id"), pick(STREAMS, F.col("o_custkey") % 5).alias("stream"), "start_ts", F.greatest("start_ts", F.coalesce("end_ts", "start_ts")).alias("end_ts"), (F.col("o_custkey") % 7).cast("string").alias("device_id"))


def failures(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("raw_id") % 100 != 0
    return raw(spark, d).where("raw_id % 50 = 0").select("raw_id", "stream", F.when(own, F.col("start_ts")).alias("start_ts"), F.when(own, F.col("start_ts")).alias("end_ts"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    r = raw(spark, d).where("raw_id % 500 = 0")
    return r.select("stream", F.to_date("start_ts").alias("from_day"), F.date_add(F.to_date("start_ts"), 2).alias("to_day"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """stream, kind, start_ts, end_ts of records, claims and failures: ``raw``, ``claims`` and ``failures`` from one pass."""
    r, own = raw(spark, d), F.col("raw_id") % 100 != 0
    day = F.to_date("start_ts").cast("timestamp")
    span = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("start_ts"), high.alias("end_ts"))
    kept = F.col("stream") != "json:live"
    every = F.array(
        F.when(kept, span("covered", F.col("start_ts"), F.col("end_ts"))), F.when(F.col("raw_id") % 500 == 0, span("covered", day, day + F.expr("INTERVAL 3 DAYS"))),
        F.when(kept & (F.col("raw_id") % 50 == 0), span("failed", F.col("start_ts"), F.when(own, F.col("start_ts")).otherwise(F.col("end_ts")))),
    )
    return r.select("stream", F.inline(F.filter(every, lambda x: x.isNotNull())))


FIT_FROM = 1_704_067_200
FIT_TYPES = (32, 49, 68, 73, 44)


def fit_fixture(u: int, ids: list[int]) -> bytes:
    """A file with every message that is decoded; its values follow from the user's number, the events' and their ranks.

    Fields that a large number would not fit are wider: a definition states the types of its fields.
    """
    base = W.stamp(FIT_FROM + 100_000 * u)
    t = lambda r: W.wide(W.U32, base + 60 * r)
    ahead = (u % 5 - 2) * 3600 if u % 7 else 30 * 3600
    out = [
        (0, {0: (W.ENUM, FIT_TYPES[u % 5]), 3: W.wide(W.U32Z, 1000 + u), 4: t(0)}), (103, {253: t(0), 0: W.wide(W.U32, base + ahead), 5: W.wide(W.U16, 1500 + u)}),
        (211, {253: t(0), 0: (W.U8, u % 3 * 50), 1: (W.U8, 40 + u % 30)}), (21, {253: t(0), 0: (W.ENUM, 74), 1: (W.ENUM, 0)}),
    ]
    for r, e in enumerate(ids, 1):
        when = {253: t(r)} if r % 4 == 1 else {26: (W.U16, (base + 60 * r) & 0xFFFF)}
        out += [
            (55, when | {27: (W.U8, e % 120), 24: (W.BYTE, (6 if r % 2 else 2) | r % 7 << 5), 3: (W.U32, 10 * r), 2: (W.U32, 150 * r)}), (227, {1: t(r), 0: (W.S16, e % 110 - 5), 3: (W.U8, e % 130)}),
            (297, {253: t(r), 0: (W.S16, e % 400 - 20)}), (269, {253: t(r), 0: (W.U8, e % 100), 2: (W.ENUM, r % 3)}), (371, {253: t(r), 0: (W.U16, e % 2000)}),
        ]
        if r <= 12:
            out.append((275, {253: t(r), 0: (W.ENUM, (r + u) % 5)}))
    out += [
        (370, {253: t(1), 6: (W.ENUM, u % 5)} | {k: W.wide(W.U16, 5000 + 100 * k + u) for k in range(6)}), (398, {253: t(1), 0: W.wide(W.U32, base + 60 + ahead), 4: (W.F32, 35.5 + u % 8 / 4), 1: (W.F32, u % 5 / 8), 2: (W.F32, -u % 7 / 4)}),
        (229, {0: t(2), 2: W.wide(W.U16, 400 + u if u % 4 else 0), 5: (W.ENUM, u % 3)}), (346, {k: (W.U8, (u + k) % 100) for k in range(12)} | {14: (W.U8, u % 90), 15: (W.U16, 7 * u % 10_000)}),
        (21, {253: t(len(ids) + 5), 0: (W.ENUM, 74), 1: (W.ENUM, 1)}),
        (18, {253: t(30), 2: t(3), 5: (W.ENUM, 1), 6: (W.ENUM, u % 6), 7: W.wide(W.U32, 1000 * u + 500), 8: W.wide(W.U32, 1000 * u), 9: W.wide(W.U32, 100 * u), 11: W.wide(W.U16, u), 16: (W.U8, 120), 17: (W.U8, 180), 14: (W.U16, 2500), 22: W.wide(W.U16, u), 23: W.wide(W.U16, u // 2)}
         | ({124: (W.U32, 2600)} if u % 2 else {})),
    ]
    return W.write(out, b"\x0f" if u % 9 == 8 else b"")


def fit_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content: a file a user of events; those of every ninth user end in bytes that are no message."""

    @F.pandas_udf("binary")
    def build(u: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([fit_fixture(int(a), [int(x) for x in b]) for a, b in zip(u, ids, strict=True)])

    users = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return users.select(F.col("user_id").cast("string").alias("path"), build("user_id", "ids").alias("content"))


FIT_SQL = f"""FU AS (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
FT AS (SELECT *, to_timestamp({FIT_FROM} + u * 100000 + r * 60)::TIMESTAMP AS ts FROM FU),
FF AS (SELECT u, max(r) AS n, {FIT_FROM} + u * 100000 AS base, [{', '.join(map(str, FIT_TYPES))}][u % 5 + 1] AS kind, CASE WHEN u % 7 <> 0 THEN (u % 5 - 2) * 3600 ELSE 108000 END AS ahead FROM FU GROUP BY u)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    streams = F.when(F.col("scope") == "device", F.array(F.lit("fit:monitoring_b"), F.lit("fit:sleep"))).when(F.col("scope") == "vendor_cloud", F.array(F.lit("json:uds"))).otherwise(F.array(F.lit("json:sleep")))
    return daily(spark, d).select("metric", "scope").distinct().select("metric", "scope", F.explode(streams).alias("stream"))


SQL = """
S AS (SELECT event_type AS metric, ts, value, CASE user_id % 3 WHEN 0 THEN 'device' WHEN 1 THEN 'vendor_cloud' ELSE 'local' END AS scope,
  CAST(user_id AS VARCHAR) AS device_id, event_id AS raw_id, epoch_us(ts) AS us FROM events),
ODAY AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
O AS (SELECT epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR) AS m,
  CASE date_diff('day', DATE '1970-01-01', day) % 4 WHEN 0 THEN 0 WHEN 1 THEN 3600 WHEN 2 THEN 19800 ELSE -18000 END AS off FROM ODAY),
REG AS (SELECT off, coalesce(lag(m) OVER (ORDER BY m) + m, -4611686018427387904) AS lo2, coalesce(lead(m) OVER (ORDER BY m) + m, 4611686018427387904) AS hi2 FROM O),
L AS (SELECT S.*, REG.off AS off, CAST(ts + to_seconds(CAST(REG.off AS BIGINT)) AS DATE) AS local_day FROM S JOIN REG ON 2 * us > lo2 AND 2 * us <= hi2),
D AS (SELECT o_orderpriority AS metric, CASE o_orderstatus WHEN 'O' THEN 'device' WHEN 'F' THEN 'vendor_cloud' ELSE 'local' END AS scope,
  CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders GROUP BY ALL),
LE AS (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1),
RAW AS (SELECT o_orderkey AS raw_id, ['fit:monitoring_b', 'fit:sleep', 'json:uds', 'json:sleep', 'json:live'][o_custkey % 5 + 1] AS stream, o_orderdate AS start_ts,
  greatest(o_orderdate, coalesce(e, o_orderdate)) AS end_ts, CAST(o_custkey % 7 AS VARCHAR) AS device_id FROM orders LEFT JOIN LE ON o_orderkey = l_orderkey),
FAILED_RAW AS (SELECT raw_id, stream, start_ts AS s, CASE WHEN raw_id % 100 <> 0 THEN start_ts ELSE end_ts END AS e FROM RAW WHERE raw_id % 50 = 0 AND stream <> 'json:live'),
CLAIM AS (SELECT stream, CAST(start_ts AS DATE) AS a, CAST(start_ts AS DATE) + 2 AS b FROM RAW WHERE raw_id % 500 = 0),
P AS (SELECT DISTINCT metric, scope, unnest(CASE scope WHEN 'device' THEN ['fit:monitoring_b', 'fit:sleep'] WHEN 'vendor_cloud' THEN ['json:uds'] ELSE ['json:sleep'] END) AS stream FROM D),
CAL AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
COV0 AS (SELECT DISTINCT stream, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (
  SELECT stream, CAST(start_ts AS DATE) AS s, CAST(greatest(start_ts, end_ts - INTERVAL 1 MICROSECOND) AS DATE) AS e FROM RAW WHERE stream <> 'json:live'
  UNION ALL SELECT stream, a, b FROM CLAIM)),
COV AS (SELECT stream, day FROM COV0 SEMI JOIN CAL USING (day) UNION SELECT unnest(['fit:sleep', 'fit:hrv', 'fit:skin_temp']), day FROM COV0 SEMI JOIN CAL USING (day) WHERE stream = 'fit:monitoring_b'),
FAI AS (SELECT DISTINCT stream, CAST(unnest(generate_series(CAST(CAST(s AS DATE) AS TIMESTAMP), CAST(CAST(greatest(s, e - INTERVAL 1 MICROSECOND) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM FAILED_RAW),
ST AS (SELECT metric, scope, day, CASE WHEN EXISTS (SELECT 1 FROM D WHERE D.metric = g.metric AND D.scope = g.scope AND D.day = g.day) THEN 'present'
    WHEN EXISTS (SELECT 1 FROM P JOIN FAI USING (stream) WHERE P.metric = g.metric AND P.scope = g.scope AND FAI.day = g.day) THEN 'failed'
    WHEN EXISTS (SELECT 1 FROM P JOIN COV USING (stream) WHERE P.metric = g.metric AND P.scope = g.scope AND COV.day = g.day) THEN 'source_empty' ELSE 'not_covered' END AS status
  FROM (SELECT metric, scope, day FROM (SELECT DISTINCT metric, scope FROM P) CROSS JOIN CAL) AS g)
"""
