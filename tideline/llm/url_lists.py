"""URL filters by temporal list join.

Dated list events (key, verdict, action, at) become validity intervals; every capture is held against the entries that
were active when it was fetched. Keys are ``d:`` + a domain, which covers its subdomains, or ``p:`` + host and path, which
covers what is below that path. The longest active key decides; a path wins against a domain of the same length.

Defined results: events of one key are ordered by (at, action) and the last one before or at the fetch holds, so a
removal wins a tie; events with a null key or time, and captures with a null time, match nothing; a null or odd URL has
host '' and no keys; IP addresses (IPv6 in brackets) have no parent domains; repeated captures are one row with ``n_captures``; an
empty list lets everything through. Of a very long URL only as many labels and parts make keys as the longest listed keys have,
so keys stay few and none that could match is left out.

The join is an equality join on the key with the interval as its condition. The list has one active entry a key at any
time, so a host with a third of all rows makes no more than one row a capture and key, and adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def keys_of(host: Column, path: Column, most_labels: Column, most_parts: Column) -> Column:
    """Keys that can match: no longer in labels and parts than the longest listed ones. An address is its own only domain."""
    none = F.array().cast("array<string>")
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    parts = F.slice(F.split(path, "/", -1), F.lit(1), F.greatest(most_parts, F.lit(1)))
    first = F.greatest(F.size(labels) - most_labels + 1, F.lit(1))
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    below = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("p:"), host, F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(F.when(first <= F.size(labels), domains).otherwise(none), F.when(F.size(parts) > 1, below).otherwise(none))))


def longest(events: DataFrame) -> DataFrame:
    """One row: the most labels of a listed domain (an address counts as one) and the most parts of a listed path."""
    text = F.substring("key", 3, 1 << 30)
    labels = F.when(text.rlike(ADDRESS), 1).otherwise(F.size(F.split(text, r"\.")))
    most = events.agg(F.max(F.when(F.col("key").startswith("d:"), labels)).alias("l"), F.max(F.when(F.col("key").startswith("p:"), F.size(F.split(text, "/")))).alias("p"))
    return most.select(F.coalesce("l", F.lit(0)).alias("most_labels"), F.coalesce("p", F.lit(0)).alias("most_parts"))


def intervals(events: DataFrame) -> DataFrame:
    """key, verdict, valid_from, valid_to (exclusive) of every stretch in which an entry holds."""
    events = events.where(F.col("key").isNotNull() & F.col("at").isNotNull()).select("key", "verdict", "action", "at").distinct()
    order = Window.partitionBy("key").orderBy("at", "action", "verdict")
    return (
        events.withColumn("next", F.coalesce(F.lead("at").over(order), F.lit(FOREVER).cast("date")))
        .where((F.col("action") == "add") & (F.col("at") < F.col("next")))
        .select("key", "verdict", F.col("at").alias("valid_from"), F.col("next").alias("valid_to"))
    )


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures: page_id, url, fetched (date). One row a distinct capture with the entry that decides, if any."""
    seen = captures.groupBy("page_id", "url", "fetched").agg(F.count(F.lit(1)).alias("n_captures"))
    seen = seen.withColumn("host", host_of(F.col("url")))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), PATH, 1)
    keys = keys_of(F.col("host"), path, F.col("most_labels"), F.col("most_parts"))
    keyed = seen.crossJoin(F.broadcast(longest(events))).withColumn("key", F.explode_outer(keys)).drop("most_labels", "most_parts")
    listed = intervals(events).withColumnRenamed("key", "listed")
    hit = keyed.join(
        listed, (F.col("key") == F.col("listed")) & (F.col("valid_from") <= F.col("fetched")) & (F.col("fetched") < F.col("valid_to")), "left"
    )
    rule = F.when(F.col("listed").isNotNull(), F.struct(F.length("listed").alias("n"), F.col("listed").alias("key"), "verdict", "valid_from"))
    best = hit.groupBy("page_id", "url", "fetched", "host", "n_captures").agg(F.max(rule).alias("rule"))
    return best.select(
        "page_id", "url", "fetched", "host", "n_captures",
        F.col("rule.key").alias("rule_key"), F.col("rule.valid_from").alias("rule_from"),
        F.coalesce(F.col("rule.verdict") == "block", F.lit(False)).alias("blocked"),
    )


def number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def dated_lists(hosts: DataFrame) -> DataFrame:
    """A synthetic dated list over hosts: block and allow entries that come, go and come again."""
    n = number(F.col("host"))
    domain = F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int"))
    event = lambda key, verdict, action, at: F.struct(key.alias("key"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), day(at).alias("at"))
    host_key = F.concat(F.lit("d:"), F.col("host"))
    own = hosts.where((F.col("host") != "") & F.col("host").contains(".")).select(
        F.explode(
            F.array(
                event(host_key, "block", "add", n % 300), event(host_key, "block", "remove", n % 300 + 10 + n % 40), event(host_key, "block", "add", n % 300 + 60 + n % 7),
                event(F.concat(F.lit("p:"), F.col("host"), F.lit("/en")), "allow", "add", n % 200),
            )
        ).alias("e"),
        (n % 3).alias("pick"),
    )
    own = own.where(F.col("pick") == 0).select("e.*")
    domains = hosts.where(F.col("host").contains(".")).select(domain.alias("host")).distinct()
    wide = domains.where(n % 2 == 0).select(event(host_key, "block", "add", n % 366).alias("e")).select("e.*")
    return own.unionByName(wide)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int")))
    return filter_urls(captures, dated_lists(hosts))


OP8_SQL = r"""
WITH p AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS DATE) AS fetched,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '.') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS n FROM p WHERE contains(host, '.')),
d AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS n
  FROM (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS host FROM h)),
ev AS (
  SELECT 'd:' || host AS key, 'block' AS verdict, 'add' AS action, n % 300 AS k FROM h WHERE n % 3 = 0
  UNION SELECT 'd:' || host, 'block', 'remove', n % 300 + 10 + n % 40 FROM h WHERE n % 3 = 0
  UNION SELECT 'd:' || host, 'block', 'add', n % 300 + 60 + n % 7 FROM h WHERE n % 3 = 0
  UNION SELECT 'p:' || host || '/en', 'allow', 'add', n % 200 FROM h WHERE n % 3 = 0
  UNION SELECT 'd:' || host, 'block', 'add', n % 366 FROM d WHERE n % 2 = 0),
iv AS (SELECT key, verdict, action, k, lead(k, 1, 9999999) OVER (PARTITION BY key ORDER BY k, action, verdict) AS nxt FROM ev),
act AS (SELECT key, verdict, CAST(DATE '2024-01-01' + CAST(k AS INTEGER) AS DATE) AS f, CAST(DATE '2024-01-01' + CAST(nxt AS INTEGER) AS DATE) AS t FROM iv
  WHERE action = 'add' AND k < nxt),
c AS (SELECT page_id, url, fetched, host, path, count(*) AS n_captures FROM p GROUP BY ALL),
ks AS (
  SELECT c.*, unnest(list_distinct(list_concat(
      CASE WHEN regexp_matches(host, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') THEN ['d:' || host] ELSE
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'd:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END,
      list_transform(range(2, len(string_split(path, '/')) + 1), lambda i: 'p:' || host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))))) AS key
  FROM c WHERE host <> ''),
b AS (SELECT page_id, url, fetched, max_by(act.key, (length(act.key), act.key)) AS rule_key, max_by(act.f, (length(act.key), act.key)) AS rule_from,
    max_by(act.verdict, (length(act.key), act.key)) AS verdict
  FROM ks JOIN act ON ks.key = act.key AND act.f <= fetched AND fetched < act.t GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched, c.host, c.n_captures, b.rule_key, b.rule_from, coalesce(b.verdict = 'block', false) AS blocked
FROM c LEFT JOIN b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url IS NOT DISTINCT FROM b.url AND c.fetched IS NOT DISTINCT FROM b.fetched
"""
