"""Which of several rows with one key stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in content order; a pre-aggregated maximum, not a window."""
    return _pick(rows, keys, order, F.max)


def first_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(rows, keys, order, F.min)


def _pick(rows: DataFrame, keys: list[str], order: list[str], best) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(best(F.struct(*order, *rest)).alias("p"))
    return picked.select(*keys, *(F.col(f"p.{c}").alias(c) for c in rows.columns if c not in keys))


def latest_observed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert by observation time, in content order: a row loses only if both times are known and its own is older.

    A null time replaces and is replaced by anything. So nothing before a key's last row without a time matters, and of that row and those
    behind it the latest observed holds, ties by order; both are maxima, which are aggregated before the shuffle. A key's
    versions are never collected. Rows without a time meet the others as one a key, so ``rows`` that are known to have none are read once;
    keep others first if they are dear.
    """
    rest = [c for c in rows.columns if c not in keys]
    versions = rows.select(F.struct(*keys).alias("key"), "observed", F.struct(order, F.struct(*rest).alias("version")).alias("v"))
    untimed = versions.where("observed is null").groupBy("key").agg(F.max("v").alias("v"))
    cut = untimed.select(F.col("key").alias("of"), F.col(f"v.{order}").alias("cut"))
    timed = versions.where("observed is not null").join(cut, F.col("key").eqNullSafe(F.col("of")), "left").where(F.col("cut").isNull() | (F.col(f"v.{order}") >= F.col("cut")))
    left = timed.select(*versions.columns).unionByName(untimed, allowMissingColumns=True)
    best = left.groupBy("key").agg(F.max(F.struct("observed", "v")).alias("best"))
    return best.select("key.*", *(F.col(f"best.v.version.{c}").alias(c) for c in rest))


def conflict_winner(rows: DataFrame, keys: list[str], by_hash: Column | None = None) -> DataFrame:
    """The later observed version, ties by the larger payload hash; unknown times lose.

    by_hash says of which rows only the hash decides: those of batch streams and those that do not decode.
    """
    if by_hash is not None:
        groups = rows.groupBy(*keys).agg(F.bool_or(by_hash).alias("hashed"))
        rows = rows.join(groups, keys).withColumn("seen", F.when(~F.col("hashed"), F.col("observed"))).drop("hashed")
        return last_write(rows, keys, ["seen", "payload_hash"]).drop("seen")
    return last_write(rows, keys, ["observed", "payload_hash"])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_write(rows, keys, order)


def content_order(start: str, digest: str, stream: str, source_key: str) -> Column:
    """The one tie-break of the store as a column that orders: start (nulls first), digest, stream, key."""
    return F.struct(start, digest, stream, source_key)
