"""Exact medians of groups of any size, by selection instead of sorting.

A mergeable sketch brackets the middle of each group: its ranks are off by ``1 / ACCURACY`` of the group at most, the bracket is four times as
wide on either side. A second pass counts what lies below the bracket, and how often each value inside occurs; both are summed
before the shuffle. Only the distinct values inside, a few thousandths of a group at most, are ordered. Small groups are their own bracket.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 20_000
MARGIN = 4 / ACCURACY


def medians(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, lower, upper: the middle value of each group's values, or the two of them. Null values are left out; groups may have null keys."""
    rows = rows.select(F.struct(*by).alias("group"), F.col(value).alias("v")).where("v is not null")
    sketch = F.percentile_approx("v", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    bracket = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), sketch.alias("middle"))
    small = F.col("n") <= ACCURACY
    bracket = bracket.select(F.col("group").alias("of"), "n", F.when(small, F.col("low")).otherwise(F.col("middle")[0]).alias("low"), F.when(small, F.col("high")).otherwise(F.col("middle")[1]).alias("high"))
    met = rows.join(bracket, F.col("group").eqNullSafe(F.col("of"))).where("v <= high")
    counted = met.groupBy("group", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("times"))  # null: below
    upto = counted.withColumn("upto", F.sum("times").over(Window.partitionBy("group").orderBy(F.col("v").asc_nulls_first())))
    rank = {"lower": F.floor((F.col("n") + 1) / 2), "upper": F.floor(F.col("n") / 2) + 1}
    reached = {name: F.min(F.when(F.col("upto") >= k, F.struct("upto", "v"))).alias(name) for name, k in rank.items()}
    out = upto.groupBy("group", "n").agg(*reached.values())
    bracketed = functools.reduce(Column.__and__, (F.col(f"{name}.v").isNotNull() for name in rank))
    sure = lambda name: F.when(bracketed, F.col(f"{name}.v")).otherwise(F.raise_error(F.lit("a sketch missed the middle of its group")))
    return out.select("group.*", "n", sure("lower").alias("lower"), sure("upper").alias("upper"))
