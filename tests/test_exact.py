"""Exact rounding, exact medians by selection and the latest observation, against plain Python."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F
from tideline.functions import scalars
from tideline.operators import dedupe, selection


def test_rounding_is_python_s(spark):
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) * 10 ** rng.uniform(-12, 18) for _ in range(150_000)] + [rng.randrange(-10**7, 10**7) / 10 ** rng.randrange(0, 7) for _ in range(150_000)]
    values += [k / 2**b for k in range(-3000, 3000, 3) for b in (1, 2, 3, 5, 9)] + [(2**52 + k) / 2**b for k in range(-40, 40) for b in (0, 1, 3, 10)] + [math.nextafter(k / 1000 + 0.0005, d) for k in range(3000) for d in (-1e9, 1e9)]
    values += [0.0, -0.0, math.inf, -math.inf, 1e308, 5e-324, 2.675, 1.005, 0.125, 2.5, 3.5, -2.5, 4503599627370496.5, 9007199254740993.0]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for digits in (0, 1, 2, 3, 6):
        got = [r.x for r in df.select(scalars.round_exact(F.col("v"), digits).alias("x")).collect()]
        wrong = [(v, g) for v, g in zip(values, got, strict=True) if g != round(v, digits)] if digits else [(v, g) for v, g in zip(values, got, strict=True) if g != (round(v, 0) if math.isfinite(v) else v)]
        assert not wrong, wrong[:5]
    odd = spark.sql("select cast('NaN' as double) as v union all select null").select(scalars.round_exact(F.col("v"), 2).alias("x")).collect()
    assert math.isnan(odd[0].x) and odd[1].x is None
    shown = spark.createDataFrame([(2.0625,), (0.0005,), (0.0015,), (3.0,), (-1.25,)], "v double").select(scalars.plain_number(F.col("v")).alias("x"))
    assert [r.x for r in shown.collect()] == ["2.062", "0.001", "0.002", "3", "-1.25"]


def test_medians_by_selection(spark, monkeypatch):
    rng = random.Random(9)
    groups = {("hot", None): [rng.gauss(50, 9) for _ in range(60_000)], ("ties", "a"): [float(rng.randrange(60, 64)) for _ in range(50_000)], ("two", "a"): [3.0, 1.0], ("one", None): [7.5], ("even", "b"): [float(k) for k in range(10)], ("spread", "b"): [10.0 ** rng.uniform(-300, 300) for _ in range(30_001)]}
    rows = [(m, s, v) for (m, s), vs in groups.items() for v in vs] + [("none", "a", None)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["m", "s", "v"]).astype({"m": object, "s": object}), "m string, s string, v double").repartition(6)
    got = {(r.m, r.s): (r.n, r.lower, r.upper) for r in selection.medians(df.replace(float("nan"), None), "v", "m", "s").collect()}
    want = {k: (len(v), sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]) for k, v in groups.items()}
    assert got == want
    plan = selection.medians(df, "v", "m", "s")._jdf.queryExecution().executedPlan().toString()
    assert "percentile_disc" not in plan and "collect_list" not in plan


def test_latest_observed_is_the_fold(spark):
    rng = random.Random(2)
    rows = [(k, None if k % 3 else "d", n, rng.choice([None, None, 1, 2, 3, 4, 5, 6]) if k % 4 else rng.randrange(9), rng.random()) for k in range(300) for n in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "k long, d string, n int, observed int, value double").repartition(5)
    want = {}
    for k, _, n, observed, value in sorted(rows, key=lambda r: (r[0], r[2])):
        held = want.get(k)
        if held is None or observed is None or held[1] is None or observed >= held[1]:
            want[k] = (n, observed, value)
    out = dedupe.latest_observed(df, ["k", "d"], "n")
    assert {r.k: (r.n, r.observed, r.value) for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
