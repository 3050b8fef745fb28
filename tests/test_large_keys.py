"""Queries against their SQL on tables whose keys are those of far larger ones."""

import os
import time

import duckdb
import pytest

from tideline import catalogue
from tideline.sources import files, snapshots

from .test_catalogue import DATA, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
FIT = (
    "fit_drops", "fit_labels", "import_files", "reparsed", "clock_offsets", "fit_activities", "fit_dailies", "fit_intervals", "fit_messages", "fit_spans", "fit_nights", "fit_samples", "fit_stages",
    "imported_heart_rate", "nested_archives",
)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """(folder, connection): users up to half a million, records up to nine million."""
    folder, con = str(tmp_path_factory.mktemp("large")), duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    changed = {
        "events": "* REPLACE (user_id * 39989 AS user_id)", "orders": "* REPLACE (o_orderkey + 8998500 AS o_orderkey)", "lineitem": "* REPLACE (l_orderkey + 8998500 AS l_orderkey)",
    }
    for t in TABLES:
        con.execute(f"COPY (SELECT {changed.get(t, '*')} FROM '{DATA}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, con


def equal(spark, large, name):
    folder, con = large
    df = catalogue.QUERIES[name](spark, folder)
    df = df.select(*(df[c].cast("string") if t == "timestamp" else df[c] for c, t in df.dtypes))
    want = con.execute(f"SELECT * FROM ({catalogue.ORACLE_SQL[name]})")
    columns = [c[0] for c in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", FIT)
def test_files_of_users_with_large_numbers(spark, large, name):
    equal(spark, large, name)


def test_report_names_records_with_large_numbers(spark, large):
    equal(spark, large, "data_health")


def test_long_live_files_are_split_once(spark):
    """Splitting the text again for each line takes minutes here."""
    many = 12_000
    text = "\n".join(f'{{"t":{1_700_000_000 + k},"metric":"heart_rate","value":{k % 200}}}' for k in range(many))
    began = time.time()
    (found,) = files.live_lines(spark.createDataFrame([("a", text)], "path string, text string")).selectExpr("size(readings) AS n", "readings[11999].t AS last", "cut_off").collect()
    assert (found.n, found.last, found.cut_off) == (many, 1_700_011_999.0, False)
    assert time.time() - began < 30


def test_days_in_many_ranges(spark):
    days = {-1_000_000, *range(20_000, 38_000, 3)}
    rows = spark.range(19_000, 40_000).selectExpr("id AS d").union(spark.sql("SELECT * FROM VALUES (-1000000L), (CAST(NULL AS BIGINT)), (-999999L)"))
    found = rows.where(snapshots.within(rows["d"], days)).collect()
    assert sorted(r.d for r in found) == sorted(days)


def test_replayed_records_are_decoded_once(spark):
    """The facts come from kept messages: their plan decodes no file again, and reads the JSON records once."""
    plan = catalogue.QUERIES["reparsed"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan
    assert sum("Relation" in line and "event_id" in line for line in plan.splitlines()) == 1
