"""Every named query against its SQL, and the whole workflow end to end."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from fleetspark.catalog.oracles import ORACLES
from fleetspark.catalog.queries import ORDER, QUERIES, raw_export
from fleetspark.plans.workflow import analyse, prepare_tables

SF_DIR = "/root/testdata/sf0.001"
# At the smallest scale these tables have no rows.
LARGER = {"session_times", "session_times_plain", "session_overview", "session_trace", "centers_near_session", "map_points_short", "map_points_box"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("sf0.001", "sf0.01"):
        con.sql(f"CREATE SCHEMA \"{name}\"")
        con.sql(f"CREATE VIEW \"{name}\".events AS SELECT * FROM '/root/testdata/{name}/events.parquet'")
    yield con
    con.close()


def cells(df):
    def plain(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v) + 0.0)
        return str(pd.Timestamp(v)) if hasattr(v, "year") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, row)) for row in df.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    sf = "sf0.01" if name in LARGER else "sf0.001"
    got = QUERIES[name](spark, f"/root/testdata/{sf}").toPandas()
    duck.sql(f'USE "{sf}"')
    want = duck.sql(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
    assert len(got)


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 998


def test_workflow_end_to_end(spark, tmp_path):
    out = str(tmp_path)
    raw = raw_export(spark, SF_DIR)
    tables = prepare_tables(raw, out)
    assert tables["telemetry"].count() == raw.count() - 1
    assert tables["sample_1min"].count() == 998 and tables["sample_10min"].count() == 984
    again = spark.read.parquet(f"{out}/telemetry_backup")
    assert again.count() == tables["telemetry"].count()
    answers = analyse(tables, out, k=4)
    assert answers["field_centers"].count() > 0
    rows = answers["sessions"]
    assert rows.count() == 998
    per_machine = rows.groupBy("serial_number").agg(
        F.max("session_id").alias("last"), F.count_distinct("session_id").alias("n")
    )
    assert per_machine.filter("last <> n").count() == 0
    inside = rows.filter((F.col("symb") == 1) & (F.col("gap_minutes") > 120))
    assert inside.count() == 0
    counts = answers["in_field_counts"].first()
    assert counts.n_field + counts.n_road == 998
    for name in ("q1_time_split", "q1_hours_check", "q2_field_count", "q3_activities", "q6_road_fuel"):
        assert answers[name].count() > 0
