"""What Spark makes of the operators: pushdown, pruning, bounded windows, no pair joins."""

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetspark.catalog.queries import CENTERS, QUERIES, TIES
from fleetspark.operators import explore, geo, grid, sampling
from fleetspark.sources.events import telemetry
from fleetspark.functions import month_of
from fleetspark.sources.tables import MONTH, local_table, read_range, read_table, write_table

SF_DIR = "/root/testdata/sf0.001"
ITERATIVE = {"wss_curve", "field_centers", "q1_clustered", "correlation_matrix"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    path = str(tmp_path_factory.mktemp("tables") / "telemetry")
    write_table(telemetry(spark, SF_DIR), path)
    return read_table(spark, path)


def test_range_and_machine_filters_reach_the_scan(stored):
    text = plan(explore.rows_for_range(stored, "A03", date(2024, 1, 5), date(2024, 1, 8)))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "EqualTo(serial_number,A03)" in pushed
    assert "GreaterThanOrEqual(date_time,2024-01-05" in pushed
    assert "LessThan(date_time,2024-01-09" in pushed


def test_boxes_reach_the_scan(stored):
    text = plan(geo.in_bbox(stored, geo.MAP_BOX, inclusive=False))
    assert "GreaterThan(gps_longitude,20.1)" in text and "LessThan(gps_latitude,45.7)" in text


def test_only_needed_columns_are_read(stored):
    schema = re.findall(r"ReadSchema: struct<(.*?)>", plan(explore.machine_activity(stored)))[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "date_time", "serial_number", "total_working_hours",
    }


def test_samples_are_cut_before_the_shuffle(stored):
    text = plan(sampling.sample_first(stored, 60, **TIES))
    limits = re.findall(r"WindowGroupLimit .*?(Partial|Final)", text)
    assert sorted(limits) == ["Final", "Partial"]
    assert text.count("Exchange hashpartitioning") == 1


def test_averages_never_gather_a_whole_machine(stored):
    text = plan(sampling.sample_table(stored, 60, **TIES))
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    by_machine = [k for k in keys if re.fullmatch(r"serial_number#\d+", k)]
    # The one exchange by machine alone carries the last rows of each slice.
    assert len(by_machine) == 1 and len(keys) == 5
    below = text[text.index(f"Exchange hashpartitioning({by_machine[0]},"):]
    assert re.search(r"Filter \(_rank#\d+ <= 180\)", below.split("Exchange hashpartitioning", 2)[1])


def test_unused_averages_are_not_computed(stored):
    sample = sampling.add_moving_averages(stored, frames={"a": 7, "b": 40}, **TIES)
    text = plan(sample.select("event_id", "fuel_ma_a"))
    assert "engine_load" not in text and "speed" not in text


def test_points_are_not_shuffled_to_meet_centres(spark, stored):
    flagged = geo.flag_in_field(stored, local_table(spark, CENTERS, "x double, y double"))
    text = plan(flagged.select("event_id", "in_field"))
    assert "BroadcastHashJoin" in text
    assert text.index("BroadcastHashJoin") < text.index("FileScan")
    above_scan = text[: text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in above_scan.split("FileScan")[0]


def test_zones_need_no_join_and_extents_one_subquery(stored):
    assert "Join" not in plan(geo.assign_zones(stored))
    text = plan(grid.grid_count(stored, 80, 80))
    assert "Join" not in text and len(set(re.findall(r"subquery#(\d+)", text))) <= 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ITERATIVE))
def test_no_pair_joins_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for risky in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert risky not in text


@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    """The test data and the same rows 31, 62 and 400 days later, one row without a time."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    path = str(tmp_path_factory.mktemp("tables") / "by_month")
    rows = telemetry(spark, SF_DIR)
    later = [rows.withColumn("date_time", rows.date_time + timedelta(days=n)) for n in (31, 62, 400)]
    none = rows.limit(1).withColumn("date_time", F.lit(None).cast(rows.schema["date_time"].dataType))
    for part in (*later, none):
        rows = rows.unionByName(part)
    write_table(rows.withColumn(MONTH, month_of("date_time")), path, partition_by=[MONTH])
    return path


@pytest.mark.parametrize(
    "start, end, months",
    [
        (date(2024, 1, 5), date(2024, 1, 9), ("2024-01", "2024-01")),
        (date(2024, 1, 20), date(2024, 3, 1), ("2024-01", "2024-02")),
        (datetime(2024, 1, 31, 23), datetime(2024, 2, 1), ("2024-01", "2024-01")),
        (datetime(2024, 2, 3, 7), datetime(2024, 2, 3, 8), ("2024-02", "2024-02")),
        (date(2023, 12, 1), date(2025, 6, 1), ("2023-12", "2025-05")),
    ],
)
def test_time_ranges_skip_months(spark, by_month, start, end, months):
    rows = read_range(spark, by_month, start, end)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema", plan(rows))
    assert f"isnotnull({MONTH}#" in filters.group(1)
    assert f">= {months[0]})" in filters.group(1) and f"<= {months[1]})" in filters.group(1)
    assert "GreaterThanOrEqual(date_time," in filters.group(2) and "LessThan(date_time," in filters.group(2)
    whole = read_table(spark, by_month)
    want = whole.filter((F.col("date_time") >= F.lit(str(start)).cast("timestamp_ntz")) & (F.col("date_time") < F.lit(str(end)).cast("timestamp_ntz")))
    assert rows.count() == want.count() and rows.exceptAll(want).isEmpty()
    assert isinstance(start, datetime) or not rows.isEmpty()  # the small data has no row in some hours


def test_ranges_without_rows_and_tables_without_months(spark, by_month, stored, tmp_path):
    assert read_range(spark, by_month, date(2024, 1, 9), date(2024, 1, 9)).isEmpty()
    path = str(tmp_path / "plain")
    write_table(stored, path)
    got = read_range(spark, path, date(2024, 1, 5), date(2024, 1, 9))
    assert got.count() == stored.filter("date_time >= '2024-01-05' and date_time < '2024-01-09'").count() > 0
