import pytest

from fleetspark.operators.clean import clean_telemetry, drop_header_rows, reject_counts, union_all
from fleetspark.schema import RAW_SCHEMA, TELEMETRY
from fleetspark.sources.tables import (
    describe,
    local_table,
    read_raw,
    read_table,
    write_points_csv,
    write_table,
)

DATA = {
    "date_time": "2019-03-13 08:15:59.123", "serial_number": "A1", "gps_longitude": "20.25",
    "gps_latitude": "45.5", "total_working_hours": "100.5", "engine_rpm": "900", "engine_load": "50",
    "gear_shift": "2.5", "parking_break_status": "1", "all_wheel_drive_status": "on",
    "creeper_status": "OFF",
}


def raw_rows(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in TELEMETRY) for r in rows], RAW_SCHEMA)


def header():
    return {c: "DateTime" if c == "date_time" else c for c in TELEMETRY}


def test_header_goes_and_missing_times_stay(spark):
    raw = raw_rows(spark, header(), {**DATA, "date_time": None}, DATA, DATA)
    assert drop_header_rows(raw).count() == 3


def test_types_rounding_and_switch_words(spark):
    row = clean_telemetry(raw_rows(spark, DATA)).first()
    assert str(row.date_time) == "2019-03-13 08:15:59"
    assert (row.gear_shift, row.parking_break_status, row.all_wheel_drive_status) == (3, 1, "ON")
    assert row.engine_rpm == 900.0 and row.fuel_consumption_l_h is None


def test_bad_numbers_fail_or_become_null(spark):
    raw = raw_rows(spark, DATA, {**DATA, "engine_rpm": "n/a"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean_telemetry(raw).collect()
    values = [r.engine_rpm for r in clean_telemetry(raw, on_error="null").collect()]
    assert values == [900.0, None]
    rejected = {r.column: r.rejected for r in reject_counts(raw).collect()}
    assert rejected["engine_rpm"] == 1 and sum(rejected.values()) == 1


def test_union_keeps_duplicates(spark):
    raw = raw_rows(spark, DATA)
    assert union_all(raw, raw, raw).count() == 3


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    first = local_table(spark, [("a", 1), ("b", 2)], "k string, v int")
    write_table(first, path, "errorifexists")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_table(first, path, "errorifexists")
    write_table(first.limit(0), path, "ignore")
    assert read_table(spark, path).count() == 2
    write_table(first.filter("v = 1"), path, partition_by=["k"])
    back = read_table(spark, path)
    assert [(r.k, r.v) for r in back.collect()] == [("a", 1)]
    assert describe(first) == [("k", "string", True), ("v", "int", True)]


def test_csv_export_and_raw_scan(spark, tmp_path):
    raw = raw_rows(spark, header(), DATA)
    for part in ("p1", "p2"):
        raw.write.csv(str(tmp_path / part))
    back = read_raw(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert back.schema == RAW_SCHEMA and back.count() == 4
    points = local_table(spark, [("n, 1", 45.5, 20.5)], "name string, latitude double, longitude double")
    write_points_csv(points, str(tmp_path / "csv"))
    again = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert [tuple(r) for r in again.collect()] == [("n, 1", "45.5", "20.5")]


def test_empty_local_table(spark):
    empty = local_table(spark, [], "x double, n bigint")
    assert empty.count() == 0 and empty.columns == ["x", "n"]


def test_numbers_beyond_the_type_are_null_or_fail(spark):
    raw = raw_rows(spark, {**DATA, "gear_shift": "1e12", "parking_break_status": "x"})
    row = clean_telemetry(raw, on_error="null").first()
    assert row.gear_shift is None and row.parking_break_status is None and row.engine_rpm == 900
    assert {r.column: r.rejected for r in reject_counts(raw).collect() if r.rejected} == {"gear_shift": 1, "parking_break_status": 1}
    with pytest.raises(Exception):
        clean_telemetry(raw).collect()
