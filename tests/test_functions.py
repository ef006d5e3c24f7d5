import json

import pytest
from pyspark.sql import functions as F

from fleetspark.functions import (
    bucket10,
    haversine,
    minute_gap,
    point_label,
    safe_ratio,
    second_gap,
    switch_upper,
    time_bucket,
)
from fleetspark.functions.labels import NIL_LABEL, PLAIN_LABEL
from fleetspark.operators.explore import (
    latest_rows,
    month_name,
    months_between,
    pivot_metric,
    value_counts_nested,
)


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_distance_of_the_known_pair(spark):
    pair = (F.lit(20.181258), F.lit(45.318750), F.lit(20.351847), F.lit(45.324694))
    assert one(spark, haversine(*pair, units="m")) == pytest.approx(13368.646, abs=1e-3)
    assert one(spark, haversine(*pair)) == pytest.approx(13.368646, abs=1e-6)
    assert one(spark, haversine(*pair, units="miles")) == pytest.approx(13368.646 / 1609.344, abs=1e-6)


def test_bucket10_rounds_half_away_twice(spark):
    df = spark.createDataFrame([(14.9,), (15.0,), (24.9,), (131.07,), (None,), (-15.0,)], "x double")
    assert [r.v for r in df.select(bucket10("x").alias("v")).collect()] == [20, 20, 30, 130, None, -20]


def test_gaps_count_boundaries(spark):
    a, b = ts("2024-01-01 10:00:59"), ts("2024-01-01 10:01:00")
    assert one(spark, minute_gap(a, b)) == 1
    assert one(spark, second_gap(ts("2024-01-01 10:00:00.9"), ts("2024-01-01 10:00:01.1"))) == 1


def test_time_bucket_equals_text_prefix(spark):
    df = spark.createDataFrame(
        [("2024-01-01 00:09:59.9",), ("2024-01-01 00:10:00",), ("1969-12-31 23:59:59",), (None,)],
        "t string",
    ).withColumn("ts", F.col("t").cast("timestamp_ntz"))
    rows = df.select(time_bucket("ts", 600).alias("b"), time_bucket("ts", 60).alias("m")).collect()
    assert rows[0].b + 1 == rows[1].b and rows[0].m + 1 == rows[1].m
    assert rows[2].b == -1 and rows[2].m == -1
    assert rows[3].b == max(r.b for r in rows)


def test_switch_words(spark):
    df = spark.createDataFrame([("on",), ("off",), ("ON",), ("Automatic",), (None,)], "s string")
    assert [r.v for r in df.select(switch_upper("s").alias("v")).collect()] == [
        "ON", "OFF", "ON", "Automatic", None,
    ]


def test_ratio_by_zero_is_null(spark):
    assert one(spark, safe_ratio(F.lit(3), F.lit(0))) is None
    assert one(spark, safe_ratio(F.lit(3), F.lit(2))) == 1.5


def test_labels_and_nulls(make):
    row = {
        "date_time": "2024-01-01 10:00:00", "serial_number": "A", "gps_latitude": 45.5,
        "gps_longitude": 20.25, "total_working_hours": 1.5, "engine_rpm": 900.0, "engine_load": 50.0,
        "fuel_consumption_l_h": 7.5, "speed_gearbox_km_h": 5.0, "speed_radar_km_h": 5.5,
    }
    df = make([row]).select(point_label(NIL_LABEL).alias("nil"), point_label(PLAIN_LABEL).alias("plain"))
    got = df.first()
    assert got.plain is None
    assert got.nil.startswith(
        "2024-01-01 10:00:00<br />  -  Lat: 45.5<br />  -  Log: 20.25<br/ >  -  Ambient temp: nil<br />"
    )
    assert got.nil.endswith("  -  Parking: nil<br />  -  Differentials: nil<br />  -  4wheels: nil")


def test_nested_counts_put_null_first_on_ties(make):
    rows = [{"serial_number": "A", "gear_shift": g} for g in [None] * 9 + [2] * 9 + [1] * 5]
    nested = value_counts_nested(make(rows), "gear_shift", "gear", "gears")
    text = nested.select(F.to_json("gears").alias("j")).first().j
    assert text == '[{"cnt":9},{"gear":2,"cnt":9},{"gear":1,"cnt":5}]'
    assert json.loads(text)[0] == {"cnt": 9}


def test_pivot_leaves_missing_cells_null(spark):
    df = spark.createDataFrame(
        [("A", "2019-01", 1.0), ("A", "2019-03", 2.0), ("B", "2019-03", 4.0)],
        "serial_number string, month string, v double",
    )
    months = months_between("2019-01", "2019-03")
    wide = pivot_metric(df, "serial_number", "month", months, "v", [month_name(m) for m in months])
    assert wide.columns == ["serial_number", "jan2019", "feb2019", "mar2019"]
    assert sorted(map(tuple, wide.collect())) == [("A", 1.0, None, 2.0), ("B", None, None, 4.0)]
    long_sum = sum(r.v for r in df.collect())
    assert sum(v or 0 for r in wide.collect() for v in r[1:]) == long_sum


def test_months_cross_years():
    assert months_between("2018-12", "2019-02") == ["2018-12", "2019-01", "2019-02"]
    assert month_name("2018-12") == "dec2018"
    assert len(months_between("2018-12", "2020-04")) == 17


def test_latest_rows_settles_ties(make):
    rows = [
        {"date_time": "2024-01-01 10:00:00", "serial_number": s} for s in ("A", "B", "C")
    ] + [{"date_time": None, "serial_number": "D"}]
    assert [r.serial_number for r in latest_rows(make(rows), 2, ["serial_number"]).collect()] == ["C", "B"]
