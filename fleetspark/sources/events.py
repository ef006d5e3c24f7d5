"""Telemetry read out of the `events` table of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The agreed projection, valid word for word in Spark SQL and DuckDB.
TELEMETRY_SQL = """
  ts AS date_time,
  concat('A', lpad(CAST(user_id % 10 AS STRING), 2, '0')) AS serial_number,
  20.0 + CAST((user_id * 37) % 50 AS DOUBLE) / 100 + CAST((event_id * 13) % 41 AS DOUBLE) / 4000 AS gps_longitude,
  45.2 + CAST((user_id * 53) % 95 AS DOUBLE) / 100 + CAST((event_id * 11) % 43 AS DOUBLE) / 4000 AS gps_latitude,
  1000 + CAST(user_id % 10 AS DOUBLE) * 100 + CAST(event_id AS DOUBLE) / 20 AS total_working_hours,
  800 + CAST((event_id * 17) % 1400 AS DOUBLE) AS engine_rpm,
  CAST((event_id * 29) % 101 AS DOUBLE) AS engine_load,
  CASE WHEN event_id % 37 = 0 THEN NULL ELSE value / 2 END AS fuel_consumption_l_h,
  CAST((event_id * 7) % 400 AS DOUBLE) / 10 AS speed_gearbox_km_h,
  CASE WHEN event_id % 50 = 0 THEN 131.07 ELSE CAST((event_id * 7) % 400 AS DOUBLE) / 10 + 0.5 END AS speed_radar_km_h,
  70 + CAST(event_id % 31 AS DOUBLE) AS temp_coolant_c,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(event_id % 1000 AS DOUBLE) ELSE 0 END AS pto_front_rpm,
  CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 4 = 0 THEN CAST(event_id % 540 AS DOUBLE) ELSE 0 END AS pto_rear_rpm,
  CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(event_id % 13 AS INT) END AS gear_shift,
  CAST((event_id * 3) % 45 AS DOUBLE) - 5 AS temp_ambient_c,
  CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS parking_break_status,
  CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS differential_lock_status,
  CASE event_id % 6 WHEN 0 THEN 'on' WHEN 1 THEN 'off' WHEN 2 THEN 'ON' WHEN 3 THEN 'OFF' WHEN 4 THEN 'Automatic' ELSE NULL END AS all_wheel_drive_status,
  CASE event_id % 5 WHEN 0 THEN 'ON' WHEN 1 THEN NULL ELSE 'OFF' END AS creeper_status
"""

# The projection above, plus the unique event number that settles ties.
TELEMETRY_EXPRESSIONS = [e.strip().rstrip(",") for e in TELEMETRY_SQL.strip().splitlines()]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("event_id", *TELEMETRY_EXPRESSIONS)
