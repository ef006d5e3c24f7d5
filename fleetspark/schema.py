"""Column names and types of the telemetry tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "serial_number"
TIME = "date_time"

# The column order of the raw export and the type of each column
# once cleaned.
TELEMETRY_TYPES = {
    "date_time": "timestamp_ntz",
    "serial_number": "string",
    "gps_longitude": "double",
    "gps_latitude": "double",
    "total_working_hours": "double",
    "engine_rpm": "double",
    "engine_load": "double",
    "fuel_consumption_l_h": "double",
    "speed_gearbox_km_h": "double",
    "speed_radar_km_h": "double",
    "temp_coolant_c": "double",
    "pto_front_rpm": "double",
    "pto_rear_rpm": "double",
    "gear_shift": "int",
    "temp_ambient_c": "double",
    "parking_break_status": "int",
    "differential_lock_status": "int",
    "all_wheel_drive_status": "string",
    "creeper_status": "string",
}

TELEMETRY = list(TELEMETRY_TYPES)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TELEMETRY])

# Two columns are left out of the samples and statistics: their readings are faulty.
UNRELIABLE = ("speed_radar_km_h", "creeper_status")
SAMPLED = [c for c in TELEMETRY if c not in UNRELIABLE]
NUMERIC = [c for c in SAMPLED if TELEMETRY_TYPES[c] in ("double", "int")]

# Averaged columns, and how many rows precede the current one in
# each frame (about 10 seconds per row).
MA_COLUMNS = {
    "fuel": "fuel_consumption_l_h",
    "engine_load": "engine_load",
    "speed": "speed_gearbox_km_h",
}
MA_FRAMES = {"5m": 30, "10m": 60, "20m": 120, "30m": 180}


def ma_names(columns=MA_COLUMNS, frames=MA_FRAMES) -> list[str]:
    return [f"{name}_ma_{label}" for label in frames for name in columns]
