"""Text labels of map points."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class LabelField(NamedTuple):
    caption: str
    column: str
    nil: bool = False  # write NULLs as text instead of making the whole label NULL
    end: str = "<br />"


# Captions, order and line ends of the labels, as read by the map site.
_POSITION = [
    LabelField("Lat", "gps_latitude"),
    LabelField("Log", "gps_longitude", end="<br/ >"),
]
_ENGINE = [
    LabelField("RPM", "engine_rpm"),
    LabelField("LOAD", "engine_load"),
    LabelField("Fuel", "fuel_consumption_l_h"),
    LabelField("Gearbox", "speed_gearbox_km_h"),
    LabelField("SpeedRadar", "speed_radar_km_h"),
]
_SWITCHES = [
    LabelField("Parking", "parking_break_status"),
    LabelField("Differentials", "differential_lock_status"),
    LabelField("4wheels", "all_wheel_drive_status"),
]
_NIL_SENSORS = [
    LabelField("GearShift", "gear_shift", nil=True),
    LabelField("PTO Front", "pto_front_rpm", nil=True),
    LabelField("PTO Rear", "pto_rear_rpm", nil=True),
    LabelField("TempCoolant", "temp_coolant_c", nil=True),
]
_NIL_SWITCHES = [f._replace(nil=True) for f in _SWITCHES]
_AMBIENT = LabelField("Ambient temp", "temp_ambient_c", nil=True)
_HOURS = LabelField("WH", "total_working_hours")
_LOAD_MA = LabelField("LOAD MA", "engine_load_ma")
_FUEL_MA = LabelField("Fuel MA", "fuel_ma")

PLAIN_LABEL = [*_POSITION, _HOURS, *_ENGINE, *_SWITCHES]
SHORT_LABEL = [_POSITION[0], _POSITION[1]._replace(end="<br />"), *_ENGINE, *_SWITCHES]
NIL_LABEL = [*_POSITION, _AMBIENT, _HOURS, *_ENGINE, *_NIL_SENSORS, *_NIL_SWITCHES]
MA_LABEL = [
    *_POSITION, _AMBIENT, _HOURS,
    *_ENGINE[:2], _LOAD_MA, _ENGINE[2], _FUEL_MA, *_ENGINE[3:],
    *_NIL_SENSORS, *_NIL_SWITCHES,
]
SAMPLE_MA_LABEL = [
    *_POSITION, _AMBIENT, _HOURS,
    *_ENGINE[:2], _LOAD_MA, _ENGINE[2], _FUEL_MA,
    LabelField("Gearbox speed", "speed_gearbox_km_h"),
    LabelField("Gearbox speed MA", "speed_ma"),
    *_NIL_SENSORS, *_NIL_SWITCHES,
]


def point_label(
    fields: list[LabelField],
    time: str = "date_time",
    null_text: str = "nil",
) -> Column:
    """Concatenate the time and the captioned fields; NULL if a non-`nil` part is NULL."""
    parts = [F.col(time).cast("string"), F.lit("<br />")]
    for i, field in enumerate(fields):
        value = F.col(field.column).cast("string")
        if field.nil:
            value = F.coalesce(value, F.lit(null_text))
        parts += [F.lit(f"  -  {field.caption}: "), value]
        if i < len(fields) - 1:
            parts.append(F.lit(field.end))
    return F.concat(*parts)
