"""Column expressions; all are built-in, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, TEN_MINUTES, HOUR, DAY, WEEK = 1, 60, 600, 3600, 86400, 604800

EARTH_RADIUS_M = 6378137.0
METRES_PER = {"km": 1000.0, "miles": 1609.344}

# Bucket of rows without a time: after every real bucket, as NULLs sort last.
NO_TIME = 1 << 60


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a time without zone, in a session set to UTC.

    The cast is free there; taking the clock fields apart instead would need no zone but
    costs several times more per row.
    """
    return F.unix_seconds(as_column(ts).cast("timestamp"))


def time_bucket(ts: str | Column, seconds: int) -> Column:
    """Number of the time slot a row falls in; equal to grouping by a time-text prefix."""
    slot = F.floor(epoch_seconds(ts) / F.lit(seconds))
    return F.coalesce(slot, F.lit(NO_TIME))


def month_of(ts: str | Column) -> Column:
    return F.date_format(as_column(ts), "yyyy-MM")


def second_gap(a: str | Column, b: str | Column) -> Column:
    """Second boundaries crossed going from `a` to `b`."""
    return epoch_seconds(b) - epoch_seconds(a)


def minute_gap(a: str | Column, b: str | Column) -> Column:
    """Minute boundaries crossed going from `a` to `b` (10:00:59 to 10:01:00 is 1)."""
    minutes = lambda ts: F.floor(epoch_seconds(ts) / F.lit(MINUTE))
    return minutes(b) - minutes(a)


def bucket10(x: str | Column) -> Column:
    """Value in tens, rounding half away from zero before and after the division."""
    return (F.round(F.round(as_column(x)) / 10) * 10).cast("int")


def switch_upper(c: str | Column) -> Column:
    """Upper-case the two switch words; every other value stays as it is."""
    c = as_column(c)
    return F.when(c == "on", "ON").when(c == "off", "OFF").otherwise(c)


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero."""
    return as_column(a) / F.nullif(as_column(b), F.lit(0))


def great_circle(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres on a sphere (haversine form)."""
    lon1, lat1, lon2, lat2 = (F.radians(as_column(c)) for c in (lon1, lat1, lon2, lat2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def haversine(lon1, lat1, lon2, lat2, units: str = "km") -> Column:
    """Distance in kilometres, miles, or (any other unit name) metres."""
    return great_circle(lon1, lat1, lon2, lat2) / METRES_PER.get(units, 1.0)
