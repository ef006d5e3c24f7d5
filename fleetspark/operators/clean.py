"""From raw all-text exports to the typed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import switch_upper
from fleetspark.schema import TELEMETRY, TELEMETRY_TYPES, TIME

# The text of the repeated header row's first field, and the length
# of a time without fractions.
HEADER_TEXT = "DateTime"
TIME_LENGTH = 19


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of same-schema tables, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def drop_header_rows(df: DataFrame) -> DataFrame:
    """Remove repeated header rows; rows without a time stay."""
    return df.filter(~F.col(TIME).eqNullSafe(HEADER_TEXT))


def _typed(column: str, cast) -> F.Column:
    c, target = F.col(column), TELEMETRY_TYPES[column]
    if column == TIME:
        return cast(F.substring(c, 1, TIME_LENGTH), target)
    if column == "all_wheel_drive_status":
        return switch_upper(c)
    if target == "int":
        # Text such as "2.5" counts as a number and is rounded half away from zero.
        return cast(F.round(cast(c, "double")), "int")
    return c if target == "string" else cast(c, target)


def clean_telemetry(raw: DataFrame, on_error: str = "fail") -> DataFrame:
    """Cast the raw text columns and unify the drive switch words.

    `on_error="null"` turns unreadable values into NULL instead of failing the job.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    cast = F.Column.cast if on_error == "fail" else F.Column.try_cast
    return raw.select(
        *[_typed(c, cast).alias(c) for c in TELEMETRY],
        *[c for c in raw.columns if c not in TELEMETRY],
    )


def reject_counts(raw: DataFrame) -> DataFrame:
    """Per column, how many non-NULL raw values cannot be read as the target type."""
    typed = clean_telemetry(raw, on_error="null")
    after = [F.count(F.col(c)).alias(c) for c in TELEMETRY]
    read = typed.agg(*after).select(F.inline(_pairs("readable")))
    given = raw.agg(*after).select(F.inline(_pairs("given")))
    return given.join(read, "column").select(
        "column", (F.col("given") - F.col("readable")).alias("rejected")
    )


def _pairs(value: str) -> F.Column:
    return F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias(value)) for c in TELEMETRY]
    )
