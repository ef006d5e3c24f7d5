"""Working sessions: runs of one machine without a long pause.

Input is the one-minute sample with an `in_field` flag.  Rows are handled per
(machine, week); pauses across the border of two weeks and the running session number
travel through a table with one row per machine and week.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions import minute_gap, safe_ratio
from fleetspark.functions.expressions import WEEK, epoch_seconds
from fleetspark.operators.geo import LAT, LON, meet_boxes
from fleetspark.operators.ordered import SLICE, ascending, join_same, with_slice
from fleetspark.schema import KEY, TIME

# Longest pause inside a session in minutes, shortest session in rows,
# and the two row symbols.
IDLE_MINUTES = 120
MIN_ROWS = 8
CONTINUES, BREAKS = 1, 2
# Fixed value: degrees added around a session's box when looking for centres.
SESSION_PAD = 0.0216916

TRACED = ("speed_gearbox_km_h", "engine_rpm")


def _symbol(gap: Column, idle_minutes: int) -> Column:
    """1 if the next row follows within the pause; 2 at a break or at the last row."""
    return F.when(gap <= idle_minutes, CONTINUES).otherwise(BREAKS)


def _ordered(order: Sequence[str]):
    return Window.partitionBy(KEY, SLICE).orderBy(*ascending(order))


def _slice_summary(sliced: DataFrame, idle_minutes: int, order: Sequence[str]) -> DataFrame:
    """Per machine and slice: first time of the next slice and sessions closed before it."""
    gap = minute_gap(TIME, F.lead(TIME).over(_ordered(order)))
    by_slice = Window.partitionBy(KEY).orderBy(SLICE)
    return (
        sliced.select(KEY, SLICE, *[c for c in order])
        .withColumn("_gap", gap)
        .groupBy(KEY, SLICE)
        .agg(
            F.min(TIME).alias("_first"),
            F.max(TIME).alias("_last"),
            F.count_if(F.col("_gap") > idle_minutes).alias("_inner_breaks"),
        )
        .withColumn("_next_first", F.lead("_first").over(by_slice))
        .withColumn(
            "_breaks",
            F.col("_inner_breaks")
            + (_symbol(minute_gap("_last", "_next_first"), idle_minutes) - CONTINUES),
        )
        .withColumn(
            "_closed",
            F.coalesce(
                F.sum("_breaks").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(KEY, SLICE, "_next_first", "_closed")
    )


def mark_gaps(
    sample: DataFrame,
    idle_minutes: int = IDLE_MINUTES,
    order: Sequence[str] = (TIME,),
    slice_seconds: int = WEEK,
) -> DataFrame:
    """Add each row's next time, the minutes up to it, and the row symbol."""
    sliced = with_slice(sample, slice_seconds)
    return _mark(sliced, idle_minutes, order).drop(SLICE, "_closed")


def _mark(sliced: DataFrame, idle_minutes: int, order: Sequence[str]) -> DataFrame:
    summary = _slice_summary(sliced, idle_minutes, order)
    return (
        sliced.withColumn("_next", F.lead(TIME).over(_ordered(order)))
        .transform(join_same, summary, [KEY, SLICE])
        .withColumn("next_time", F.coalesce("_next", "_next_first"))
        .withColumn("gap_minutes", F.abs(minute_gap(TIME, "next_time")))
        .withColumn("symb", _symbol(F.col("gap_minutes"), idle_minutes))
        .drop("_next", "_next_first")
    )


def assign_sessions(
    sample: DataFrame,
    idle_minutes: int = IDLE_MINUTES,
    order: Sequence[str] = (TIME,),
    slice_seconds: int = WEEK,
) -> DataFrame:
    """`mark_gaps`, plus the session number; a breaking row closes its own session."""
    marked = _mark(with_slice(sample, slice_seconds), idle_minutes, order)
    earlier = _ordered(order).rowsBetween(Window.unboundedPreceding, -1)
    closed_here = F.coalesce(F.sum((F.col("symb") == BREAKS).cast("long")).over(earlier), F.lit(0))
    return marked.withColumn("session_id", 1 + F.col("_closed") + closed_here).drop(
        SLICE, "_closed"
    )


def session_times(
    sessions: DataFrame, mode: str = "reference", min_rows: int = MIN_ROWS
) -> DataFrame:
    """Rows and minutes in total, on site and in transport, per session of `min_rows` or more.

    The default mode subtracts one from the sums of row symbols of all rows and of on-site
    rows, so a session without on-site rows gets -1; "plain" counts rows.
    """
    return _times(sessions, mode).filter(F.col("n_rows") >= min_rows)


def _times(sessions: DataFrame, mode: str) -> DataFrame:
    if mode not in ("reference", "plain"):
        raise ValueError("mode must be 'reference' or 'plain'")
    on_site = F.col("in_field") == 1
    if mode == "reference":
        total = F.sum("symb") - 1
        activity = F.coalesce(F.sum(F.when(on_site, F.col("symb"))), F.lit(0)) - 1
    else:
        total, activity = F.count("*"), F.count_if(on_site)
    return sessions.groupBy(KEY, "session_id").agg(
        F.count("*").alias("n_rows"),
        total.alias("total_minutes"),
        activity.alias("activity_minutes"),
        (total - activity).alias("transport_minutes"),
    )


def machine_times(
    sessions: DataFrame, mode: str = "reference", min_rows: int = MIN_ROWS
) -> DataFrame:
    """On-site and transport minutes per machine; 0 if all its sessions are too short."""
    counted = F.col("n_rows") >= min_rows
    kept = lambda c: F.sum(F.when(counted, F.col(c)).otherwise(0)).alias(c)
    return (
        _times(sessions, mode)
        .groupBy(KEY)
        .agg(
            F.count_if(counted).alias("n_sessions"),
            kept("activity_minutes"),
            kept("transport_minutes"),
        )
    )


def session_overview(sessions: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Start, end, box and length of each session, by clock and by hour counter."""
    hours = F.col("total_working_hours")
    return (
        sessions.groupBy(KEY, "session_id")
        .agg(
            F.count("*").alias("n_rows"),
            F.min(TIME).alias("start_time"),
            F.max(TIME).alias("end_time"),
            F.min(LON).alias("left"),
            F.min(LAT).alias("bottom"),
            F.max(LON).alias("right"),
            F.max(LAT).alias("top"),
            ((F.max(hours) - F.min(hours)) * 60).alias("counter_minutes"),
        )
        .filter(F.col("n_rows") >= min_rows)
        .withColumn(
            "clock_minutes", (epoch_seconds("end_time") - epoch_seconds("start_time")) / 60
        )
    )


def centers_near_session(
    overview: DataFrame, centers: DataFrame, pad_deg: float = SESSION_PAD
) -> DataFrame:
    """Centres strictly inside a session's box widened by `pad_deg`.

    `overview` comes from `session_overview`.  Boxes of any size take up to four cells.
    """
    padded = overview.select(
        KEY,
        "session_id",
        *[(F.col(c) - pad_deg).alias(c) for c in ("left", "bottom")],
        *[(F.col(c) + pad_deg).alias(c) for c in ("right", "top")],
    )
    within = (
        (F.col("x") > F.col("left"))
        & (F.col("x") < F.col("right"))
        & (F.col("y") > F.col("bottom"))
        & (F.col("y") < F.col("top"))
    )
    met = meet_boxes(centers.select("x", "y"), padded, "x", "y")
    return met.filter(within).select(KEY, "session_id", "x", "y")


def session_trace(
    sessions: DataFrame,
    order: Sequence[str] = (TIME,),
    min_rows: int = MIN_ROWS,
    slice_seconds: int = WEEK,
) -> DataFrame:
    """Rows with their number inside the session and two scaled flags for charts.

    `field_flag` is the site flag times the session's mean speed, `parking_flag` the brake
    flag times a tenth of its mean engine speed.
    """
    sliced = with_slice(sessions, slice_seconds)
    session, by = [KEY, "session_id"], [KEY, "session_id", SLICE]
    total = lambda c: F.sum(c).over(Window.partitionBy(*session))
    before = Window.partitionBy(*session).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    stats = (
        sliced.groupBy(*by)
        .agg(
            F.count("*").alias("_n"),
            *[F.sum(c).alias(f"_sum_{c}") for c in TRACED],
            *[F.count(c).alias(f"_n_{c}") for c in TRACED],
        )
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_size", total("_n"))
        .withColumns({f"_mean_{c}": safe_ratio(total(f"_sum_{c}"), total(f"_n_{c}")) for c in TRACED})
        .filter(F.col("_size") >= min_rows)
        .select(*by, "_before", *[f"_mean_{c}" for c in TRACED])
    )
    here = Window.partitionBy(*by).orderBy(*ascending(order))
    return (
        sliced.withColumn("_rn", F.row_number().over(here))
        .transform(join_same, stats, by)
        .withColumn("row_index", F.col("_before") + F.col("_rn"))
        .withColumn("field_flag", F.col("in_field") * F.col("_mean_speed_gearbox_km_h"))
        .withColumn("parking_flag", F.col("parking_break_status") * F.col("_mean_engine_rpm") / 10)
        .drop(SLICE, "_rn", "_before", *[f"_mean_{c}" for c in TRACED])
    )
