"""Answers to the report questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import safe_ratio
from fleetspark.operators.geo import DEFAULT_ZONES, Zone
from fleetspark.operators.grid import FIELD_CUTOFF, ZONE_STEP, zone_grid
from fleetspark.operators.ordered import join_same
from fleetspark.schema import KEY


def in_field_counts(flagged: DataFrame) -> DataFrame:
    """Rows in total, on a site, and on the road."""
    on_site = F.count_if(F.col("in_field") == 1)
    return flagged.agg(
        F.count("*").alias("n_rows"),
        on_site.alias("n_field"),
        (F.count("*") - on_site).alias("n_road"),
    )


def time_split(times: DataFrame) -> DataFrame:
    """Q1: fleet hours in transport, on site and in total, and both shares in percent."""
    hours = lambda c: F.sum(c) / 60
    split = times.agg(
        hours("transport_minutes").alias("transport_hours"),
        hours("activity_minutes").alias("activity_hours"),
    ).withColumn("total_hours", F.col("activity_hours") + F.col("transport_hours"))
    share = lambda c: safe_ratio(c, "total_hours") * 100
    return split.withColumn("transport_percent", share("transport_hours")).withColumn(
        "activity_percent", share("activity_hours")
    )


def hours_check(times: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Q1 check: hours from sessions against each machine's hour counter."""
    counter = telemetry.groupBy(KEY).agg(
        F.round(F.max("total_working_hours") - F.min("total_working_hours"), 2).alias(
            "counter_hours"
        )
    )
    minutes = F.col("transport_minutes") + F.col("activity_minutes")
    sessions = times.select(KEY, F.round(minutes / 60, 2).alias("session_hours"))
    error = safe_ratio(F.col("counter_hours") - F.col("session_hours"), "counter_hours") * 100
    return join_same(sessions, counter, [KEY]).withColumn("error_percent", F.round(error, 2))


def field_count(
    flagged: DataFrame,
    zones: Sequence[Zone] = DEFAULT_ZONES,
    step_deg: float = ZONE_STEP,
    cutoff: int = FIELD_CUTOFF,
) -> DataFrame:
    """Q2: dense grid cells of on-site rows, per zone and over all zones (zone_id NULL)."""
    grid = zone_grid(flagged.filter(F.col("in_field") == 1), zones, step_deg)
    dense = lambda rows: rows.agg(F.count_if(F.col("n") > cutoff).alias("n_fields"))
    # The total is an aggregate of its own, so that it says 0 where there is no cell.
    total = dense(grid).select(F.lit(None).cast("int").alias("zone_id"), "n_fields")
    return dense(grid.groupBy("zone_id")).select(F.col("zone_id").cast("int"), "n_fields").unionByName(total)


def activities(
    flagged: DataFrame, speed: float = 10, rear: float = 0, front: float = 10
) -> DataFrame:
    """Q3: on-site minutes per machine that are fast, slow, or use a power take-off."""
    on_site = F.col("in_field") == 1
    count = lambda test: F.count_if(on_site & test)
    return flagged.groupBy(KEY).agg(
        count(F.col("speed_ma_30m") > speed).alias("speed_above"),
        count(F.col("speed_ma_30m") < speed).alias("speed_below"),
        count(F.col("pto_rear_rpm") > rear).alias("pto_rear"),
        count(F.col("pto_front_rpm") > front).alias("pto_front"),
    )


def road_fuel(flagged: DataFrame, times: DataFrame) -> DataFrame:
    """Q6: mean fuel use on the road (NULL as 0) times the fleet's transport hours."""
    hours = time_split(times).select("transport_hours").scalar()
    return (
        flagged.filter(F.col("in_field") == 0)
        .agg(F.avg(F.coalesce(F.col("fuel_consumption_l_h"), F.lit(0.0))).alias("mean_road_fuel"))
        .withColumn("transport_hours", hours)
        .withColumn("road_fuel_l", F.col("mean_road_fuel") * F.col("transport_hours"))
    )
