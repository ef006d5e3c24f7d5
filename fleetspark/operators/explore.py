"""Exploration reports over the typed and sampled tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions import (
    LabelField,
    bucket10,
    month_of,
    point_label,
    safe_ratio,
    second_gap,
    time_bucket,
)
from fleetspark.functions.expressions import HOUR, MINUTE, TEN_MINUTES, epoch_seconds
from fleetspark.functions.labels import MA_LABEL, NIL_LABEL, PLAIN_LABEL, SAMPLE_MA_LABEL
from fleetspark.operators.ordered import join_same
from fleetspark.operators.quantiles import medians, melt, quantiles_long
from fleetspark.operators.sampling import add_moving_averages, sample_first, sample_with_averages
from fleetspark.schema import KEY, MA_COLUMNS, NUMERIC, TELEMETRY, TIME
from fleetspark.sources.tables import local_table

LABEL_FRAME = {"": 60}


# --- counts and lists ---------------------------------------------------------


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def latest_rows(df: DataFrame, k: int = 10, tie_break: Sequence[str] = ()) -> DataFrame:
    """The k rows with the newest times."""
    ties = [F.col(c).desc_nulls_last() for c in (tie_break or df.columns)]
    return df.orderBy(F.col(TIME).desc_nulls_last(), *ties).limit(k)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def count_by(df: DataFrame, columns: Sequence[str], out: str = "cnt") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(out))


def rows_for_range(
    df: DataFrame,
    serial: str | None = None,
    first_day: date | None = None,
    last_day: date | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Rows of one machine, of whole days (both included) and/or between two times.

    Days become a range on the time itself, so storage can skip files and row groups.
    """
    time = F.col(TIME)
    ntz = lambda x: F.lit(x).cast("timestamp_ntz")
    if serial is not None:
        df = df.filter(F.col(KEY) == serial)
    if first_day is not None:
        df = df.filter(time >= ntz(first_day))
    if last_day is not None:
        df = df.filter(time < ntz(date.fromordinal(last_day.toordinal() + 1)))
    if start is not None:
        df = df.filter(time >= ntz(start))
    if end is not None:
        df = df.filter(time <= ntz(end))
    return df


# --- per-machine summaries ----------------------------------------------------


def machine_activity(df: DataFrame) -> DataFrame:
    """Days with data, first and last time, and hours worked, per machine."""
    return (
        df.groupBy(KEY)
        .agg(
            F.count_distinct(F.to_date(TIME)).alias("days_on_run"),
            F.min(TIME).alias("start_date"),
            F.max(TIME).alias("max_date"),
            (F.max("total_working_hours") - F.min("total_working_hours")).alias("working_hours"),
        )
        .orderBy(F.col("working_hours").desc_nulls_last())
    )


def day_span(df: DataFrame) -> DataFrame:
    """First and last time of each machine and day, and the hours between."""
    span = second_gap("start_day", "end_day")
    return (
        df.groupBy(KEY, F.to_date(TIME).alias("day"))
        .agg(F.min(TIME).alias("start_day"), F.max(TIME).alias("end_day"))
        .withColumn("day_hours", F.round(F.abs(span) / 3600, 2))
    )


def values_per_machine(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct non-NULL values of a column as one ordered text per machine."""
    return (
        df.filter(F.col(column).isNotNull())
        .select(KEY, column)
        .distinct()
        .groupBy(KEY)
        .agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(out))
    )


def load_summary(df: DataFrame) -> DataFrame:
    mean = df.groupBy(KEY).agg(F.avg("engine_load").alias("avg_load"))
    return join_same(mean, medians(df, [KEY], {"median_load": "engine_load"}), [KEY], "left")


def fuel_summary(df: DataFrame) -> DataFrame:
    fuel = F.col("fuel_consumption_l_h")
    totals = df.groupBy(KEY).agg(
        F.max(fuel).alias("max_fuel"),
        F.avg(fuel).alias("avg_fuel"),
        F.count("*").alias("event_cnt"),
    )
    median = medians(df, [KEY], {"median_fuel": "fuel_consumption_l_h"})
    return join_same(totals, median, [KEY], "left").orderBy("max_fuel")


def attribute_summary(df: DataFrame) -> DataFrame:
    """Dates, extremes, means and medians of the main readings, per machine."""
    day = F.to_date(TIME)
    totals = df.groupBy(KEY).agg(
        F.min(day).alias("start_date"),
        F.max(day).alias("end_date"),
        F.max("speed_radar_km_h").alias("max_radar_speed"),
        F.max("speed_gearbox_km_h").alias("max_gearbox_speed"),
        F.avg("speed_gearbox_km_h").alias("avg_gearbox_speed"),
        F.max("engine_rpm").alias("max_engine_rpm"),
        F.avg("engine_rpm").alias("avg_engine_rpm"),
        F.avg("engine_load").alias("avg_engine_load"),
        F.max("fuel_consumption_l_h").alias("max_fuel"),
        F.avg("fuel_consumption_l_h").alias("avg_fuel"),
        F.min("total_working_hours").alias("min_working_hours"),
        F.max("total_working_hours").alias("max_working_hours"),
    )
    middle = medians(
        df,
        [KEY],
        {
            "med_gearbox_speed": "speed_gearbox_km_h",
            "med_engine_rpm": "engine_rpm",
            "med_engine_load": "engine_load",
            "med_fuel": "fuel_consumption_l_h",
        },
    )
    return join_same(totals, middle, [KEY], "left").orderBy("max_fuel")


def value_counts_nested(
    df: DataFrame, column: str, field: str, out: str, key: str = KEY
) -> DataFrame:
    """Per machine, an array of {field, cnt} objects, most frequent value first."""
    counted = df.groupBy(key, F.col(column).alias(field)).agg(F.count("*").alias("cnt"))
    ranked = F.struct((-F.col("cnt")).alias("rank"), F.col(field), F.col("cnt"))
    objects = F.transform(
        F.array_sort(F.collect_list(ranked)),
        lambda x: F.struct(x[field].alias(field), x["cnt"].alias("cnt")),
    )
    return counted.groupBy(key).agg(objects.alias(out))


def machine_summary(df: DataFrame, min_load: float = 60) -> DataFrame:
    """Attributes under load, per machine, with nested counts over all its rows."""
    loaded = df.filter(F.col("engine_load") > min_load)
    both = lambda c, name: [F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}")]
    when = lambda test: F.count_if(test)
    totals = loaded.groupBy(KEY).agg(
        F.count("*").alias("cnt"),
        *both("speed_gearbox_km_h", "gearbox_speed"),
        *both("speed_radar_km_h", "radar"),
        F.sum("parking_break_status").alias("parked"),
        F.max("fuel_consumption_l_h").alias("max_fuel"),
        when(F.col("creeper_status") == "OFF").alias("creep_off"),
        (F.count("*") - when(F.col("creeper_status") == "OFF")).alias("creep_on"),
        *both("temp_coolant_c", "coolant"),
        *both("pto_front_rpm", "front"),
        when(F.col("pto_front_rpm") > 0).alias("front_positive"),
        when(F.col("pto_front_rpm") == 0).alias("front_zeros"),
        *both("pto_rear_rpm", "rear"),
        when(F.col("pto_rear_rpm") > 0).alias("rear_positive"),
        when(F.col("pto_rear_rpm") == 0).alias("rear_zeros"),
        *both("temp_ambient_c", "ambient"),
    )
    middle = medians(
        loaded,
        [KEY],
        {
            "med_coolant": "temp_coolant_c",
            "med_front": "pto_front_rpm",
            "med_rear": "pto_rear_rpm",
            "med_ambient": "temp_ambient_c",
        },
    )
    nested = [
        value_counts_nested(df, "gear_shift", "gear", "gears"),
        value_counts_nested(df, "differential_lock_status", "differential", "differentials"),
        value_counts_nested(df, "all_wheel_drive_status", "4wheelDrive", "wheel4drive"),
    ]
    result = join_same(totals, middle, [KEY], "left")
    for breakdown in nested:
        result = join_same(result, breakdown, [KEY], "left")
    return result


# --- radar checks -------------------------------------------------------------


def radar_max_bucket(df: DataFrame) -> DataFrame:
    return df.agg(bucket10(F.max("speed_radar_km_h")).alias("speed"))


def speed_buckets(df: DataFrame) -> DataFrame:
    """Rows per radar speed and gearbox speed, both in tens."""
    return df.groupBy(
        bucket10("speed_radar_km_h").alias("speed"),
        bucket10("speed_gearbox_km_h").alias("speed_gear"),
    ).agg(F.count("*").alias("cnt"))


def radar_anomalies(
    df: DataFrame, serial: str | None = None, above: int = 100, **sampling
) -> DataFrame:
    """Ten-minute sample rows whose radar speed, in tens, is above a limit."""
    sampled = sample_first(rows_for_range(df, serial), TEN_MINUTES, **sampling)
    return (
        sampled.select(*TELEMETRY)
        .withColumn("speed", bucket10("speed_radar_km_h"))
        .filter(F.col("speed") > above)
    )


def radar_error(df: DataFrame) -> DataFrame:
    difference = F.abs(F.col("speed_radar_km_h") - F.col("speed_gearbox_km_h"))
    return df.agg(F.avg(difference).alias("mean_abs_error"))


def radar_totals(df: DataFrame, above: float = 100) -> DataFrame:
    off = F.count_if(F.col("creeper_status") == "OFF")
    return df.filter(F.col("speed_radar_km_h") > above).agg(
        F.count("*").alias("cnt"),
        F.min("speed_radar_km_h").alias("min_radar"),
        F.max("speed_radar_km_h").alias("max_radar"),
        F.sum("parking_break_status").alias("parked"),
        F.max("fuel_consumption_l_h").alias("max_fuel"),
        off.alias("creep_off"),
        (F.count("*") - off).alias("creep_on"),
    )


# --- labelled points ----------------------------------------------------------


def map_points(
    df: DataFrame,
    label: list[LabelField] = PLAIN_LABEL,
    bucket_seconds: int | None = MINUTE,
    **sampling,
) -> DataFrame:
    """Labelled (name, latitude, longitude), one per machine and slot.

    Filter machines and days first with `rows_for_range`.
    """
    if bucket_seconds:
        df = sample_first(df, bucket_seconds, **sampling)
    return _points(df, label)


def _points(df: DataFrame, label: list[LabelField], *more: str) -> DataFrame:
    return df.select(
        *more,
        point_label(label).alias("name"),
        F.col("gps_latitude").alias("latitude"),
        F.col("gps_longitude").alias("longitude"),
    )


def map_points_nil(df: DataFrame, **sampling) -> DataFrame:
    """Labelled points of rows without a creeper status."""
    return map_points(df.filter(F.col("creeper_status").isNull()), NIL_LABEL, **sampling)


def _label_averages(df: DataFrame, digits: int | None) -> DataFrame:
    renamed = {f"{name}_ma_": f"{name}_ma" for name in MA_COLUMNS}
    df = df.withColumnsRenamed(renamed)
    if digits is None:
        return df
    return df.withColumns({c: rounded(c, digits) for c in renamed.values()})


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round a computed double so that the order of summation cannot show.

    The shift keeps exact halves on one side.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(10.0 ** -(digits + 3)), digits)


def map_points_ma(
    df: DataFrame,
    bucket_seconds: int = MINUTE,
    limit: int | None = None,
    digits: int | None = None,
    **sampling,
) -> DataFrame:
    """Labelled slot samples with averages over all rows; `limit` keeps the earliest."""
    averaged = sample_with_averages(
        df,
        bucket_seconds,
        frames=LABEL_FRAME,
        keep=[*TELEMETRY],
        **sampling,
    )
    if limit is not None:
        order = dict.fromkeys([TIME, KEY, *sampling.get("order", ())])
        averaged = averaged.orderBy(*order).limit(limit)
    return _points(_label_averages(averaged, digits), MA_LABEL)


def map_points_of_sample(sample: DataFrame, digits: int | None = None, **averaging) -> DataFrame:
    """Labelled points of an (already filtered) sample, averages over the rows given."""
    rows = sample.drop(*[c for c in sample.columns if "_ma_" in c])
    averaged = add_moving_averages(rows, frames=LABEL_FRAME, **averaging)
    return _points(_label_averages(averaged, digits), SAMPLE_MA_LABEL)


def points_for_hour(df: DataFrame, start, end) -> DataFrame:
    """Points of all machines from `start` up to but not including `end`."""
    ntz = lambda x: F.lit(x).cast("timestamp_ntz")
    hour = df.filter((F.col(TIME) >= ntz(start)) & (F.col(TIME) < ntz(end)))
    return hour.select(
        F.concat(F.col(TIME).cast("string"), F.lit("  -  "), F.col(KEY)).alias("name"),
        "gps_longitude",
        "gps_latitude",
    )


# --- months and hours ---------------------------------------------------------


def month_name(month: str) -> str:
    """Column name of a month: 2018-12 becomes dec2018."""
    return date.fromisoformat(f"{month}-01").strftime("%b%Y").lower()


def months_between(first: str, last: str) -> list[str]:
    """All months from `first` to `last`, both as yyyy-MM and included."""
    index = lambda m: int(m[:4]) * 12 + int(m[5:]) - 1
    return [f"{i // 12:04d}-{i % 12 + 1:02d}" for i in range(index(first), index(last) + 1)]


def pivot_metric(
    df: DataFrame,
    row: str,
    column: str,
    values: Sequence[str],
    metric: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per `row`, one column per listed value; cells without rows are NULL."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.sum(metric))
    return wide.toDF(row, *(names or values))


def monthly_fuel(df: DataFrame, first_month: str | None = None) -> DataFrame:
    """Mean fuel use per machine and month, from `first_month` on."""
    if first_month is not None:
        start = F.lit(f"{first_month}-01 00:00:00").cast("timestamp_ntz")
        df = df.filter(F.col(TIME) >= start)
    return df.groupBy(KEY, month_of(TIME).alias("month")).agg(
        F.avg("fuel_consumption_l_h").alias("avg_fuel")
    )


def fuel_by_month_pivot(df: DataFrame, months: Sequence[str]) -> DataFrame:
    monthly = monthly_fuel(df, min(months))
    return pivot_metric(
        monthly, KEY, "month", months, "avg_fuel", [month_name(m) for m in months]
    )


def fuel_by_machine_pivot(df: DataFrame, serials: Sequence[str]) -> DataFrame:
    return pivot_metric(monthly_fuel(df), "month", KEY, serials, "avg_fuel")


def speed_ratio_pivot(
    sample: DataFrame, months: Sequence[str], speed: float = 10, fuel: float = 30
) -> DataFrame:
    """Fast over slow minutes under high fuel use, per machine and month."""
    busy = F.col("fuel_ma_30m") > fuel
    daily = sample.groupBy(KEY, F.to_date(TIME).alias("day")).agg(
        F.count_if((F.col("speed_ma_30m") > speed) & busy).alias("above"),
        F.count_if((F.col("speed_ma_30m") < speed) & busy).alias("below"),
    )
    monthly = daily.groupBy(KEY, month_of("day").alias("month")).agg(
        F.round(safe_ratio(F.sum("above"), F.sum("below")), 5).alias("metric")
    )
    return pivot_metric(monthly, KEY, "month", months, "metric", [month_name(m) for m in months])


def concurrent_hours(df: DataFrame, more_than: int = 1) -> DataFrame:
    """Hours in which more than so many machines sent data."""
    return (
        df.groupBy(time_bucket(TIME, HOUR).alias("_hour"))
        .agg(
            F.min(TIME).alias("_first"),
            F.count_distinct(KEY).alias("machines_active"),
        )
        .filter(F.col("machines_active") > more_than)
        .select(F.date_format("_first", "yyyy-MM-dd HH").alias("hour"), "machines_active")
    )


# --- statistics of all columns ------------------------------------------------


def column_summary(df: DataFrame, columns: Sequence[str] = NUMERIC, times: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, median, mean, maximum and NULL count of each column.

    Columns in `times` are summarised as whole seconds since 1970.
    """
    df = df.select(*columns, *[epoch_seconds(c).alias(c) for c in times])
    columns = [*columns, *times]
    per_column = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    totals = (
        df.select(F.inline(per_column))
        .groupBy("name")
        .agg(
            F.min("value").alias("min"),
            F.avg("value").alias("mean"),
            F.max("value").alias("max"),
            F.count_if(F.col("value").isNull()).alias("n_null"),
        )
    )
    quartiles = (
        quantiles_long(melt(df, [], columns), [], [0.25, 0.5, 0.75])
        .groupBy("name")
        .agg(
            *[
                F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(out)
                for p, out in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
            ]
        )
    )
    return totals.join(quartiles, "name", "left").select(
        F.col("name").alias("column"), "min", "q1", "median", "mean", "q3", "max", "n_null"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Pearson correlation of every pair of columns, NULLs taken as 0.

    Acts when called; the result has one row per pair.  A pair with a constant column
    gives NaN.
    """
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled)
    matrix = Correlation.corr(vectors, "features").first()[0].toArray()
    rows = [
        (a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return local_table(
        df.sparkSession, rows, "column_a string, column_b string, correlation double"
    )
