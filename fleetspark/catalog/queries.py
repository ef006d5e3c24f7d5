"""Named queries over the test tables, one per step of the analysis.

Each takes (spark, sf_dir).  Computed doubles are rounded to six digits, so that a
result does not depend on the order in which Spark adds numbers up.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.functions import haversine
from fleetspark.functions.expressions import MINUTE, TEN_MINUTES
from fleetspark.functions.labels import SHORT_LABEL
from fleetspark.operators import clean, cluster, explore, fuzzy, gap, geo, grid, reports, sampling, sessions
from fleetspark.operators.explore import rounded
from fleetspark.schema import KEY, MA_COLUMNS, RAW_SCHEMA, TELEMETRY, TIME
from fleetspark.sources.events import telemetry
from fleetspark.sources.tables import local_table

ORDER = (TIME, "event_id")
TIES = {"order": ORDER, "unique_order": True}

# Parameters of the registered queries.
MONTHS = explore.months_between("2024-01", "2024-02")
SERIALS = [f"A{i:02d}" for i in range(10)]
FIRST_DAY, LAST_DAY = date(2024, 1, 5), date(2024, 1, 8)
HOUR_START, HOUR_END = "2024-01-10 09:00:00", "2024-01-10 10:00:00"
# Site centres every 0.05 degrees over the covered area.
CENTERS = [
    (round(20.05 + 0.05 * i, 2), round(45.25 + 0.05 * j, 2)) for i in range(9) for j in range(18)
]
DEPOT = (20.181258, 45.31875)
LOW_CUTOFF = 3
THINNING = 30
OUTLIER_K, N_OUTLIERS = 4, 7
FUZZY_K, FUZZY_ROUNDS = 5, 10
GAP_K, GAP_SETS, GAP_SIZE = 6, 5, 300

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def round_doubles(df: DataFrame, *names: str) -> DataFrame:
    """Round the named double columns; without names, all of them."""
    doubles = names or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: rounded(c) for c in doubles})


def centers(spark: SparkSession) -> DataFrame:
    return local_table(spark, CENTERS, "x double, y double")


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of every machine and minute, without averages."""
    return sampling.sample_first(telemetry(spark, sf_dir), MINUTE, **TIES)


def averaged_minutes(spark, sf_dir, columns, frames) -> DataFrame:
    return sampling.sample_with_averages(
        telemetry(spark, sf_dir), MINUTE, columns=columns, frames=frames, **TIES
    )


def fuel_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes with the ten-minute fuel average, by which high load is told."""
    return averaged_minutes(spark, sf_dir, {"fuel": MA_COLUMNS["fuel"]}, {"10m": 60})


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.flag_in_field(minutes(spark, sf_dir), centers(spark))


def working_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.assign_sessions(flagged(spark, sf_dir), order=ORDER)


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as text, with one header row among the data."""
    text = telemetry(spark, sf_dir).select(
        *[F.col(c).cast("string").alias(c) for c in TELEMETRY]
    )
    names = [clean.HEADER_TEXT if c == TIME else c for c in TELEMETRY]
    header = spark.createDataFrame([names], RAW_SCHEMA)
    return clean.union_all(header, text)


# --- cleaning -----------------------------------------------------------------


@query
def union_parts(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    parts = [rows.filter(F.col("event_id") % 9 == i) for i in range(9)]
    return clean.union_all(*parts)


@query
def count_rows(spark, sf_dir):
    raw = raw_export(spark, sf_dir)
    return (
        explore.count_rows(raw)
        .withColumn("stage", F.lit("raw"))
        .unionByName(
            explore.count_rows(clean.drop_header_rows(raw)).withColumn("stage", F.lit("typed"))
        )
    )


@query
def drop_header(spark, sf_dir):
    return clean.drop_header_rows(raw_export(spark, sf_dir))


@query
def clean_telemetry(spark, sf_dir):
    return clean.clean_telemetry(clean.drop_header_rows(raw_export(spark, sf_dir)))


@query
def latest_rows(spark, sf_dir):
    return explore.latest_rows(telemetry(spark, sf_dir), 10, ["event_id"])


# --- counts and summaries -----------------------------------------------------


@query
def distinct_serials(spark, sf_dir):
    return explore.distinct_values(telemetry(spark, sf_dir), KEY)


@query
def distinct_gears(spark, sf_dir):
    return explore.distinct_values(telemetry(spark, sf_dir), "gear_shift")


@query
def machine_activity(spark, sf_dir):
    return round_doubles(explore.machine_activity(telemetry(spark, sf_dir)))


@query
def day_span(spark, sf_dir):
    return explore.day_span(telemetry(spark, sf_dir))


@query
def rows_for_range(spark, sf_dir):
    return explore.rows_for_range(telemetry(spark, sf_dir), "A03", FIRST_DAY, LAST_DAY)


@query
def sample_for_range(spark, sf_dir):
    return explore.rows_for_range(
        minutes(spark, sf_dir), start="2024-01-04 21:41:00", end="2024-01-05 09:13:04"
    )


@query
def status_combos(spark, sf_dir):
    columns = ["gear_shift", "differential_lock_status", "all_wheel_drive_status"]
    return explore.count_by(telemetry(spark, sf_dir), columns)


@query
def awd_values(spark, sf_dir):
    return explore.values_per_machine(
        telemetry(spark, sf_dir), "all_wheel_drive_status", "drive_values"
    )


@query
def awd_counts(spark, sf_dir):
    rows = telemetry(spark, sf_dir).filter(F.col("all_wheel_drive_status").isNotNull())
    return explore.count_by(rows, [KEY, "all_wheel_drive_status"])


@query
def events_per_machine(spark, sf_dir):
    return explore.count_by(telemetry(spark, sf_dir), [KEY], "events_recorded")


@query
def load_summary(spark, sf_dir):
    return round_doubles(explore.load_summary(telemetry(spark, sf_dir)))


@query
def fuel_summary(spark, sf_dir):
    return round_doubles(explore.fuel_summary(telemetry(spark, sf_dir)))


@query
def attribute_summary(spark, sf_dir):
    return round_doubles(explore.attribute_summary(telemetry(spark, sf_dir)))


@query
def machine_summary(spark, sf_dir):
    result = round_doubles(explore.machine_summary(telemetry(spark, sf_dir)))
    nested = ["gears", "differentials", "wheel4drive"]
    return result.withColumns({c: F.to_json(c) for c in nested})


@query
def column_summary(spark, sf_dir):
    return round_doubles(explore.column_summary(telemetry(spark, sf_dir), times=[TIME]))


@query
def correlation_matrix(spark, sf_dir):
    return round_doubles(explore.correlation_matrix(telemetry(spark, sf_dir)))


@query
def concurrent_hours(spark, sf_dir):
    return explore.concurrent_hours(telemetry(spark, sf_dir))


# --- radar --------------------------------------------------------------------


@query
def radar_max_bucket(spark, sf_dir):
    return explore.radar_max_bucket(telemetry(spark, sf_dir))


@query
def speed_buckets(spark, sf_dir):
    return explore.speed_buckets(telemetry(spark, sf_dir))


@query
def radar_anomalies(spark, sf_dir):
    return explore.radar_anomalies(telemetry(spark, sf_dir), **TIES)


@query
def radar_error(spark, sf_dir):
    return round_doubles(explore.radar_error(telemetry(spark, sf_dir)))


@query
def radar_totals(spark, sf_dir):
    return explore.radar_totals(telemetry(spark, sf_dir))


# --- samples and averages -----------------------------------------------------


@query
def sample_1min(spark, sf_dir):
    sampled = sampling.sample_table(telemetry(spark, sf_dir), MINUTE, **TIES)
    return round_doubles(sampled, *sampling.ma_names())


@query
def sample_10min(spark, sf_dir):
    sampled = sampling.sample_table(telemetry(spark, sf_dir), TEN_MINUTES, **TIES)
    return round_doubles(sampled, *sampling.ma_names())


@query
def sample_counts(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    ten = sampling.sample_first(rows, TEN_MINUTES, **TIES)
    one = sampling.sample_first(rows, MINUTE, **TIES)
    label = lambda df, text: explore.count_rows(df).withColumn("sample", F.lit(text))
    return label(one, "1 min").unionByName(label(ten, "10 min"))


@query
def moving_averages(spark, sf_dir):
    """Averages for every row, not only the sampled ones."""
    averaged = sampling.add_moving_averages(telemetry(spark, sf_dir), **TIES)
    return round_doubles(averaged.select("event_id", *sampling.ma_names()), *sampling.ma_names())


# --- map points ---------------------------------------------------------------


@query
def map_points(spark, sf_dir):
    return explore.map_points(telemetry(spark, sf_dir), **TIES)


@query
def map_points_short(spark, sf_dir):
    day = explore.rows_for_range(telemetry(spark, sf_dir), "A05", FIRST_DAY, FIRST_DAY)
    return explore.map_points(day, SHORT_LABEL, **TIES)


@query
def map_points_nil(spark, sf_dir):
    return explore.map_points_nil(telemetry(spark, sf_dir), **TIES)


@query
def map_points_ma(spark, sf_dir):
    return explore.map_points_ma(telemetry(spark, sf_dir), digits=6, **TIES)


@query
def map_points_first(spark, sf_dir):
    """The earliest thousand labelled minutes of one machine."""
    one = explore.rows_for_range(telemetry(spark, sf_dir), "A09")
    return explore.map_points_ma(one, limit=1000, digits=6, **TIES)


@query
def map_points_half_plane(spark, sf_dir):
    sample = minutes(spark, sf_dir).filter(F.col("gps_longitude") < 20.25)
    return explore.map_points_of_sample(sample, digits=6, **TIES)


@query
def map_points_box(spark, sf_dir):
    sample = sampling.sample_first(telemetry(spark, sf_dir), TEN_MINUTES, **TIES)
    boxed = geo.in_bbox(sample, geo.MAP_BOX, inclusive=False)
    return explore.map_points_of_sample(boxed, digits=6, **TIES)


@query
def points_for_hour(spark, sf_dir):
    return explore.points_for_hour(telemetry(spark, sf_dir), HOUR_START, HOUR_END)


# --- months -------------------------------------------------------------------


@query
def fuel_by_month_pivot(spark, sf_dir):
    return round_doubles(explore.fuel_by_month_pivot(telemetry(spark, sf_dir), MONTHS))


@query
def fuel_by_machine_pivot(spark, sf_dir):
    return round_doubles(explore.fuel_by_machine_pivot(telemetry(spark, sf_dir), SERIALS))


@query
def speed_ratio_pivot(spark, sf_dir):
    columns = {"fuel": MA_COLUMNS["fuel"], "speed": MA_COLUMNS["speed"]}
    sample = averaged_minutes(spark, sf_dir, columns, {"30m": 180})
    return explore.speed_ratio_pivot(sample, MONTHS)


# --- positions ----------------------------------------------------------------


@query
def extent_nm(spark, sf_dir):
    return round_doubles(geo.extent_nm(telemetry(spark, sf_dir)))


@query
def global_bbox(spark, sf_dir):
    return round_doubles(geo.bbox(telemetry(spark, sf_dir), grid.MAP_MARGIN))


@query
def haversine_pairs(spark, sf_dir):
    """Distance of every row from one place, in the three units."""
    there = ("gps_longitude", "gps_latitude", F.lit(DEPOT[0]), F.lit(DEPOT[1]))
    pairs = telemetry(spark, sf_dir).select(
        "event_id", *[haversine(*there, units=u).alias(u) for u in ("km", "miles", "m")]
    )
    return round_doubles(pairs, "km", "miles").withColumn("m", rounded("m", 3))


@query
def zone_counts(spark, sf_dir):
    return explore.count_by(geo.assign_zones(minutes(spark, sf_dir)), ["zone_id"], "n")


@query
def zone_table_counts(spark, sf_dir):
    """As `zone_counts`, with the zones in a table met by an equality join on cells."""
    zones = local_table(
        spark,
        [(z.zone_id, *z.box) for z in geo.DEFAULT_ZONES],
        "zone_id int, left double, bottom double, right double, top double",
    )
    placed = geo.assign_zone_table(minutes(spark, sf_dir), zones)
    return explore.count_by(placed, ["zone_id"], "n")


@query
def grid_heatmap(spark, sf_dir):
    return grid.grid_count(telemetry(spark, sf_dir), 80, 80)


@query
def road_fuel_grid(spark, sf_dir):
    """Mean fuel use per cell away from the sites, brake off and warm weather."""
    road = flagged(spark, sf_dir).filter(
        (F.col("in_field") == 0)
        & (F.col("parking_break_status") == 0)
        & (F.col("temp_ambient_c") > 20)
    )
    used = ["gps_longitude", "gps_latitude", "engine_rpm", "engine_load",
            "fuel_consumption_l_h", "speed_gearbox_km_h"]
    road = road.select(*used).dropna()
    return round_doubles(grid.grid_agg(road, F.avg("fuel_consumption_l_h"), 200, 200))


@query
def candidate_fields(spark, sf_dir):
    return grid.candidate_fields(telemetry(spark, sf_dir))


@query
def candidate_fields_low(spark, sf_dir):
    return grid.candidate_fields(telemetry(spark, sf_dir), cutoff=LOW_CUTOFF)


@query
def zone_grid(spark, sf_dir):
    return grid.zone_grid(minutes(spark, sf_dir))


@query
def zone_dense_cells(spark, sf_dir):
    return grid.dense_cells(grid.zone_grid(minutes(spark, sf_dir)), LOW_CUTOFF)


# --- sites --------------------------------------------------------------------


@query
def high_load_points(spark, sf_dir):
    busy = cluster.high_load_points(geo.assign_zones(fuel_minutes(spark, sf_dir)))
    return busy.select("zone_id", "event_id", "gps_longitude", "gps_latitude")


@query
def every_nth(spark, sf_dir):
    placed = geo.assign_zones(minutes(spark, sf_dir))
    thin = sampling.every_nth(placed, THINNING, ["zone_id"], ORDER)
    return thin.select("zone_id", "event_id", "gps_longitude", "gps_latitude")


@query
def wss_curve(spark, sf_dir):
    """Curves of all zones, from one set of rounds."""
    rows = geo.assign_zones(minutes(spark, sf_dir))
    return round_doubles(cluster.wss_curves(rows, "zone_id"))


@query
def silhouette_curve(spark, sf_dir):
    rows = cluster.thinned(geo.assign_zones(minutes(spark, sf_dir)), THINNING, ["zone_id"], ORDER)
    curves = cluster.wss_curves(rows, "zone_id", silhouette=True).drop("wss")
    return round_doubles(curves.filter(F.col("silhouette").isNotNull()))


@query
def field_centers(spark, sf_dir):
    """Centres of all zones, each with the k that its curve prefers."""
    return round_doubles(cluster.field_centers(fuel_minutes(spark, sf_dir), order=ORDER))


@query
def field_outliers(spark, sf_dir):
    """The farthest high-load points of every zone, set aside in each round."""
    busy = cluster.high_load_points(geo.assign_zones(fuel_minutes(spark, sf_dir)))
    _, outliers = cluster.kmeans_without_outliers(busy, "zone_id", OUTLIER_K, N_OUTLIERS)
    return outliers


@query
def fuzzy_centers(spark, sf_dir):
    busy = cluster.high_load_points(geo.assign_zones(fuel_minutes(spark, sf_dir)))
    return round_doubles(fuzzy.fuzzy_cmeans(busy, "zone_id", FUZZY_K, rounds=FUZZY_ROUNDS))


@query
def fuzzy_memberships(spark, sf_dir):
    """The strongest membership of every high-load row."""
    busy = cluster.high_load_points(geo.assign_zones(fuel_minutes(spark, sf_dir)))
    found = fuzzy.fuzzy_cmeans(busy, "zone_id", FUZZY_K, rounds=FUZZY_ROUNDS)
    rows = fuzzy.with_memberships(busy, found, "zone_id").withColumn("membership", F.array_max("memberships"))
    return round_doubles(rows.select("zone_id", "event_id", "membership"))


@query
def gap_statistic(spark, sf_dir):
    rows = geo.assign_zones(minutes(spark, sf_dir))
    return round_doubles(gap.gap_statistic(rows, "zone_id", GAP_K, GAP_SETS, GAP_SIZE))


@query
def in_field(spark, sf_dir):
    return flagged(spark, sf_dir).select("event_id", "in_field")


@query
def nearest_center(spark, sf_dir):
    rows = minutes(spark, sf_dir)
    return round_doubles(
        geo.nearest_center(rows, centers(spark)).select("event_id", "nearest_km"), "nearest_km"
    )


@query
def in_field_counts(spark, sf_dir):
    return reports.in_field_counts(flagged(spark, sf_dir))


# --- sessions -----------------------------------------------------------------


@query
def mark_gaps(spark, sf_dir):
    marked = sessions.mark_gaps(minutes(spark, sf_dir), order=ORDER)
    return marked.select("event_id", "next_time", "gap_minutes", "symb")


@query
def session_rows(spark, sf_dir):
    return working_sessions(spark, sf_dir).select(
        KEY, "event_id", "in_field", "symb", "session_id"
    )


@query
def session_times(spark, sf_dir):
    return sessions.session_times(working_sessions(spark, sf_dir))


@query
def session_times_plain(spark, sf_dir):
    return sessions.session_times(working_sessions(spark, sf_dir), mode="plain")


@query
def machine_times(spark, sf_dir):
    return sessions.machine_times(working_sessions(spark, sf_dir))


@query
def session_overview(spark, sf_dir):
    return round_doubles(sessions.session_overview(working_sessions(spark, sf_dir)))


@query
def session_trace(spark, sf_dir):
    traced = sessions.session_trace(working_sessions(spark, sf_dir), order=ORDER)
    flags = ["field_flag", "parking_flag"]
    return round_doubles(traced.select("event_id", "session_id", "row_index", *flags), *flags)


@query
def centers_near_session(spark, sf_dir):
    overview = sessions.session_overview(working_sessions(spark, sf_dir))
    return sessions.centers_near_session(overview, centers(spark))


# --- report questions ---------------------------------------------------------


@query
def q1_time_split(spark, sf_dir):
    times = sessions.machine_times(working_sessions(spark, sf_dir))
    return round_doubles(reports.time_split(times))


@query
def q1_hours_check(spark, sf_dir):
    times = sessions.machine_times(working_sessions(spark, sf_dir))
    return reports.hours_check(times, telemetry(spark, sf_dir))


@query
def q1_clustered(spark, sf_dir):
    """The time split with centres found by clustering instead of given ones."""
    found = cluster.field_centers(fuel_minutes(spark, sf_dir), order=ORDER)
    on_site = geo.flag_in_field(minutes(spark, sf_dir), found)
    times = sessions.machine_times(sessions.assign_sessions(on_site, order=ORDER))
    return round_doubles(reports.time_split(times))


@query
def q2_field_count(spark, sf_dir):
    return reports.field_count(flagged(spark, sf_dir))


@query
def q2_field_count_low(spark, sf_dir):
    return reports.field_count(flagged(spark, sf_dir), cutoff=LOW_CUTOFF)


@query
def q3_activities(spark, sf_dir):
    sample = averaged_minutes(spark, sf_dir, {"speed": MA_COLUMNS["speed"]}, {"30m": 180})
    return reports.activities(geo.flag_in_field(sample, centers(spark)))


@query
def q6_road_fuel(spark, sf_dir):
    on_site = flagged(spark, sf_dir)
    times = sessions.machine_times(sessions.assign_sessions(on_site, order=ORDER))
    return round_doubles(reports.road_fuel(on_site, times))
