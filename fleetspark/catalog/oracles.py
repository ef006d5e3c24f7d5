"""The same results as `queries.py`, as SQL for DuckDB.

Written without the library's operators: plain windows over whole machines, exact
medians, nested-loop distances.  Only parameters and fixed texts are shared.
"""

from __future__ import annotations

from fleetspark.catalog.queries import (
    CENTERS,
    DEPOT,
    FIRST_DAY,
    FUZZY_K,
    FUZZY_ROUNDS,
    GAP_K,
    GAP_SETS,
    GAP_SIZE,
    HOUR_END,
    HOUR_START,
    LAST_DAY,
    LOW_CUTOFF,
    MONTHS,
    N_OUTLIERS,
    OUTLIER_K,
    SERIALS,
    THINNING,
)
from fleetspark.functions.labels import (
    MA_LABEL,
    NIL_LABEL,
    PLAIN_LABEL,
    SAMPLE_MA_LABEL,
    SHORT_LABEL,
)
from fleetspark.operators.explore import month_name
from fleetspark.operators.geo import DEFAULT_ZONES, MAP_BOX
from fleetspark.schema import MA_COLUMNS, MA_FRAMES, NUMERIC, SAMPLED, TELEMETRY, TELEMETRY_TYPES
from fleetspark.sources.events import TELEMETRY_SQL

ORACLES: dict[str, str] = {}

COLUMNS = ", ".join(TELEMETRY)
ORDER = "date_time, event_id"
MACHINE = f"PARTITION BY serial_number ORDER BY {ORDER}"


def r6(expression: str) -> str:
    return f"round(({expression}) + 1e-9, 6)"


def oracle(name: str, select: str, *ctes: str) -> None:
    base = f"telemetry AS (SELECT event_id, {TELEMETRY_SQL} FROM events)"
    ORACLES[name] = f"WITH RECURSIVE {', '.join([base, *ctes])}\n{select}"


def first_rows(name: str, bucket: str, source: str = "telemetry") -> str:
    return (
        f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER "
        f"(PARTITION BY serial_number, {bucket} ORDER BY {ORDER}) = 1)"
    )


def moving(columns: dict[str, str], frames: dict[str, int]) -> str:
    return ", ".join(
        f"avg({column}) OVER ({MACHINE} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) "
        f"AS {name}_ma{label and '_' + label}"
        for label, n in frames.items()
        for name, column in columns.items()
    )


MINUTE = "date_trunc('minute', date_time)"
TEN_MINUTES = "substring(CAST(date_time AS VARCHAR), 1, 15)"
MINUTES = first_rows("minutes", MINUTE)
TENS = first_rows("tens", TEN_MINUTES)

CENTER_ROWS = ", ".join(f"({x}, {y})" for x, y in CENTERS)
CENTER_CTE = f"centers(x, y) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE) FROM (VALUES {CENTER_ROWS}) v(a, b))"


def distance_m(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"(2 * 6378137.0 * atan2(sqrt({h}), sqrt(1 - ({h}))))"


TO_CENTER = distance_m("m.gps_longitude", "m.gps_latitude", "c.x", "c.y")


def flagged_cte(source: str) -> str:
    return (
        f"flagged AS (SELECT m.*, CASE WHEN EXISTS (SELECT 1 FROM centers c WHERE {TO_CENTER} "
        f"/ 1000 < 1.5) THEN 1 ELSE 0 END AS in_field FROM {source} m)"
    )


FLAGGED = [MINUTES, CENTER_CTE, flagged_cte("minutes")]


def gaps_cte(source: str) -> list[str]:
    return [
        f"nexts AS (SELECT *, lead(date_time) OVER ({MACHINE}) AS next_time FROM {source})",
        "gaps AS (SELECT *, abs(date_diff('minute', date_time, next_time)) AS gap_minutes FROM nexts)",
        "marked AS (SELECT *, CASE WHEN gap_minutes <= 120 THEN 1 ELSE 2 END AS symb FROM gaps)",
    ]


SESSIONS = [
    *FLAGGED,
    *gaps_cte("flagged"),
    f"sessions AS (SELECT *, 1 + coalesce(sum(CASE WHEN symb = 2 THEN 1 ELSE 0 END) OVER ({MACHINE} "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session_id FROM marked)",
]
TIMES = (
    "times AS (SELECT serial_number, session_id, count(*) AS n_rows, sum(symb) - 1 AS total_minutes, "
    "coalesce(sum(symb) FILTER (WHERE in_field = 1), 0) - 1 AS activity_minutes, "
    "sum(symb) - coalesce(sum(symb) FILTER (WHERE in_field = 1), 0) AS transport_minutes "
    "FROM sessions GROUP BY ALL)"
)
MACHINE_TIMES = (
    "machine_times AS (SELECT serial_number, count(*) FILTER (WHERE n_rows >= 8) AS n_sessions, "
    "coalesce(sum(activity_minutes) FILTER (WHERE n_rows >= 8), 0) AS activity_minutes, "
    "coalesce(sum(transport_minutes) FILTER (WHERE n_rows >= 8), 0) AS transport_minutes "
    "FROM times GROUP BY serial_number)"
)

ZONE_ROWS = ", ".join(f"({z.zone_id}, {', '.join(map(str, z.box))})" for z in DEFAULT_ZONES)
ZONES = (
    'zones AS (SELECT zone_id, CAST(a AS DOUBLE) AS "left", CAST(b AS DOUBLE) AS bottom, '
    'CAST(c AS DOUBLE) AS "right", CAST(d AS DOUBLE) AS "top" '
    f"FROM (VALUES {ZONE_ROWS}) v(zone_id, a, b, c, d))"
)


def zoned(source: str) -> str:
    return (
        f"zoned AS (SELECT z.*, s.* FROM {source} s JOIN zones z ON s.gps_longitude >= z.\"left\" "
        'AND s.gps_longitude <= z."right" AND s.gps_latitude >= z.bottom AND s.gps_latitude <= z."top")'
    )


def cell(value: str, low: str, high: str, n: str) -> str:
    width = f"nullif((({high}) - ({low})) / ({n}), 0)"
    return (
        f"CAST(coalesce(least(greatest(ceil(({value} - ({low})) / {width}), 1), {n}), 1) AS INTEGER)"
    )


ZONE_CELLS = [
    "extents AS (SELECT zone_id, min(gps_longitude) AS x0, max(gps_longitude) AS x1, "
    "min(gps_latitude) AS y0, max(gps_latitude) AS y1, "
    'any_value(ceil(("right" - "left") / (1.0::DOUBLE / 240))) AS nx, '
    'any_value(ceil(("top" - bottom) / (1.0::DOUBLE / 240))) AS ny FROM zoned GROUP BY zone_id)',
    f"cells AS (SELECT zone_id, {cell('gps_longitude', 'x0', 'x1', 'nx')} AS ix, "
    f"{cell('gps_latitude', 'y0', 'y1', 'ny')} AS iy, count(*) AS n "
    "FROM zoned JOIN extents USING (zone_id) GROUP BY ALL)",
]


def label(fields, time: str = "date_time") -> str:
    parts = [f"CAST({time} AS VARCHAR)", "'<br />'"]
    for i, f in enumerate(fields):
        value = f"CAST({f.column} AS VARCHAR)"
        parts += [f"'  -  {f.caption}: '", f"coalesce({value}, 'nil')" if f.nil else value]
        if i < len(fields) - 1:
            parts.append(f"'{f.end}'")
    return " || ".join(parts)


def points(fields) -> str:
    return f"{label(fields)} AS name, gps_latitude AS latitude, gps_longitude AS longitude"


LABEL_MA = moving(MA_COLUMNS, {"": 60})
ROUNDED_LABEL_MA = ", ".join(f"{r6(f'{c}_ma')} AS {c}_ma" for c in MA_COLUMNS)
ROUND_MA = f"SELECT * REPLACE ({ROUNDED_LABEL_MA})"

# --- cleaning -----------------------------------------------------------------

RAW = (
    "raw AS (SELECT "
    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in TELEMETRY)
    + " FROM telemetry UNION ALL SELECT "
    + ", ".join("'DateTime'" if c == "date_time" else f"'{c}'" for c in TELEMETRY)
    + ")"
)
oracle("union_parts", "SELECT * FROM telemetry")
oracle(
    "count_rows",
    "SELECT 'raw' AS stage, count(*) AS n_rows FROM raw UNION ALL SELECT 'typed', count(*) FROM raw "
    "WHERE date_time IS DISTINCT FROM 'DateTime'",
    RAW,
)
oracle("drop_header", "SELECT * FROM raw WHERE date_time IS DISTINCT FROM 'DateTime'", RAW)


def typed(column: str) -> str:
    kind = TELEMETRY_TYPES[column]
    if column == "date_time":
        return "CAST(substring(date_time, 1, 19) AS TIMESTAMP) AS date_time"
    if column == "all_wheel_drive_status":
        return (
            f"CASE {column} WHEN 'on' THEN 'ON' WHEN 'off' THEN 'OFF' ELSE {column} END AS {column}"
        )
    if kind == "double":
        return f"CAST({column} AS DOUBLE) AS {column}"
    return f"CAST({column} AS INTEGER) AS {column}" if kind == "int" else column


oracle(
    "clean_telemetry",
    f"SELECT {', '.join(map(typed, TELEMETRY))} FROM raw WHERE date_time IS DISTINCT FROM 'DateTime'",
    RAW,
)
oracle("latest_rows", "SELECT * FROM telemetry ORDER BY date_time DESC, event_id DESC LIMIT 10")

# --- counts and summaries -----------------------------------------------------

oracle("distinct_serials", "SELECT DISTINCT serial_number FROM telemetry")
oracle("distinct_gears", "SELECT DISTINCT gear_shift FROM telemetry")
oracle(
    "machine_activity",
    "SELECT serial_number, count(DISTINCT CAST(date_time AS DATE)) AS days_on_run, "
    "min(date_time) AS start_date, max(date_time) AS max_date, "
    f"{r6('max(total_working_hours) - min(total_working_hours)')} AS working_hours "
    "FROM telemetry GROUP BY 1",
)
oracle(
    "day_span",
    # Integer arithmetic, so that halves are rounded exactly.
    "SELECT *, CAST((abs(date_diff('second', start_day, end_day)) * 100 + 1800) // 3600 AS DOUBLE) / 100 "
    "AS day_hours FROM (SELECT serial_number, CAST(date_time AS DATE) AS day, min(date_time) AS start_day, "
    "max(date_time) AS end_day FROM telemetry GROUP BY 1, 2)",
)
oracle(
    "rows_for_range",
    "SELECT * FROM telemetry WHERE serial_number = 'A03' AND CAST(date_time AS DATE) "
    f"BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'",
)
oracle(
    "sample_for_range",
    "SELECT * FROM minutes WHERE date_time >= TIMESTAMP '2024-01-04 21:41:00' "
    "AND date_time <= TIMESTAMP '2024-01-05 09:13:04'",
    MINUTES,
)
oracle(
    "status_combos",
    "SELECT gear_shift, differential_lock_status, all_wheel_drive_status, count(*) AS cnt "
    "FROM telemetry GROUP BY ALL",
)
oracle(
    "awd_values",
    "SELECT serial_number, string_agg(DISTINCT all_wheel_drive_status, ', ' ORDER BY all_wheel_drive_status) "
    "AS drive_values FROM telemetry WHERE all_wheel_drive_status IS NOT NULL GROUP BY 1",
)
oracle(
    "awd_counts",
    "SELECT serial_number, all_wheel_drive_status, count(*) AS cnt FROM telemetry "
    "WHERE all_wheel_drive_status IS NOT NULL GROUP BY 1, 2",
)
oracle(
    "events_per_machine",
    "SELECT serial_number, count(*) AS events_recorded FROM telemetry GROUP BY 1",
)
oracle(
    "load_summary",
    f"SELECT serial_number, {r6('avg(engine_load)')} AS avg_load, {r6('median(engine_load)')} AS median_load "
    "FROM telemetry GROUP BY 1",
)
FUEL = "fuel_consumption_l_h"
oracle(
    "fuel_summary",
    f"SELECT serial_number, {r6(f'max({FUEL})')} AS max_fuel, {r6(f'avg({FUEL})')} AS avg_fuel, "
    f"{r6(f'median({FUEL})')} AS median_fuel, count(*) AS event_cnt FROM telemetry GROUP BY 1",
)
ATTRIBUTES = {
    "max_radar_speed": "max(speed_radar_km_h)",
    "max_gearbox_speed": "max(speed_gearbox_km_h)",
    "avg_gearbox_speed": "avg(speed_gearbox_km_h)",
    "med_gearbox_speed": "median(speed_gearbox_km_h)",
    "max_engine_rpm": "max(engine_rpm)",
    "avg_engine_rpm": "avg(engine_rpm)",
    "med_engine_rpm": "median(engine_rpm)",
    "avg_engine_load": "avg(engine_load)",
    "med_engine_load": "median(engine_load)",
    "max_fuel": f"max({FUEL})",
    "avg_fuel": f"avg({FUEL})",
    "med_fuel": f"median({FUEL})",
    "min_working_hours": "min(total_working_hours)",
    "max_working_hours": "max(total_working_hours)",
}
oracle(
    "attribute_summary",
    "SELECT serial_number, min(CAST(date_time AS DATE)) AS start_date, max(CAST(date_time AS DATE)) AS end_date, "
    + ", ".join(f"{r6(e)} AS {n}" for n, e in ATTRIBUTES.items())
    + " FROM telemetry GROUP BY 1",
)
EXTREMES = {
    "gearbox_speed": "speed_gearbox_km_h",
    "radar": "speed_radar_km_h",
    "coolant": "temp_coolant_c",
    "front": "pto_front_rpm",
    "rear": "pto_rear_rpm",
    "ambient": "temp_ambient_c",
}


def nested_cte(column: str, field: str, out: str) -> str:
    quote = "" if TELEMETRY_TYPES[column] == "int" else '"'
    value = f"CASE WHEN {column} IS NULL THEN '' ELSE '\"{field}\":{quote}' || {column} || '{quote},' END"
    return (
        f"{out}_t AS (SELECT serial_number, '[' || string_agg('{{' || {value} || '\"cnt\":' || cnt || '}}', ',' "
        f"ORDER BY cnt DESC, {column} ASC NULLS FIRST) || ']' AS {out} FROM (SELECT serial_number, {column}, "
        "count(*) AS cnt FROM telemetry GROUP BY 1, 2) GROUP BY 1)"
    )


oracle(
    "machine_summary",
    "SELECT t.*, gears, differentials, wheel4drive FROM (SELECT serial_number, count(*) AS cnt, "
    + ", ".join(
        f"{r6(f'{f}({c})')} AS {f}_{n}" for n, c in EXTREMES.items() for f in ("min", "max")
    )
    + ", "
    + ", ".join(
        f"{r6(f'median({EXTREMES[n]})')} AS med_{n}" for n in ("coolant", "front", "rear", "ambient")
    )
    + f", CAST(sum(parking_break_status) AS BIGINT) AS parked, {r6(f'max({FUEL})')} AS max_fuel, "
    "count(*) FILTER (WHERE creeper_status = 'OFF') AS creep_off, "
    "count(*) - count(*) FILTER (WHERE creeper_status = 'OFF') AS creep_on, "
    "count(*) FILTER (WHERE pto_front_rpm > 0) AS front_positive, "
    "count(*) FILTER (WHERE pto_front_rpm = 0) AS front_zeros, "
    "count(*) FILTER (WHERE pto_rear_rpm > 0) AS rear_positive, "
    "count(*) FILTER (WHERE pto_rear_rpm = 0) AS rear_zeros "
    "FROM telemetry WHERE engine_load > 60 GROUP BY 1) t "
    "LEFT JOIN gears_t USING (serial_number) LEFT JOIN differentials_t USING (serial_number) "
    "LEFT JOIN wheel4drive_t USING (serial_number)",
    nested_cte("gear_shift", "gear", "gears"),
    nested_cte("differential_lock_status", "differential", "differentials"),
    nested_cte("all_wheel_drive_status", "4wheelDrive", "wheel4drive"),
)
oracle(
    "column_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(f'min({c})')} AS \"min\", {r6(f'quantile_cont({c}, 0.25)')} AS q1, "
        f"{r6(f'median({c})')} AS median, {r6(f'avg({c})')} AS mean, {r6(f'quantile_cont({c}, 0.75)')} AS q3, "
        f"{r6(f'max({c})')} AS \"max\", count(*) - count({c}) AS n_null "
        f"FROM (SELECT {e} AS {c} FROM telemetry)"
        for c, e in [*((c, f"CAST({c} AS DOUBLE)") for c in NUMERIC), ("date_time", "CAST(epoch_us(date_time) // 1000000 AS DOUBLE)")]
    ),
)
oracle(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({a}, {b})')} AS correlation FROM filled"
        for a in NUMERIC
        for b in NUMERIC
    ),
    f"filled AS (SELECT {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in NUMERIC)} FROM telemetry)",
)
oracle(
    "concurrent_hours",
    "SELECT substring(CAST(date_time AS VARCHAR), 1, 13) AS hour, count(DISTINCT serial_number) AS machines_active "
    "FROM telemetry GROUP BY 1 HAVING machines_active > 1",
)

# --- radar --------------------------------------------------------------------


def tens_of(c: str) -> str:
    return f"CAST(round(round({c}) / 10) * 10 AS INTEGER)"


oracle("radar_max_bucket", f"SELECT {tens_of('max(speed_radar_km_h)')} AS speed FROM telemetry")
oracle(
    "speed_buckets",
    f"SELECT {tens_of('speed_radar_km_h')} AS speed, {tens_of('speed_gearbox_km_h')} AS speed_gear, "
    "count(*) AS cnt FROM telemetry GROUP BY 1, 2",
)
oracle(
    "radar_anomalies",
    f"SELECT {COLUMNS}, {tens_of('speed_radar_km_h')} AS speed FROM tens WHERE {tens_of('speed_radar_km_h')} > 100",
    TENS,
)
oracle(
    "radar_error",
    f"SELECT {r6('avg(abs(speed_radar_km_h - speed_gearbox_km_h))')} AS mean_abs_error FROM telemetry",
)
oracle(
    "radar_totals",
    "SELECT count(*) AS cnt, min(speed_radar_km_h) AS min_radar, max(speed_radar_km_h) AS max_radar, "
    f"CAST(sum(parking_break_status) AS BIGINT) AS parked, max({FUEL}) AS max_fuel, "
    "count(*) FILTER (WHERE creeper_status = 'OFF') AS creep_off, "
    "count(*) - count(*) FILTER (WHERE creeper_status = 'OFF') AS creep_on "
    "FROM telemetry WHERE speed_radar_km_h > 100",
)

# --- samples and averages -----------------------------------------------------

AVERAGED = f"averaged AS (SELECT *, {moving(MA_COLUMNS, MA_FRAMES)} FROM telemetry)"
MA_ROUNDED = ", ".join(
    f"{r6(f'{c}_ma_{frame}')} AS {c}_ma_{frame}" for frame in MA_FRAMES for c in MA_COLUMNS
)
for name, bucket in (("sample_1min", MINUTE), ("sample_10min", TEN_MINUTES)):
    oracle(
        name,
        f"SELECT {', '.join(SAMPLED)}, {MA_ROUNDED} FROM sampled",
        AVERAGED,
        first_rows("sampled", bucket, "averaged"),
    )
oracle(
    "sample_counts",
    f"SELECT '1 min' AS sample, count(DISTINCT (serial_number, {MINUTE})) AS n_rows FROM telemetry "
    f"UNION ALL SELECT '10 min', count(DISTINCT (serial_number, {TEN_MINUTES})) FROM telemetry",
)
oracle("moving_averages", f"SELECT event_id, {MA_ROUNDED} FROM averaged", AVERAGED)

# --- map points ---------------------------------------------------------------

oracle("map_points", f"SELECT {points(PLAIN_LABEL)} FROM minutes", MINUTES)
oracle(
    "map_points_short",
    f"SELECT {points(SHORT_LABEL)} FROM minutes WHERE serial_number = 'A05' "
    f"AND CAST(date_time AS DATE) = DATE '{FIRST_DAY}'",
    MINUTES,
)
oracle(
    "map_points_nil",
    f"SELECT {points(NIL_LABEL)} FROM sampled",
    "uncrept AS (SELECT * FROM telemetry WHERE creeper_status IS NULL)",
    first_rows("sampled", MINUTE, "uncrept"),
)
oracle(
    "map_points_ma",
    f"SELECT {points(MA_LABEL)} FROM ({ROUND_MA} FROM sampled)",
    f"averaged AS (SELECT *, {LABEL_MA} FROM telemetry)",
    first_rows("sampled", MINUTE, "averaged"),
)
oracle(
    "map_points_first",
    f"SELECT {points(MA_LABEL)} FROM ({ROUND_MA} FROM sampled ORDER BY date_time, event_id LIMIT 1000)",
    f"averaged AS (SELECT *, {LABEL_MA} FROM telemetry WHERE serial_number = 'A09')",
    first_rows("sampled", MINUTE, "averaged"),
)
oracle(
    "map_points_half_plane",
    f"SELECT {points(SAMPLE_MA_LABEL)} FROM ({ROUND_MA} FROM averaged)",
    MINUTES,
    f"averaged AS (SELECT *, {LABEL_MA} FROM minutes WHERE gps_longitude < 20.25)",
)
oracle(
    "map_points_box",
    f"SELECT {points(SAMPLE_MA_LABEL)} FROM ({ROUND_MA} FROM averaged)",
    TENS,
    f"averaged AS (SELECT *, {LABEL_MA} FROM tens WHERE gps_latitude > {MAP_BOX.bottom} "
    f"AND gps_latitude < {MAP_BOX.top} AND gps_longitude > {MAP_BOX.left} AND gps_longitude < {MAP_BOX.right})",
)
oracle(
    "points_for_hour",
    "SELECT CAST(date_time AS VARCHAR) || '  -  ' || serial_number AS name, gps_longitude, gps_latitude "
    f"FROM telemetry WHERE date_time >= TIMESTAMP '{HOUR_START}' AND date_time < TIMESTAMP '{HOUR_END}'",
)

# --- months -------------------------------------------------------------------


def pivot_cells(column: str, values, metric: str, names) -> str:
    return ", ".join(
        f"sum({metric}) FILTER (WHERE {column} = '{v}') AS {n}" for v, n in zip(values, names)
    )


MONTH_NAMES = [month_name(m) for m in MONTHS]
MONTHLY = (
    "monthly AS (SELECT serial_number, strftime(date_time, '%Y-%m') AS month, "
    f"{r6(f'avg({FUEL})')} AS avg_fuel FROM telemetry GROUP BY 1, 2)"
)
oracle(
    "fuel_by_month_pivot",
    f"SELECT serial_number, {pivot_cells('month', MONTHS, 'avg_fuel', MONTH_NAMES)} FROM monthly GROUP BY 1",
    MONTHLY,
)
oracle(
    "fuel_by_machine_pivot",
    f"SELECT month, {pivot_cells('serial_number', SERIALS, 'avg_fuel', SERIALS)} FROM monthly GROUP BY 1",
    MONTHLY,
)
oracle(
    "speed_ratio_pivot",
    f"SELECT serial_number, {pivot_cells('month', MONTHS, 'metric', MONTH_NAMES)} FROM "
    "(SELECT serial_number, strftime(day, '%Y-%m') AS month, "
    "round(sum(above)::DOUBLE / nullif(sum(below), 0), 5) AS metric FROM daily GROUP BY 1, 2) GROUP BY 1",
    AVERAGED,
    first_rows("sampled", MINUTE, "averaged"),
    "daily AS (SELECT serial_number, CAST(date_time AS DATE) AS day, "
    "count(*) FILTER (WHERE speed_ma_30m > 10 AND fuel_ma_30m > 30) AS above, "
    "count(*) FILTER (WHERE speed_ma_30m < 10 AND fuel_ma_30m > 30) AS below FROM sampled GROUP BY 1, 2)",
)

# --- positions ----------------------------------------------------------------

oracle(
    "extent_nm",
    f"SELECT {r6('(max(gps_latitude) - min(gps_latitude)) / 0.0167')} AS y_extent, "
    f"{r6('(max(gps_longitude) - min(gps_longitude)) / 0.0167')} AS x_extent FROM telemetry",
)
oracle(
    "global_bbox",
    f"SELECT {r6('min(gps_longitude) - 0.2')} AS \"left\", {r6('min(gps_latitude) - 0.2')} AS bottom, "
    f"{r6('max(gps_longitude) + 0.2')} AS \"right\", {r6('max(gps_latitude) + 0.2')} AS \"top\" FROM telemetry",
)
TO_DEPOT = distance_m("gps_longitude", "gps_latitude", str(DEPOT[0]), str(DEPOT[1]))
oracle(
    "haversine_pairs",
    f"SELECT event_id, {r6(f'{TO_DEPOT} / 1000')} AS km, {r6(f'{TO_DEPOT} / 1609.344')} AS miles, "
    f"round({TO_DEPOT} + 1e-6, 3) AS m FROM telemetry",
)
for name in ("zone_counts", "zone_table_counts"):
    oracle(
        name,
        "SELECT zone_id, count(*) AS n FROM zoned GROUP BY 1",
        MINUTES,
        ZONES,
        zoned("minutes"),
    )


def ranged_cells(nx: str, ny: str) -> str:
    return (
        f"{cell('gps_longitude', 'x0', 'x1', nx)} AS ix, {cell('gps_latitude', 'y0', 'y1', ny)} AS iy"
    )


def data_range(source: str) -> str:
    return (
        "data_range AS (SELECT min(gps_longitude) AS x0, max(gps_longitude) AS x1, "
        f"min(gps_latitude) AS y0, max(gps_latitude) AS y1 FROM {source})"
    )


oracle(
    "grid_heatmap",
    f"SELECT {ranged_cells('80', '80')}, count(*) AS n FROM telemetry, data_range GROUP BY 1, 2",
    data_range("telemetry"),
)
oracle(
    "road_fuel_grid",
    f"SELECT {ranged_cells('200', '200')}, {r6(f'avg({FUEL})')} AS z FROM road, data_range GROUP BY 1, 2",
    *FLAGGED,
    f"road AS (SELECT * FROM flagged WHERE in_field = 0 AND parking_break_status = 0 AND temp_ambient_c > 20 "
    f"AND {FUEL} IS NOT NULL AND engine_rpm IS NOT NULL AND engine_load IS NOT NULL "
    "AND speed_gearbox_km_h IS NOT NULL)",
    data_range("road"),
)
for name, cutoff in (("candidate_fields", 1800), ("candidate_fields_low", LOW_CUTOFF)):
    oracle(
        name,
        f"SELECT max(nx) AS cells_x, max(ny) AS cells_y, count(*) FILTER (WHERE n > {cutoff}) AS n_candidates "
        f"FROM (SELECT {ranged_cells('nx', 'ny')}, any_value(nx) AS nx, any_value(ny) AS ny, count(*) AS n "
        "FROM telemetry, sized GROUP BY 1, 2)",
        data_range("telemetry"),
        "sized AS (SELECT *, CAST(ceil(((x1 + 0.2) - (x0 - 0.2)) / (1.0::DOUBLE / 60 / 2)) AS BIGINT) AS nx, "
        "CAST(ceil(((y1 + 0.2) - (y0 - 0.2)) / (1.0::DOUBLE / 60 / 2)) AS BIGINT) AS ny FROM data_range)",
    )
oracle(
    "zone_grid", "SELECT zone_id, ix, iy, n FROM cells", MINUTES, ZONES, zoned("minutes"), *ZONE_CELLS
)
oracle(
    "zone_dense_cells",
    f"SELECT zone_id, ix, iy, n FROM cells WHERE n > {LOW_CUTOFF}",
    MINUTES,
    ZONES,
    zoned("minutes"),
    *ZONE_CELLS,
)

# --- sites --------------------------------------------------------------------

oracle(
    "high_load_points",
    "SELECT zone_id, event_id, gps_longitude, gps_latitude FROM zoned WHERE fuel_ma_10m > 30",
    AVERAGED,
    first_rows("sampled", MINUTE, "averaged"),
    ZONES,
    zoned("sampled"),
)
oracle(
    "every_nth",
    "SELECT zone_id, event_id, gps_longitude, gps_latitude FROM zoned QUALIFY "
    f"(row_number() OVER (PARTITION BY zone_id ORDER BY {ORDER}) - 1) % 30 = 0",
    MINUTES,
    ZONES,
    zoned("minutes"),
)

def positions_cte(name: str, source: str) -> str:
    return (
        f"{name} AS (SELECT zone_id AS g, gps_longitude AS x, gps_latitude AS y, count(*) AS w "
        f"FROM {source} WHERE gps_longitude IS NOT NULL AND gps_latitude IS NOT NULL GROUP BY ALL)"
    )


def whole(c: str) -> str:
    return f"CAST(floor({c} * 1e9 + 0.5) AS BIGINT)"


def apart(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(({x1} - {x2}) * ({x1} - {x2}) + ({y1} - {y2}) * ({y1} - {y2}))"


def starts_ctes(p: str, pos: str, k: str, skip: int = 0) -> list[str]:
    """`{p}starts`(g, i, x, y): the place nearest the mean, then the farthest from all before."""
    cell = lambda c: f"least(coalesce(floor(({c} - {c}0) / nullif({c}1 - {c}0, 0) * 16), 0), 15)"
    mean = lambda c: f"sum({whole(c)} * w)::DOUBLE / sum(w)::DOUBLE / 1e9 AS {c}m"
    return [
        f"{p}about AS (SELECT g, min(x) AS x0, max(x) AS x1, {mean('x')}, min(y) AS y0, max(y) AS y1, {mean('y')} FROM {pos} GROUP BY g)",
        f"{p}few AS (SELECT * FROM (SELECT g, x, y, w, {apart('x', 'y', 'xm', 'ym')} AS near, {cell('x')} AS cx, {cell('y')} AS cy FROM {pos} JOIN {p}about USING (g)) "
        f"QUALIFY row_number() OVER (PARTITION BY g, cx, cy ORDER BY w DESC, x, y) <= {k})",
        f"{p}picks AS (SELECT g, 1 AS step, [x] AS xs, [y] AS ys FROM {p}few QUALIFY row_number() OVER (PARTITION BY g ORDER BY near, w DESC, x, y) = 1 "
        f"UNION ALL SELECT g, step + 1, list_append(xs, x), list_append(ys, y) FROM (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY d DESC, w DESC, x, y ROWS UNBOUNDED PRECEDING) AS taken "
        f"FROM (SELECT p.g, p.step, p.xs, p.ys, f.x, f.y, f.w, list_min(list_transform(range(1, len(xs) + 1), lambda i: {apart('f.x', 'f.y', 'xs[i]', 'ys[i]')})) AS d "
        f"FROM {p}picks p JOIN {p}few f USING (g) WHERE p.step < {k})) WHERE taken > {skip} QUALIFY row_number() OVER (PARTITION BY g ORDER BY taken) = 1 AND d > 0)",
        f"{p}starts AS (SELECT g, i - 1 AS i, xs[i] AS x, ys[i] AS y FROM (SELECT g, xs, ys, unnest(range(1, len(xs) + 1)) AS i FROM {p}picks QUALIFY row_number() OVER (PARTITION BY g ORDER BY step DESC) <= len(xs)) "
        f"QUALIFY len(xs) = max(len(xs)) OVER (PARTITION BY g))",
    ]


def near_select(pos: str, centres: str) -> str:
    """(g, k, x, y, w, near.d, near.i): the nearest centre of every model, ties to the lower number."""
    return (
        f"SELECT p.g, q.k, p.x, p.y, p.w, min({{'d': {apart('p.x', 'p.y', 'q.x', 'q.y')}, 'i': q.i}}) AS near "
        f"FROM {pos} p JOIN {centres} q ON q.g = p.g GROUP BY p.g, q.k, p.x, p.y, p.w"
    )


def kept_select(near: str, n: int) -> str:
    """Weights left after the n farthest points of each model are taken away."""
    if not n:
        return f"SELECT *, w AS kept FROM ({near})"
    before = "coalesce(sum(w) OVER (PARTITION BY g, k ORDER BY near.d DESC, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"SELECT * EXCLUDE (taken), w - least(w, greatest({n} - taken, 0)) AS kept FROM (SELECT *, {before} AS taken FROM ({near}))"


def kmeans_ctes(p: str, pos: str, models: str, k: str, outliers: int = 0, rounds: int = 20) -> list[str]:
    """`{p}near`: positions with their nearest centre after 20 rounds; `{p}final`: the centres of `models` (g, k)."""
    mean = lambda c: f"sum({whole(c)} * kept)::DOUBLE / sum(kept)::DOUBLE / 1e9 AS {c}"
    return [
        *starts_ctes(p, pos, k, outliers),
        f"{p}rounds AS (SELECT 0 AS step, g, m.k, i, x, y FROM {models} m JOIN {p}starts USING (g) WHERE i < m.k "
        f"UNION ALL SELECT r.step + 1, r.g, r.k, r.i, coalesce(m.x, r.x), coalesce(m.y, r.y) FROM {p}rounds r LEFT JOIN "
        f"(SELECT g, k, near.i AS i, {mean('x')}, {mean('y')} FROM ({kept_select(near_select(pos, f'{p}rounds'), outliers)}) WHERE kept > 0 GROUP BY g, k, near.i) m "
        f"ON m.g = r.g AND m.k = r.k AND m.i = r.i WHERE r.step < {rounds})",
        f"{p}final AS (SELECT g, k, i, x, y FROM {p}rounds WHERE step = {rounds})",
        f"{p}near AS ({kept_select(near_select(pos, f'{p}final'), outliers)})",
        f"{p}curve AS (SELECT g, k, sum(CAST(near.d * w AS DECIMAL(38,20))) AS wss, sum(w) AS n FROM {p}near GROUP BY g, k)",
    ]


def all_models(name: str, pos: str, k_max: int) -> str:
    return f"{name} AS (SELECT g, unnest(range(1, {k_max + 1})) AS k FROM (SELECT DISTINCT g FROM {pos}))"


ZONED = [MINUTES, ZONES, zoned("minutes"), positions_cte("pos", "zoned")]
CURVES = [all_models("models", "pos", 18), *kmeans_ctes("a_", "pos", "models", "18")]
BUSY = [
    AVERAGED,
    first_rows("sampled", MINUTE, "averaged"),
    ZONES,
    zoned("sampled"),
    "busy_rows AS (SELECT * FROM zoned WHERE fuel_ma_10m > 30)",
    positions_cte("busy", "busy_rows"),
]
CHOSEN = [
    *BUSY,
    positions_cte("pos", "zoned"),
    *CURVES,
    "chosen AS (SELECT g, k FROM a_curve QUALIFY row_number() OVER (PARTITION BY g ORDER BY wss, k) = 1)",
    *kmeans_ctes("b_", "busy", "chosen", "(SELECT max(k) FROM chosen)"),
]
oracle("wss_curve", f"SELECT g AS zone_id, k::INTEGER AS k, {r6('wss::DOUBLE')} AS wss FROM a_curve", *ZONED, *CURVES)
oracle("field_centers", f"SELECT g AS zone_id, {r6('x')} AS x, {r6('y')} AS y FROM b_final", *CHOSEN)
oracle(
    "field_outliers",
    "SELECT g AS zone_id, x, y, (w - kept)::BIGINT AS n FROM o_near WHERE kept < w",
    *BUSY,
    f"models AS (SELECT DISTINCT g, {OUTLIER_K} AS k FROM busy)",
    *kmeans_ctes("o_", "busy", "models", str(OUTLIER_K), N_OUTLIERS),
)
# Mean squared distances to a cluster from its sums, about the middle of the zone.
oracle(
    "silhouette_curve",
    f"SELECT g AS zone_id, k::INTEGER AS k, {r6('sum(s * w) / sum(w)')} AS silhouette FROM (SELECT *, CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM sides) GROUP BY g, k",
    *ZONED[:3],
    f"thin AS (SELECT * FROM zoned QUALIFY (row_number() OVER (PARTITION BY zone_id ORDER BY {ORDER}) - 1) % {THINNING} = 0)",
    positions_cte("pos", "thin"),
    *CURVES,
    "placed AS (SELECT a.g, a.k, a.near.i AS i, a.w, a.x - m.xm AS u, a.y - m.ym AS v FROM a_near a JOIN a_about m USING (g))",
    "sums AS (SELECT g, k, i, sum(w) AS n, sum(u * w) AS su, sum(v * w) AS sv, sum((u * u + v * v) * w) AS sq FROM placed GROUP BY ALL)",
    "sides AS (SELECT p.g, p.k, p.u, p.v, p.w, p.i, max(s.n) FILTER (WHERE s.i = p.i) AS n, "
    "min(u * u + v * v + (sq - 2 * u * su - 2 * v * sv) / s.n) FILTER (WHERE s.i <> p.i) AS b, "
    "max((u * u + v * v) * s.n + sq - 2 * u * su - 2 * v * sv) FILTER (WHERE s.i = p.i) / nullif(max(s.n) FILTER (WHERE s.i = p.i) - 1, 0) AS a "
    "FROM placed p JOIN sums s ON s.g = p.g AND s.k = p.k GROUP BY p.g, p.k, p.u, p.v, p.w, p.i HAVING count(*) > 1)",
)
FUZZY_FAR = f"list_transform(range(1, len(q.xs) + 1), lambda i: {apart('p.x', 'p.y', 'q.xs[i]', 'q.ys[i]')})"
FUZZY_SHARES = (
    "CASE WHEN list_position(far, 0) > 0 THEN list_transform(far, lambda d, i: CASE WHEN i = list_position(far, 0) THEN 1::DOUBLE ELSE 0 END) "
    "ELSE list_transform(far, lambda d: 1 / list_reduce(list_prepend(0::DOUBLE, list_transform(far, lambda e: d / e)), lambda s, e: s + e)) END"
)
FUZZY = [
    *BUSY,
    *starts_ctes("f_", "busy", str(FUZZY_K)),
    "fuzzy AS (SELECT 0 AS step, g, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys, list(0::DOUBLE ORDER BY i) AS ws FROM f_starts GROUP BY g "
    "UNION ALL SELECT step + 1, g, list(sx::DOUBLE / n::DOUBLE / 1e9 ORDER BY i), list(sy::DOUBLE / n::DOUBLE / 1e9 ORDER BY i), list(n::DOUBLE / 1e12 ORDER BY i) FROM ("
    f"SELECT step, g, i, sum(q * w) AS n, sum(q * w * {whole('x')}) AS sx, sum(q * w * {whole('y')}) AS sy FROM ("
    "SELECT step, g, x, y, w, unnest(range(len(us))) AS i, unnest(list_transform(us, lambda u: CAST(floor(u * u * 1e12 + 0.5) AS HUGEINT))) AS q FROM ("
    f"SELECT *, {FUZZY_SHARES} AS us FROM (SELECT q.step, p.g, p.x, p.y, p.w, {FUZZY_FAR} AS far FROM busy p JOIN fuzzy q ON q.g = p.g WHERE q.step < {FUZZY_ROUNDS}))) "
    "GROUP BY step, g, i) GROUP BY step, g)",
    f"fuzzy_end AS (SELECT * FROM fuzzy WHERE step = {FUZZY_ROUNDS})",
]
oracle(
    "fuzzy_centers",
    f"SELECT g AS zone_id, (i - 1)::INTEGER AS c, {r6('xs[i]')} AS x, {r6('ys[i]')} AS y, {r6('ws[i]')} AS weight FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM fuzzy_end)",
    *FUZZY,
)
oracle(
    "fuzzy_memberships",
    f"SELECT zone_id, event_id, {r6('list_max(us)')} AS membership FROM (SELECT *, {FUZZY_SHARES} AS us FROM (SELECT p.zone_id, p.event_id, {FUZZY_FAR} AS far "
    "FROM (SELECT *, gps_longitude AS x, gps_latitude AS y FROM busy_rows) p JOIN fuzzy_end q ON q.g = p.zone_id))",
    *FUZZY,
)
DRAWN = "('0x' || substr(md5(g || ':' || b || ':' || i), {}, 8))::BIGINT::DOUBLE / 4294967296"
oracle(
    "gap_statistic",
    f"SELECT p.zone_id, p.k::INTEGER AS k, {r6('p.s')} AS log_wss, {r6('avg(r.s) - p.s')} AS gap, {r6(f'stddev_pop(r.s) * sqrt(1 + 1 / {GAP_SETS}::DOUBLE)')} AS error "
    "FROM spreads p JOIN spreads r ON r.zone_id = p.zone_id AND r.k = p.k AND r.b > 0 WHERE p.b = 0 GROUP BY p.zone_id, p.k, p.s",
    *ZONED,
    f"drawn AS (SELECT g, unnest(range(1, {GAP_SETS + 1})) AS b FROM (SELECT DISTINCT g FROM pos))",
    f"numbers AS (SELECT g, b, unnest(range({GAP_SIZE})) AS i FROM drawn)",
    f"sets AS (SELECT g * {GAP_SETS + 1} AS g, x, y, w FROM pos UNION ALL SELECT g * {GAP_SETS + 1} + b, x0 + {DRAWN.format(1)} * (x1 - x0), y0 + {DRAWN.format(9)} * (y1 - y0), 1 "
    "FROM numbers JOIN (SELECT g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pos GROUP BY g) USING (g))",
    all_models("models", "sets", GAP_K),
    *kmeans_ctes("s_", "sets", "models", str(GAP_K)),
    f"spreads AS (SELECT g // {GAP_SETS + 1} AS zone_id, g % {GAP_SETS + 1} AS b, k, ln(wss::DOUBLE / n) AS s FROM s_curve)",
)
oracle("in_field", "SELECT event_id, in_field FROM flagged", *FLAGGED)
oracle(
    "nearest_center",
    f"SELECT event_id, {r6(f'min({TO_CENTER}) / 1000')} AS nearest_km FROM minutes m, centers c GROUP BY 1",
    MINUTES,
    CENTER_CTE,
)
oracle(
    "in_field_counts",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE in_field = 1) AS n_field, "
    "count(*) FILTER (WHERE in_field <> 1) AS n_road FROM flagged",
    *FLAGGED,
)

# --- sessions -----------------------------------------------------------------

oracle(
    "mark_gaps",
    "SELECT event_id, next_time, gap_minutes, symb FROM marked",
    MINUTES,
    *gaps_cte("minutes"),
)
oracle(
    "session_rows",
    "SELECT serial_number, event_id, in_field, symb, CAST(session_id AS BIGINT) AS session_id FROM sessions",
    *SESSIONS,
)
oracle(
    "session_times",
    "SELECT serial_number, CAST(session_id AS BIGINT) AS session_id, n_rows, CAST(total_minutes AS BIGINT) AS "
    "total_minutes, CAST(activity_minutes AS BIGINT) AS activity_minutes, "
    "CAST(transport_minutes AS BIGINT) AS transport_minutes FROM times WHERE n_rows >= 8",
    *SESSIONS,
    TIMES,
)
oracle(
    "session_times_plain",
    "SELECT serial_number, CAST(session_id AS BIGINT) AS session_id, count(*) AS n_rows, count(*) AS total_minutes, "
    "count(*) FILTER (WHERE in_field = 1) AS activity_minutes, "
    "count(*) FILTER (WHERE in_field <> 1) AS transport_minutes FROM sessions GROUP BY 1, 2 HAVING n_rows >= 8",
    *SESSIONS,
)
oracle(
    "machine_times",
    "SELECT serial_number, n_sessions, CAST(activity_minutes AS BIGINT) AS activity_minutes, "
    "CAST(transport_minutes AS BIGINT) AS transport_minutes FROM machine_times",
    *SESSIONS,
    TIMES,
    MACHINE_TIMES,
)
OVERVIEW = (
    "overview AS (SELECT serial_number, CAST(session_id AS BIGINT) AS session_id, count(*) AS n_rows, "
    "min(date_time) AS start_time, max(date_time) AS end_time, min(gps_longitude) AS \"left\", "
    "min(gps_latitude) AS bottom, max(gps_longitude) AS \"right\", max(gps_latitude) AS \"top\", "
    "(max(total_working_hours) - min(total_working_hours)) * 60 AS counter_minutes, "
    "date_diff('second', min(date_time), max(date_time)) / 60.0::DOUBLE AS clock_minutes "
    "FROM sessions GROUP BY 1, 2 HAVING n_rows >= 8)"
)
oracle(
    "session_overview",
    "SELECT serial_number, session_id, n_rows, start_time, end_time, "
    + ", ".join(
        f'{r6(chr(34) + c + chr(34))} AS "{c}"'
        for c in ("left", "bottom", "right", "top", "counter_minutes", "clock_minutes")
    )
    + " FROM overview",
    *SESSIONS,
    OVERVIEW,
)
oracle(
    "session_trace",
    "SELECT event_id, CAST(session_id AS BIGINT) AS session_id, row_index, "
    f"{r6('in_field * mean_speed')} AS field_flag, {r6('parking_break_status * mean_rpm / 10')} AS parking_flag "
    "FROM (SELECT *, row_number() OVER (PARTITION BY serial_number, session_id ORDER BY date_time, event_id) "
    "AS row_index, count(*) OVER s AS n, avg(speed_gearbox_km_h) OVER s AS mean_speed, "
    "avg(engine_rpm) OVER s AS mean_rpm FROM sessions WINDOW s AS (PARTITION BY serial_number, session_id)) "
    "WHERE n >= 8",
    *SESSIONS,
)
oracle(
    "centers_near_session",
    "SELECT serial_number, session_id, x, y FROM overview o JOIN centers c ON c.x > o.\"left\" - 0.0216916 "
    'AND c.x < o."right" + 0.0216916 AND c.y > o.bottom - 0.0216916 AND c.y < o."top" + 0.0216916',
    *SESSIONS,
    OVERVIEW,
)

# --- report questions ---------------------------------------------------------

FLEET = (
    "fleet AS (SELECT sum(transport_minutes) / 60.0::DOUBLE AS tt, sum(activity_minutes) / 60.0::DOUBLE AS at_ "
    "FROM machine_times)"
)
oracle(
    "q1_time_split",
    f"SELECT {r6('tt')} AS transport_hours, {r6('at_')} AS activity_hours, {r6('tt + at_')} AS total_hours, "
    f"{r6('tt / (tt + at_) * 100')} AS transport_percent, {r6('at_ / (tt + at_) * 100')} AS activity_percent "
    "FROM fleet",
    *SESSIONS,
    TIMES,
    MACHINE_TIMES,
    FLEET,
)
oracle(
    "q1_clustered",
    ORACLES["q1_time_split"].rsplit("\n", 1)[1],
    MINUTES,
    *CHOSEN,
    "centers AS (SELECT x, y FROM b_final)",
    *SESSIONS[2:],
    TIMES,
    MACHINE_TIMES,
    FLEET,
)
oracle(
    "q1_hours_check",
    "SELECT serial_number, session_hours, counter_hours, "
    "round((counter_hours - session_hours) / nullif(counter_hours, 0) * 100, 2) AS error_percent FROM "
    "(SELECT serial_number, round((transport_minutes + activity_minutes) / 60.0::DOUBLE, 2) AS session_hours "
    "FROM machine_times) JOIN (SELECT serial_number, round(max(total_working_hours) - min(total_working_hours), 2) "
    "AS counter_hours FROM telemetry GROUP BY 1) USING (serial_number)",
    *SESSIONS,
    TIMES,
    MACHINE_TIMES,
)
for name, cutoff in (("q2_field_count", 120), ("q2_field_count_low", LOW_CUTOFF)):
    oracle(
        name,
        f"SELECT zone_id, count(*) FILTER (WHERE n > {cutoff}) AS n_fields FROM cells GROUP BY zone_id "
        f"UNION ALL SELECT NULL, count(*) FILTER (WHERE n > {cutoff}) FROM cells",
        *FLAGGED,
        ZONES,
        "on_site AS (SELECT * FROM flagged WHERE in_field = 1)",
        zoned("on_site"),
        *ZONE_CELLS,
    )
oracle(
    "q3_activities",
    "SELECT serial_number, count(*) FILTER (WHERE in_field = 1 AND speed_ma_30m > 10) AS speed_above, "
    "count(*) FILTER (WHERE in_field = 1 AND speed_ma_30m < 10) AS speed_below, "
    "count(*) FILTER (WHERE in_field = 1 AND pto_rear_rpm > 0) AS pto_rear, "
    "count(*) FILTER (WHERE in_field = 1 AND pto_front_rpm > 10) AS pto_front FROM flagged GROUP BY 1",
    AVERAGED,
    first_rows("sampled", MINUTE, "averaged"),
    CENTER_CTE,
    flagged_cte("sampled"),
)
oracle(
    "q6_road_fuel",
    f"SELECT {r6('f')} AS mean_road_fuel, {r6('tt')} AS transport_hours, {r6('f * tt')} AS road_fuel_l "
    f"FROM (SELECT avg(coalesce({FUEL}, 0)) AS f FROM flagged WHERE in_field = 0), fleet",
    *SESSIONS,
    TIMES,
    MACHINE_TIMES,
    FLEET,
)
