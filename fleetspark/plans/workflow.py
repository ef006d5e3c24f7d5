"""The two workflows: from raw export to stored tables, and from those to the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from fleetspark.functions import month_of
from fleetspark.functions.expressions import MINUTE, TEN_MINUTES
from fleetspark.operators import cluster, geo, grid, reports, sessions
from fleetspark.operators.clean import clean_telemetry, drop_header_rows
from fleetspark.operators.ordered import total_order
from fleetspark.operators.sampling import sample_with_averages
from fleetspark.schema import KEY, SAMPLED, TIME
from fleetspark.sources.tables import MONTH, read_table, write_table


def _store(df: DataFrame, path: str, if_exists: str = "overwrite") -> DataFrame:
    """Write by month, so that `read_range` skips folders, and read the stored table back."""
    write_table(df.withColumn(MONTH, month_of(TIME)), path, if_exists, partition_by=[MONTH])
    return read_table(df.sparkSession, path)


def prepare_tables(
    raw: DataFrame, out_dir: str, on_error: str = "fail", **sampling
) -> dict[str, DataFrame]:
    """Clean the export and store the typed table, its backup and both samples.

    `out_dir` must be a folder all executors share.  Later steps read the stored tables,
    so losing executors repeats at most the step at hand.
    """
    typed = clean_telemetry(drop_header_rows(raw), on_error)
    tables = {"telemetry": _store(typed, f"{out_dir}/telemetry")}
    write_table(tables["telemetry"], f"{out_dir}/telemetry_backup", "ignore", [MONTH])
    extra = [c for c in typed.columns if c in sampling.get("order", ())]
    keep = list(dict.fromkeys([*SAMPLED, *extra]))
    for name, seconds in (("sample_1min", MINUTE), ("sample_10min", TEN_MINUTES)):
        sampled = sample_with_averages(tables["telemetry"], seconds, keep=keep, **sampling)
        tables[name] = _store(sampled, f"{out_dir}/{name}")
    return tables


def analyse(
    tables: Mapping[str, DataFrame],
    out_dir: str,
    zones: Sequence[geo.Zone] = geo.DEFAULT_ZONES,
    k: int | None = None,
    order: Sequence[str] | None = None,
    km: float = geo.FIELD_RADIUS_KM,
    idle_minutes: int = sessions.IDLE_MINUTES,
    min_rows: int = sessions.MIN_ROWS,
    mode: str = "reference",
) -> dict[str, DataFrame]:
    """Find site centres, flag and cut the minutes into sessions, and answer the questions.

    Without `order`, rows of one machine and time follow one another by all their other
    columns, so that equal times never fall by chance.
    """
    sample, telemetry = tables["sample_1min"], tables["telemetry"]
    order = order or total_order(sample.drop(MONTH), (TIME, KEY), False)
    centers = cluster.field_centers(sample, zones, k, order=order)
    write_table(centers, f"{out_dir}/field_centers")
    centers = read_table(sample.sparkSession, f"{out_dir}/field_centers")
    flagged = geo.flag_in_field(sample, centers, km)
    rows = sessions.assign_sessions(flagged, idle_minutes, order)
    rows = _store(rows.drop(MONTH), f"{out_dir}/sessions")
    times = sessions.machine_times(rows, mode, min_rows)
    return {
        "field_centers": centers,
        "sessions": rows,
        "session_times": sessions.session_times(rows, mode, min_rows),
        "machine_times": times,
        "in_field_counts": reports.in_field_counts(rows),
        "candidate_fields": grid.candidate_fields(telemetry),
        "q1_time_split": reports.time_split(times),
        "q1_hours_check": reports.hours_check(times, telemetry),
        "q2_field_count": reports.field_count(rows, zones),
        "q3_activities": reports.activities(rows),
        "q6_road_fuel": reports.road_fuel(rows, times),
    }
