import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import geo, reports
from fleetspark.operators.sessions import (
    assign_sessions,
    centers_near_session,
    machine_times,
    mark_gaps,
    session_overview,
    session_times,
    session_trace,
)
from fleetspark.sources.tables import local_table

START = dt.datetime(2024, 1, 1, 8)
COLUMNS = "in_field int"


def minutes(machine, offsets, in_field=(), **more):
    return [
        {"serial_number": machine, "date_time": START + dt.timedelta(minutes=m),
         "in_field": int(i in in_field), "gps_longitude": 20.0 + i / 100, "gps_latitude": 45.0,
         "speed_gearbox_km_h": float(i), "engine_rpm": 1000.0, "parking_break_status": i % 2,
         "total_working_hours": 100 + m / 60, **more}
        for i, m in enumerate(offsets)
    ]


def two_sessions(first_field=range(2, 7)):
    """Ten rows, a pause of 121 minutes, eight rows off site."""
    return minutes("M", [*range(10), *range(9 + 121, 9 + 129)], set(first_field))


def times_of(df, **kw):
    rows = session_times(assign_sessions(df), **kw).orderBy("session_id").collect()
    return [(r.session_id, r.total_minutes, r.activity_minutes, r.transport_minutes) for r in rows]


def test_session_arithmetic(make):
    df = make(two_sessions(), COLUMNS)
    assert times_of(df) == [(1, 10, 4, 6), (2, 8, -1, 9)]
    assert times_of(df, mode="plain") == [(1, 10, 5, 5), (2, 8, 0, 8)]
    total = machine_times(assign_sessions(df)).first()
    assert (total.activity_minutes, total.transport_minutes, total.n_sessions) == (3, 15, 2)


def test_last_row_on_site_counts_twice(make):
    df = make(two_sessions({7, 8, 9}), COLUMNS)
    assert times_of(df)[0] == (1, 10, 3, 7)


def test_short_sessions_are_dropped(make):
    df = make(minutes("S", range(7)) + minutes("M", range(8)), COLUMNS)
    sessions = assign_sessions(df)
    assert [r.serial_number for r in session_times(sessions).collect()] == ["M"]
    short = {r.serial_number: r for r in machine_times(sessions).collect()}["S"]
    assert (short.n_sessions, short.activity_minutes, short.transport_minutes) == (0, 0, 0)


def test_gap_of_exactly_the_pause_continues(make):
    df = make(minutes("M", [0, 120, 241]), COLUMNS)
    got = mark_gaps(df).orderBy("date_time").collect()
    assert [(r.gap_minutes, r.symb) for r in got] == [(120, 1), (121, 2), (None, 2)]
    assert [r.session_id for r in assign_sessions(df).orderBy("date_time").collect()] == [1, 1, 2]


def test_boundary_minutes(make):
    rows = [
        {"serial_number": "M", "date_time": t, "in_field": 0}
        for t in ("2024-01-01 10:00:59", "2024-01-01 10:01:00")
    ]
    assert mark_gaps(make(rows, COLUMNS)).orderBy("date_time").first().gap_minutes == 1


@pytest.mark.parametrize("slice_seconds", [3600, 86400, 604800])
def test_sessions_across_slices_match_brute_force(make, slice_seconds):
    rng = random.Random(11)
    rows = []
    for machine in ("A", "B"):
        offset, offsets = 0, []
        for _ in range(300):
            offset += rng.choice([1, 1, 1, 5, 60, 119, 120, 121, 500, 20000])
            offsets.append(offset)
        rows += minutes(machine, offsets, {i for i in range(300) if rng.random() < 0.4})
    got = assign_sessions(make(rows, COLUMNS), slice_seconds=slice_seconds)
    found = {(r.serial_number, r.date_time): (r.session_id, r.symb, r.next_time) for r in got.collect()}
    for machine in ("A", "B"):
        mine = [r["date_time"] for r in rows if r["serial_number"] == machine]
        session = 1
        for now, after in zip(mine, [*mine[1:], None]):
            symb = 1 if after and (after - now).total_seconds() / 60 <= 120 else 2
            assert found[machine, now] == (session, symb, after)
            session += symb == 2


def test_trace_and_overview(make):
    sessions = assign_sessions(make(two_sessions(), COLUMNS))
    trace = session_trace(sessions, slice_seconds=3600).orderBy("date_time").collect()
    assert [r.row_index for r in trace] == [*range(1, 11), *range(1, 9)]
    assert trace[2].field_flag == pytest.approx(4.5) and trace[0].field_flag == 0
    assert trace[1].parking_flag == pytest.approx(100.0)
    first, second = session_overview(sessions).orderBy("session_id").collect()
    assert (first.n_rows, first.clock_minutes) == (10, 9.0)
    assert first.counter_minutes == pytest.approx(9.0)
    assert (first.left, first.right) == (20.0, 20.09)


def test_centres_near_a_session(spark, make):
    overview = session_overview(assign_sessions(make(two_sessions(), COLUMNS)))
    pad = 0.0216916
    spots = [(20.05, 45.0), (20.09 + pad, 45.0), (19.99, 45.01), (21.0, 45.0), (20.18, 44.98)]
    centers = local_table(spark, spots, "x double, y double")
    near = centers_near_session(overview, centers).collect()
    boxes = {r.session_id: (r.left, r.bottom, r.right, r.top) for r in overview.collect()}
    want = {
        (s, x, y) for s, (l, b, r, t) in boxes.items() for x, y in spots
        if l - pad < x < r + pad and b - pad < y < t + pad
    }
    assert {(r.session_id, r.x, r.y) for r in near} == want and len(near) == len(want) > 0


def test_reports(make):
    rows = two_sessions()
    df = make(rows, COLUMNS)
    times = machine_times(assign_sessions(df))
    split = reports.time_split(times).first()
    assert split.total_hours == pytest.approx(18 / 60)
    assert split.transport_percent + split.activity_percent == pytest.approx(100)
    counts = reports.in_field_counts(df).first()
    assert counts.n_field + counts.n_road == counts.n_rows == 18
    check = reports.hours_check(times, df).first()
    assert check.session_hours == 0.3 and check.counter_hours == round(137 / 60, 2)
    fuel = make(
        [{**r, "fuel_consumption_l_h": f} for r, f in zip(rows, [None, 13.0] + [1.0] * 16)], COLUMNS
    )
    answer = reports.road_fuel(fuel, times).first()
    assert answer.mean_road_fuel == pytest.approx((0 + 13 + 11) / 13)
    assert answer.road_fuel_l == pytest.approx(answer.mean_road_fuel * 15 / 60)


def test_activities_leave_out_equality(make):
    rows = [
        {"serial_number": "A", "in_field": f, "speed_ma_30m": s, "pto_rear_rpm": rear, "pto_front_rpm": front}
        for f, s, rear, front in [(1, 11.0, 1.0, 10.0), (1, 9.0, 0.0, 11.0), (1, 10.0, None, None), (0, 20.0, 9.0, 99.0)]
    ] + [{"serial_number": "B", "in_field": 0, "speed_ma_30m": 20.0}]
    got = {r.serial_number: tuple(r)[1:] for r in reports.activities(make(rows, "in_field int, speed_ma_30m double")).collect()}
    assert got == {"A": (1, 1, 1, 1), "B": (0, 0, 0, 0)}


def test_field_count_reports_every_zone(make):
    rows = [
        {"gps_longitude": 20.1 + 0.01 * (i % 3), "gps_latitude": 45.3 + 0.01 * (i % 2), "in_field": 1} for i in range(600)
    ]
    got = {r.zone_id: r.n_fields for r in reports.field_count(make(rows, COLUMNS), cutoff=99).collect()}
    assert got == {3: 6, None: 6}
    assert reports.field_count(make(rows, COLUMNS), cutoff=100).first().n_fields == 0


def test_rows_without_a_machine_stay(make):
    rows = two_sessions()
    df = make(rows + [{**r, "serial_number": None} for r in rows], COLUMNS)
    for per in (mark_gaps(df), assign_sessions(df), session_trace(assign_sessions(df))):
        counts = {r.serial_number: r.n for r in per.groupBy("serial_number").agg(F.count("*").alias("n")).collect()}
        assert counts == {"M": len(rows), None: len(rows)}
    split = {(r.serial_number, r.session_id): r.total_minutes for r in session_times(assign_sessions(df)).collect()}
    assert {k[1]: v for k, v in split.items() if k[0] is None} == {k[1]: v for k, v in split.items() if k[0] == "M"}
    checked = reports.hours_check(machine_times(assign_sessions(df)), df).collect()
    assert {r.serial_number for r in checked} == {"M", None}


def test_no_rows_on_site_count_zero_fields(make):
    df = make(two_sessions(()), COLUMNS)
    assert [tuple(r) for r in reports.field_count(df).collect()] == [(None, 0)]
    assert [tuple(r) for r in reports.field_count(df.limit(0)).collect()] == [(None, 0)]


def test_a_session_across_the_globe_meets_its_centres(spark, make):
    """A fix at (0, 0) makes a huge box; it still takes at most four cells."""
    rows = minutes("M", range(10))
    rows[3] |= {"gps_longitude": 0.0, "gps_latitude": 0.0}
    overview = session_overview(assign_sessions(make(rows, COLUMNS)))
    centers = local_table(spark, [(10.0, 20.0), (20.0, 45.0), (20.2, 45.0), (-1.0, 0.0)], "x double, y double")
    assert sorted((r.x, r.y) for r in centers_near_session(overview, centers).collect()) == [(10.0, 20.0), (20.0, 45.0)]
    boxes = overview.select("left", "bottom", "right", "top")
    assert geo.meet_boxes(centers, boxes, "x", "y").count() <= 4
