"""Samples, moving averages and numbering against brute force in pandas."""

import datetime as dt
import random

import pandas as pd
import pytest

from fleetspark.operators.sampling import (
    add_moving_averages,
    every_nth,
    sample_first,
    sample_with_averages,
)
from fleetspark.schema import MA_COLUMNS, MA_FRAMES, ma_names

START = dt.datetime(2024, 1, 1)
TIES = {"order": ("date_time", "event_id"), "unique_order": True}


def uneven_rows(seed=7):
    """Quiet days, a gap of months, one minute with hundreds of rows, and equal times."""
    rng = random.Random(seed)
    rows, event = [], 0

    def add(machine, when):
        nonlocal event
        rows.append(
            {
                "event_id": event, "date_time": when, "serial_number": machine,
                "fuel_consumption_l_h": None if rng.random() < 0.1 else round(rng.uniform(0, 60), 3),
                "engine_load": float(rng.randint(0, 100)),
                "speed_gearbox_km_h": round(rng.uniform(0, 40), 1),
            }
        )
        event += 1

    for i in range(400):
        add("hot", START + dt.timedelta(minutes=5, milliseconds=20 * i))
    for i in range(300):
        add("hot", START + dt.timedelta(minutes=7, seconds=i // 3))
    for day in range(0, 200, 3):
        add("hot", START + dt.timedelta(days=day, hours=3))
    for i in range(500):
        add("even", START + dt.timedelta(seconds=600 * i))
    add("single", START)
    for i in range(5):
        add("late", START + dt.timedelta(days=30 * i))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return uneven_rows()


@pytest.fixture(scope="module")
def df(make, rows):
    return make(rows, "event_id bigint")


@pytest.fixture(scope="module")
def expected(rows):
    pdf = pd.DataFrame(rows).sort_values(["serial_number", "date_time", "event_id"])
    for label, n in MA_FRAMES.items():
        for name, column in MA_COLUMNS.items():
            pdf[f"{name}_ma_{label}"] = pdf.groupby("serial_number")[column].transform(
                lambda s: s.astype(float).rolling(n + 1, min_periods=1).mean()
            )
    return pdf.set_index("event_id")


def assert_averages(got, expected):
    assert len(got) == len(expected)
    for name in ma_names():
        pd.testing.assert_series_equal(
            got[name].astype(float), expected.loc[got.index, name], check_names=False, rtol=1e-9
        )


@pytest.mark.parametrize("slice_seconds", [3600, 86400, 604800])
def test_averages_of_all_rows(df, expected, slice_seconds):
    got = add_moving_averages(df, slice_seconds=slice_seconds, **TIES)
    assert_averages(got.toPandas().set_index("event_id"), expected)


@pytest.mark.parametrize("bucket,slice_seconds", [(60, 604800), (600, 604800), (60, 3600)])
def test_sampled_averages_over_all_rows(df, expected, bucket, slice_seconds):
    got = sample_with_averages(df, bucket, slice_seconds=slice_seconds, **TIES)
    got = got.toPandas().set_index("event_id")
    first = expected.reset_index().sort_values(["date_time", "event_id"])
    first["slot"] = first["date_time"].dt.floor(f"{bucket}s")
    first = first.groupby(["serial_number", "slot"]).head(1).set_index("event_id")
    assert set(got.index) == set(first.index)
    assert_averages(got, first)


def test_sample_is_unique_per_slot(df, rows):
    sampled = sample_first(df, 600, **TIES).toPandas()
    slots = {(r["serial_number"], pd.Timestamp(r["date_time"]).floor("600s")) for r in rows}
    assert len(sampled) == len(slots)


def test_ties_are_settled_by_the_remaining_columns(make):
    same = {"date_time": "2024-01-01 10:00:00", "serial_number": "A"}
    rows = [{**same, "engine_rpm": r} for r in (900.0, 800.0, 1000.0)]
    for order in (rows, rows[::-1]):
        assert sample_first(make(order), 60).first().engine_rpm == 800.0


def test_tied_rows_give_the_same_sample_every_time(make):
    rows = [
        {"date_time": START + dt.timedelta(seconds=20 * (i // 4)), "serial_number": "A",
         "fuel_consumption_l_h": float(i % 7), "engine_load": float(i % 5), "engine_rpm": float(i),
         "speed_gearbox_km_h": float(i % 3)}
        for i in range(200)
    ]
    runs = [
        sorted(map(str, sample_with_averages(make(r), 60, slice_seconds=3600).collect()))
        for r in (rows, rows[::-1])
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 17


def test_frame_of_thirty(make):
    rows = [
        {"date_time": START + dt.timedelta(seconds=10 * i), "serial_number": "A", "engine_load": float(i)}
        for i in range(41)
    ]
    got = add_moving_averages(make(rows), {"load": "engine_load"}, {"5m": 30}).toPandas()
    by_load = got.set_index("engine_load")["load_ma_5m"]
    assert by_load[40.0] == 25 and by_load[3.0] == 1.5


def test_frames_without_a_common_step(make):
    rows = [
        {"date_time": START + dt.timedelta(seconds=10 * i), "serial_number": "A", "engine_load": float(i)}
        for i in range(60)
    ]
    frames = {"a": 7, "b": 20}
    got = add_moving_averages(make(rows), {"load": "engine_load"}, frames, slice_seconds=60).toPandas()
    got = got.sort_values("engine_load")
    for label, n in frames.items():
        want = got["engine_load"].rolling(n + 1, min_periods=1).mean()
        pd.testing.assert_series_equal(got[f"load_ma_{label}"], want, check_names=False)


def test_missing_times_come_last(make):
    rows = [
        {"date_time": None, "serial_number": "A", "engine_load": 90.0},
        {"date_time": "2024-01-01 10:00:00", "serial_number": "A", "engine_load": 10.0},
    ]
    got = add_moving_averages(make(rows), {"load": "engine_load"}, {"x": 30}).toPandas()
    assert dict(zip(got["engine_load"], got["load_ma_x"])) == {10.0: 10.0, 90.0: 50.0}


@pytest.mark.parametrize("n", [1, 7, 30])
def test_every_nth(df, rows, n):
    got = every_nth(df, n, (), ("date_time", "event_id")).toPandas()
    ordered = sorted(rows, key=lambda r: (r["date_time"], r["event_id"]))
    assert set(got["event_id"]) == {r["event_id"] for r in ordered[::n]}
