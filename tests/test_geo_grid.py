import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.operators import geo
from fleetspark.operators.geo import (
    DEFAULT_ZONES,
    Box,
    Zone,
    assign_zone_table,
    assign_zones,
    bbox,
    extent_nm,
    flag_in_field,
    in_bbox,
    nearest_center,
)
from fleetspark.operators.grid import (
    candidate_fields,
    dense_cells,
    grid_agg,
    grid_count,
    grid_spec,
    zone_grid,
)
from fleetspark.sources.tables import local_table

POINT = "id bigint, gps_longitude double, gps_latitude double"


def distance_km(lon1, lat1, lon2, lat2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6378.137 * math.asin(min(1.0, math.sqrt(h)))


@pytest.fixture(scope="module")
def spots():
    """Points and centres around Europe, the date line and both poles."""
    rng = random.Random(5)
    places = [(20.2, 45.5), (179.995, 10.0), (-179.995, 10.0), (0.0, 89.99), (120.0, -89.985), (7.0, 65.0)]
    near = lambda: [(max(-180, min(180, x + rng.gauss(0, 0.03))), max(-90, min(90, y + rng.gauss(0, 0.02))))
                    for x, y in places for _ in range(60)]
    return near(), near()[::7]


@pytest.mark.parametrize("km", [0.5, 1.5, 30.0])
def test_in_field_matches_brute_force(spark, spots, km):
    points, centers = spots
    df = local_table(spark, [(i, *p) for i, p in enumerate(points)], POINT)
    got = flag_in_field(df, local_table(spark, centers, "x double, y double"), km)
    assert got.columns == [*df.columns, "in_field"]
    flags = {r.id: r.in_field for r in got.collect()}
    want = {i: int(min(distance_km(*p, *c) for c in centers) < km) for i, p in enumerate(points)}
    assert flags == want
    assert 0 < sum(want.values())


def test_nearest_matches_brute_force(spark, spots):
    points, centers = spots
    centers = centers[:-12]  # leaves the last place far from every centre
    df = local_table(spark, [(i, *p) for i, p in enumerate(points)], POINT)
    got = nearest_center(df, local_table(spark, centers, "x double, y double"))
    for row in got.collect():
        want = min(distance_km(*points[row.id], *c) for c in centers)
        assert row.nearest_km == pytest.approx(want, rel=1e-7, abs=1e-6)


def test_no_centres_means_no_field(spark, spots):
    df = local_table(spark, [(1, 20.0, 45.0)], POINT)
    assert flag_in_field(df, local_table(spark, [], "x double, y double")).first().in_field == 0


def test_zone_borders_belong_to_both_zones(spark):
    df = local_table(spark, [(1, 20.2, 45.55), (2, 20.2, 45.56), (3, 19.0, 45.0)], POINT)
    hits = sorted((r.id, r.zone_id) for r in assign_zones(df).collect())
    assert hits == [(1, 2), (1, 3), (2, 2)]
    table = local_table(
        spark, [(z.zone_id, *z.box) for z in DEFAULT_ZONES],
        "zone_id int, left double, bottom double, right double, top double",
    )
    assert sorted((r.id, r.zone_id) for r in assign_zone_table(df, table).collect()) == hits


@pytest.mark.parametrize("inline", [0, 5000])
def test_many_zones_by_brute_force(spark, monkeypatch, inline):
    """Two thousand boxes of all sizes, among them points, stripes and one over all."""
    monkeypatch.setattr(geo, "MAX_INLINE", inline)
    rng = random.Random(11)
    zones = [Zone(0, Box(-180.0, -90.0, 180.0, 90.0)), Zone(1, Box(20.0, -90.0, 20.0001, 90.0)), Zone(2, Box(20.5, 45.5, 20.5, 45.5)), Zone(3, Box(21.0, 45.0, 20.0, 46.0))]
    while len(zones) < (2000 if not inline else 40):
        x, y, size = rng.uniform(19, 21), rng.uniform(45, 46), 10 ** rng.uniform(-5, 0)
        zones.append(Zone(len(zones), Box(x, y, x + size * rng.random(), y + size * rng.random())))
    points = [(i, rng.uniform(19, 21), rng.uniform(45, 46)) for i in range(200)] + [(200, 20.5, 45.5), (201, 0.0, 0.0), (202, None, 1.0), (203, zones[9].box.right, zones[9].box.top)]
    df = local_table(spark, points, POINT)
    got = sorted((r.id, r.zone_id) for r in assign_zones(df, zones).collect())
    want = [(i, z.zone_id) for i, x, y in points if x is not None for z in zones if z.box.left <= x <= z.box.right and z.box.bottom <= y <= z.box.top]
    assert got == sorted(want) and len(got) > 204
    if not inline:
        boxes = local_table(spark, [(z.zone_id, *z.box) for z in zones], "zone_id int, left double, bottom double, right double, top double")
        assert geo.meet_boxes(df, boxes).count() < 40 * len(got)


def test_boxes(spark):
    df = local_table(spark, [(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.0, 2.0)], POINT)
    box = Box(1.0, 1.0, 3.0, 3.0)
    assert in_bbox(df, box).count() == 3 and in_bbox(df, box, inclusive=False).count() == 0
    assert tuple(bbox(df, 0.5).first()) == (0.5, 0.5, 3.5, 3.5)
    assert extent_nm(df).first().x_extent == pytest.approx(2 / 0.0167)


def test_cells_are_right_closed_with_the_lowest_edge(spark):
    df = local_table(spark, [(i, float(i), 1.0) for i in range(5)], POINT)
    got = {(r.ix, r.iy): r.n for r in grid_count(df, 4, 3).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 1): 1}


def test_grid_counts_add_up_and_match_numpy(spark):
    rng = np.random.default_rng(1)
    xy = rng.normal(size=(500, 2))
    df = local_table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], POINT)
    got = {(r.ix, r.iy): r.n for r in grid_count(df, 7, 5).collect()}
    assert sum(got.values()) == 500
    want, _, _ = np.histogram2d(-xy[:, 0], -xy[:, 1], bins=(7, 5))  # mirrored: right-closed
    want = want[::-1, ::-1]
    assert got == {(i + 1, j + 1): int(n) for (i, j), n in np.ndenumerate(want) if n}


def test_grid_over_a_box_and_means(spark):
    df = local_table(spark, [(1, 0.1, 0.1), (2, 0.2, 0.2), (3, 9.0, 9.0)], POINT)
    means = grid_agg(df, F.avg("id"), 2, 2, box=Box(0, 0, 1, 1)).collect()
    assert [(r.ix, r.iy, r.z) for r in means] == [(1, 1, 1.5)]


def test_grid_sizes_come_from_float_division():
    assert grid_spec(Box(0, 0, 1, 0.5), 0.25) == (4, 2)
    assert [grid_spec(z.box, 1 / 240) for z in DEFAULT_ZONES] == [(85, 48), (84, 37), (120, 84)]


def test_dense_cells_are_strictly_above(spark):
    grid = local_table(spark, [(1, 1, 120), (1, 2, 121)], "ix int, iy int, n bigint")
    assert dense_cells(grid, 120).count() == 1


def test_candidates_and_zone_grid(spark):
    rows = [(i, 20.1 + (i % 10) * 0.01, 45.3 + (i % 7) * 0.01) for i in range(2000)]
    df = local_table(spark, rows, POINT)
    found = candidate_fields(df, cutoff=20).first()
    assert found.cells_x == math.ceil((20.19 + 0.2 - (20.1 - 0.2)) / (1 / 120))
    assert found.n_candidates == sum(n > 20 for n in Counter((r[1], r[2]) for r in rows).values())
    zones = zone_grid(df).groupBy("zone_id").agg(F.sum("n").alias("n")).collect()
    assert [(r.zone_id, r.n) for r in zones] == [(3, 2000)]
