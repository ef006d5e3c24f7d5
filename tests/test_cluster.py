import math
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import cluster, fuzzy, gap
from fleetspark.operators.cluster import choose_k, field_centers, kmeans_minus_minus, wss_curve
from fleetspark.operators.geo import DEFAULT_ZONES, LAT, LON
from fleetspark.sources.tables import local_table

SCHEMA = "gps_longitude double, gps_latitude double"


def blobs(centers, n=60, seed=2, spread=0.002):
    rng = random.Random(seed)
    return [(x + rng.gauss(0, spread), y + rng.gauss(0, spread)) for x, y in centers for _ in range(n)]


SITES = [(20.1, 45.3), (20.3, 45.4), (20.4, 45.25)]


def test_wss_falls_and_k_is_the_lowest(spark):
    curve = wss_curve(local_table(spark, blobs(SITES), SCHEMA), k_max=5, silhouette=True)
    wss = [r.wss for r in curve.orderBy("k").collect()]
    assert len(wss) == 5 and wss[0] > wss[1] > wss[2]
    assert all(b <= a * 1.05 for a, b in zip(wss, wss[1:]))
    assert choose_k(curve) == 1 + wss.index(min(wss))
    assert choose_k(curve, "silhouette") == 3


def test_smallest_k_on_ties(spark):
    curve = local_table(spark, [(1, 5.0), (3, 2.0), (2, 2.0)], "k int, wss double")
    assert choose_k(curve) == 2


def test_outliers_are_set_aside(spark):
    far = [(20.8, 45.9), (19.5, 44.9), (20.8, 45.9)]
    points = local_table(spark, blobs(SITES) + far, SCHEMA)
    centers, outliers = kmeans_minus_minus(points, 3, n_outliers=3)
    assert sorted((r.x, r.y, r.n) for r in outliers.collect()) == [(19.5, 44.9, 1), (20.8, 45.9, 2)]
    found = sorted((r.x, r.y) for r in centers.collect())
    for (x, y), (wx, wy) in zip(found, sorted(SITES)):
        assert (x, y) == (pytest.approx(wx, abs=2e-3), pytest.approx(wy, abs=2e-3))


def test_outlier_count_is_exact_for_copies(spark):
    points = local_table(spark, blobs(SITES) + [(25.0, 50.0)] * 10, SCHEMA)
    _, outliers = kmeans_minus_minus(points, 3, n_outliers=4)
    assert sum(r.n for r in outliers.collect()) == 4


def test_no_outliers_is_plain_kmeans(spark):
    centers, outliers = kmeans_minus_minus(local_table(spark, blobs(SITES), SCHEMA), 3)
    assert centers.count() == 3 and outliers.count() == 0


def test_centres_lie_in_their_zones(spark):
    sites = [*SITES, (20.1, 46.0), (20.3, 46.1)]
    rows = [
        (i, "A", x, y, 40.0 if i % 2 else 10.0) for i, (x, y) in enumerate(blobs(sites, spread=0.001))
    ]
    df = local_table(
        spark, rows, "i bigint, serial_number string, gps_longitude double, gps_latitude double, fuel_ma_10m double"
    ).selectExpr("*", "timestamp_seconds(i * 60)::timestamp_ntz AS date_time")
    found = field_centers(df, k=2).collect()
    boxes = {z.zone_id: z.box for z in DEFAULT_ZONES}
    assert {r.zone_id for r in found} == {1, 3}
    for r in found:
        box = boxes[r.zone_id]
        assert box.left <= r.x <= box.right and box.bottom <= r.y <= box.top


def rounded_centres(df, parts):
    curve = cluster.wss_curves(df.repartition(parts), "zone_id", 6, silhouette=True)
    gaps = gap.gap_statistic(df.repartition(parts), "zone_id", 3, sets=2)
    soft = fuzzy.fuzzy_cmeans(df.repartition(parts), "zone_id", 3)
    hard, out = cluster.kmeans_without_outliers(df.repartition(parts), "zone_id", 3, 5)
    return [sorted(map(str, frame.collect())) for frame in (curve, gaps, soft, hard, out)]


def grouped(spark):
    rows = [(z, x, y) for z in (1, 2) for x, y in blobs(SITES, n=40, seed=z)] + [(3, 20.0, 45.0)] * 4 + [(4, None, 1.0)]
    return local_table(spark, rows, "zone_id int, gps_longitude double, gps_latitude double")


def test_partitioning_never_shows(spark):
    df = grouped(spark)
    assert rounded_centres(df, 4) == rounded_centres(df, 9)


def test_vectorised_rounds_equal_column_expressions(spark):
    positions = cluster.weighted_positions(grouped(spark), LON, LAT, "zone_id")
    centers = {m: places for m, places in cluster._started(positions, [1, 2, 5]).items()}
    got = {(r.g, r.k, r.c): r for r in cluster.assigned_moments(positions, centers).collect()}
    want = {(r.g, r.k, r.c): r for r in cluster.moments(cluster.nearest(positions, centers)).collect()}
    assert set(got) == set(want)
    for key, row in got.items():
        assert (row.n, row.sx, row.sy) == (want[key].n, want[key].sx, want[key].sy)
        assert row.wss == pytest.approx(float(want[key].wss), abs=1e-15)


def test_centres_settle_where_plain_rounds_do(spark):
    points = blobs(SITES, n=50, seed=5)
    positions = cluster.weighted_positions(local_table(spark, points, SCHEMA), LON, LAT)
    start = cluster.starting_places(positions, 4)[0]
    centres = list(start)
    for _ in range(cluster.MAX_ITER):
        sums = [[0, 0, 0] for _ in centres]
        for x, y in points:
            c = min(range(4), key=lambda i: ((x - centres[i][0]) ** 2 + (y - centres[i][1]) ** 2, i))
            for j, v in enumerate((int(x * 1e9 + 0.5), int(y * 1e9 + 0.5), 1)):
                sums[c][j] += v
        centres = [(sx / n / 1e9, sy / n / 1e9) if n else old for (sx, sy, n), old in zip(sums, centres)]
    got = cluster.settle(positions, {cluster.Model(0, 4): start})
    assert got[cluster.Model(0, 4)] == centres


def test_starts_are_the_farthest_places(spark):
    points = blobs(SITES, n=12)  # so few that every position of a cell is a candidate
    positions = cluster.weighted_positions(local_table(spark, points, SCHEMA), LON, LAT)
    found = cluster.starting_places(positions, 18)[0]
    far = lambda p, seen: min((p[0] - x) ** 2 + (p[1] - y) ** 2 for x, y in seen)
    assert len(found) == len(set(found)) == 18
    for i in range(1, 18):
        assert far(found[i], found[:i]) == max(far(p, found[:i]) for p in points)


def test_silhouette_by_brute_force(spark):
    points = blobs(SITES, n=15) + [(20.1, 45.3)] * 4
    curve = wss_curve(local_table(spark, points, SCHEMA), k_max=5, silhouette=True)
    positions = cluster.weighted_positions(local_table(spark, points, SCHEMA), LON, LAT)
    centres = cluster.settle(positions, cluster._started(positions, range(1, 6)))
    square = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    for row in curve.collect():
        if row.k == 1:
            assert row.silhouette is None
            continue
        cs = centres[cluster.Model(0, row.k)]
        label = [min(range(row.k), key=lambda i: square(p, cs[i])) for p in points]
        total = 0
        for p, mine in zip(points, label):
            mean = lambda c, less=0: sum(square(p, q) for q, l in zip(points, label) if l == c) / (label.count(c) - less)
            if label.count(mine) > 1:
                a, b = mean(mine, 1), min(mean(c) for c in set(label) - {mine})
                total += (b - a) / max(a, b) if max(a, b) else 0
        assert row.silhouette == pytest.approx(total / len(points), abs=1e-7)


def test_more_outliers_than_points(spark):
    points = local_table(spark, blobs(SITES, n=3) + [(20.0, 45.0)], SCHEMA)
    centers, outliers = kmeans_minus_minus(points, 2, n_outliers=11)
    assert centers.count() == 0 and sum(r.n for r in outliers.collect()) == 10
    centers, outliers = kmeans_minus_minus(points, 2, n_outliers=9)
    assert centers.count() == 1 and sum(r.n for r in outliers.collect()) == 9
    centers, outliers = kmeans_minus_minus(points.limit(0), 2, n_outliers=3)
    assert centers.count() == 0 and outliers.count() == 0


@pytest.mark.parametrize("few", [0, 4096])
def test_farthest_points_with_ties(spark, monkeypatch, few):
    """Refined bounds end at the very point, also among equal distances and equal x."""
    monkeypatch.setattr(cluster, "FEW", few)
    ring = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (0.0, -1.0), (0.5, 0.0), (0.0, 0.0), (2.0, 0.0)]
    positions = cluster.weighted_positions(local_table(spark, ring, SCHEMA), LON, LAT)
    centre = {cluster.Model(0, 1): [(0.0, 0.0)]}
    farthest = sorted(((-(x * x + y * y), x, y) for x, y in ring))
    for n in range(10):
        rows = cluster.without_farthest(cluster.nearest(positions, centre), {cluster.Model(0, 1): n}).collect()
        taken = [(r.x, r.y) for r in rows for _ in range(r.w - r.kept)]
        assert sorted(taken) == sorted((x, y) for _, x, y in farthest[:n])


def test_memberships_by_definition(spark):
    points = blobs(SITES, n=10) + [(20.1, 45.3)]
    for m in (2.0, 1.5):
        df = local_table(spark, [(1, *p) for p in points], "zone_id int, " + SCHEMA)
        found = fuzzy.fuzzy_cmeans(df, "zone_id", 3, m, rounds=7)
        centres = cluster.starting_places(cluster.weighted_positions(df, LON, LAT, "zone_id"), 3)[1]
        def shares(p):
            far = [(p[0] - x) ** 2 + (p[1] - y) ** 2 for x, y in centres]
            if 0 in far:
                return [float(i == far.index(0)) for i in range(3)]
            return [1 / sum((d / e) ** (1 / (m - 1)) for e in far) for d in far]

        for _ in range(7):
            us = [[u**m for u in shares(p)] for p in points]
            centres = [tuple(sum(u[c] * p[j] for u, p in zip(us, points)) / sum(u[c] for u in us) for j in (0, 1)) for c in range(3)]
        got = [(r.x, r.y) for r in found.orderBy("c").collect()]
        for a, b in zip(got, centres):
            assert a == pytest.approx(b, abs=1e-8)
        rows = fuzzy.with_memberships(df, found, "zone_id", m).collect()
        for row in rows:
            assert row.memberships == pytest.approx(shares((row.gps_longitude, row.gps_latitude)), abs=1e-5)
            assert sum(row.memberships) == pytest.approx(1)


def test_gap_finds_the_number_of_sites(spark):
    df = local_table(spark, [(7, *p) for p in blobs(SITES, n=40)], "zone_id int, " + SCHEMA)
    gaps = gap.gap_statistic(df, "zone_id", 5, sets=4)
    assert [tuple(r) for r in gap.choose_k_by_gap(gaps, "zone_id").collect()] == [(7, 3)]
    # By definition: one set drawn by hand, settled alone.
    own = cluster.weighted_positions(df, LON, LAT, "zone_id")
    drawn = gap.reference_sets(own, 4)
    assert drawn.count() == 4 * 120 and drawn.groupBy("b").count().count() == 4
    logs = []
    for b in range(1, 5):
        curve = cluster.wss_curve(drawn.filter(F.col("b") == b), 3, lon="x", lat="y")
        logs.append(math.log(curve.filter("k = 3").first().wss / 120))
    mine = math.log(cluster.wss_curve(df, 3).filter("k = 3").first().wss / 120)
    row = gaps.filter("k = 3").first()
    assert (row.log_wss, row.gap) == (pytest.approx(mine, abs=1e-9), pytest.approx(sum(logs) / 4 - mine, abs=1e-9))


def test_k_of_the_curve_is_used_per_zone(spark):
    rows = [(i, x, y, 40.0) for i, (x, y) in enumerate(blobs(SITES, n=20) + [(20.1, 46.0)] * 5)]
    df = local_table(spark, rows, "i bigint, gps_longitude double, gps_latitude double, fuel_ma_10m double")
    df = df.selectExpr("*", "'A' AS serial_number", "timestamp_seconds(i * 60)::timestamp_ntz AS date_time")
    counts = {r.zone_id: r.n for r in field_centers(df, k_max=4).groupBy("zone_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 1, 3: 4}
    assert field_centers(df.limit(0)).count() == 0 and field_centers(df, thin=30, k_max=2).count() > 0
