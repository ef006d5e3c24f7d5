"""Fuzzy c-means: every position belongs to all centres, the more the nearer it is.

One pass over the weighted positions per round, for all groups at once. Memberships are
rounded to a trillionth before they are added up as whole numbers, so that the centres do
not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.cluster import UNIT, Model, Place, _met, _whole, squared, starting_places, weighted_positions
from fleetspark.operators.geo import LAT, LON
from fleetspark.sources.tables import local_table

# Usual exponent of the memberships, and rounds.
FUZZIFIER, ROUNDS = 2.0, 20
SHARE = 1e12


def memberships(far: Column, m: float = FUZZIFIER) -> Column:
    """Shares of a position in the centres at squared distances `far`; they add up to 1.

    A position on a centre belongs to that centre alone, to the first of several.
    """
    shrunk = (lambda x: x) if m == 2 else (lambda x: F.pow(x, F.lit(1 / (m - 1))))
    # Nearness, at most 1; lambda variables hold what all centres share.
    near = F.transform(F.array(F.array_min(far)), lambda least: F.transform(far, lambda d: shrunk(least / d)))[0]
    total = lambda all_: F.aggregate(all_, F.lit(0.0), lambda sum_, n: sum_ + n)
    shares = F.transform(
        F.array(near), lambda all_: F.transform(F.array(total(all_)), lambda sum_: F.transform(all_, lambda n: n / sum_))[0]
    )[0]
    on = F.array_position(far, F.lit(0.0))
    alone = F.transform(far, lambda d, i: F.when(i + 1 == on, 1.0).otherwise(0.0))
    return F.when(on > 0, alone).otherwise(shares)


def fuzzy_cmeans(
    points: DataFrame,
    group: str,
    k: int,
    m: float = FUZZIFIER,
    rounds: int = ROUNDS,
    lon: str = LON,
    lat: str = LAT,
) -> DataFrame:
    """(group, c, x, y, weight): k centres per group after a number of rounds.

    `weight` is the sum of the memberships to the power m. Starts are those of k-means; a
    group with fewer positions than k has as many centres.
    """
    if m <= 1:
        raise ValueError("m must be greater than 1")
    positions = weighted_positions(points, lon, lat, group).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = {Model(g, k): list(found) for g, found in starting_places(positions, k).items()}
        weights: dict[tuple[Model, int], float] = {}
        for _ in range(rounds):
            for row in _round(positions, centers, m):
                if row.n:
                    place = (float(row.sx) / float(row.n) / UNIT, float(row.sy) / float(row.n) / UNIT)
                    centers[Model(row.g, row.k)][row.c] = place
                weights[Model(row.g, row.k), row.c] = float(row.n) / SHARE
    finally:
        positions.unpersist()
    rows = [
        (model.group, c, x, y, weights.get((model, c), 0.0))
        for model, places in sorted(centers.items())
        for c, (x, y) in enumerate(places)
    ]
    return local_table(points.sparkSession, rows, f"{group} int, c int, x double, y double, weight double")


def _round(positions: DataFrame, centers: Mapping[Model, Sequence[Place]], m: float) -> list:
    """Sums of memberships and of positions by membership, a row per centre."""
    far = F.transform("cs", lambda c: squared(F.col("x"), F.col("y"), c))
    met = _met(positions, centers).withColumn("far", far).withColumn("u", memberships(F.col("far"), m))
    power = (lambda u: u * u) if m == 2 else (lambda u: F.pow(u, F.lit(m)))
    part = met.select("g", "k", "x", "y", "w", F.posexplode(F.transform("u", power)).alias("c", "u"))
    weight = F.floor(F.col("u") * SHARE + 0.5).cast("decimal(13,0)") * F.col("w").cast("decimal(12,0)")
    total = lambda c: F.sum(weight * _whole(c).cast("decimal(12,0)"))
    return part.groupBy("g", "k", "c").agg(F.sum(weight).alias("n"), total("x").alias("sx"), total("y").alias("sy")).collect()


def with_memberships(
    points: DataFrame, centers: DataFrame, group: str, m: float = FUZZIFIER, lon: str = LON, lat: str = LAT
) -> DataFrame:
    """Add `memberships`, the shares of each point in its group's centres by their number.

    Points without a place get NULL; those of a group without centres, no shares.
    """
    cs = centers.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("c", "x", "y"))).alias("_cs"))
    # A row of k places per group of the caller's list.
    met = points.join(F.broadcast(cs), group, "left")
    far = F.transform(F.coalesce("_cs", F.array()), lambda c: squared(F.col(lon), F.col(lat), c))
    placed = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return met.withColumn("memberships", F.when(placed, memberships(far, m))).drop("_cs")
