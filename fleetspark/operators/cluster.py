"""Site centres by clustering positions under high fuel use.

Any number of groups (zones) and numbers of clusters are worked on together: a round is
one pass over the weighted positions, keyed (group, k, centre), whatever the number of
models. Results do not depend on the partitioning: starts are chosen by distance, weight
and position, sums are taken over whole billionths of a degree, ties go to the lower
number.

These functions act when called. The driver keeps the centres (groups x k rows) and, for
outliers, one histogram per model; positions never leave the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.geo import DEFAULT_ZONES, LAT, LON, Zone, assign_zones
from fleetspark.operators.sampling import every_nth
from fleetspark.schema import KEY, TIME
from fleetspark.sources.tables import local_table

# Fuel average that marks field work, and largest k.
HIGH_FUEL = 30
K_MAX = 18

MAX_ITER = 20
# Billionths of a degree: sums of positions are exact.
UNIT = 1e9
# Starts are looked for among the heaviest positions of each cell of a START_GRID squared
# grid, at most as many per cell as there are clusters.
START_GRID = 16
# Bins of a histogram, and positions that may be put in order directly.
BINS, FEW = 1024, 4096

_SQUARE = "decimal(38,20)"


class Model(NamedTuple):
    """A group of positions and the number of its clusters."""

    group: int
    k: int


Place = tuple[float, float]


def high_load_points(
    df: DataFrame, threshold: float = HIGH_FUEL, column: str = "fuel_ma_10m"
) -> DataFrame:
    return df.filter(F.col(column) > threshold)


def thinned(df: DataFrame, n: int, keys: Sequence[str] = (), order: Sequence[str] = (TIME, KEY)):
    """Every n-th row in time order; all rows for n = 1."""
    return df if n == 1 else every_nth(df, n, keys, order)


def weighted_positions(points: DataFrame, lon: str, lat: str, group: str | None = None) -> DataFrame:
    """One row (g, x, y, w) per group and position, so that copies of a point cost nothing later."""
    return (
        points.select(
            (F.col(group) if group else F.lit(0)).cast("int").alias("g"),
            F.col(lon).alias("x"),
            F.col(lat).alias("y"),
        )
        .dropna()
        .groupBy("g", "x", "y")
        .agg(F.count("*").alias("w"))
    )


def squared(x: Column, y: Column, place: Column) -> Column:
    return (x - place["x"]) * (x - place["x"]) + (y - place["y"]) * (y - place["y"])


def starting_places(positions: DataFrame, k: int, skip: int = 0) -> dict[int, list[Place]]:
    """Up to k places per group: the one nearest the mean, then each time the farthest from all before.

    Places are chosen among the k heaviest positions of each grid cell, so a group brings
    at most START_GRID squared times k rows together; equal distances go by weight, then by
    position. The first j places are the start for j clusters. With `skip`, that many of
    the farthest points are passed over each time, so that outliers do not become starts.
    """
    weight = F.col("w").cast("decimal(18,0)")
    mean = lambda c: F.sum(_whole(c) * weight).cast("double") / F.sum("w").cast("double") / UNIT
    about = positions.groupBy("g").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), mean("x").alias("xm"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), mean("y").alias("ym"),
    )
    cell = lambda c: F.least(
        F.coalesce(
            F.floor((F.col(c) - F.col(f"{c}0")) / F.nullif(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0)) * START_GRID),
            F.lit(0),
        ),
        F.lit(START_GRID - 1),
    )
    heaviest = Window.partitionBy("g", "cx", "cy").orderBy(F.col("w").desc(), "x", "y")
    near = (F.col("x") - F.col("xm")) * (F.col("x") - F.col("xm")) + (F.col("y") - F.col("ym")) * (F.col("y") - F.col("ym"))
    few = (
        positions.join(about, "g")
        .select("g", "x", "y", "w", near.alias("near"), cell("x").alias("cx"), cell("y").alias("cy"))
        .withColumn("n", F.row_number().over(heaviest))
        .filter(F.col("n") <= k)
    )
    # The greatest struct wins: distance, weight, then the smaller position.
    place = F.struct((-F.col("near")).alias("d"), "w", (-F.col("x")).alias("u"), (-F.col("y")).alias("v"))
    few = few.groupBy("g").agg(F.sort_array(F.collect_list(place), asc=False).alias("all"))
    first = F.col("all")[0]
    steps = F.aggregate(
        F.sequence(F.lit(2), F.lit(max(2, k))),
        F.struct(
            F.array(first).alias("found"),
            F.transform("all", lambda p: p.withField("d", _apart(p, first))).alias("left"),
        ),
        lambda now, step: _next_place(now, skip),
    )
    rows = few.select("g", F.slice(steps["found"], 1, k).alias("found")).collect()
    return {r.g: [(-p.u, -p.v) for p in r.found] for r in rows}


def _apart(a: Column, b: Column) -> Column:
    return (a["u"] - b["u"]) * (a["u"] - b["u"]) + (a["v"] - b["v"]) * (a["v"] - b["v"])


def _next_place(now: Column, skip: int) -> Column:
    """One step: the farthest candidate joins `found` if any is left, and distances shrink.

    Each candidate carries its distance to the places so far; places taken are at 0.
    """
    top = F.array_max(now["left"])
    if skip:
        none = F.array_max(F.filter(now["left"], lambda p: F.lit(False)))
        reach = F.aggregate(
            F.sort_array(now["left"], asc=False),
            F.struct(F.lit(skip).cast("bigint").alias("skip"), none.alias("at")),
            lambda a, p: F.when(a["at"].isNotNull(), a)
            .when(a["skip"] >= p["w"], F.struct((a["skip"] - p["w"]).alias("skip"), none.alias("at")))
            .otherwise(F.struct(a["skip"].alias("skip"), p.alias("at"))),
        )
        top = reach["at"]
    # A lambda variable holds the place, else it is looked for once per candidate.
    return F.transform(F.array(top), lambda at: _joined(now, at))[0]


def _joined(now: Column, at: Column) -> Column:
    found = F.when(at["d"] > 0, F.concat(now["found"], F.array(at))).otherwise(now["found"])
    left = F.transform(now["left"], lambda p: p.withField("d", F.least(p["d"], _apart(p, at))))
    return F.struct(found.alias("found"), left.alias("left"))


def _met(positions: DataFrame, centers: Mapping[Model, Sequence[Place]]) -> DataFrame:
    """(g, x, y, w, k, cs): each position with the centres of each model of its group."""
    by_group: dict[int, list[dict]] = {}
    for model, places in sorted(centers.items()):
        by_group.setdefault(model.group, []).append(
            {"k": model.k, "cs": [{"x": x, "y": y} for x, y in places]}
        )
    table = local_table(
        positions.sparkSession,
        list(by_group.items()),
        "g int, models array<struct<k: int, cs: array<struct<x: double, y: double>>>>",
    )
    # One row per group, of the size of the driver's own copy.
    return positions.join(F.broadcast(table), "g").select("g", "x", "y", "w", F.inline("models"))


def nearest(positions: DataFrame, centers: Mapping[Model, Sequence[Place]]) -> DataFrame:
    """(g, k, x, y, w, c, d): number of and squared distance to the nearest centre of each model."""
    far = F.transform("cs", lambda c: squared(F.col("x"), F.col("y"), c))
    return (
        _met(positions, centers)
        .withColumn("far", far)
        .withColumn("d", F.array_min("far"))
        .select("g", "k", "x", "y", "w", (F.array_position("far", F.col("d")) - 1).cast("int").alias("c"), "d")
    )


def assigned_moments(positions: DataFrame, centers: Mapping[Model, Sequence[Place]]) -> DataFrame:
    """`moments(nearest(…))` for many models: (g, k, c, n, sx, sy, wss).

    A batch of positions is measured against all centres of its group as a matrix, and
    gives a row per centre; column expressions took three times as long. Whole numbers,
    split in two halves, keep the sums exact.
    """
    by_group: dict[int, list[tuple[int, list[Place]]]] = {}
    for model, places in sorted(centers.items()):
        by_group.setdefault(model.group, []).append((model.k, list(places)))
    low, high, unit = 1 << 19, float(1 << 20), UNIT

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def added(c, k, values):
            total = np.zeros(k, np.int64)
            np.add.at(total, c, values)
            return total.tolist()

        for batch in batches:
            g, x, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out = []
            for group, models in by_group.items():
                here = np.flatnonzero(g == group)
                if not len(here):
                    continue
                hx, hy, hw = x[here], y[here], w[here]
                wx, wy = (np.floor(v * unit + 0.5).astype(np.int64) for v in (hx, hy))
                for k, places in models:
                    best = np.full(len(here), np.inf)
                    c = np.zeros(len(here), np.int64)
                    for i, (px, py) in enumerate(places):
                        d = (hx - px) * (hx - px) + (hy - py) * (hy - py)
                        closer = d < best
                        best[closer], c[closer] = d[closer], i
                    spread = best * hw * high
                    whole = np.floor(spread)
                    rest = np.floor((spread - whole) * float(1 << 40) + 0.5)
                    sums = [
                        added(c, len(places), v)
                        for v in (hw, wx // low * hw, wx % low * hw, wy // low * hw, wy % low * hw, whole.astype(np.int64), rest.astype(np.int64))
                    ]
                    out += [(group, k, i, *row) for i, row in enumerate(zip(*sums)) if row[0]]
            if out:
                names = ("g", "k", "c", "n", "xh", "xl", "yh", "yl", "dh", "dl")
                kinds = (pa.int32(),) * 3 + (pa.int64(),) * 7
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=list(names))

    parts = positions.select("g", "x", "y", "w").mapInArrow(
        run, "g int, k int, c int, n long, xh long, xl long, yh long, yl long, dh long, dl long"
    )
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    joined = lambda c: (total(f"{c}h") * F.lit(low) + total(f"{c}l")).cast("decimal(38,0)").alias(f"s{c}")
    spread = total("dh").cast("double") / high + total("dl").cast("double") / (high * float(1 << 40))
    return parts.groupBy("g", "k", "c").agg(F.sum("n").alias("n"), joined("x"), joined("y"), spread.alias("wss"))


def _whole(c: str) -> Column:
    return F.floor(F.col(c) * UNIT + 0.5).cast("decimal(20,0)")


def moments(assigned: DataFrame, weight: str = "w") -> DataFrame:
    """(g, k, c): weight, exact sums of positions, and squared distances."""
    w = F.col(weight)
    total = lambda c: F.sum(_whole(c) * w.cast("decimal(18,0)")).alias(f"s{c}")
    return assigned.groupBy("g", "k", "c").agg(
        F.sum(w).alias("n"), total("x"), total("y"), F.sum((F.col("d") * w).cast(_SQUARE)).alias("wss")
    )


def _mean(row) -> Place:
    return float(row.sx) / float(row.n) / UNIT, float(row.sy) / float(row.n) / UNIT


def settle(
    positions: DataFrame,
    centers: Mapping[Model, Sequence[Place]],
    max_iter: int = MAX_ITER,
    n_outliers: int = 0,
) -> dict[Model, list[Place]]:
    """Lloyd's rounds for all models until no centre moves; settled models leave the rounds.

    With outliers, each round leaves out the farthest points before it averages the rest.
    A centre that no point is nearest to stays where it is.
    """
    now = {m: list(places) for m, places in centers.items()}
    moving = set(now)
    for _ in range(max_iter):
        if not moving:
            break
        if n_outliers:
            assigned = nearest(positions, {m: now[m] for m in moving})
            assigned = without_farthest(assigned, dict.fromkeys(moving, n_outliers))
            rows = moments(assigned.filter("kept > 0"), "kept").collect()
        else:
            rows = assigned_moments(positions, {m: now[m] for m in moving}).collect()
        moved = set()
        for row in rows:
            model, place = Model(row.g, row.k), _mean(row)
            if now[model][row.c] != place:
                now[model][row.c] = place
                moved.add(model)
        moving = moved
    return now


def _started(
    positions: DataFrame, ks: Mapping[int, Sequence[int]] | Sequence[int], skip: int = 0
) -> dict[Model, list[Place]]:
    """Starts of every model: numbers of clusters for all groups, or by group."""
    most = max((k for some in ks.values() for k in some) if isinstance(ks, Mapping) else ks)
    places = starting_places(positions, most, skip)
    of = (lambda g: ks.get(g, ())) if isinstance(ks, Mapping) else (lambda g: ks)
    return {Model(g, k): found[:k] for g, found in places.items() for k in of(g)}


def silhouettes(
    positions: DataFrame, centers: Mapping[Model, Sequence[Place]], sums: Sequence
) -> dict[Model, float | None]:
    """Mean silhouette of each model by squared distances, in one pass for all models.

    The mean squared distance from a point to a cluster is that to the cluster's mean
    plus the cluster's own spread, so no pair of points is ever formed. A point alone in
    its cluster counts 0; a model with one cluster has none.
    """
    clusters: dict[Model, list[dict]] = {}
    for row in sums:
        x, y = _mean(row)
        cx, cy = centers[Model(row.g, row.k)][row.c]
        spread = max(0.0, float(row.wss) / row.n - (x - cx) ** 2 - (y - cy) ** 2)
        clusters.setdefault(Model(row.g, row.k), []).append({"c": row.c, "x": x, "y": y, "n": row.n, "spread": spread})
    by_group: dict[int, list[dict]] = {}
    for model, found in sorted(clusters.items()):
        if len(found) > 1:
            by_group.setdefault(model.group, []).append(
                {"k": model.k, "cs": [{"x": a, "y": b} for a, b in centers[model]], "all": found}
            )
    if not by_group:
        return {}
    table = local_table(
        positions.sparkSession,
        list(by_group.items()),
        "g int, models array<struct<k: int, cs: array<struct<x: double, y: double>>,"
        " all: array<struct<c: int, x: double, y: double, n: bigint, spread: double>>>>",
    )
    met = positions.join(F.broadcast(table), "g").select("g", "x", "y", "w", F.inline("models"))
    far = F.transform("cs", lambda c: squared(F.col("x"), F.col("y"), c))
    met = met.withColumn("far", far).withColumn("c", F.array_position("far", F.array_min("far")) - 1)
    mean = lambda q: squared(F.col("x"), F.col("y"), q) + q["spread"]
    own = F.filter("all", lambda q: q["c"] == F.col("c"))[0]
    met = met.withColumn("own", own).withColumn(
        "b", F.array_min(F.transform(F.filter("all", lambda q: q["c"] != F.col("c")), mean))
    )
    a = mean(F.col("own")) * F.col("own.n") / (F.col("own.n") - 1)
    score = F.when(F.col("own.n") == 1, 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    met = met.withColumn("a", F.when(F.col("own.n") > 1, a))
    rows = met.groupBy("g", "k").agg((F.sum((score * F.col("w")).cast(_SQUARE)) / F.sum("w")).cast("double").alias("s")).collect()
    return {Model(r.g, r.k): r.s for r in rows}


def wss_curves(
    points: DataFrame,
    group: str | None,
    k_max: int = K_MAX,
    max_iter: int = MAX_ITER,
    lon: str = LON,
    lat: str = LAT,
    silhouette: bool = False,
) -> DataFrame:
    """(group, k, wss) for k = 1 … k_max of every group; with `silhouette` also that score.

    All curves come from the same rounds. A group with fewer than k positions has every
    position as a centre for k; a group without positions has no curve.
    """
    positions = weighted_positions(points, lon, lat, group).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = settle(positions, _started(positions, range(1, k_max + 1)), max_iter)
        sums = assigned_moments(positions, centers).collect() if centers else []
        score = silhouettes(positions, centers, sums) if silhouette else {}
    finally:
        positions.unpersist()
    wss = dict.fromkeys(centers, 0.0)
    for row in sorted(sums, key=lambda r: (r.g, r.k, r.c)):
        wss[Model(row.g, row.k)] += row.wss
    rows = [(*m, total, score.get(m)) for m, total in sorted(wss.items())]
    name = group or "g"
    curve = local_table(points.sparkSession, rows, f"{name} int, k int, wss double, silhouette double")
    return curve.drop(*([] if silhouette else ["silhouette"]), *([] if group else ["g"]))


def wss_curve(points: DataFrame, k_max: int = K_MAX, max_iter: int = MAX_ITER, lon: str = LON, lat: str = LAT, silhouette: bool = False) -> DataFrame:
    """(k, wss) for k = 1 … k_max over all points; with `silhouette` also that score (NULL for k = 1)."""
    return wss_curves(points, None, k_max, max_iter, lon, lat, silhouette)


def choose_k(curve: DataFrame, method: str = "min_wss") -> int:
    """k with the lowest WSS (or highest silhouette); the smallest such k on ties."""
    return curve.orderBy(*_preference(method)).first().k


def choose_ks(curves: DataFrame, group: str, method: str = "min_wss") -> DataFrame:
    """(group, k): `choose_k` for every group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*_preference(method)))
    return curves.withColumn("_rank", rank).filter("_rank = 1").select(group, "k")


def _preference(method: str) -> list[Column]:
    best = F.col("wss").asc() if method == "min_wss" else F.col("silhouette").desc_nulls_last()
    return [best, F.col("k").asc()]


def kmeans_centers(
    points: DataFrame, k: int, max_iter: int = MAX_ITER, lon: str = LON, lat: str = LAT
) -> DataFrame:
    """(x, y) of k centres; plain Euclidean distance in degrees.

    Fewer than k positions are all returned as centres.
    """
    return kmeans_minus_minus(points, k, 0, max_iter, lon, lat)[0]


def kmeans_minus_minus(
    points: DataFrame,
    k: int,
    n_outliers: int = 0,
    max_iter: int = MAX_ITER,
    lon: str = LON,
    lat: str = LAT,
) -> tuple[DataFrame, DataFrame]:
    """Centres (x, y) and outliers (x, y, n) of k-means with the farthest points set aside.

    Each round measures every position against the current centres, leaves out the
    `n_outliers` farthest points and averages the rest (Chawla and Gionis, 2013). With no
    outliers this is plain k-means. If there are no more points than outliers, every point
    is one and there is no centre; if there are few more, there may be fewer than k centres.
    """
    centers, outliers = _clustered(weighted_positions(points, lon, lat), [k], n_outliers, max_iter)
    return centers.drop("g"), outliers.drop("g")


def kmeans_without_outliers(
    points: DataFrame,
    group: str,
    k: int,
    n_outliers: int,
    max_iter: int = MAX_ITER,
    lon: str = LON,
    lat: str = LAT,
) -> tuple[DataFrame, DataFrame]:
    """`kmeans_minus_minus` for every group at once: (group, x, y) and (group, x, y, n)."""
    found = _clustered(weighted_positions(points, lon, lat, group), [k], n_outliers, max_iter)
    return found[0].withColumnRenamed("g", group), found[1].withColumnRenamed("g", group)


def _clustered(
    positions: DataFrame, ks: Mapping[int, Sequence[int]] | Sequence[int], n_outliers: int, max_iter: int
) -> tuple[DataFrame, DataFrame]:
    """Centres (g, x, y) and outliers (g, x, y, n) of one model per group."""
    spark = positions.sparkSession
    none = local_table(spark, [], "g int, x double, y double, n bigint")
    kept = positions.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = settle(kept, _started(kept, ks, n_outliers), max_iter, n_outliers)
        outliers = none
        if n_outliers and centers:
            totals = {r.g: r.n for r in kept.groupBy("g").agg(F.sum("w").alias("n")).collect()}
            apart = without_farthest(nearest(positions, centers), dict.fromkeys(centers, n_outliers))
            outliers = apart.filter(F.col("kept") < F.col("w")).select("g", "x", "y", (F.col("w") - F.col("kept")).alias("n"))
            centers = {m: places for m, places in centers.items() if totals[m.group] > n_outliers}
    finally:
        kept.unpersist()
    rows = [(m.group, x, y) for m, places in sorted(centers.items()) for x, y in sorted(places)]
    return local_table(spark, rows, "g int, x double, y double"), outliers


class _Edge(NamedTuple):
    """Where a model's farthest points end: rows in these bounds share what is left to take."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    need: int
    rows: int = FEW + 1


def without_farthest(assigned: DataFrame, take: Mapping[Model, int]) -> DataFrame:
    """Add `kept`: each position's weight after the farthest points of its model are taken away.

    Farthest by distance, equal distances by position (x, then y, smaller first). The
    border is found by histograms that are refined where it lies, until few positions are
    left in question; only those are put in order, within their model.
    """
    spark = assigned.sparkSession
    # Ascending in the order of being taken.
    order = {"_d": -F.col("d"), "_x": F.col("x"), "_y": F.col("y")}
    rows = assigned.withColumns(order)
    edges = {m: _edge_start(n) for m, n in take.items()}
    for depth, name in enumerate(order):
        edges = _refined(rows, edges, depth, name)
    table = local_table(
        spark,
        [(m.group, m.k, *e.low, *e.high, e.need) for m, e in sorted(edges.items())],
        "g int, k int, " + ", ".join(f"{side}{n} double" for side in ("low", "high") for n in order) + ", need bigint",
    )
    met = rows.join(F.broadcast(table), ["g", "k"])
    before, after = _compared(list(order))
    # Each model's border rows are at most FEW, or one position.
    first = Window.partitionBy("g", "k").orderBy("_d", "_x", "_y").rowsBetween(Window.unboundedPreceding, -1)
    border = met.filter(~before & ~after).withColumn("_taken", F.coalesce(F.sum("w").over(first), F.lit(0)))
    border = border.withColumn(
        "kept", F.col("w") - F.least(F.col("w"), F.greatest(F.col("need") - F.col("_taken"), F.lit(0)))
    )
    rest = met.filter(before | after).withColumn("kept", F.when(before, F.lit(0)).otherwise(F.col("w")))
    return border.unionByName(rest, allowMissingColumns=True).select(*assigned.columns, "kept")


def _edge_start(need: int) -> _Edge:
    infinite = float("inf")
    return _Edge((-infinite,) * 3, (infinite,) * 3, need)


def _compared(names: Sequence[str]) -> tuple[Column, Column]:
    """Whether a row is taken before, or comes after, all rows within the bounds."""
    before = after = F.lit(False)
    for name in reversed(list(names)):
        here, low, high = F.col(name), F.col(f"low{name}"), F.col(f"high{name}")
        same = low == high
        before = (here < low) | (same & (here == low) & before)
        after = (here > high) | (same & (here == high) & after)
    return before, after


def _refined(rows: DataFrame, edges: Mapping[Model, _Edge], depth: int, name: str) -> dict[Model, _Edge]:
    """Narrow the bounds of one value until few rows lie in them, or one value is left."""
    done = dict(edges)
    names = ["_d", "_x", "_y"]
    # Bounds on this value matter only once all values before it are down to one.
    open_ = {m: e for m, e in edges.items() if e.rows > FEW and all(e.low[i] == e.high[i] for i in range(depth))}
    while open_:
        table = local_table(
            rows.sparkSession,
            [(m.group, m.k, *e.low, *e.high) for m, e in sorted(open_.items())],
            "g int, k int, " + ", ".join(f"{side}{n} double" for side in ("low", "high") for n in names),
        )
        met = rows.join(F.broadcast(table), ["g", "k"])
        within = F.lit(True)
        for n in names[: depth + 1]:
            within &= (F.col(n) >= F.col(f"low{n}")) & (F.col(n) <= F.col(f"high{n}"))
        share = (F.col(name) - F.col(f"low{name}")) / (F.col(f"high{name}") - F.col(f"low{name}"))
        bounded = (F.col(f"high{name}") < float("inf")) & (F.col(f"high{name}") > F.col(f"low{name}"))
        spot = F.when(bounded, F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        found = (
            met.filter(within)
            .groupBy("g", "k", spot.alias("bin"))
            .agg(F.sum("w").alias("w"), F.count("*").alias("rows"), F.min(name).alias("low"), F.max(name).alias("high"))
            .collect()
        )
        bins: dict[Model, list] = {}
        for row in sorted(found, key=lambda r: r.bin):
            bins.setdefault(Model(row.g, row.k), []).append(row)
        still = {}
        for m, e in open_.items():
            need = e.need
            for row in bins.get(m, []):
                if row.w >= need or row is bins[m][-1]:
                    change = lambda side, value: (*side[:depth], value, *side[depth + 1 :])
                    done[m] = _Edge(change(e.low, row.low), change(e.high, row.high), need, row.rows)
                    if row.low < row.high and (row.rows > FEW or e.low[depth] == -float("inf")):
                        still[m] = done[m]
                    break
                need -= row.w
        open_ = still
    return done


def field_centers(
    sample: DataFrame,
    zones: Sequence[Zone] = DEFAULT_ZONES,
    k: int | None = None,
    k_max: int = K_MAX,
    max_iter: int = MAX_ITER,
    n_outliers: int = 0,
    order: Sequence[str] = (TIME, KEY),
    fuel: str = "fuel_ma_10m",
    thin: int = 1,
) -> DataFrame:
    """(zone_id, x, y): centres of the high-load points of every zone.

    Without `k`, each zone gets the k with the lowest WSS over its points, of which `thin`
    keeps every n-th. Zones without high-load points have no centres.
    """
    needed = dict.fromkeys(["zone_id", LON, LAT, fuel, *order])
    zoned = assign_zones(sample, zones).select(*needed)
    busy = weighted_positions(high_load_points(zoned, column=fuel), LON, LAT, "zone_id")
    ks: Mapping[int, Sequence[int]] | Sequence[int] = [k or 1]
    if k is None:
        curves = wss_curves(thinned(zoned, thin, ["zone_id"], order), "zone_id", k_max, max_iter)
        ks = {r.zone_id: [r.k] for r in choose_ks(curves, "zone_id").collect()}  # a row per zone
        if not ks:
            return local_table(sample.sparkSession, [], "zone_id int, x double, y double")
    centers, _ = _clustered(busy, ks, n_outliers, max_iter)
    return centers.withColumnRenamed("g", "zone_id")
