"""Gap statistic: how far a clustering of the points is tighter than one of no structure.

Reference sets are drawn evenly over each group's box by a counter-based generator: a
place depends on its group, set and number alone, so neither the partitioning nor a task
that runs again shows in it. All sets and numbers of clusters are settled in the same
rounds as the points themselves (Tibshirani, Walther and Hastie, 2001).
"""

from __future__ import annotations

from math import log, sqrt
from statistics import fmean, pstdev

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.cluster import MAX_ITER, Model, _started, assigned_moments, settle, weighted_positions
from fleetspark.operators.geo import LAT, LON
from fleetspark.sources.tables import local_table

# Fixed value: number of reference sets.
SETS = 20
_BLOCK = 4096


def reference_sets(positions: DataFrame, sets: int, size: int | None = None) -> DataFrame:
    """(g, b, x, y, w): for each group `sets` sets of `size` places, evenly spread over its box.

    Without `size` a set has as many places as its group has points.
    """
    box = positions.groupBy("g").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("w").alias("n")
    )
    box = box.withColumn("n", F.lit(size).cast("bigint") if size else F.col("n"))
    set_ = box.select("*", F.explode(F.sequence(F.lit(1), F.lit(sets))).alias("b"))
    # Blocks of numbers are dealt out before they become places, so no task draws a whole set.
    blocks = set_.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _BLOCK))).alias("at"))
    numbers = blocks.repartition("g", "b", "at").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(_BLOCK - 1))).alias("i")
    ).withColumn("i", F.col("at") * _BLOCK + F.col("i"))
    code = F.md5(F.concat_ws(":", "g", "b", "i").cast("binary"))
    share = lambda start: F.conv(F.substring(code, start, 8), 16, 10).cast("double") / 4294967296.0
    return numbers.filter("i < n").select(
        "g",
        "b",
        (F.col("x0") + share(1) * (F.col("x1") - F.col("x0"))).alias("x"),
        (F.col("y0") + share(9) * (F.col("y1") - F.col("y0"))).alias("y"),
        F.lit(1).cast("bigint").alias("w"),
    )


def gap_statistic(
    points: DataFrame,
    group: str,
    k_max: int,
    sets: int = SETS,
    size: int | None = None,
    max_iter: int = MAX_ITER,
    lon: str = LON,
    lat: str = LAT,
) -> DataFrame:
    """(group, k, log_wss, gap, error) for k = 1 … k_max of every group.

    Spreads are squared distances per point, so sets may be smaller than the group. A
    spread of 0 (no more positions than clusters) has no logarithm: its gap is NULL.
    """
    own = weighted_positions(points, lon, lat, group).persist(StorageLevel.MEMORY_AND_DISK)
    coded = lambda b: (F.col("g") * (sets + 1) + b).cast("int").alias("g")
    drawn = reference_sets(own, sets, size).select(coded(F.col("b")), "x", "y", "w")
    every = own.select(coded(F.lit(0)), "x", "y", "w").unionByName(drawn).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = settle(every, _started(every, range(1, k_max + 1)), max_iter)
        sums = assigned_moments(every, centers).collect() if centers else []
    finally:
        every.unpersist()
        own.unpersist()
    wss, n = dict.fromkeys(centers, 0.0), dict.fromkeys(centers, 0)
    for row in sorted(sums, key=lambda r: (r.g, r.k, r.c)):
        model = Model(row.g, row.k)
        wss[model], n[model] = wss[model] + row.wss, n[model] + row.n
    spread = {m: log(wss[m] / n[m]) if wss[m] > 0 else None for m in centers}
    rows = []
    for model in sorted(centers):
        g, b = divmod(model.group, sets + 1)
        if b == 0:
            mine = spread[model]
            drawn_ = [spread[Model(model.group + i, model.k)] for i in range(1, sets + 1)]
            known = mine is not None and None not in drawn_
            gap = fmean(drawn_) - mine if known else None
            rows.append((g, model.k, mine, gap, pstdev(drawn_) * sqrt(1 + 1 / sets) if known else None))
    return local_table(points.sparkSession, rows, f"{group} int, k int, log_wss double, gap double, error double")


def choose_k_by_gap(gaps: DataFrame, group: str) -> DataFrame:
    """(group, k): the smallest k whose gap is not below the next one's less its error; else the largest k."""
    from pyspark.sql import Window

    next_ = lambda c: F.lead(c).over(Window.partitionBy(group).orderBy("k"))
    good: Column = F.col("gap") >= next_("gap") - next_("error")
    marked = gaps.withColumn("_good", good)
    return marked.groupBy(group).agg(F.coalesce(F.min(F.when(F.col("_good"), F.col("k"))), F.max("k")).alias("k"))
