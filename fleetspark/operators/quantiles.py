"""Exact medians and quantiles that do not hold a group in memory.

Spark's `median` keeps every distinct value of a group in one aggregation buffer.
Here coarse value ranges are counted first to find those that hold a wanted rank; only
their values are shuffled, parted by finer ranges, and put in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.operators.ordered import join_same

# Ranges per doubling of the value's size.
RANGES_PER_OCTAVE = 1024
FINE = RANGES_PER_OCTAVE << 20


def _value_range(value: str, per_octave: int = RANGES_PER_OCTAVE) -> Column:
    """Monotone range of a number; the count of coarse ranges is bounded for all doubles."""
    v = F.col(value)
    # NaN sorts after every number, infinities at the ends.
    size = F.least(F.log2(F.abs(v) + 1), F.lit(2000.0))
    place = F.when(F.isnan(v), F.lit(1 << 60)).otherwise(
        F.floor(F.signum(v) * size * per_octave)
    )
    return F.coalesce(place.cast("long"), F.lit(0))


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row (keys, name, value) per non-NULL value of the columns."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    return df.select(*keys, F.inline(pairs)).dropna(subset=["value"])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """One row per group; column `out` is quantile p of column c for `wanted[out] = (c, p)`.

    Quantiles between two values are interpolated linearly; NULLs are ignored.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    long = quantiles_long(melt(df, keys, columns), keys, sorted({p for _, p in wanted.values()}))
    cells = [
        F.max(F.when((F.col("name") == c) & (F.col("p") == p), F.col("quantile"))).alias(out)
        for out, (c, p) in wanted.items()
    ]
    if keys:
        return long.groupBy(*keys).agg(*cells)
    return long.agg(*cells)


def _shares(probabilities: Sequence[float]) -> Column:
    """For each probability the ranks (from 0) of the two values it lies between."""
    at = lambda p: (F.col("total") - 1) * F.lit(p)
    return F.array(
        *[
            F.struct(F.lit(p).alias("p"), F.floor(at(p)).alias("low"), F.ceil(at(p)).alias("high"), at(p).alias("at"))
            for p in probabilities
        ]
    )


def _picked(ranges: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, range, below, n, ranks) to the ranges that hold a wanted rank, each with those ranks."""
    open_ = ranges.select(*group, "range", "below", "n", F.inline("ranks"))
    return (
        open_.filter((F.col("low") < F.col("below") + F.col("n")) & (F.col("high") >= F.col("below")))
        .groupBy(*group, "range", "below")
        .agg(F.collect_list(F.struct("p", "low", "high", "at")).alias("ranks"))
    )


def quantiles_long(melted: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(keys, name, p, quantile) for every group, name and probability.

    A first pass counts rows per coarse range, which map tasks add up to a bounded table.
    A second pass shuffles only the values of the ranges that hold a wanted rank; finer
    ranges part them once more before any are put in order. NULL keys are a group.
    """
    group = [*keys, "name"]
    coarse = melted.withColumn("range", _value_range("value"))
    by_group = Window.partitionBy(*group)
    ranges = (
        coarse.groupBy(*group, "range")
        .agg(F.count("*").alias("n"))
        .withColumn("total", F.sum("n").over(by_group))
        .withColumn("below", F.sum("n").over(by_group.orderBy("range")) - F.col("n"))
        .withColumn("ranks", _shares(probabilities))
    )
    picked = _picked(ranges, group).withColumnRenamed("range", "coarse")
    # Equal values collapse inside each task, so a value shared by a third of the rows is cheap.
    inner = [*group, "coarse"]
    counts = (
        join_same(coarse.withColumnRenamed("range", "coarse"), picked.select(*inner), inner)
        .groupBy(*inner, "value")
        .agg(F.count("*").alias("n"))
        .withColumn("range", _value_range("value", FINE))
    )
    fine = counts.groupBy(*inner, "range").agg(F.sum("n").alias("n"))
    fine = join_same(fine, picked, inner).withColumn(
        "below", F.col("below") + F.sum("n").over(Window.partitionBy(*inner).orderBy("range")) - F.col("n")
    )
    picked = _picked(fine, inner)
    in_range = Window.partitionBy(*inner, "range").orderBy("value")
    ordered = (
        join_same(counts, picked, [*inner, "range"])
        .withColumn("end", F.col("below") + F.sum("n").over(in_range))
        .withColumn("start", F.col("end") - F.col("n"))
    )
    holds = lambda rank: (F.col(rank) >= F.col("start")) & (F.col(rank) < F.col("end"))
    return (
        ordered.select(*group, "value", "start", "end", F.inline("ranks"))
        .filter(holds("low") | holds("high"))
        .groupBy(*group, "p", "at")
        .agg(
            F.max(F.when(holds("low"), F.col("value"))).alias("lower"),
            F.max(F.when(holds("high"), F.col("value"))).alias("upper"),
        )
        .select(
            *group,
            "p",
            (
                F.col("lower")
                + (F.col("upper") - F.col("lower")) * (F.col("at") - F.floor("at"))
            ).alias("quantile"),
        )
    )


def medians(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Exact median of each column; `columns` maps result name to column."""
    return exact_quantiles(df, keys, {out: (c, 0.5) for out, c in columns.items()})
