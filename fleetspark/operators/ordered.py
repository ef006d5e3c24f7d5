"""Ordered work on one machine's rows without putting the machine into one task.

A machine may hold a third of all rows, so nothing here sorts a whole machine.
Rows are split by (machine, time slice); what a slice needs from earlier slices
travels through a small table with one row (or a fixed number of rows) per slice.
The per-machine windows left over see that small table only, whose length is
bounded by the clock, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.expressions import time_bucket
from fleetspark.schema import TIME

SLICE = "_slice"


def with_slice(df: DataFrame, seconds: int, time: str = TIME) -> DataFrame:
    return df.withColumn(SLICE, time_bucket(time, seconds))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL counting as equal to NULL; the keys come from the left."""
    names = {k: f"_right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(renamed, same, how).drop(*names.values())


def ascending(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def descending(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_first() for c in columns]


def total_order(df: DataFrame, order: Sequence[str], unique: bool) -> list[str]:
    """Order columns, followed by all others as tie-breaks unless `order` is unique."""
    return list(order) if unique else list(dict.fromkeys([*order, *df.columns]))


def with_preceding_rows(
    df: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
) -> DataFrame:
    """Add to every (keys, slice) of `df` copies of the last `n` rows before the slice.

    `source` holds the rows that can be copied.  Copies have `_copied` set and NULL in
    the columns `source` lacks.  Slices may be empty or short: copies come from as many
    earlier slices as needed.
    """
    by_slice = Window.partitionBy(*keys, SLICE)
    # Filtering a row number directly lets Spark cut every task's groups to n rows
    # before the shuffle, so a crowded slice costs no more than a quiet one.
    last_rows = (
        source.withColumn("_rank", F.row_number().over(by_slice.orderBy(*descending(order))))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )
    by_key = Window.partitionBy(*keys).orderBy(*ascending([SLICE, *order]))
    opens = ~F.lag(SLICE).over(by_key).eqNullSafe(F.col(SLICE))
    copies = (
        last_rows.withColumn("_opened", F.when(opens, F.col(SLICE)))
        .withColumn("_into", F.collect_list("_opened").over(by_key.rowsBetween(1, n)))
        .withColumn(SLICE, F.explode("_into"))
        .drop("_opened", "_into")
        .withColumn("_copied", F.lit(True))
    )
    return df.withColumn("_copied", F.lit(False)).unionByName(copies, allowMissingColumns=True)


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    seconds: int,
    time: str = TIME,
) -> DataFrame:
    """Number the rows 1, 2, … in each group of `keys`; `order` must start with `time`."""
    sliced = with_slice(df, seconds, time)
    by = [*keys, SLICE]
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by)
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    in_slice = Window.partitionBy(*by).orderBy(*ascending(order))
    return (
        sliced.withColumn("_rn", F.row_number().over(in_slice))
        .transform(join_same, offsets, by)
        .withColumn(out, F.col("_offset") + F.col("_rn"))
        .drop("_rn", "_offset", SLICE)
    )
