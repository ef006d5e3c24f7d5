"""Down-sampling and row-framed moving averages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.expressions import HOUR, WEEK, time_bucket
from fleetspark.operators.ordered import (
    SLICE,
    ascending,
    descending,
    total_order,
    with_position,
    with_preceding_rows,
    with_slice,
)
from fleetspark.schema import KEY, MA_COLUMNS, MA_FRAMES, SAMPLED, TIME, ma_names

# Above this many look-backs per average, one frame per average is cheaper.
MAX_LOOK_BACKS = 12


def sample_first(
    df: DataFrame,
    bucket_seconds: int,
    order: Sequence[str] = (TIME,),
    unique_order: bool = False,
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """First row of every machine and time slot.

    Rows are cut to one per slot inside each task before the shuffle.
    """
    rows = df.withColumn("_bucket", time_bucket(TIME, bucket_seconds))
    slot = Window.partitionBy(*keys, "_bucket").orderBy(
        *ascending(total_order(df, order, unique_order))
    )
    return (
        rows.withColumn("_row", F.row_number().over(slot))
        .filter(F.col("_row") == 1)
        .drop("_row", "_bucket")
    )


def _with_frame_averages(
    rows: DataFrame,
    columns: Mapping[str, str],
    frames: Mapping[str, int],
    keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Add averages over frames of n preceding rows plus the current one.

    When every frame is a multiple of one step, each average is put together from the
    current value and step-long sums looked up 1, 1+step, 1+2*step … rows back.  A row
    then costs one short frame instead of one long frame per average.
    """
    w = Window.partitionBy(*keys, SLICE).orderBy(*ascending(order))
    step = reduce(gcd, frames.values())
    if not step or max(frames.values()) // step > MAX_LOOK_BACKS:
        return rows.withColumns(
            {
                f"{name}_ma_{label}": F.avg(column).over(w.rowsBetween(-n, 0))
                for label, n in frames.items()
                for name, column in columns.items()
            }
        )

    short = w.rowsBetween(-(step - 1), 0)
    sums = [F.sum(column).over(short).alias(f"sum_{name}") for name, column in columns.items()]
    counts = [F.count(column).over(short).alias(f"n_{name}") for name, column in columns.items()]
    look_backs = range(max(frames.values()) // step)
    back = [f"_back{i}" for i in look_backs]

    def average(name: str, column: str, n: int) -> Column:
        used = back[: n // step]
        total = [f"`{column}`", *(f"{b}.sum_{name}" for b in used)]
        count = [f"int(`{column}` IS NOT NULL)", *(f"{b}.n_{name}" for b in used)]
        both = (" + ".join(f"coalesce({x}, {zero})" for x in xs)
                for xs, zero in ((total, "0D"), (count, "0")))
        return F.expr("({}) / nullif({}, 0)".format(*both))

    return (
        rows.withColumn("_step", F.struct(*sums, *counts))
        .withColumns({b: F.lag("_step", 1 + i * step).over(w) for i, b in enumerate(back)})
        .withColumns(
            {
                f"{name}_ma_{label}": average(name, column, n)
                for label, n in frames.items()
                for name, column in columns.items()
            }
        )
        .drop("_step", *back)
    )


def add_moving_averages(
    df: DataFrame,
    columns: Mapping[str, str] = MA_COLUMNS,
    frames: Mapping[str, int] = MA_FRAMES,
    order: Sequence[str] = (TIME,),
    unique_order: bool = False,
    keys: Sequence[str] = (KEY,),
    slice_seconds: int = WEEK,
    source: DataFrame | None = None,
) -> DataFrame:
    """Average each column over the current and the n preceding rows of the machine.

    NULL values are skipped.  A task holds one machine's `slice_seconds` and the longest
    frame before it, so choose the slice by the rows a machine can have in that time;
    for raw rows that may crowd together use `sample_with_averages`.  `source` replaces
    `df` as the rows that frames may reach back to before a slice.
    """
    if not unique_order:
        order = total_order(df, [*order, *columns.values()], False)
    sliced = with_slice(df, slice_seconds)
    narrow = list(dict.fromkeys([*keys, SLICE, *order, *columns.values()]))
    source = sliced if source is None else with_slice(source, slice_seconds)
    rows = with_preceding_rows(sliced, source.select(*narrow), keys, order, max(frames.values()))
    averaged = _with_frame_averages(rows, columns, frames, keys, order)
    return averaged.filter(~F.col("_copied")).drop("_copied", SLICE)


def sample_with_averages(
    df: DataFrame,
    bucket_seconds: int,
    columns: Mapping[str, str] = MA_COLUMNS,
    frames: Mapping[str, int] = MA_FRAMES,
    keep: Sequence[str] = SAMPLED,
    order: Sequence[str] = (TIME,),
    unique_order: bool = False,
    keys: Sequence[str] = (KEY,),
    slice_seconds: int = WEEK,
) -> DataFrame:
    """First row of every machine and slot, with averages taken over *all* rows.

    A frame that ends at the first row of a slot reaches back at most n rows into each
    earlier slot, so the first row and the last n others of a slot are all that can
    matter.  Everything else is dropped before averaging (inside each task, before the
    shuffle), which bounds a slot at n + 1 rows however many readings it holds and
    leaves the result exact.
    """
    if slice_seconds % bucket_seconds:
        raise ValueError("slice_seconds must be a multiple of bucket_seconds")
    n = max(frames.values())
    values = list(columns.values())
    # Rows that tie on time and on every averaged value are interchangeable here.
    order = list(order) if unique_order else list(dict.fromkeys([*order, *values]))
    narrow = list(dict.fromkeys([*keys, *order, *values]))
    wide = list(dict.fromkeys([*narrow, *keep]))

    heads = sample_first(df.select(*wide), bucket_seconds, order, unique_order, keys)
    slot = Window.partitionBy(*keys, "_bucket")
    others = (
        df.select(*narrow)
        .withColumn("_bucket", time_bucket(TIME, bucket_seconds))
        .withColumn("_rank", F.row_number().over(slot.orderBy(*descending(order))))
        .filter(F.col("_rank") <= n + 1)
        # The earliest of what is left is the head itself, or a row out of reach.
        .withColumn("_size", F.count("*").over(slot))
        .filter(F.col("_rank") < F.col("_size"))
        .drop("_rank", "_size", "_bucket")
    )
    rows = heads.withColumn("_head", F.lit(True)).unionByName(
        others.withColumn("_head", F.lit(False)), allowMissingColumns=True
    )
    averaged = add_moving_averages(
        rows, columns, frames, order, True, keys, slice_seconds, source=df.select(*narrow)
    )
    names = [*keep, *ma_names(columns, frames)]
    return averaged.filter("_head").select(*dict.fromkeys([*names, *order]))


def sample_table(df: DataFrame, bucket_seconds: int, **options) -> DataFrame:
    """Sampled table in its stored column order."""
    sampled = sample_with_averages(df, bucket_seconds, **options)
    return sampled.select(*SAMPLED, *ma_names())


def every_nth(
    df: DataFrame,
    n: int,
    keys: Sequence[str] = (),
    order: Sequence[str] = (TIME, KEY),
    slice_seconds: int = HOUR,
) -> DataFrame:
    """Rows 1, n+1, 2n+1, … of each group in time order."""
    numbered = with_position(df, keys, order, "_position", slice_seconds)
    return numbered.filter((F.col("_position") - 1) % n == 0).drop("_position")
