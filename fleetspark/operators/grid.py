"""Two-dimensional binning of positions."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.operators.geo import DEFAULT_ZONES, LAT, LON, Box, Zone, assign_zones, bbox, in_bbox

# Cell sizes in degrees and the row counts that make a cell dense.
GLOBAL_STEP, ZONE_STEP = 1 / 60 / 2, 1 / 240
CANDIDATE_CUTOFF = 360 * 5
FIELD_CUTOFF = 120
MAP_MARGIN = 0.2


def grid_spec(box: Box, step_deg: float) -> tuple[int, int]:
    """Number of cells across and up for a box."""
    cells = lambda low, high: ceil((high - low) / step_deg)
    return cells(box.left, box.right), cells(box.bottom, box.top)


def cell_index(value: Column, low: Column, high: Column, n: Column) -> Column:
    """1..n over equal, right-closed cells; the lowest edge belongs to cell 1."""
    width = F.nullif((high - low) / n, F.lit(0.0))
    index = F.ceil((value - low) / width)
    return F.coalesce(F.least(F.greatest(index, F.lit(1)), n.cast("long")), F.lit(1)).cast("int")


def _extent(df: DataFrame, pad: float = 0.0, lon: str = LON, lat: str = LAT) -> Column:
    """The box of the data as one scalar subquery with four fields."""
    return bbox(df, pad, lon, lat).select(F.struct(*Box._fields)).scalar()


def _as_column(n: int | Column) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def with_cells(
    df: DataFrame,
    nx: int | Column,
    ny: int | Column,
    box: Box | None = None,
    lon: str = LON,
    lat: str = LAT,
) -> DataFrame:
    """Add cell numbers ix, iy over the extent of the data, or over `box` if given."""
    if box is None:
        edges = _extent(df, 0.0, lon, lat)
    else:
        df = in_bbox(df, box, lon=lon, lat=lat)
        edges = F.struct(*[F.lit(value).alias(side) for side, value in box._asdict().items()])
    side = lambda name: F.col(f"_edges.{name}")
    return (
        df.withColumn("_edges", edges)
        .withColumn("ix", cell_index(F.col(lon), side("left"), side("right"), _as_column(nx)))
        .withColumn("iy", cell_index(F.col(lat), side("bottom"), side("top"), _as_column(ny)))
        .drop("_edges")
    )


def grid_agg(
    df: DataFrame,
    aggregate: Column,
    nx: int | Column,
    ny: int | Column,
    out: str = "z",
    box: Box | None = None,
    lon: str = LON,
    lat: str = LAT,
) -> DataFrame:
    """One aggregate per occupied cell."""
    cells = with_cells(df, nx, ny, box, lon, lat)
    return cells.groupBy("ix", "iy").agg(aggregate.alias(out))


def grid_count(df: DataFrame, nx: int | Column, ny: int | Column, **where) -> DataFrame:
    """Rows per occupied cell."""
    return grid_agg(df, F.count("*"), nx, ny, out="n", **where)


def zone_grid(
    df: DataFrame,
    zones: Sequence[Zone] = DEFAULT_ZONES,
    step_deg: float = ZONE_STEP,
    lon: str = LON,
    lat: str = LAT,
) -> DataFrame:
    """Rows per zone and cell, with each zone's grid laid over the extent of its points."""
    placed = assign_zones(df, zones, lon, lat).select("zone_id", lon, lat)
    # One row per listed zone: small by construction.
    extents = placed.groupBy("zone_id").agg(
        F.min(lon).alias("left"),
        F.max(lon).alias("right"),
        F.min(lat).alias("bottom"),
        F.max(lat).alias("top"),
    )
    specs = {zone.zone_id: grid_spec(zone.box, step_deg) for zone in zones}
    cells_of = lambda axis: F.element_at(
        F.create_map(*[F.lit(v) for z, spec in specs.items() for v in (z, spec[axis])]),
        F.col("zone_id"),
    )
    column = F.col
    return (
        placed.join(F.broadcast(extents), "zone_id")
        .withColumn("ix", cell_index(column(lon), column("left"), column("right"), cells_of(0)))
        .withColumn("iy", cell_index(column(lat), column("bottom"), column("top"), cells_of(1)))
        .groupBy("zone_id", "ix", "iy")
        .agg(F.count("*").alias("n"))
    )


def dense_cells(grid: DataFrame, cutoff: int) -> DataFrame:
    """Cells with more than `cutoff` rows."""
    return grid.filter(F.col("n") > cutoff)


def candidate_fields(
    df: DataFrame,
    cutoff: int = CANDIDATE_CUTOFF,
    step_deg: float = GLOBAL_STEP,
    margin: float = MAP_MARGIN,
) -> DataFrame:
    """Grid size over the whole area and the number of cells busy enough to be a site.

    The number of cells comes from the extent with a margin; the cells cover the extent
    of the data itself.
    """
    cells = lambda low, high: F.ceil(
        (F.col(f"_padded.{high}") - F.col(f"_padded.{low}")) / F.lit(step_deg)
    )
    sized = df.withColumn("_padded", _extent(df, margin)).withColumns(
        {"_nx": cells("left", "right"), "_ny": cells("bottom", "top")}
    )
    return (
        with_cells(sized, F.col("_nx"), F.col("_ny"))
        .groupBy("ix", "iy")
        .agg(F.count("*").alias("n"), F.first("_nx").alias("_nx"), F.first("_ny").alias("_ny"))
        .agg(
            F.max("_nx").alias("cells_x"),
            F.max("_ny").alias("cells_y"),
            F.count_if(F.col("n") > cutoff).alias("n_candidates"),
        )
    )
