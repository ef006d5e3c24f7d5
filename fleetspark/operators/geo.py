"""Boxes, zones and distances to site centres."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sin
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.expressions import EARTH_RADIUS_M, METRES_PER
from fleetspark.sources.tables import local_table

LON, LAT = "gps_longitude", "gps_latitude"

# Degrees of latitude per kilometre on the sphere used for distances.
DEGREES_PER_KM = 180.0 / (pi * EARTH_RADIUS_M / 1000.0)
NAUTICAL_MILE_DEG = 0.0167

# Largest list that is written into a plan as literals.
MAX_INLINE = 1024
# Cells of boxes: sides of the smallest, and how many times it is doubled.
SMALLEST_CELL_DEG, LEVELS = 1e-4, 24
# Largest table of centres that is broadcast, in rows (about 1 KB each once spread).
MAX_BROADCAST_ROWS = 100_000


class Box(NamedTuple):
    left: float
    bottom: float
    right: float
    top: float


class Zone(NamedTuple):
    zone_id: int
    box: Box


# The three working areas and the box of one map query.
DEFAULT_ZONES = [
    Zone(1, Box(20.0, 45.95, 20.35, 46.15)),
    Zone(2, Box(20.1, 45.55, 20.45, 45.70)),
    Zone(3, Box(20.0, 45.2, 20.5, 45.55)),
]
MAP_BOX = Box(20.1, 45.55, 20.45, 45.70)

# Fixed value: distance to a centre, in kilometres, below which a row is on a site.
FIELD_RADIUS_KM = 1.5


def inside(box: Box, lon: Column, lat: Column, inclusive: bool = True) -> Column:
    if inclusive:
        return (lon >= box.left) & (lon <= box.right) & (lat >= box.bottom) & (lat <= box.top)
    return (lon > box.left) & (lon < box.right) & (lat > box.bottom) & (lat < box.top)


def in_bbox(df: DataFrame, box: Box, inclusive: bool = True, lon=LON, lat=LAT) -> DataFrame:
    return df.filter(inside(box, F.col(lon), F.col(lat), inclusive))


def bbox(df: DataFrame, pad: float = 0.0, lon=LON, lat=LAT) -> DataFrame:
    """Extent of the points, widened by `pad` degrees on every side."""
    return df.agg(
        (F.min(lon) - pad).alias("left"),
        (F.min(lat) - pad).alias("bottom"),
        (F.max(lon) + pad).alias("right"),
        (F.max(lat) + pad).alias("top"),
    )


def extent_nm(df: DataFrame, lon=LON, lat=LAT) -> DataFrame:
    """Height and width of the covered area in nautical miles."""
    return df.agg(
        ((F.max(lat) - F.min(lat)) / NAUTICAL_MILE_DEG).alias("y_extent"),
        ((F.max(lon) - F.min(lon)) / NAUTICAL_MILE_DEG).alias("x_extent"),
    )


def assign_zones(
    df: DataFrame, zones: Sequence[Zone] = DEFAULT_ZONES, lon=LON, lat=LAT
) -> DataFrame:
    """One output row per row and zone that contains it; borders belong to a zone.

    Up to `MAX_INLINE` zones are part of the plan, so points are neither joined nor
    shuffled; longer lists go through `assign_zone_table`.
    """
    if len(zones) > MAX_INLINE:
        rows = [(z.zone_id, *map(float, z.box)) for z in zones]
        schema = "zone_id int, left double, bottom double, right double, top double"
        return assign_zone_table(df, local_table(df.sparkSession, rows, schema), lon, lat)
    hits = F.array_compact(
        F.array(*[F.when(inside(z.box, F.col(lon), F.col(lat)), z.zone_id) for z in zones])
    )
    return df.withColumn("zone_id", F.explode(hits))


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / (F.lit(SMALLEST_CELL_DEG) * F.pow(F.lit(2.0), level)))


def meet_boxes(points: DataFrame, boxes: DataFrame, lon: str = LON, lat: str = LAT) -> DataFrame:
    """Points beside the boxes (left, bottom, right, top) that may hold them.

    A box is put into cells about its own size, so it takes at most four, however large;
    a point looks up one cell for each size that any box has (at most `LEVELS`). They
    meet by an equality join. Boxes with a NULL side hold nothing.
    """
    side = F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom"), F.lit(SMALLEST_CELL_DEG))
    level = F.least(F.greatest(F.ceil(F.log2(side / SMALLEST_CELL_DEG)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    sides = [F.col(c) for c in ("left", "bottom", "right", "top")]
    known = boxes.filter(F.greatest(*[s.isNull().cast("int") + F.isnan(s).cast("int") for s in sides]) == 0)
    span = lambda low, high: F.explode(F.sequence(_cell(F.col(low), F.col("_level")), _cell(F.col(high), F.col("_level"))))
    covered = (
        known.filter("left <= right and bottom <= top")
        .withColumn("_level", level)
        .withColumn("_cx", span("left", "right"))
        .withColumn("_cy", span("bottom", "top"))
    )
    used = sorted(r._level for r in known.select(level.alias("_level")).distinct().collect())  # at most LEVELS
    if not used:
        used = [0]
    places = points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in used])))
    places = places.withColumns({"_cx": _cell(F.col(lon), F.col("_level")), "_cy": _cell(F.col(lat), F.col("_level"))})
    return places.join(covered, ["_level", "_cx", "_cy"]).drop("_level", "_cx", "_cy")


def assign_zone_table(df: DataFrame, zones: DataFrame, lon=LON, lat=LAT) -> DataFrame:
    """`assign_zones` for a table (zone_id, left, bottom, right, top) of any length.

    Other columns of the zone table are not read.
    """
    sides = ["left", "bottom", "right", "top"]
    boxes = zones.select("zone_id", *[F.col(c).alias(f"_box_{c}") for c in sides])
    boxes = boxes.withColumnsRenamed({f"_box_{c}": c for c in sides})
    clash = {c: f"_own_{c}" for c in sides if c in df.columns}
    met = meet_boxes(df.withColumnsRenamed(clash), boxes, clash.get(lon, lon), clash.get(lat, lat))
    x, y = F.col(clash.get(lon, lon)), F.col(clash.get(lat, lat))
    within = (x >= F.col("left")) & (x <= F.col("right")) & (y >= F.col("bottom")) & (y <= F.col("top"))
    return met.filter(within).drop(*sides).withColumnsRenamed({new: c for c, new in clash.items()})


def _lon_step(band: Column, reach_deg: float) -> Column:
    """Cell width in a latitude band: `reach_deg` spans less anywhere in it or next to it."""
    edge = F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(reach_deg)
    # Near the poles one cell covers all longitudes.
    return F.when(
        edge < 89, F.least(F.lit(reach_deg) / F.cos(F.radians(edge)) * 1.01, F.lit(360.0))
    ).otherwise(F.lit(360.0))


def _unit_vector(lon: Column, lat: Column) -> list[Column]:
    x, y = F.radians(lon), F.radians(lat)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _centre_cells(centers: DataFrame, km: float, x: str, y: str) -> DataFrame:
    """(_band, _cell, _near): the centres that can be within `km` of a cell's points.

    One row per cell; centres are held as places on the unit sphere.
    """
    reach = km * DEGREES_PER_KM * 1.01
    band = F.floor(F.col(y) / F.lit(reach))
    place = [v.alias(n) for v, n in zip(_unit_vector(F.col(x), F.col(y)), ("x", "y", "z"))]
    spread = (
        centers.select(F.col(x).alias("lon"), band.alias("_home"), F.struct(*place).alias("_place"))
        .distinct()
        .withColumn("_band", F.explode(F.sequence(F.col("_home") - 1, F.col("_home") + 1)))
        .withColumn("_step", _lon_step(F.col("_band"), reach))
    )
    cell = lambda v: F.floor(v / F.col("_step"))
    # A centre close to the date line is also reached from the other side of it.
    turns = F.array(*[F.col("lon") + turn for turn in (-360.0, 0.0, 360.0)])
    reached = F.flatten(F.transform(turns, lambda v: F.sequence(cell(v) - 1, cell(v) + 1)))
    return (
        spread.withColumn("_cell", F.explode(F.array_distinct(reached)))
        .groupBy("_band", "_cell")
        .agg(F.collect_list("_place").alias("_near"))
    )


def _meet_centres(
    points: DataFrame, cells: DataFrame, km: float, small: bool, lon: str, lat: str
) -> DataFrame:
    """Points (with `_px`, `_py`, `_pz`) and the `_near` centres of their cell, or NULL."""
    reach = km * DEGREES_PER_KM * 1.01
    placed = points.withColumn("_band", F.floor(F.col(lat) / F.lit(reach))).withColumn(
        "_cell", F.floor(F.col(lon) / _lon_step(F.col("_band"), reach))
    )
    cells = F.broadcast(cells) if small else cells
    return placed.join(cells, ["_band", "_cell"], "left").drop("_band", "_cell")


def _is_small(centers: DataFrame) -> bool:
    return centers.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS


def _with_place(points: DataFrame, lon: str, lat: str) -> DataFrame:
    place = _unit_vector(F.col(lon), F.col(lat))
    return points.withColumns(dict(zip(("_px", "_py", "_pz"), place)))


def _line(c: Column) -> Column:
    """Squared straight line from the point to a centre; grows with the distance."""
    dx, dy, dz = F.col("_px") - c["x"], F.col("_py") - c["y"], F.col("_pz") - c["z"]
    return dx * dx + dy * dy + dz * dz


def _squared_line(km: float) -> float:
    return (2 * sin(min(km * 1000 / (2 * EARTH_RADIUS_M), pi / 2))) ** 2


def flag_in_field(
    points: DataFrame,
    centers: DataFrame,
    km: float = FIELD_RADIUS_KM,
    out: str = "in_field",
    lon: str = LON,
    lat: str = LAT,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Add 1 where some centre is less than `km` away (great circle), else 0.

    Centres are spread over cells one radius wide, so a point meets by equality join
    only the few centres of its own cell.  The centres are counted first: up to
    `MAX_BROADCAST_ROWS` they are broadcast and points stay where they are; beyond, the
    join shuffles and adaptive execution splits crowded cells.
    """
    cells = _centre_cells(centers, km, x, y)
    met = _meet_centres(_with_place(points, lon, lat), cells, km, _is_small(centers), lon, lat)
    near = F.exists("_near", lambda c: _line(c) < F.lit(_squared_line(km)))
    return met.withColumn(out, F.coalesce(near, F.lit(False)).cast("int")).drop(
        "_near", "_px", "_py", "_pz"
    )


def nearest_center(
    points: DataFrame,
    centers: DataFrame,
    out: str = "nearest_km",
    first_reach_km: float = 5.0,
    lon: str = LON,
    lat: str = LAT,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Add the great-circle distance in kilometres to the closest centre.

    Points look among the centres of their cell, first with a short reach, then a longer
    one, until the reach is half the globe.  A find within the reach is the closest of
    all. Every point joins at every reach; found ones keep what they have.
    """
    small = _is_small(centers)
    found = _with_place(points, lon, lat).withColumn("_best", F.lit(None).cast("double"))
    reach_km, half_globe = first_reach_km, pi * EARTH_RADIUS_M / 1000
    while True:
        last = reach_km >= half_globe
        cells = _centre_cells(centers, min(reach_km, half_globe), x, y)
        met = _meet_centres(found, cells, min(reach_km, half_globe), small, lon, lat)
        shortest = F.array_min(F.transform("_near", _line))
        hit = shortest if last else F.when(shortest <= F.lit(_squared_line(reach_km)), shortest)
        found = met.withColumn(
            "_best", F.when(F.col("_best").isNull(), hit).otherwise(F.col("_best"))
        ).drop("_near")
        if last:
            break
        reach_km *= 16
    half = F.least(F.sqrt("_best") / 2, F.lit(1.0))
    return found.withColumn(
        out, F.asin(half) * (2 * EARTH_RADIUS_M / METRES_PER["km"])
    ).drop("_best", "_px", "_py", "_pz")
