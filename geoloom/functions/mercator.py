"""Web Mercator, tile grid and Hilbert order as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LATITUDE = 85.05112877980659
EARTH_RADIUS = 6378137.0
MAX_ZOOM = 22


def unit_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def unit_y(lat: Column) -> Column:
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))))
    return F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def unit_x_to_lon(x: Column) -> Column:
    return x * 360.0 - 180.0


def unit_y_to_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh((F.lit(1.0) - y * 2.0) * math.pi)))


def meters(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (unit_x(lon) - 0.5) * (2 * math.pi * EARTH_RADIUS), (F.lit(0.5) - unit_y(lat)) * (2 * math.pi * EARTH_RADIUS)


def from_meters(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of Web Mercator meters."""
    around = 2 * math.pi * EARTH_RADIUS
    return unit_x_to_lon(x / around + 0.5), unit_y_to_lat(F.lit(0.5) - y / around)


def cell(unit: Column, z: Column | int) -> Column:
    """Column or row of a unit coordinate at zoom z, clamped to the grid; NaN is 0."""
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(float(z)))
    return F.greatest(F.least(F.floor(F.nanvl(unit, F.lit(0.0)) * n), n - 1), F.lit(0)).cast("long")


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north."""
    n = F.pow(F.lit(2.0), z)
    return unit_x_to_lon(x / n), unit_y_to_lat((y + 1) / n), unit_x_to_lon((x + 1) / n), unit_y_to_lat(y / n)


def hilbert_id(z: int, x: Column, y: Column) -> Column:
    """Tile id in archive order: tiles of lower zooms first, then along the Hilbert curve of the grid."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, level: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        d = acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        px, py = F.when(flip, s - 1 - acc["x"].bitwiseAND(s - 1)).otherwise(acc["x"].bitwiseAND(s - 1)), F.when(flip, s - 1 - acc["y"].bitwiseAND(s - 1)).otherwise(acc["y"].bitwiseAND(s - 1))
        return F.struct(F.when(ry == 0, py).otherwise(px).alias("x"), F.when(ry == 0, px).otherwise(py).alias("y"), d.alias("d"))

    base = (4**z - 1) // 3
    if z == 0:
        return F.lit(0).cast("long")
    return F.aggregate(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["d"] + base)


def parent(v: Column) -> Column:
    return F.floor(v / 2)


def children(z: Column, x: Column, y: Column) -> Column:
    """The four tiles below a tile, array<struct<z, x, y>>, row by row; null below the last zoom."""
    below = [F.struct((z + 1).alias("z"), (x * 2 + dx).alias("x"), (y * 2 + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)]
    return F.when(z < MAX_ZOOM, F.array(*below))


def on_grid(z: Column, x: Column, y: Column) -> Column:
    """Whether a tile is one."""
    n = F.pow(F.lit(2.0), z)
    return F.coalesce((z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (x < n) & (y >= 0) & (y < n), F.lit(False))


def range_size(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Tiles in an inclusive range; one that is turned over is empty."""
    side = lambda a, b: F.greatest(b.cast("long") - a.cast("long") + 1, F.lit(0))
    return side(x0, x1) * side(y0, y1)


def in_range(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def fixed(degrees: Column, limit: float | None = None) -> Column:
    """Degrees as 1e-7 integers, half away from zero; null for what isn't finite or is past +-limit."""
    good = degrees.isNotNull() & ~F.isnan(degrees) & (F.abs(degrees) <= (214.7483647 if limit is None else limit))
    return F.when(good, F.round(degrees * 1e7).cast("int"))


BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in BOX]


def box_valid(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether a box isn't turned over; an empty one is."""
    return F.coalesce((w <= e) & (s <= n), F.lit(False))


def box_center(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.struct(((w + e) / 2).alias("lon"), ((s + n) / 2).alias("lat"))


def boxes_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes have a point in common; sides count."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def box_around(a: list[Column], b: list[Column]) -> list[Column]:
    """The smallest box around two; a null one adds nothing."""
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]
