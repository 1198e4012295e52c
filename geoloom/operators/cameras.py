"""Camera views as rows: what each shows of the tile grid, and the view that shows a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mercator as M

#: Pixels of a tile's side at its own zoom; tiles of a view; zooms of tiles.
TILE, MOST, DEEPEST = 512.0, 4096, 30


def _zoom(zoom: Column) -> Column:
    """A camera's zoom; what isn't a number is 0."""
    return F.least(F.greatest(F.nanvl(F.coalesce(zoom.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(float(M.MAX_ZOOM)))


def visible_tiles(cameras: DataFrame, max_zoom: int = M.MAX_ZOOM, margin: float = 0.0) -> DataFrame:
    """view, z, x, y, world, place: the tiles that each of `cameras` (view, lon, lat, zoom, width, height) shows, grown by `margin` pixels.

    Tiles are of the camera's zoom rounded down, `max_zoom` at most. Columns go on around the globe: `world` counts the
    times. `place` is from 1 by the distance of a tile's middle from the view's, ties by row and column. A view that would
    need more than MOST tiles, or whose place or size is null or no finite number, has none. So a view's rows are bounded.
    """
    if not 0 <= max_zoom <= DEEPEST:
        raise ValueError(f"tiles have zooms from 0 to {DEEPEST}")
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e300" for c in ("lon", "lat", "width", "height"))
    c = cameras.select("view", *(F.col(n).cast("double").alias(n) for n in ("lon", "lat", "width", "height")), _zoom(F.col("zoom")).alias("zoom")).where(finite)
    x = M.unit_x(F.col("lon"))
    c = c.withColumn("cx", x - F.floor(x)).withColumn("cy", F.greatest(F.least(M.unit_y(F.col("lat")), F.lit(1.0)), F.lit(0.0))).withColumn("z", F.least(F.floor("zoom"), F.lit(max_zoom)).cast("int"))
    n, world = F.pow(F.lit(2.0), "z"), F.pow(F.lit(2.0), "zoom") * TILE
    half = lambda side: (F.greatest(F.col(side), F.lit(1.0)) / 2 + margin) / world
    first = lambda low: F.floor(low * n)
    last = lambda low, high: F.greatest(F.ceil(high * n) - 1, F.floor(low * n))
    inside = lambda v: F.greatest(F.least(v, n - 1), F.lit(0.0)).cast("long")
    west, east = F.col("cx") - half("width"), F.col("cx") + half("width")
    top, bottom = F.greatest(F.col("cy") - half("height"), F.lit(0.0)), F.least(F.col("cy") + half("height"), F.lit(1.0))
    c = c.withColumn("x0", first(west)).withColumn("x1", last(west, east)).withColumn("y0", inside(first(top))).withColumn("y1", inside(last(top, bottom)))
    c = c.where((F.col("x1").cast("double") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) <= MOST)
    tiles = c.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("column", F.explode(F.sequence("x0", "x1")))
    far = lambda v, middle: F.pow(F.col(v) + 0.5 - F.col(middle) * n, F.lit(2))
    by = Window.partitionBy("view").orderBy(F.round(far("column", "cx") + far("y", "cy"), 9), "y", "column")
    side = n.cast("long")
    return tiles.select("view", "z", F.pmod(F.col("column"), side).alias("x"), "y", F.floor(F.col("column") / side).cast("int").alias("world"), F.row_number().over(by).alias("place"))


def fitted(boxes: DataFrame, width: float, height: float, padding: float = 0.0) -> DataFrame:
    """view, lon, lat, zoom, width, height of the cameras that show boxes (view, min_lon, min_lat, max_lon, max_lat) with `padding` pixels around them, as near as may be."""
    room = lambda side: max(side - 2 * padding, 1.0)
    fit = lambda px, extent: F.when(extent > 0, F.log2(F.lit(px) / (TILE * extent))).otherwise(float(M.MAX_ZOOM))
    wide, tall = M.unit_x(F.col("max_lon")) - M.unit_x(F.col("min_lon")), M.unit_y(F.col("min_lat")) - M.unit_y(F.col("max_lat"))
    center = M.box_center(*M.box())
    return boxes.select("view", center["lon"].alias("lon"), center["lat"].alias("lat"), _zoom(F.least(fit(room(width), wide), fit(room(height), tall))).alias("zoom"), F.lit(float(width)).alias("width"), F.lit(float(height)).alias("height"))
