"""Tiles: features over the grid, order inside a tile, statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..sources.tables import written

# Layers in the order of their numbers, the first part of a feature's sort key.
SORT_LAYERS = (
    "highway", "building", "water", "natural", "landuse", "railway", "amenity", "leisure", "boundary", "place", "shop", "tourism", "office", "healthcare", "craft", "historic", "club", "emergency", "education",
)


def secondary_key(layer: Column, importance: Column, size: Column) -> Column:
    """Layers ascending, then importance and size descending, in one long."""
    ordinal = F.array_position(F.array(*[F.lit(x) for x in SORT_LAYERS]), layer) - 1
    return F.shiftleft(ordinal.cast("long"), 56).bitwiseOR(F.shiftleft((F.lit(255) - importance).cast("long"), 48)).bitwiseOR(F.shiftleft((F.lit(65535) - size).cast("long"), 32))


def point_pieces(points: DataFrame, low: int, high: int) -> DataFrame:
    """Points (min_zoom, lon7, lat7, others) with z, x, y for each zoom from max(low, min_zoom) to high."""
    z = F.explode(F.sequence(F.greatest(F.lit(low), F.col("min_zoom")), F.lit(high)))
    out = points.where(F.greatest(F.lit(low), F.col("min_zoom")) <= high).withColumn("z", z)
    return out.withColumn("x", M.cell(M.unit_x(F.col("lon7") / 1e7), F.col("z"))).withColumn("y", M.cell(M.unit_y(F.col("lat7") / 1e7), F.col("z")))


def expand_box(boxes: DataFrame, z: int, buffer: float = 0.0) -> DataFrame:
    """Boxes (min_lon, min_lat, max_lon, max_lat, others) with x, y for each tile of zoom z that they touch."""
    n = float(1 << z)
    at = lambda u, d: M.cell(u + F.lit(d / n), z)
    xs = F.sequence(at(M.unit_x(F.col("min_lon")), -buffer), at(M.unit_x(F.col("max_lon")), buffer))
    ys = F.sequence(at(M.unit_y(F.col("max_lat")), -buffer), at(M.unit_y(F.col("min_lat")), buffer))
    return boxes.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))


def layer_stats(pieces: DataFrame) -> DataFrame:
    """layer, min_zoom, max_zoom, pieces; with attrs (tags k, v) also fields, the attribute keys in order."""
    if "attrs" not in pieces.columns:
        return pieces.groupBy("layer").agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count("*").alias("pieces"))
    # a row for each key of a piece, the first of which counts the piece: keys are combined before a layer gathers them
    keys = pieces.select("layer", "z", F.posexplode_outer(F.array_distinct(F.transform("attrs", lambda t: t["k"]))).alias("i", "k"))
    by_key = keys.groupBy("layer", "k").agg(F.min("z").alias("a"), F.max("z").alias("b"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("n"))
    return by_key.groupBy("layer").agg(F.min("a").alias("min_zoom"), F.max("b").alias("max_zoom"), F.sum("n").alias("pieces"), F.array_sort(F.collect_list("k")).alias("fields"))


def tile_summary(pieces: DataFrame) -> DataFrame:
    """z, tiles, features; counts are combined by tile first."""
    return pieces.groupBy("z", "x", "y").agg(F.count("*").alias("n")).groupBy("z").agg(F.count("*").alias("tiles"), F.sum("n").alias("features"))


def archive_summary(tiles: DataFrame) -> DataFrame:
    """z, tiles, features, dropped, bytes of assembled tiles."""
    return tiles.groupBy("z").agg(F.count("*").alias("tiles"), F.sum("features").alias("features"), F.sum("dropped").alias("dropped"), F.sum(F.octet_length("data")).alias("bytes"))


def archive_metadata(stats: DataFrame, name: str, description: str = "", attribution: str = "", generator: str = "geoloom") -> DataFrame:
    """One row `metadata`: the archive's document in JSON, from layer_stats with fields. Only layers that have features are there, and every field is a String."""
    rows = F.array_sort(F.collect_list(F.struct("layer", "fields", "min_zoom", "max_zoom")))
    fields = lambda x: F.map_from_arrays(x["fields"], F.transform(x["fields"], lambda _: F.lit("String")))
    layers = F.transform(rows, lambda x: F.struct(x["layer"].alias("id"), fields(x).alias("fields"), x["min_zoom"].alias("minzoom"), x["max_zoom"].alias("maxzoom")))
    head = [F.lit(v).alias(n) for n, v in (("name", name), ("description", description), ("attribution", attribution), ("type", "baselayer"), ("format", "pbf"), ("generator", generator))]
    return stats.where("pieces > 0").agg(layers.alias("vector_layers")).select(F.to_json(F.struct(*head, "vector_layers")).alias("metadata"))


def best_in_tile(pieces: DataFrame, most: int) -> DataFrame:
    """The `most` pieces of each tile by importance, then id; with `place` from 1."""
    w = Window.partitionBy("z", "x", "y").orderBy(F.col("importance").desc(), "id", "layer")
    return pieces.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def ancestor_lookup(wanted: DataFrame, loaded: DataFrame, levels: int) -> DataFrame:
    """For each wanted tile (z, x, y) the deepest loaded tile above or at it: z, x, y, up (null if there is none)."""
    up = wanted.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(levels)))).where("up <= z")
    above = up.select("z", "x", "y", "up", (F.col("z") - F.col("up")).alias("az"), F.expr("shiftright(x, up)").alias("ax"), F.expr("shiftright(y, up)").alias("ay"))
    there = loaded.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(True).alias("there")).distinct()
    return above.join(there, ["az", "ax", "ay"], "left").groupBy("z", "x", "y").agg(F.min(F.when(F.col("there"), F.col("up"))).alias("up"))


def nearest(asked: DataFrame, places: DataFrame, most: float | None = None) -> DataFrame:
    """id, nearest: for each row of `asked` (id, lon7, lat7) the nearest other one of `places` by |dx| + |dy|, ties to the smaller id; null if none is within `most`.

    Grids of growing cells are gone through. A click looks at the nine cells around its own, and is done when the best
    one found is nearer than a cell's side, as nothing outside of them can be nearer then. So dense places are searched
    in small cells, and only the clicks that are left meet larger ones.
    """
    left = written(asked.select(F.col("id").alias("q"), F.col("lon7").alias("qx"), F.col("lat7").alias("qy")))
    n = places.count()
    side = max(1, int(math.sqrt(3.6e9 * 1.8e9 / max(1, n)) / 8))
    widest = int(3.6e9 + 1.8e9) if most is None else max(1, int(most))
    found = []
    while not left.isEmpty():
        at = lambda c: F.floor(F.col(c) / side)  # noqa: E731, B023
        own = left.withColumn("cx", F.explode(F.sequence(at("qx") - 1, at("qx") + 1))).withColumn("cy", F.explode(F.sequence(at("qy") - 1, at("qy") + 1)))
        cells = places.select("id", "lon7", "lat7", at("lon7").alias("cx"), at("lat7").alias("cy"))
        far = F.abs(F.col("lon7") - F.col("qx")) + F.abs(F.col("lat7") - F.col("qy"))
        best = own.join(cells, ["cx", "cy"]).where("id <> q").groupBy("q").agg(F.min(F.struct(far.alias("far"), "id")).alias("m"))
        last = side >= widest
        sure = F.col("m.far") <= (widest if last else side)
        best = written(left.join(best, "q", "left").withColumn("m", F.when(sure, F.col("m"))))
        found.append(best.where("true" if last else "m is not null").select(F.col("q").alias("id"), F.col("m.id").alias("nearest")))
        if last:
            break
        left = best.where("m is null").select("q", "qx", "qy")
        side = min(side * 4, widest)
    return reduce(DataFrame.unionByName, found) if found else asked.select("id", F.lit(None).cast("long").alias("nearest"))
