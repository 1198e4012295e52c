"""Entities: named places, their fields, and de-duplication by name and distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.style import number_text
from ..functions.tagfilter import first_value, last_non_empty
from ..sources.tables import written
from . import areas as A
from . import features as B
from . import geometry as G

EARTH_RADIUS = 6371008.8


def named(keep: Column | None = None) -> Column:
    """Whether tagged elements have a name and pass a filter."""
    out = T.non_empty(first_value(F.col("tags"), "name")).isNotNull()
    return out if keep is None else out & keep


def with_fields(located: DataFrame) -> DataFrame:
    """Entities of named elements (osm_type, id, lon7, lat7, tags); those without a place have null lon7 and lat7."""
    name = T.non_empty(first_value(F.col("tags"), "name"))
    return located.withColumn("name", name).where("name is not null").select(
        "osm_type", F.col("id").alias("osm_id"), "name", "lon7", "lat7", T.address(F.col("tags")).alias("address"), T.first_of(F.col("tags"), T.PHONE_KEYS).alias("phone"),
        T.first_of(F.col("tags"), T.WEBSITE_KEYS).alias("website"), T.first_of(F.col("tags"), ("operator",)).alias("operator"), T.tag_line(F.col("tags")).alias("tag_line"), F.exists("tags", lambda t: t["k"].isin(*T.CATEGORY_KEYS)).alias("has_category"), T.address_parts(F.col("tags")).alias("address_parts"),
    )


def entities(nodes: DataFrame) -> DataFrame:
    """Named nodes (id, lon7, lat7, tags) as entities."""
    return with_fields(nodes.withColumn("osm_type", F.lit(1)))


def relation_means(relations: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """relation_id, lon7, lat7: the mean of all points of the members of relations (id, members) that are there, each member as often as it is named."""
    m = relations.select(F.col("id").alias("relation_id"), F.explode("members").alias("m")).select("relation_id", "m.osm_type", "m.ref")
    one = F.lit(1).cast("long")
    of_nodes = m.where("osm_type = 1").join(nodes.withColumnRenamed("id", "ref"), "ref").select("relation_id", F.col("lon7").cast("long").alias("x"), F.col("lat7").cast("long").alias("y"), one.alias("n"))
    total = lambda c: F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + p[c])
    per_way = lines.select(F.col("way_id").alias("ref"), total("lon7").alias("x"), total("lat7").alias("y"), F.size("points").cast("long").alias("n"))
    of_ways = m.where("osm_type = 2").join(per_way, "ref").select("relation_id", "x", "y", "n")
    sums = of_nodes.unionByName(of_ways).groupBy("relation_id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n")).where("n > 0")
    return sums.select("relation_id", F.round(F.col("x") / F.col("n")).cast("long").alias("lon7"), F.round(F.col("y") / F.col("n")).cast("long").alias("lat7"))


def located_elements(elements: DataFrame, keep: Column | None = None, stored_places: bool = False) -> DataFrame:
    """osm_type, id, lon7, lat7, tags of the named elements that pass `keep`, with a place that stands for each.

    A node is its own place. A closed whole way is a point inside of it, another way the middle of what is there of
    it. A relation that makes an area of its whole member ways is a point inside of that, another one the mean of its
    members' points. Without any the place is null.
    """
    wanted = elements.where((F.size("tags") > 0) & named(keep))
    nodes = B.nodes_of(elements)
    place = lambda c: F.when(B.valid_place(), F.col(c).cast("long")).alias(c)
    of_nodes = wanted.where("osm_type = 1").select("osm_type", "id", place("lon7"), place("lat7"), "tags")

    ways, relations = wanted.where("osm_type = 2"), wanted.where("osm_type = 3")
    refs = relations.select(F.explode("members").alias("m")).where("m.osm_type = 2").select(F.col("m.ref").alias("id"))
    needed = elements.where("osm_type = 2").join(ways.select("id").union(refs).distinct(), "id", "left_semi")
    lines = written(B.way_lines_stored(needed) if stored_places else B.way_lines(needed.select("id", "refs"), nodes))
    ends = F.get("refs", F.lit(0)) == F.element_at("refs", -1)
    joined = ways.select("osm_type", "id", "tags", "refs").join(lines.withColumnRenamed("way_id", "id").drop("closed"), "id")
    ring = F.coalesce((F.col("missing") == 0) & ends & (F.size("points") >= 4), F.lit(False))
    joined = joined.withColumn("inside", G.interior_points(F.when(ring, F.array(F.array("points"))))).withColumn("p", F.when(F.col("inside.lon7").isNotNull(), F.col("inside")).otherwise(G.half_way(F.col("points"))))
    of_ways = joined.select("osm_type", "id", "p.lon7", "p.lat7", "tags")

    whole = lines.where("missing = 0")
    areas = relations.where(last_non_empty(F.col("tags"), "type").isin(*B.AREA_TYPES))
    made = A.assemble(B.member_segments(B.way_members(areas), whole)).where("status = 'ok'")
    shape = F.transform("polygons", lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("lon7"), p["y"].alias("lat7")))))
    inside = made.select(F.col("relation_id").alias("id"), G.interior_points(shape).alias("a"))
    means = relation_means(relations, nodes, whole).select(F.col("relation_id").alias("id"), F.struct("lon7", "lat7").alias("m"))
    of_relations = relations.select("osm_type", "id", "tags").join(inside, "id", "left").join(means, "id", "left").withColumn("p", F.when(F.col("a.lon7").isNotNull(), F.col("a")).otherwise(F.col("m")))
    return of_nodes.unionByName(of_ways).unionByName(of_relations.select("osm_type", "id", "p.lon7", "p.lat7", "tags"))


def inside_box(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows with a place in a box of degrees, its sides included; those without a place go."""
    return rows.where((F.col("lon7") / 1e7).between(west, east) & (F.col("lat7") / 1e7).between(south, north))


def _type_name(osm_type: Column) -> Column:
    return F.when(osm_type == 1, "node").when(osm_type == 2, "way").otherwise("relation")


def csv_rows(e: DataFrame, safe: bool = True) -> DataFrame:
    """name, type, id, lat, lon, address, phone, website, operator, tags of entities, as text; with `safe` a leading formula character gets a quote in front."""
    guard = T.csv_safe if safe else lambda c: c
    text = lambda c: guard(F.coalesce(F.col(c), F.lit("")))
    degrees = lambda c: F.coalesce(T.degrees7(F.col(c)), F.lit(""))
    return e.select(
        text("name").alias("name"), _type_name(F.col("osm_type")).alias("type"), F.col("osm_id").cast("string").alias("id"), F.when(F.col("lat7").isNotNull(), degrees("lat7")).otherwise("").alias("lat"),
        F.when(F.col("lon7").isNotNull(), degrees("lon7")).otherwise("").alias("lon"), *[text(c).alias(c) for c in ("address", "phone", "website", "operator")], text("tag_line").alias("tags"),
    )


def _members(pairs: list[tuple[str, Column]]) -> Column:
    """JSON text of an object from (name, JSON text) pairs; a null text leaves its pair out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(v.isNotNull(), F.concat(F.to_json(F.array(F.lit(n))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(n)))) - 2), F.lit(":"), v)) for n, v in pairs]), F.lit("}"))


def _quoted(c: Column) -> Column:
    j = F.to_json(F.array(c))
    return F.when(c.isNotNull(), j.substr(F.lit(2), F.length(j) - 2))


def _flat(parts: Column) -> Column:
    """The inside of a map's JSON object, keys in order; null if it is empty."""
    j = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parts))))
    return F.when(F.size(parts) > 0, j.substr(F.lit(2), F.length(j) - 2))


def _joined(body: Column, flat: Column) -> Column:
    """A JSON object with the inside of another put at its end."""
    return F.when(flat.isNull(), body).otherwise(F.concat(body.substr(F.lit(1), F.length(body) - 1), F.lit(","), flat, F.lit("}")))


def _degrees_json(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), number_text(F.col(c) / 1e7))


def json_rows(e: DataFrame) -> DataFrame:
    """osm_type, osm_id and line: each entity as a JSON object, its address parts as fields of their own."""
    text = lambda c: _quoted(F.coalesce(F.col(c), F.lit("")))
    place = lambda c: F.coalesce(_degrees_json(c), F.lit("null"))
    pairs = [("name", text("name")), ("osm_type", _quoted(_type_name(F.col("osm_type")))), ("osm_id", F.col("osm_id").cast("string")), ("lat", place("lat7")), ("lon", place("lon7"))]
    pairs += [(c, text(c)) for c in ("address", "phone", "website", "operator")] + [("tags", text("tag_line"))]
    return e.select("osm_type", "osm_id", _joined(_members(pairs), _flat(F.col("address_parts"))).alias("line"))


def geojson_rows(e: DataFrame) -> DataFrame:
    """osm_type, osm_id and line: each entity as a GeoJSON feature; no place is a null geometry, and empty properties are left out."""
    point = F.when(F.col("lon7").isNotNull(), F.concat(F.lit('{"type":"Point","coordinates":['), _degrees_json("lon7"), F.lit(","), _degrees_json("lat7"), F.lit("]}")))
    pairs = [("name", _quoted(F.col("name"))), ("osm_type", _quoted(_type_name(F.col("osm_type")))), ("osm_id", F.col("osm_id").cast("string"))]
    pairs += [(n, _quoted(T.non_empty(F.col(c)))) for n, c in (("address", "address"), ("phone", "phone"), ("website", "website"), ("operator", "operator"), ("tags", "tag_line"))]
    properties = _joined(_members(pairs), _flat(F.col("address_parts")))
    feature = _members([("type", F.lit('"Feature"')), ("id", _quoted(T.osm_name(F.col("osm_type"), F.col("osm_id")))), ("geometry", F.coalesce(point, F.lit("null"))), ("properties", properties)])
    return e.select("osm_type", "osm_id", feature.alias("line"))


def write_lines(rows: DataFrame, path: str, head: str, tail: str, files: int | None = None) -> None:
    """Write rows (osm_type, osm_id, line) in order as text files that each are a whole JSON document: head, the lines with commas between, tail.

    `path` must not be there yet. Files hold successive ranges of (type, id); one file is one task's stream.
    """

    def run(batches):
        import pyarrow as pa

        before = None
        for batch in batches:
            out = []
            for line in batch.column("line").to_pylist():
                if before is not None:
                    out.append(before + ",")
                elif not out:
                    out.append(head)
                before = line
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([before, tail], pa.string())], names=["value"])

    keys = ["osm_type", "osm_id"]
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).select("line").mapInArrow(run, "value string").write.mode("errorifexists").text(path)


def write_csv(e: DataFrame, path: str, safe: bool = True) -> None:
    """Write entities as CSV files with a header, in ranges of (type, id); `path` must not be there yet."""
    dealt = e.repartitionByRange("osm_type", "osm_id").sortWithinPartitions("osm_type", "osm_id")
    csv_rows(dealt, safe).write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(e: DataFrame, path: str, files: int | None = None) -> None:
    """Write entities as JSON arrays, one entity a line."""
    write_lines(json_rows(e), path, "[", "]", files)


def write_geojson(e: DataFrame, path: str, files: int | None = None) -> None:
    """Write entities as GeoJSON FeatureCollections, one feature a line."""
    write_lines(geojson_rows(e), path, '{"type":"FeatureCollection","features":[', "]}", files)


def richness(e: DataFrame) -> Column:
    """Compared in this order: contact fields, completeness (name, category, operator, address parts), other tags."""
    there = lambda c: (F.coalesce(F.length(c), F.lit(0)) > 0).cast("int")
    contact = there("address") + there("phone") + there("website")
    complete = there("name") + F.col("has_category").cast("int") + there("operator") + F.size("address_parts")
    rest = F.when(F.col("tag_line") == "", 0).otherwise(F.size(F.split("tag_line", "; ")))
    return F.struct(contact.alias("contact_fields"), complete.alias("completeness"), rest.alias("tag_count"))


def greedy_keep(rows: pd.DataFrame, radius: float) -> list[bool]:
    """Richest first (then type, id): a row is dropped if a kept one is strictly nearer; without a place only the first is kept.

    Places are points on the unit sphere in the order of the axis along which they spread most. One that is kept strikes
    out all rows around it at once, which lie in one stretch of that order.
    """
    ranked = rows.reset_index(drop=True).sort_values(["r0", "r1", "r2", "osm_type", "osm_id"], ascending=[False, False, False, True, True]).index.to_numpy()
    lon, lat = (np.radians(rows[c].to_numpy(float, na_value=np.nan) / 1e7) for c in ("lon7", "lat7"))
    keep, placed = np.zeros(len(rows), bool), ~np.isnan(lon)
    keep[ranked[~placed[ranked]][:1]] = True
    chord = 2 * math.sin(min(math.pi, radius / EARTH_RADIUS) / 2)
    v = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    along = np.flatnonzero(placed)
    if not len(along):
        return keep.tolist()
    axis = int(np.argmax(np.ptp(v[along], axis=0)))
    along = along[np.argsort(v[along, axis])]
    first, last = (np.searchsorted(v[along, axis], v[:, axis] + d * (1 + 1e-9), side) for d, side in ((-chord, "left"), (chord, "right")))
    struck = ~placed
    for i in ranked:
        if not struck[i]:
            keep[i] = True
            around = along[first[i] : last[i]]
            struck[around[((v[around] - v[i]) ** 2).sum(axis=1) < chord * chord]] = True
            struck[i] = True
    return keep.tolist()


def _split(found: DataFrame, radius: float) -> DataFrame:
    """`found` with `part`: places in latitude bands that a gap of more than the radius parts can't meet."""
    from pyspark.sql import Window

    gap = math.degrees(min(math.pi, radius / EARTH_RADIUS)) * 1e7 * 1.01 + 1
    band = F.floor(F.col("lat7") / gap)
    bands = found.select("folded", band.alias("band")).distinct()
    w = Window.partitionBy("folded").orderBy("band")
    new = F.coalesce((F.col("band") - F.lag("band").over(w) > 1).cast("int"), F.lit(1))
    parts = bands.withColumn("new", new).withColumn("part", F.sum("new").over(w)).drop("new")
    return found.withColumn("band", band).join(parts.withColumnRenamed("folded", "_f").withColumnRenamed("band", "_b"), F.col("folded").eqNullSafe(F.col("_f")) & F.col("band").eqNullSafe(F.col("_b"))).drop("_f", "_b", "band")


def _by_rounds(rows: DataFrame, radius: float) -> DataFrame:
    """osm_type, osm_id, name, kept of placed rows, as greedy_keep has it, by rounds of joins over a grid.

    Two rows of one cell are nearer than the radius, so a cell keeps one at most. In each round a cell whose best row
    comes before those of all cells around keeps it, and rows that a kept one is near to go. No step pairs rows with
    others than the kept ones around them. Rounds grow with the longest chain of cells that wait for each other.
    """
    chord = 2 * math.sin(min(math.pi, radius / EARTH_RADIUS) / 2)
    side = chord / math.sqrt(3) * (1 - 1e-9)
    lon, lat = F.radians(F.col("lon7") / 1e7), F.radians(F.col("lat7") / 1e7)
    vector = {"vx": F.cos(lat) * F.cos(lon), "vy": F.cos(lat) * F.sin(lon), "vz": F.sin(lat)}
    rank = F.struct((-F.col("r0")).alias("a"), (-F.col("r1")).alias("b"), (-F.col("r2")).alias("c"), F.col("osm_type").alias("d"), F.col("osm_id").alias("e"), F.col("_u").alias("f"))
    cell = ["folded", "cx", "cy", "cz"]

    def around(df: DataFrame) -> DataFrame:
        near = F.sequence(F.lit(-2), F.lit(2))
        for c in cell[1:]:
            df = df.withColumn(c, F.explode(F.transform(near, lambda d: F.col(c) + d)))  # noqa: B023
        return df

    left = written(rows.withColumn("_u", F.monotonically_increasing_id()))
    left = written(left.withColumns(vector).withColumns({c: F.floor(F.col(v) / side) for c, v in zip(cell[1:], vector)}).withColumn("rank", rank))
    done = []
    while True:
        best = written(left.groupBy(*cell).agg(F.min("rank").alias("rank")))
        if best.isEmpty():
            break
        first = around(best.withColumn("own", F.struct(*cell[1:]))).groupBy(*cell).agg(F.min("rank").alias("first"))
        chosen = best.join(first, cell).where(F.col("rank") == F.col("first")).select(*cell, F.col("rank").alias("_best"))
        kept = written(left.join(chosen, cell).where(F.col("rank") == F.col("_best")).drop("_best"))
        ring = around(kept.select(*cell, F.col("_u").alias("_k"), *[F.col(v).alias(f"_{v}") for v in vector]))
        far = sum((F.pow(F.col(v) - F.col(f"_{v}"), F.lit(2)) for v in vector), F.lit(0.0))
        gone = left.join(ring, cell).where((far < chord * chord) & (F.col("_k") != F.col("_u"))).select("_u").distinct()
        done.append(kept.select("osm_type", "osm_id", "name", "_u"))
        left = written(left.join(gone, "_u", "left_anti").join(kept.select("_u"), "_u", "left_anti"))
    out = rows.sparkSession.createDataFrame([], "osm_type int, osm_id long, name string")
    for part in done:
        out = out.unionByName(part.drop("_u"))
    every = rows.groupBy("osm_type", "osm_id", "name").agg(F.count("*").alias("n"))
    named = every.join(out.groupBy("osm_type", "osm_id", "name").agg(F.count("*").alias("k")), ["osm_type", "osm_id", "name"], "left")
    return named.select("osm_type", "osm_id", "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "k").select("osm_type", "osm_id", "name", (F.col("i") <= F.coalesce("k", F.lit(0))).alias("kept"))


#: Rows of one name in a part that one task keeps greedily; larger ones are resolved by rounds.
PART_ROWS = 50_000


def deduplicated(found: DataFrame, radius: float = 100.0, part_rows: int = PART_ROWS) -> DataFrame:
    """osm_type, osm_id, name, kept.

    A name's places are split by latitude where no two can meet. A part of at most `part_rows` rows is one group, and
    larger ones are resolved by rounds over a grid. Of a name's rows without a place the richest stays, by a minimum.
    """
    r = richness(found)
    rows = found.withColumn("r", r).select("osm_type", "osm_id", "name", "lon7", "lat7", T.normalize_name("name").alias("folded"), F.col("r.contact_fields").alias("r0"), F.col("r.completeness").alias("r1"), F.col("r.tag_count").alias("r2"))
    if not math.isfinite(radius) or radius <= 0:
        return rows.select("osm_type", "osm_id", "name", F.lit(True).alias("kept"))
    rows = written(rows)  # names are folded in Python once

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group[["osm_type", "osm_id", "name"]].assign(kept=greedy_keep(group, radius))

    out = "osm_type int, osm_id long, name string, kept boolean"
    order = F.struct((-F.col("r0")).alias("a"), (-F.col("r1")).alias("b"), (-F.col("r2")).alias("c"), F.col("osm_type").alias("d"), F.col("osm_id").alias("e"))
    lost = rows.where("lon7 is null").withColumn("o", order)
    first = lost.groupBy("folded").agg(F.min("o").alias("o"), F.lit(True).alias("first"))
    lost = lost.join(first, ["folded", "o"], "left").select("osm_type", "osm_id", "name", F.coalesce("first", F.lit(False)).alias("kept"))
    placed = _split(rows.where("lon7 is not null"), radius)
    sizes = placed.groupBy("folded", "part").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > part_rows).select("folded", "part")
    small = placed.join(large, ["folded", "part"], "left_anti").groupBy("folded", "part").applyInPandas(run, out)
    done = lost.unionByName(small)
    return done if large.isEmpty() else done.unionByName(_by_rounds(placed.join(large, ["folded", "part"], "left_semi"), radius))
