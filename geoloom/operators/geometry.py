"""Geometry kernels (NumPy, for use inside tasks) and their DataFrame operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_area2(points: Column) -> Column:
    """Twice the signed area of a closed ring, array<struct<x, y>> of integers, exact."""
    n = F.size(points) - 1
    big = lambda c: c.cast("decimal(18,0)")
    crosses = F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda p, q: (big(p["x"]) * big(q["y"]) - big(q["x"]) * big(p["y"])).cast("decimal(38,0)"))
    return F.aggregate(crosses, F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + c).cast("decimal(38,0)"))


def rdp_mask(points: np.ndarray, eps: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps, by distance to the segment; the last of equally far points counts."""
    n = len(points)
    keep = np.ones(n, bool)
    if n < 3 or eps <= 0:
        return keep
    keep[1:-1] = False
    work = [(0, n - 1)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = float(d @ d)
        t = np.clip((mid - p) @ d / length, 0, 1)[:, None] if length else 0.0
        away = ((mid - p - t * d) ** 2).sum(axis=1)
        far = len(away) - 1 - int(np.argmax(away[::-1]))
        if away[far] > eps * eps:
            keep[a + 1 + far] = True
            work += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def clip_line(points: np.ndarray, low: tuple, high: tuple) -> list[np.ndarray]:
    """The parts of a line inside a rectangle (Liang-Barsky by segment)."""
    out: list[list] = []
    for p, q in zip(points[:-1], points[1:]):
        t0, t1 = 0.0, 1.0
        for axis in (0, 1):
            d = q[axis] - p[axis]
            for side, bound in ((-1, low[axis]), (1, high[axis])):
                room = side * (bound - p[axis])
                step = side * d
                if step == 0:
                    if room < 0:
                        t0, t1 = 1.0, 0.0
                elif step > 0:
                    t1 = min(t1, room / step)
                else:
                    t0 = max(t0, room / step)
        if t0 > t1:
            continue
        a, b = p + t0 * (q - p) if t0 > 0 else p, p + t1 * (q - p) if t1 < 1 else q
        if out and np.array_equal(out[-1][-1], a):
            if not np.array_equal(a, b):
                out[-1].append(b)
        else:
            out.append([a] if np.array_equal(a, b) else [a, b])
    return [np.array(part) for part in out if len(part) > 1]


def clip_ring(points: np.ndarray, low: tuple, high: tuple) -> np.ndarray:
    """A closed ring cut to a rectangle (Sutherland-Hodgman), closed again; empty if nothing is left."""
    ring = points[:-1] if len(points) > 1 and np.array_equal(points[0], points[-1]) else points
    for axis, side, bound in ((0, 1, low[0]), (0, -1, high[0]), (1, 1, low[1]), (1, -1, high[1])):
        out = []
        for i in range(len(ring)):
            p, q = ring[i - 1], ring[i]
            p_in, q_in = side * (p[axis] - bound) >= 0, side * (q[axis] - bound) >= 0
            if p_in != q_in:
                a, b = (p, q) if tuple(p) <= tuple(q) else (q, p)  # one direction, so that shared edges cut alike
                cut = a + (bound - a[axis]) / (b[axis] - a[axis]) * (b - a)
                cut[axis] = bound
                out.append(cut)
            if q_in:
                out.append(q)
        ring = np.array(out)
        if len(ring) < 3:
            return np.zeros((0, 2))
    return np.vstack([ring, ring[:1]])


def points_in(shape: Column) -> Column:
    """Points of a shape (polygons of rings); null counts as none."""
    return F.coalesce(F.aggregate(F.flatten(shape), F.lit(0), lambda n, r: n + F.size(r)), F.lit(0))


def shape_box(shape: Column) -> Column:
    """struct<min_lon7, min_lat7, max_lon7, max_lat7> of a shape; null where it has no points."""
    p = F.flatten(F.flatten(shape))
    ends = [f(F.transform(p, lambda q: q[c])).alias(f"{n}_{c}") for f, n in ((F.array_min, "min"), (F.array_max, "max")) for c in ("lon7", "lat7")]  # noqa: B023
    return F.when(points_in(shape) > 0, F.struct(*ends))


def shape_name(kind: Column, shape: Column) -> Column:
    """GeoJSON's name of a shape: of several parts (or points, or lines) it is a Multi one."""
    many = F.when(kind == 3, F.size(shape) > 1).when(kind == 2, F.size(F.flatten(shape)) > 1).otherwise(points_in(shape) > 1)
    return F.concat(F.when(many, "Multi").otherwise(""), F.when(kind == 1, "Point").when(kind == 2, "LineString").otherwise("Polygon"))


def interior_point(*rings: np.ndarray) -> tuple[float, float]:
    """A point inside a polygon (outer ring, holes): the middle of the widest span on scan lines at some heights."""
    ring = rings[0]
    y0, y1 = ring[:, 1].min(), ring[:, 1].max()
    best = (-1.0, tuple(ring.mean(axis=0)))
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    for share in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
        y = y0 + share * (y1 - y0)
        cross = (a[:, 1] > y) != (b[:, 1] > y)
        xs = np.sort(a[cross, 0] + (y - a[cross, 1]) / (b[cross, 1] - a[cross, 1]) * (b[cross, 0] - a[cross, 0]))
        for x0, x1 in zip(xs[::2], xs[1::2]):
            if x1 - x0 > best[0]:
                best = (x1 - x0, ((x0 + x1) / 2, y))
        if best[0] > 0:
            break
    return float(best[1][0]), float(best[1][1])


def interior_points(shapes: Column) -> Column:
    """struct<lon7, lat7> inside of shapes (polygons of closed rings of lon7, lat7): in the polygon of the largest outer ring. Null for an empty shape."""

    def run(batch: pa.Array) -> pa.Array:
        lon, lat = np.zeros(len(batch)), np.zeros(len(batch))
        found = np.zeros(len(batch), bool)
        # Offsets are read level by level and only where a list holds something: lists of a batch without any may have none.
        held = np.flatnonzero(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False) > 0)
        if len(held):
            shapes = batch.take(pa.array(held))
            parts, part_ends = shapes.flatten(), _ends(shapes)
            ring_ends = _ends(parts)
            rings = parts.flatten() if ring_ends[-1] else None
            point_ends = _ends(rings) if ring_ends[-1] else np.zeros(1, np.int64)
            points = rings.flatten() if point_ends[-1] else None
            xy = np.stack([points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)], axis=1) if point_ends[-1] else np.zeros((0, 2))
            ring = lambda i: xy[point_ends[i] : point_ends[i + 1]]
            area = lambda r: abs(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()))
            for at, p0, p1 in zip(held.tolist(), part_ends[:-1].tolist(), part_ends[1:].tolist()):
                polygons = [[ring(i) for i in range(ring_ends[p], ring_ends[p + 1])] for p in range(p0, p1)]
                polygons = [p for p in polygons if p and len(p[0]) >= 4]
                if polygons:
                    lon[at], lat[at] = interior_point(*max(polygons, key=lambda p: area(p[0] - p[0][0])))
                    found[at] = True
        whole = [pa.array(np.round(c).astype(np.int64), mask=~found) for c in (lon, lat)]
        return pa.StructArray.from_arrays(whole, names=["lon7", "lat7"])

    return F.arrow_udf(run, "struct<lon7:long,lat7:long>")(shapes)


def _ends(lists: pa.Array) -> np.ndarray:
    """Where each list of an array begins in its flattened values, and the end of the last one."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))])


def half_way(points: Column) -> Column:
    """struct<lon7, lat7> at half the length of a line, array<struct<lon7, lat7>>: a lone point is itself, no points are null."""
    n = F.size(points)
    x = lambda p: p["lon7"].cast("double")
    y = lambda p: p["lat7"].cast("double")
    steps = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda p, q: F.struct(x(p).alias("x"), y(p).alias("y"), (x(q) - x(p)).alias("dx"), (y(q) - y(p)).alias("dy"), F.sqrt(F.pow(x(q) - x(p), F.lit(2)) + F.pow(y(q) - y(p), F.lit(2))).alias("d")),
    )
    half = F.aggregate(steps, F.lit(0.0), lambda a, s: a + s["d"]) / 2
    first = F.get(points, F.lit(0))
    start = F.struct(half.alias("left"), x(first).alias("x"), y(first).alias("y"))

    def walk(a: Column, s: Column) -> Column:
        here = F.when(s["d"] > 0, F.least(a["left"] / s["d"], F.lit(1.0))).otherwise(0.0)
        moved = F.struct((a["left"] - s["d"]).alias("left"), (s["x"] + s["dx"] * here).alias("x"), (s["y"] + s["dy"] * here).alias("y"))
        return F.when(a["left"] > 0, moved).otherwise(a)

    at = F.aggregate(steps, start, walk)
    return F.when(n > 0, F.struct(F.round(at["x"]).cast("long").alias("lon7"), F.round(at["y"]).cast("long").alias("lat7")))


def simplified(lines: DataFrame, eps: float) -> DataFrame:
    """id, n_points, n_kept for lines (id, xs array<double>, ys array<double>)."""

    def run(frames):
        for f in frames:
            kept = [int(rdp_mask(np.stack([np.asarray(x, float), np.asarray(y, float)], axis=1), eps).sum()) for x, y in zip(f["xs"], f["ys"])]
            yield pd.DataFrame({"id": f["id"], "n_points": f["xs"].map(len), "n_kept": kept})

    return lines.select("id", "xs", "ys").mapInPandas(run, "id long, n_points long, n_kept long")
