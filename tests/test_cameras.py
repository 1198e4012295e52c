"""Visible tiles against a walk over the grid."""

import math

import pytest

from geoloom.operators import cameras as C

SCHEMA = "view long, lon double, lat double, zoom double, width double, height double"


def shown(lon, lat, zoom, width, height, max_zoom=22, margin=0.0):
    zoom = min(max(0.0 if math.isnan(zoom) else zoom, 0.0), 22.0)
    s = math.sin(math.radians(max(min(lat, 85.05112877980659), -85.05112877980659)))
    cx, cy = ((lon + 180) / 360) % 1.0, min(max(0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi), 0), 1)
    z = min(math.floor(zoom), max_zoom)
    n, world = 1 << z, 512 * 2**zoom
    hw, hh = (max(width, 1) / 2 + margin) / world, (max(height, 1) / 2 + margin) / world
    out = []
    for y in range(n):
        for column in range(-3 * n - 3, 4 * n + 3):
            meets = column / n < cx + hw and (column + 1) / n > cx - hw and y / n < cy + hh and (y + 1) / n > cy - hh
            if meets:
                out.append((round((column + 0.5 - cx * n) ** 2 + (y + 0.5 - cy * n) ** 2, 9), y, column))
    return [(z, column % n, y, column // n) for _, y, column in sorted(out)]


def test_tiles_of_views(spark):
    views = [(1, 13.4, 52.5, 3.3, 800.0, 600.0), (2, 179.9, 10.0, 2.0, 1000.0, 700.0), (3, 0.1, 89.0, 1.5, 300.0, 900.0), (4, 40.0, 40.0, 0.0, 2000.0, 900.0), (5, -77.7, -33.3, 4.9, 0.0, 1.0), (6, 200.0, 0.1, float("nan"), 600.0, 300.0)]
    for max_zoom, margin in ((22, 0.0), (2, 100.0)):
        got = {}
        for r in C.visible_tiles(spark.createDataFrame(views, SCHEMA), max_zoom, margin).collect():
            got.setdefault(r.view, []).append((r.place, (r.z, r.x, r.y, r.world)))
        for view, *camera in views:
            want = shown(*camera, max_zoom, margin)
            assert [t for _, t in sorted(got[view])] == want and [p for p, _ in sorted(got[view])] == list(range(1, len(want) + 1))


def test_views_without_tiles(spark):
    bad = [(1, float("inf"), 0.0, 1.0, 10.0, 10.0), (2, 0.0, None, 1.0, 10.0, 10.0), (3, 0.0, 0.0, 1.0, float("nan"), 10.0), (4, 0.0, 0.0, 5.0, 1e9, 1e9)]
    assert C.visible_tiles(spark.createDataFrame(bad, SCHEMA)).count() == 0 and C.visible_tiles(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        C.visible_tiles(spark.createDataFrame([], SCHEMA), 31)


def test_views_of_boxes(spark):
    boxes = spark.createDataFrame([(1, 10.0, 40.0, 20.0, 50.0), (2, 5.0, 5.0, 5.0, 5.0), (3, -180.0, -85.0, 180.0, 85.0)], "view long, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {r.view: r for r in C.fitted(boxes, 800, 600, 20).collect()}
    assert got[2].zoom == 22 and got[3].zoom == pytest.approx(max(0, min(math.log2(760 / 512), math.log2(560 / 512))), abs=0.02)
    r, unit = got[1], lambda lat: 0.5 - math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / (4 * math.pi)
    world = 512 * 2**r.zoom
    assert (r.lon, r.lat) == (15.0, 45.0) and max(10 / 360 * world / 760, (unit(40) - unit(50)) * world / 560) == pytest.approx(1)
