"""Lines cut by length against walks along them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import lines as LN

SCHEMA = "id long, xs array<double>, ys array<double>"


def made(seed, n=12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.randint(1, 9)
        out.append((i, [float(r.randint(0, 50)) for _ in range(k)], [float(r.randint(0, 50)) for _ in range(k)]))
    return out + [(100, [0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 0.0, 0.0]), (101, [], []), (102, [0.0, 30.0], [0.0, 40.0])]


def walk(line):
    """(start, stop, point, point) of the segments."""
    at, out = 0.0, []
    points = list(zip(line[1], line[2]))
    for p, q in zip(points, points[1:]):
        if p != q:
            out.append((at, at + math.dist(p, q), p, q))
            at += math.dist(p, q)
    return out, at


def place(parts, d):
    for a, b, p, q in parts:
        if a <= d <= b:
            t = (d - a) / (b - a)
            return p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t


@pytest.mark.parametrize("on, off, phase", [(7, 3, 0), (5.5, 0, 2), (100, 20, 30), (2, 9, -4)])
def test_dashes(spark, on, off, phase):
    lines = made(1)
    got = {(r.id, r.dash): r for r in LN.dashes(spark.createDataFrame(lines, SCHEMA), on, off, phase).collect()}
    want = {}
    for line in lines:
        parts, total = walk(line)
        for k in range(-50, 400):
            a, b = max(0.0, k * (on + off) - phase), min(total, k * (on + off) + on - phase)
            if b - a > 1e-9:
                want[line[0], k] = (a, b, parts)
    assert set(got) >= set(want) and all(got[k].length < 1e-6 for k in set(got) - set(want)) and len(want) > 10
    for k, (a, b, parts) in want.items():
        r = got[k]
        assert r.start == pytest.approx(a) and r.length == pytest.approx(b - a)
        assert (r.xs[0], r.ys[0]) == pytest.approx(place(parts, a)) and (r.xs[-1], r.ys[-1]) == pytest.approx(place(parts, b))
        assert sum(math.dist(p, q) for p, q in zip(zip(r.xs, r.ys), zip(r.xs[1:], r.ys[1:]))) == pytest.approx(b - a)


@pytest.mark.parametrize("spacing, width, limit", [(10, 4, 180), (7, 12, 60), (25, 0, 10)])
def test_anchors(spark, spacing, width, limit):
    lines = made(2)
    got = {(r.id, r.anchor): r for r in LN.anchors(spark.createDataFrame(lines, SCHEMA), spacing, width, limit).collect()}
    want = {}
    for line in lines:
        parts, total = walk(line)
        if not parts or total < width:
            continue
        n = math.floor((total - width) / spacing)
        first = (total - n * spacing) / 2
        angles = [math.degrees(math.atan2(q[1] - p[1], q[0] - p[0])) for _, _, p, q in parts]
        bends = [parts[i][0] for i in range(1, len(parts)) if min(abs(angles[i] - angles[i - 1]), 360 - abs(angles[i] - angles[i - 1])) > limit]
        for j in range(n + 1):
            d = first + j * spacing
            if not any(abs(b - d) < width / 2 for b in bends) or limit >= 180:
                want[line[0], j] = place(parts, d)
    assert set(got) == set(want) and len(want) > 10
    assert all((got[k].x, got[k].y) == pytest.approx(p) for k, p in want.items())


def test_what_can_not_be(spark):
    lines = spark.createDataFrame(made(3), SCHEMA)
    for bad in (lambda: LN.dashes(lines, 0, 1), lambda: LN.dashes(lines, 1, -1), lambda: LN.anchors(lines, 0, 1), lambda: LN.anchors(lines, 1, -1)):
        with pytest.raises(ValueError):
            bad()
    assert LN.dashes(lines.limit(0), 1, 1).count() == 0 and LN.anchors(lines.limit(0), 1, 1, 5).count() == 0


def test_tasks_follow_the_number_of_references(spark, monkeypatch):
    from geoloom.operators import ways
    from geoloom.sources import tables

    def made():
        refs, nodes = tables.way_refs(spark, "/root/testdata/sf0.001"), tables.nodes(spark, "/root/testdata/sf0.001")
        rows = refs.count()
        found = [ways.odd_segments(ways.segments(refs), "way_id"), ways.vertex_degrees(ways.segments(refs), "way_id"), ways.located(refs, nodes, rows)]
        return [(sorted(map(str, df.collect())), df.select(F.spark_partition_id()).distinct().count()) for df in found], rows

    (plain, rows) = made()
    monkeypatch.setattr(tables, "ROWS", rows // 12)
    spread, _ = made()
    assert [r for r, _ in spread] == [r for r, _ in plain]
    assert all(n <= 4 for _, n in plain) and all(n >= 12 for _, n in spread)
