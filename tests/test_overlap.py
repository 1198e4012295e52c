"""Overlapping boxes against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import overlap as O

BOX = "id long, min_lon7 int, min_lat7 int, max_lon7 int, max_lat7 int"


def made(kind, n, seed, start=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if kind == "globe":
            x, y, w, h = r.randint(-1_800_000_000, 1_500_000_000), r.randint(-900_000_000, 600_000_000), r.choice([0, 10_000_000, 300_000_000]), r.choice([0, 20_000_000, 200_000_000])
        elif kind == "city":
            x, y, w, h = 84_000_000 + r.randint(0, 500_000), 475_000_000 + r.randint(0, 300_000), r.choice([0, 500, 20_000]), r.choice([0, 700, 9000])
        elif kind == "one place":
            x, y, w, h = 5, 5, r.choice([0, 1]), 0
        else:  # on the lines between cells
            x, y, w, h = r.choice([-(1 << 30), 0, 1 << 29]) + r.choice([-1, 0, 1]), r.choice([-(1 << 28), 0, 1 << 27]) + r.choice([-1, 0, 1]), r.choice([0, 1, 1 << 28]), r.choice([0, 1, 1 << 27])
        out.append((start + i, x, y, x + w, y + h))
    return out


def brute(a, b):
    return sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


@pytest.mark.parametrize("kind", ["globe", "city", "one place", "lines"])
def test_all_pairs(spark, kind):
    n = 60 if kind == "one place" else 400
    a, b = made(kind, n, 1), made(kind, n, 2, 1000)
    odd = [(9000, None, 1, 2, 3), (9001, 5, 5, 4, 5), (9002, 1, 1, None, None)]
    got = O.overlapping(spark.createDataFrame(a + odd, BOX), spark.createDataFrame(b + odd, BOX).withColumn("name", F.lit("x")), rows=20).select("id", "b_id", "b_name").collect()
    want = brute(a, b)
    assert sorted((r.id, r.b_id) for r in got) == want and len(want) > 50 and {r.b_name for r in got} == {"x"}
    assert O.overlapping(spark.createDataFrame([], BOX), spark.createDataFrame(b, BOX)).count() == 0


@pytest.mark.parametrize("kind", ["globe", "city"])
def test_no_cell_holds_more_than_it_should(spark, kind):
    """Small boxes, all in one city or all over the globe: cells hold no more than twice the rows asked for."""
    rows = [(i, x, y, x + 50, y + 50) for i, x, y, *_ in made(kind, 8000, 7)]
    boxes = spark.createDataFrame(rows, BOX)
    cut = O.split(boxes, boxes.limit(0), rows=200)
    held = O.in_cells(boxes, cut).groupBy("_cell").count().toPandas()["count"]
    assert held.max() <= 400 and held.sum() < 1.3 * len(rows) and len(cut) > 20


def test_a_bounded_sample(spark):
    rows = [(i, x, y, x + 50, y + 50) for i, x, y, *_ in made("city", 8000, 9)]
    boxes = spark.createDataFrame(rows, BOX)
    cut = O.split(boxes, boxes.limit(0), rows=400, sample=800)
    held = O.in_cells(boxes, cut).groupBy("_cell").count().toPandas()["count"]
    assert len(cut) > 5 and held.max() <= 1500
    assert O.cells_of(np.zeros((0, 4), np.int64), 10) == set() and O.cells_of(np.array([[1, 1, 1, 1]] * 50), 10) != set()


@pytest.mark.parametrize("kind", ["globe", "city", "one place", "lines"])
def test_sums_without_pairs(spark, kind):
    """Hits and sums of ids against all pairs, in many strips and in one."""
    a, b = made(kind, 300, 3), made(kind, 400, 4, 1000)
    odd = [(9000, None, 1, 2, 3), (9001, 5, 5, 4, 5), (9002, 1, 1, None, None)]
    want = {}
    for i, j in brute(a, b):
        want[i] = (want.get(i, (0, 0))[0] + 1, want.get(i, (0, 0))[1] + j)
    for rows in (25, 50_000):
        got = O.overlap_sums(spark.createDataFrame(a + odd, BOX), spark.createDataFrame(b + odd, BOX), strip_rows=rows, sample=150).collect()
        assert len(got) == len(a) and {r.id: (r.hits, r.total) for r in got if r.hits} == want
    assert [r.hits for r in O.overlap_sums(spark.createDataFrame(a[:2], BOX), spark.createDataFrame([], BOX)).collect()] == [0, 0]


def test_sums_of_boxes_upon_each_other(spark):
    """As many pairs as no join could make: 200,000 boxes of which each meets all."""
    boxes = spark.range(200_000).selectExpr("id", "cast(-id as int) as min_lon7", "0 as min_lat7", "cast(id as int) as max_lon7", "1 as max_lat7")
    got = O.overlap_sums(boxes, boxes).agg(F.min("hits").alias("a"), F.max("hits").alias("b"), F.min("total").alias("c"), F.max("total").alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == (200_000, 200_000, 200_000 * 199_999 // 2, 200_000 * 199_999 // 2)
