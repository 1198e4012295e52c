"""Labels that don't collide: the greedy choice by priority in each view, as rounds over a grid.

A label takes its place if no better label that it overlaps has one. In a round the best open label of every cell that it
touches wins, as nothing better can be near it; open labels that overlap a winner go. A cell has one winner a round at
most, so no pairs of labels are made, and views need no task of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Side of a cell in pixels: about what a label is wide.
CELL = 64
LABEL = ["view", "id", "rank", "sort_key", "x0", "y0", "x1", "y1", "padding", "allow_overlap"]


def _cells(low: str, high: str, side: int) -> Column:
    """The cells that the inside of [low, high] touches, one at least."""
    first = F.floor(F.col(low) / side).cast("long")
    return F.sequence(first, F.greatest(first, (F.ceil(F.col(high) / side) - 1).cast("long")))


def _overlap(a: str, b: str) -> Column:
    """Whether the insides of two boxes meet; such as only touch don't."""
    c = lambda p, n: F.col(f"{p}{n}")
    return (c(a, "px0") < c(b, "px1")) & (c(b, "px0") < c(a, "px1")) & (c(a, "py0") < c(b, "py1")) & (c(b, "py0") < c(a, "py1"))


def place(labels: DataFrame, width: float, height: float, side: int = CELL) -> DataFrame:
    """view, id of the labels that get a place, for labels (view, id, rank, sort_key, x0, y0, x1, y1, padding, allow_overlap) in pixels.

    The lowest (rank, sort_key, id) is best; ids are unique in a view. A label outside of [0, width] x [0, height] goes. One with
    `allow_overlap` always has its place, and keeps worse ones off it like any other. Between two labels there must be
    room for the padding of both. A null in a box or in the order leaves a label out; the sort keys of a label that isn't
    a number come last, as an order of doubles has them.
    """
    boxes = labels.select(*LABEL).where("x0 < x1 and y0 < y1").where((F.col("x0") < width) & (F.col("x1") > 0) & (F.col("y0") < height) & (F.col("y1") > 0))
    boxes = boxes.where(" and ".join(f"{c} is not null" for c in ("view", "id", "rank", "sort_key")))
    pad = F.coalesce("padding", F.lit(0))
    boxes = boxes.select("view", "id", F.struct("rank", "sort_key", "id").alias("prio"), (F.col("x0") - pad).alias("px0"), (F.col("y0") - pad).alias("py0"), (F.col("x1") + pad).alias("px1"), (F.col("y1") + pad).alias("py1"), F.coalesce("allow_overlap", F.lit(False)).alias("free"))
    gridded = written(boxes.withColumn("cx", F.explode(_cells("px0", "px1", side))).withColumn("cy", F.explode(_cells("py0", "py1", side))))
    free, open_ = gridded.where("free"), gridded.where("not free")
    winners = free
    found = [free.select("view", "id").distinct()]
    first = True
    while True:
        w = winners.select("view", "cx", "cy", *(F.col(c).alias(f"w_{c}") for c in ("prio", "px0", "py0", "px1", "py1")))
        hit = open_.join(w, ["view", "cx", "cy"]).where((F.col("w_prio") < F.col("prio")) & _overlap("", "w_")).select("view", "id").distinct()
        gone = hit if first else hit.unionByName(winners.select("view", "id").distinct())
        open_ = written(open_.join(gone, ["view", "id"], "left_anti"))
        if open_.isEmpty():
            break
        best = open_.groupBy("view", "cx", "cy").agg(F.min("prio").alias("best"))
        won = open_.join(best, ["view", "cx", "cy"]).groupBy("view", "id").agg(F.every(F.col("prio") == F.col("best")).alias("all")).where("all").select("view", "id")
        winners, first = written(open_.join(won, ["view", "id"], "left_semi")), False
        found.append(winners.select("view", "id").distinct())
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
