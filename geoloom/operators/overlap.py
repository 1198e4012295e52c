"""Joins of boxes that overlap, over cells of a quadtree that follows where the boxes are.

A bounded sample of both sides says where cells must be small. Each box goes to all cells it touches, and a pair is made
in the one cell that holds the lower left corner of what both share, so no pair is made twice and none is compared with
all others. Where only the number of pairs or a sum over them is asked for, overlap_sums has it without pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows of both sides that the cells are cut by; rows that a cell should hold; sampled rows below which no cell is cut.
SAMPLE, ROWS, LEAST = 200_000, 20_000, 16
#: The grid: 2 ** BITS units of 1e-7 degrees a side from -2 ** (BITS - 1); levels that are cut.
BITS, DEEPEST = 32, 24
BOX = ["min_lon7", "min_lat7", "max_lon7", "max_lat7"]


def _codes(level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number for each cell of a level, unlike those of all other levels."""
    return (np.int64(1) << np.int64(2 * level)) + (x.astype(np.int64) << np.int64(level)) + y


def cells_of(sample: np.ndarray, most: float) -> set[int]:
    """Codes of the cells that are cut: those in which more than `most` of the boxes (n x 4) of a sample lie or begin, unless all four quarters would hold nearly all of them again."""
    cut: set[int] = set()
    at = sample.astype(np.int64) + (1 << (BITS - 1))
    open_ = [(0, 0, 0, at)]
    while open_:
        level, cx, cy, rows = open_.pop()
        if len(rows) <= most or level >= DEEPEST:
            continue
        shift = np.int64(BITS - level - 1)
        parts = []
        for i in (0, 1):
            for j in (0, 1):
                x, y = 2 * cx + i, 2 * cy + j
                parts.append((level + 1, x, y, rows[(rows[:, 0] >> shift <= x) & (rows[:, 2] >> shift >= x) & (rows[:, 1] >> shift <= y) & (rows[:, 3] >> shift >= y)]))
        if sum(len(p[3]) for p in parts) > 2 * len(rows):  # boxes as large as the cell: smaller cells would hold each more often
            continue
        cut.add(int(_codes(level, np.int64(cx), np.int64(cy))))
        open_ += parts
    return cut


def split(boxes: DataFrame, others: DataFrame, rows: int = ROWS, sample: int = SAMPLE) -> np.ndarray:
    """The cut cells for two sides; the sample, and so the work of the driver, is bounded, and no cell is cut by fewer than LEAST sampled rows."""
    both = boxes.select(*BOX).unionByName(others.select(*BOX)).where(_whole())
    n = both.count()
    rate = min(1.0, sample / max(n, 1))
    took = both if rate == 1.0 else both.where(F.pmod(F.xxhash64(*BOX), F.lit(1 << 30)) < int(rate * (1 << 30)))
    got = np.array(took.limit(2 * sample).toPandas().to_numpy(np.int64)).reshape(-1, 4)
    return np.array(sorted(cells_of(got, max(rows * rate, LEAST))), np.int64)


def _whole() -> Column:
    return F.col("min_lon7").isNotNull() & F.col("min_lat7").isNotNull() & (F.col("max_lon7") >= F.col("min_lon7")) & (F.col("max_lat7") >= F.col("min_lat7"))


def in_cells(boxes: DataFrame, cut: np.ndarray) -> DataFrame:
    """`boxes` (BOX, others) with _cell, _level, _x, _y: a row for each cell, not cut, that a box touches; boxes without an extent or with a null go."""
    names = boxes.columns

    def run(batches):
        for batch in batches:
            b = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in BOX], axis=1) + (1 << (BITS - 1))
            row, x, y = np.arange(len(b)), np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            level, found = 0, []
            while len(row):
                codes = _codes(level, x, y)
                at = np.searchsorted(cut, codes)
                deeper = (at < len(cut)) & (cut[np.minimum(at, max(len(cut) - 1, 0))] == codes) if len(cut) else np.zeros(len(row), bool)
                if not deeper.all():
                    found.append((row[~deeper], codes[~deeper], np.full(int((~deeper).sum()), level, np.int32), x[~deeper], y[~deeper]))
                row, x, y = np.repeat(row[deeper], 4), np.repeat(2 * x[deeper], 4), np.repeat(2 * y[deeper], 4)
                x, y = x + np.tile([0, 0, 1, 1], len(row) // 4), y + np.tile([0, 1, 0, 1], len(row) // 4)
                level += 1
                shift = np.int64(BITS - level)
                touch = (b[row, 0] >> shift <= x) & (b[row, 2] >> shift >= x) & (b[row, 1] >> shift <= y) & (b[row, 3] >> shift >= y)
                row, x, y = row[touch], x[touch], y[touch]
            if found:
                row, codes, levels, x, y = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(codes), pa.array(levels), pa.array(x), pa.array(y)], names=[*names, "_cell", "_level", "_x", "_y"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema.fields)
    return boxes.where(_whole()).mapInArrow(run, f"{schema}, _cell long, _level int, _x long, _y long")


def overlapping(a: DataFrame, b: DataFrame, rows: int = ROWS) -> DataFrame:
    """All pairs of `a` and `b` (id, BOX in 1e-7 degrees, others) whose boxes share a point, sides included; columns of `a` as they are, those of `b` with b_ before them.

    Boxes with a null or without an extent are in no pair. A cell of many boxes that lie on each other is one key of
    the join, which AQE splits where it is skewed.
    """
    cut = split(a, b, rows)
    left = in_cells(a, cut)
    right = in_cells(b, cut).drop("_level", "_x", "_y")
    right = right.select(*(F.col(c).alias("_cell" if c == "_cell" else f"b_{c}") for c in right.columns))
    own = lambda low, at: F.expr(f"shiftright(greatest(cast({low} as bigint), cast(b_{low} as bigint)) + {1 << (BITS - 1)}L, {BITS} - _level)") == F.col(at)
    meet = (F.col("min_lon7") <= F.col("b_max_lon7")) & (F.col("b_min_lon7") <= F.col("max_lon7")) & (F.col("min_lat7") <= F.col("b_max_lat7")) & (F.col("b_min_lat7") <= F.col("max_lat7"))
    return left.join(right, "_cell").where(meet & own("min_lon7", "_x") & own("min_lat7", "_y")).drop("_cell", "_level", "_x", "_y")


#: The four corners that a box's count is made of: sides of the other box, sides of the asking one (with 1: one further), sign.
_CORNERS = (("min_lon7", "min_lat7", ("max_lon7", 1), ("max_lat7", 1), 1), ("min_lon7", "max_lat7", ("max_lon7", 1), ("min_lat7", 0), -1), ("max_lon7", "min_lat7", ("min_lon7", 0), ("max_lat7", 1), -1), ("max_lon7", "max_lat7", ("min_lon7", 0), ("min_lat7", 0), 1))
#: Points of one corner that a strip should hold, and strips at most.
STRIP_ROWS, STRIPS = 50_000, 400


def below(px: np.ndarray, py: np.ndarray, pv: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (qx, qy) how many points lie below it in x and in y, and the sum of their values: bit by bit of the points' ranks, never by pairs."""
    rank = np.empty(len(px), np.int64)
    by_x = np.argsort(px, kind="stable")
    rank[by_x] = np.arange(len(px))
    by_y = np.argsort(py, kind="stable")
    most, end = np.searchsorted(px[by_x], qx), np.searchsorted(py[by_y], qy)
    start, n, total = np.zeros(len(qx), np.int64), np.zeros(len(qx), np.int64), np.zeros(len(qx), np.int64)
    rank, value = rank[by_y], pv[by_y]
    for bit in range(len(px).bit_length() - 1, -1, -1):
        low = (rank >> bit & 1) == 0
        zeros = np.concatenate([[0], np.cumsum(low)])
        sums = np.concatenate([[0], np.cumsum(np.where(low, value, 0))])
        up = (most >> bit & 1) == 1  # all points of this bit 0 are below, and the search goes on among those of bit 1
        n += np.where(up, zeros[end] - zeros[start], 0)
        total += np.where(up, sums[end] - sums[start], 0)
        start, end = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (start, end))
        order = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
        rank, value = rank[order], value[order]
    return n, total


def _bounds(values: np.ndarray, strips: int) -> np.ndarray:
    """Where strips begin, by quantiles of a sample; a value that stands at two of them has a strip of its own."""
    at = np.sort(values)[np.linspace(0, len(values) - 1, strips + 1).astype(int)[1:-1]] if len(values) and strips > 1 else np.zeros(0, np.int64)
    return np.unique(np.concatenate([at, at[1:][at[1:] == at[:-1]] + 1])).astype(np.int64)


def overlap_sums(a: DataFrame, b: DataFrame, value: str = "id", strip_rows: int = STRIP_ROWS, sample: int = SAMPLE) -> DataFrame:
    """`a` (id, BOX) with hits and total: of the boxes of `b` (value, BOX) that share a point with it, how many they are and the sum of `value`, which a long must hold.

    No pair is made, so work grows with the rows and not with the hits. A box meets those that begin before it ends,
    less those that end before it begins, along both axes: four counts of corners below and left of a corner. Corners
    are dealt to strips along each axis. A corner's count is that of whole strips (a small table), of its strip of x,
    and of its strip of y left of that. Strips follow a bounded sample, which no count depends on. Boxes with a null or
    without an extent meet nothing and are left out.
    """
    sides = [F.col(c).cast("long").alias(c) for c in BOX]
    asked = written(a.select("id", *sides).where(_whole()).withColumn("_row", F.monotonically_increasing_id()))
    there = written(b.select(F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("_row"), *sides).where(_whole()))
    n = there.count()
    took = there if n <= sample else there.where(F.rand(7) < sample / n)
    got = took.select(*BOX).limit(2 * sample).toPandas().to_numpy(np.int64).reshape(-1, 4)
    strips = min(STRIPS, -(-n // strip_rows))
    bounds = [_bounds(np.concatenate([got[:, i], got[:, i + 2]]), strips) for i in (0, 1)]
    # Of a strip of one value no point lies below another along its axis, so it is dealt to no task.
    lone = [np.concatenate([[False], np.diff(edges) == 1, [False]])[: len(edges) + 1] for edges in bounds]
    signs = np.array([c[-1] for c in _CORNERS], np.int64)

    def corners(df: DataFrame, pick) -> DataFrame:
        made = F.array(*[F.struct(F.lit(k).alias("k"), *pick(*c[:4])) for k, c in enumerate(_CORNERS)])
        return df.select("_row", F.inline(made)).mapInArrow(placed, "_row long, k int, x long, y long, sx int, sy int")

    def placed(batches):
        for batch in batches:
            strip = [np.searchsorted(bounds[i], batch.column(c).to_numpy(), side="right").astype(np.int32) for i, c in enumerate("xy")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, strip)], names=["_row", "k", "x", "y", "sx", "sy"])

    points = corners(there, lambda x, y, *_: (F.col(x).alias("x"), F.col(y).alias("y")))
    queries = corners(asked, lambda _, __, x, y: ((F.col(x[0]) + x[1]).alias("x"), (F.col(y[0]) + y[1]).alias("y")))
    full = np.zeros((2, len(_CORNERS), len(bounds[0]) + 2, len(bounds[1]) + 2), np.int64)
    for r in points.groupBy("k", "sx", "sy").agg(F.count("*").alias("n"), F.sum("_row").alias("t")).toLocalIterator():  # a row for each corner and two strips at most
        full[:, r["k"], r["sx"] + 1, r["sy"] + 1] = r["n"], r["t"]
    whole = a.sparkSession.sparkContext.broadcast(full.cumsum(axis=2).cumsum(axis=3))

    def of_strips(batches):
        for batch in batches:
            k, sx, sy = (batch.column(c).to_numpy() for c in ("k", "sx", "sy"))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array(signs[k] * whole.value[i, k, sx, sy]) for i in (0, 1))], names=["_row", "n", "t"])

    def dealt(batches):
        for batch in batches:
            x, sx, sy = (batch.column(c).to_numpy() for c in ("x", "sx", "sy"))
            for axis, strip, along in ((0, sx, x), (1, sy, sx.astype(np.int64))):  # in a strip of y, points of strips of x further left count
                rows = np.flatnonzero(~lone[axis][strip])
                took = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([took.column("_row"), took.column("k"), pa.array(np.full(len(rows), axis, np.int32)), pa.array(strip[rows]), pa.array(along[rows]), took.column("y"), took.column("ask")], names=["_row", "k", "axis", "strip", "x", "y", "ask"])

    def counted(key, table):
        sign, ask = signs[key[0].as_py()], table.column("ask").to_numpy(zero_copy_only=False)
        row, x, y = (table.column(c).to_numpy() for c in ("_row", "x", "y"))
        n, total = below(x[~ask], y[~ask], row[~ask], x[ask], y[ask])
        return pa.table({"_row": row[ask], "n": sign * n, "t": sign * total})

    both = queries.withColumn("ask", F.lit(True)).unionByName(points.withColumn("ask", F.lit(False)))
    in_strips = both.mapInArrow(dealt, "_row long, k int, axis int, strip int, x long, y long, ask boolean").groupBy("k", "axis", "strip").applyInArrow(counted, "_row long, n long, t long")
    sums = in_strips.unionByName(queries.mapInArrow(of_strips, "_row long, n long, t long")).groupBy("_row").agg(F.sum("n").alias("hits"), F.sum("t").alias("total"))
    return asked.join(sums, "_row").drop("_row")
