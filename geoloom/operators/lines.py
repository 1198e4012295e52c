"""Lines by length: running lengths, dashes with a phase, and even anchors for labels with a limit on bends.

Every segment is a row with the length before and after it, so a dash or an anchor is found by its segment alone; what
belongs to one dash is gathered by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(lines: DataFrame) -> DataFrame:
    """id, pos, x0, y0, x1, y1, start, stop of lines (id, xs, ys): each segment with the line's length before and after it; ids are unique, segments of no length go."""
    points = lines.select("id", F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "p")).select("id", "pos", F.col("p.xs").cast("double").alias("x0"), F.col("p.ys").cast("double").alias("y0"))
    along = Window.partitionBy("id").orderBy("pos")
    pairs = points.withColumn("x1", F.lead("x0").over(along)).withColumn("y1", F.lead("y0").over(along)).where("x1 is not null and y1 is not null and (x0 <> x1 or y0 <> y1)")
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    stop = F.sum("_length").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return pairs.withColumn("_length", length).withColumn("stop", stop).withColumn("start", F.coalesce(F.lag("stop").over(along), F.lit(0.0))).drop("_length")


def _at(d, c: str):
    """A coordinate of the place at length `d` on its segment."""
    return F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (d - F.col("start")) / (F.col("stop") - F.col("start"))


def dashes(lines: DataFrame, on: float, off: float, phase: float = 0.0) -> DataFrame:
    """id, dash, start, length, xs, ys: lines cut into dashes `on` long with gaps of `off`, the pattern moved back by `phase`.

    `dash` counts the pattern from where it would start; a dash bends with its line, and is cut by the line's ends.
    """
    if on <= 0 or off < 0:
        raise ValueError("a dash has a length, and a gap none below 0")
    period = on + off
    number = lambda c: F.floor((F.col(c) + phase) / period)
    rows = segments(lines).withColumn("dash", F.explode(F.sequence(number("start"), number("stop"))))
    low = F.greatest("start", F.col("dash") * period - phase)
    high = F.least("stop", F.col("dash") * period + on - phase)
    rows = rows.withColumn("_a", low).withColumn("_b", high).where("_a < _b")
    rows = rows.select("id", "dash", "_a", "_b", _at(F.col("_a"), "x").alias("ax"), _at(F.col("_a"), "y").alias("ay"), _at(F.col("_b"), "x").alias("bx"), _at(F.col("_b"), "y").alias("by"))
    parts = F.array_sort(F.collect_list(F.struct("_a", "ax", "ay", "bx", "by")))
    out = rows.groupBy("id", "dash").agg(F.min("_a").alias("start"), (F.max("_b") - F.min("_a")).alias("length"), parts.alias("p"))
    joined = lambda a, b: F.concat(F.slice(F.transform("p", lambda s: s[a]), 1, 1), F.transform("p", lambda s: s[b]))
    return out.select("id", "dash", "start", "length", joined("ax", "bx").alias("xs"), joined("ay", "by").alias("ys"))


def anchors(lines: DataFrame, spacing: float, width: float, max_turn: float = 180.0) -> DataFrame:
    """id, anchor (from 0), x, y, angle (degrees) of labels `width` long on lines, their middles `spacing` apart, the row of them in the middle of its line.

    A line shorter than a label has none. A label is left out if the line turns by more than `max_turn` degrees at a
    point under it.
    """
    if spacing <= 0 or width < 0:
        raise ValueError("anchors are apart, and labels not narrower than 0")
    s = segments(lines)
    total = Window.partitionBy("id")
    s = s.withColumn("_total", F.max("stop").over(total)).where(F.col("_total") >= width)
    count = F.floor((F.col("_total") - width) / spacing)  # anchors after the first
    s = s.withColumn("_count", count).withColumn("_first", (F.col("_total") - count * spacing) / 2)
    low, high = F.ceil((F.col("start") - F.col("_first")) / spacing), F.ceil((F.col("stop") - F.col("_first")) / spacing) - 1
    low, high = F.greatest(low, F.lit(0)), F.least(F.when(F.col("stop") == F.col("_total"), F.col("_count")).otherwise(high), F.col("_count"))
    angle = F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    found = s.where(low <= high).withColumn("anchor", F.explode(F.sequence(low, high)))
    d = F.col("_first") + F.col("anchor") * spacing
    found = found.select("id", "anchor", _at(d, "x").alias("x"), _at(d, "y").alias("y"), angle.alias("angle"))
    if max_turn >= 180:
        return found
    along = Window.partitionBy("id").orderBy("pos")
    turn = F.abs(F.col("_angle") - F.lag("_angle").over(along))
    bends = s.withColumn("_angle", angle).withColumn("_turn", F.least(turn, 360 - turn)).where(F.col("_turn") > max_turn)
    near = lambda side: (F.col("start") - F.col("_first") + side * width / 2) / spacing
    under = bends.select("id", F.greatest(F.floor(near(-1)) + 1, F.lit(0)).alias("a"), F.least(F.ceil(near(1)) - 1, F.col("_count")).alias("b")).where("a <= b")
    return found.join(under.select("id", F.explode(F.sequence("a", "b")).alias("anchor")).distinct(), ["id", "anchor"], "left_anti")
