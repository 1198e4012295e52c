"""Changes: the final state of each object, and its application to a base snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(changes: DataFrame, keys: list[str], order: list[str], payload: list[str], bare: str | None = None) -> DataFrame:
    """keys, order, action, version and payload of the change that holds in the end; `bare` names a column for the place of the last change without a version.

    In `order` a change replaces the stored one unless both versions are known and the new one is lower. So what was
    before an object's last change without a version does not count, and of what follows it (or that change itself, if
    nothing does) the highest version holds, of equal ones the last. Both are maxima, combined before the shuffle.
    """
    place, row = F.struct(*order), F.struct(*order, "action", "version", *payload)
    unversioned = F.col("version").isNull()
    lasts = changes.where(unversioned).groupBy(*keys).agg(F.max(place).alias("_from"), F.max_by(row, place).alias("_bare"))
    versioned = changes.where(~unversioned).withColumn("_row", row).withColumn("_place", place)
    # the last change without a version is an object's only row here, so the join keeps the changes as they are
    after = versioned.join(lasts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_from"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").where(F.col("_from").isNull() | (F.col("_place") > F.col("_from")))
    best = after.groupBy(*keys).agg(F.max_by("_row", F.struct("version", "_place")).alias("_best"))
    both = best.join(lasts.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full_outer")
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], F.coalesce("_best", "_bare").alias("s"), "_from").select(*keys, "s.*", *([F.col("_from").alias(bare)] if bare else []))


def folded(changes: DataFrame) -> DataFrame:
    """id, seq, action, version, value of the change that holds in the end, for changes (seq, id, action, version, value)."""
    typed = changes.select("id", F.col("seq").cast("long").alias("seq"), "action", F.col("version").cast("int").alias("version"), F.col("value").cast("long").alias("value"))
    return fold(typed, ["id"], ["seq"], ["value"])


def folded_elements(changes: DataFrame) -> DataFrame:
    """The same for whole elements, as sources.files.read_changes has them."""
    return fold(changes, ["osm_type", "id"], ["seq", "ord"], ["lon7", "lat7", "refs", "members", "tags"])


def applied_elements(base: DataFrame, state: DataFrame) -> DataFrame:
    """osm_type, id, lon7, lat7, refs, members, tags and outcome: base elements after the final states; deleted rows stay, without content."""
    content = ["lon7", "lat7", "refs", "members", "tags"]
    b = base.select("osm_type", "id", F.struct(*content).alias("old"))
    s = state.select("osm_type", "id", "action", F.struct(*content).alias("new"))
    both = b.join(s, ["osm_type", "id"], "full_outer")
    was = F.col("old").isNotNull()
    outcome = F.when(F.col("action").isNull(), "unchanged").when(F.col("action") == "delete", F.when(was, "deleted").otherwise("absent")).otherwise(F.when(was, "modified").otherwise("created"))
    kept = F.when(F.col("action").isNull(), F.col("old")).when(F.col("action") != "delete", F.col("new"))
    return both.select("osm_type", "id", kept.alias("kept"), outcome.alias("outcome")).select("osm_type", "id", "kept.*", "outcome")


def latest(changes: DataFrame) -> DataFrame:
    """The same where every change has a version: the highest version, then the last; combined before the shuffle."""
    top = F.max_by(F.struct("seq", "action", "version", "value"), F.struct("version", "seq"))
    return changes.groupBy("id").agg(top.alias("s")).select("id", "s.*")


def applied(base: DataFrame, state: DataFrame) -> DataFrame:
    """id, value, outcome: base (id, value) after the final states; deleted rows stay with outcome 'deleted'."""
    b = base.select("id", F.col("value").alias("old"), F.lit(True).alias("was"))
    s = state.select("id", F.col("value").alias("new"), "action")
    both = b.join(s, "id", "full_outer")
    outcome = F.when(F.col("action").isNull(), "unchanged").when(F.col("action") == "delete", F.when(F.col("was"), "deleted").otherwise("absent")).otherwise(F.when(F.col("was"), "modified").otherwise("created"))
    return both.select("id", F.when(F.col("action").isNull(), F.col("old")).when(F.col("action") != "delete", F.col("new")).alias("value"), outcome.alias("outcome"))


def apply_stats(done: DataFrame) -> DataFrame:
    return done.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("created", "modified", "deleted", "unchanged")])


def update_stats(done: DataFrame) -> DataFrame:
    """read, written, created, modified, deleted of applied elements: deletions of what wasn't there count as nothing."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return done.agg(
        n("unchanged", "modified", "deleted").alias("read"), n("unchanged", "modified", "created").alias("written"), n("created").alias("created"), n("modified").alias("modified"), n("deleted").alias("deleted"),
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """objects and deletions of folded changes."""
    return changes.agg(F.count("*").alias("objects"), F.count_if(F.col("action") == "delete").alias("deletions"))


def file_key() -> list[Column]:
    """Type, negative ids first, then by absolute id."""
    return [F.col("osm_type"), F.col("id") >= 0, F.abs("id")]


def file_places(rows: DataFrame, folder: str) -> DataFrame:
    """`rows` with place, from 1 in file order: numbered within ranges of the order, after the counts of the ranges before.

    The ranges are written to `folder` first, as a range partitioning computed twice may cut elsewhere.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(ranges, *file_key()).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.parquet(folder)
    before, starts = 0, []
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        starts.append((r["_range"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(starts, "_range int, _before long"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*file_key()))
    return dealt.withColumn("_inside", inside).join(starts, "_range").withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")
