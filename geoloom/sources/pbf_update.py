"""Changes applied to sorted PBF files by the blobs they touch; all other blobs are copied as they are.

The index of the blobs (pbf.blocks) says which of them have a changed id between their least and greatest. Only those are
opened and joined with the changes. What comes out and the untouched blobs, each a row of its least id, are sorted
together by range, and tasks write them in that order, so nothing is decoded or encoded that no change is near.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import applied_elements
from . import pbf, pbf_blocks
from .tables import scratch, written

_KEY = ["osm_type", "id"]
_BLOB = "struct<path:string,at:long,bytes:long,last_id:long,elements:long>"


def as_of(rows: DataFrame, markers: DataFrame, column: str) -> DataFrame:
    """`rows` (osm_type, id, others) with `column` of the last of `markers` (osm_type, id, `column`) whose type and id are not greater, null where there is none.

    Both are dealt out by ranges of (type, id); a range goes on from the last marker of the ranges before it, which are as
    many as the session has shuffle partitions. Neither side is joined, broadcast or held whole.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = markers.schema[column].dataType
    both = rows.withColumn(column, F.lit(None).cast(kind)).withColumn("_row", F.lit(True)).unionByName(markers.select(*_KEY, column).withColumn("_row", F.lit(False)), allowMissingColumns=True)
    folder = scratch(spark)
    both.repartitionByRange(n, *_KEY).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.schema(both.withColumn("_range", F.lit(0)).schema).parquet(folder)
    held, carry = None, []
    for r in dealt.groupBy("_range").agg(F.max(F.when(~F.col("_row"), F.struct(*_KEY, column))).alias("m")).orderBy("_range").collect():  # a row for each range
        carry.append((r["_range"], held))
        held = r["m"][column] if r["m"] is not None else held
    before = F.broadcast(spark.createDataFrame(carry, f"_range int, _before {kind.simpleString()}"))
    order = Window.partitionBy("_range").orderBy(*_KEY, "_row").rowsBetween(Window.unboundedPreceding, 0)
    known = dealt.withColumn(column, F.last(column, ignorenulls=True).over(order)).join(before, "_range", "left")
    return known.where("_row").withColumn(column, F.coalesce(column, "_before")).drop("_row", "_range", "_before")


def touched(index: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, at) of the blobs of `index` (pbf.blocks) that hold, or stand around, an id of `changed` (osm_type, id); one of several types is always touched."""
    known = index.where("osm_type is not null")
    blob = F.struct("path", "at", "bytes", "last_id", "elements", F.col("osm_type").alias("kind")).alias("blob")
    found = as_of(changed.select(*_KEY), known.select("osm_type", F.col("first_id").alias("id"), blob), "blob")
    hit = found.where((F.col("blob.kind") == F.col("osm_type")) & (F.col("id") <= F.col("blob.last_id"))).select("blob.path", "blob.at")
    return hit.unionByName(index.where("osm_type is null").select("path", "at")).distinct()


def opened(blobs: DataFrame) -> DataFrame:
    """The elements (pbf.SCHEMA) of `blobs` (path, at, bytes)."""

    def run(batches):
        for batch in batches:
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "bytes"))):
                for _, _, _, payload in pbf._blobs(path, at, at + 1, sure=True):
                    rows = pbf_blocks.decoded(payload)
                    if rows is not None:
                        yield rows

    return blobs.select("path", "at", "bytes").repartition("path", "at").mapInArrow(run, pbf.SCHEMA)


def write_merged(elements: DataFrame, blobs: DataFrame, folder: str, files: int, header: bytes) -> DataFrame:
    """Write elements (pbf.SCHEMA) and whole `blobs` (of pbf.blocks) in order of type and id as part files; a plan that returns path, elements, copied, made, bytes of each.

    No element may stand between the ids of a blob.
    """
    marks = blobs.select("osm_type", F.col("first_id").alias("id"), F.struct("path", "at", "bytes", "last_id", "elements").cast(_BLOB).alias("blob"))
    both = elements.select(*pbf.COLUMNS).withColumn("blob", F.lit(None).cast(_BLOB)).unionByName(marks, allowMissingColumns=True)
    ordered = both.repartitionByRange(files, *_KEY).sortWithinPartitions(*_KEY)

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.osm.pbf"
        said = {"elements": 0, "copied": 0, "made": 0, "bytes": 0}
        with pbf.part_file(folder, name) as out:
            out.write(header)

            def made(table: pa.RecordBatch) -> None:
                got = pbf.encoded([table], out)
                for k in ("elements", "bytes"):
                    said[k] += got[k]
                said["made"] += -(-got["elements"] // pbf.BLOCK_ELEMENTS)

            held: list[pa.RecordBatch] = []
            for batch in batches:
                marks = batch.column("blob").to_pylist()
                start = 0
                for i in [*(i for i, m in enumerate(marks) if m), len(marks)]:
                    if i > start:
                        held.append(batch.slice(start, i - start).select(list(pbf.COLUMNS)))
                    if i < len(marks) or sum(b.num_rows for b in held) >= pbf.BLOCK_ELEMENTS:
                        for table in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
                            made(table)
                        held = []
                    if i < len(marks):
                        m = marks[i]
                        system, own = pbf.open_fs(m["path"])
                        with system.open_input_file(own) as f:
                            f.seek(m["at"])
                            head = int.from_bytes(f.read(4), "big")
                            f.seek(m["at"] + 4 + head)
                            frame = pbf._framed(b"OSMData", f.read(m["bytes"] - 4 - head), (batch.column("osm_type")[i].as_py(), batch.column("id")[i].as_py(), m["last_id"], m["elements"]))
                        out.write(frame)
                        said["copied"] += 1
                        said["elements"] += m["elements"]
                        said["bytes"] += len(frame)
                    start = i + 1
            for table in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
                made(table)
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}"} | said])

    return ordered.mapInArrow(run, "path string, elements long, copied long, made long, bytes long")


def update(spark: SparkSession, base: str, state: DataFrame, target: str, files: int, header: bytes) -> tuple[dict, dict]:
    """Write the files at `base`, sorted by type and id, with the final states `state` of changes applied, as the new folder `target`.

    Returns read, written, created, modified, deleted of elements (deletions of what isn't there count as nothing) and
    blobs, opened, copied, made of blobs.
    """
    state = written(state)
    index = written(pbf.blocks(spark, base))
    hit = written(touched(index, state))
    taken = index.join(hit, ["path", "at"], "left_semi")
    left = index.join(hit, ["path", "at"], "left_anti")
    old = written(opened(taken).select(*_KEY, "lon7", "lat7", "refs", "members", "tags"))
    done = written(applied_elements(old, state))
    kept = done.where("outcome <> 'deleted' and outcome <> 'absent'").drop("outcome")
    for name in ("places", "meta"):
        kept = kept.withColumn(name, F.lit(None).cast(pbf._spark_type(name)))
    kept = kept.where("osm_type <> 1 or (lon7 is not null and lat7 is not null)")
    parts = write_merged(kept, left, target, files, header).collect()  # a row for each part
    n = done.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("created", "modified", "deleted")]).first().asDict()
    blobs = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("elements"), F.lit(0)).alias("elements"), F.count_if(F.col("elements").isNull()).alias("mixed")).first()
    read = blobs["elements"] + (old.count() - (taken.agg(F.coalesce(F.sum("elements"), F.lit(0))).first()[0]) if blobs["mixed"] else 0)
    return {"read": read, "written": read + n["created"] - n["deleted"]} | n, {"blobs": blobs["n"], "opened": hit.count(), "copied": sum(p["copied"] for p in parts), "made": sum(p["made"] for p in parts)}
