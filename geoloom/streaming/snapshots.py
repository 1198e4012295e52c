"""Snapshots of map elements that are merged on read.

The elements lie in blocks, each the ids of one type that agree in all but their low bits, as Parquet partitioned by
block. A batch of changes is folded and written beside them, so what a batch costs grows with its changes. A reader joins
only the blocks that changes touch and scans the others. Deltas of one level are merged into one of the next when there
are several; those of the last level are merged into the blocks they touch, which are written anew, while all other
blocks stay the files they are. A manifest names what belongs to the snapshot after each batch; it is written last, and
a repeated batch writes the same under the same names.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import fold
from ..sources.pbf import open_fs

CONTENT = ["lon7", "lat7", "refs", "members", "tags"]
ELEMENT = ["osm_type", "id", *CONTENT]
#: An element's state: the change that holds, and where its last change without a version stood.
STATE = (
    "osm_type int, id long, seq long, ord int, action string, version long, lon7 int, lat7 int, refs array<long>, members array<struct<osm_type: int, ref: long, role: string>>, "
    "tags array<struct<k: string, v: string>>, bare struct<seq: long, ord: int>, block long"
)
#: Low bits of the ids of one block; deltas of one level that are merged; levels of deltas.
BITS, FANOUT, LEVELS = 20, 4, 2
#: Touched blocks up to which a reader names their folders; more are joined.
NAMED = 10_000


@dataclass
class Manifest:
    """What a snapshot consists of after `batch`: deltas as [level, folder, blocks touched], `versions` of blocks with how many of each are live and were written."""

    batch: int
    bits: int
    sequence: int | None
    table: str
    deltas: list = field(default_factory=list)
    versions: dict = field(default_factory=dict)


@dataclass
class Applied:
    """What a batch did: objects changed, blocks there are, touched by it, read and written anew, and left as they are."""

    batch: int
    changed: int
    blocks: int
    touched: int
    read: int
    written: int
    kept: int


def block_of(bits: int, osm_type: Column | None = None, id_: Column | None = None) -> Column:
    osm_type, id_ = F.col("osm_type") if osm_type is None else osm_type, F.col("id") if id_ is None else id_
    return (F.shiftleft(osm_type.cast("long"), 58) + F.shiftright(id_.cast("long"), bits)).cast("long")


def _typed(df: DataFrame) -> DataFrame:
    have = df.columns
    from pyspark.sql.types import StructType

    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(STATE)))


def folded_state(changes: DataFrame, bits: int) -> DataFrame:
    """The state of each object that `changes` (files.CHANGE) name, by these changes alone."""
    return _typed(fold(changes, ["osm_type", "id"], ["seq", "ord"], CONTENT, bare="bare").withColumn("block", block_of(bits)))


def merged(states: DataFrame) -> DataFrame:
    """One state for each object of several, as if all their changes had been folded at once.

    What is before an object's last change without a version doesn't count; of the rest the highest version holds, of
    equal ones the last, and without any that change itself.
    """
    place = F.struct("seq", "ord")
    own = Window.partitionBy("osm_type", "id")
    after = states.withColumn("bare", F.max("bare").over(own)).where(F.col("bare").isNull() | (place >= F.col("bare")))
    rows = F.struct(*[c for c in states.columns if c not in ("osm_type", "id")])
    best = after.groupBy("osm_type", "id").agg(F.max_by(rows, F.struct(F.col("version").isNotNull(), "version", place)).alias("s"))
    return best.select("osm_type", "id", "s.*").select(*states.columns)


def _manifests(path: str) -> list[int]:
    fs, root = open_fs(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return sorted(int(i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json") and not i.base_name.startswith("_"))


def manifest(path: str, below: int | None = None) -> Manifest:
    """The newest manifest (before batch `below`, if given)."""
    done = [v for v in _manifests(path) if below is None or v < below]
    if not done:
        raise FileNotFoundError(f"no snapshot in {path}")
    fs, root = open_fs(path)
    with fs.open_input_stream(f"{root}/manifests/{done[-1]}.json") as f:
        return Manifest(**json.loads(f.read()))


def _publish(path: str, m: Manifest) -> None:
    fs, root = open_fs(path)
    fs.create_dir(f"{root}/manifests", recursive=True)
    draft, name = f"{root}/manifests/_{m.batch}.draft", f"{root}/manifests/{m.batch}.json"
    with fs.open_output_stream(draft) as f:
        f.write(json.dumps(asdict(m)).encode())
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)  # of an earlier try of this batch
    fs.move(draft, name)


def _write_blocks(states: DataFrame, path: str, version: int) -> None:
    """States as one sorted file for each block; a block has no more rows than ids."""
    states.repartition("block").sortWithinPartitions("block", "osm_type", "id").write.mode("overwrite").partitionBy("block").parquet(f"{path}/blocks/v={version}")


def _version(spark: SparkSession, path: str, version: int | str) -> DataFrame:
    return _typed(spark.read.schema(STATE).parquet(f"{path}/blocks/v={version}"))


def start(elements: DataFrame, path: str, bits: int = BITS, sequence: int | None = None) -> Manifest:
    """Write elements as the snapshot before the first batch (batch -1); an element counts as a change before all others."""
    spark = elements.sparkSession
    first = F.struct(F.lit(-1).cast("long").alias("seq"), F.lit(-1).alias("ord"))
    states = elements.select(*ELEMENT, F.lit(-1).alias("seq"), F.lit(-1).alias("ord"), F.lit("create").alias("action"), first.alias("bare"), block_of(bits).alias("block"))
    _write_blocks(_typed(states), path, -1)
    table = f"{path}/tables/{-1}"
    _version(spark, path, -1).groupBy("block").agg(F.count("*").alias("rows")).select("block", F.lit(-1).cast("long").alias("v"), "rows").write.mode("overwrite").parquet(table)
    n = spark.read.parquet(table).count()
    m = Manifest(-1, bits, sequence, table, versions={"-1": [n, n]})
    _publish(path, m)
    return m


def _base(spark: SparkSession, path: str, m: Manifest) -> DataFrame:
    """The states in the live blocks of a snapshot, without its deltas."""
    out = spark.createDataFrame([], STATE)
    for v, (live, written) in m.versions.items():
        if live:
            rows = _version(spark, path, v)
            own = spark.read.parquet(m.table).where(F.col("v") == int(v)).select("block")
            out = out.unionByName(rows if live == written else rows.join(F.broadcast(own) if live <= NAMED else own, "block", "left_semi"))
    return out


def _deltas(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(STATE).parquet(*folders) if folders else spark.createDataFrame([], STATE)


def _split(base: DataFrame, changes: DataFrame, touched: int) -> tuple[DataFrame, DataFrame]:
    """(rows of `base` in blocks that `changes` touch, the others); of few blocks the folders are named, so the others' stay closed."""
    if touched <= NAMED:
        blocks = [r["block"] for r in changes.select("block").distinct().collect()]  # no more than `touched`
        return base.where(F.col("block").isin(blocks)), base.where(~F.col("block").isin(blocks)) if blocks else base
    blocks = changes.select("block").distinct()
    return base.join(blocks, "block", "left_semi"), base.join(blocks, "block", "left_anti")


def states(spark: SparkSession, path: str, m: Manifest) -> DataFrame:
    """The state of every object, deleted ones too: touched blocks merged with the deltas, the others as they lie."""
    base = _base(spark, path, m)
    if not m.deltas:
        return base
    deltas = _deltas(spark, [d[1] for d in m.deltas])
    hot, cold = _split(base, deltas, sum(d[2] for d in m.deltas))
    return cold.unionByName(merged(hot.unionByName(deltas)))


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The elements of the newest snapshot (before batch `below`, if given)."""
    return states(spark, path, manifest(path, below)).where("action <> 'delete'").select(*ELEMENT)


def apply_batch(spark: SparkSession, path: str, batch: int, changes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, keep: int = 3) -> Applied:
    """Bring the snapshot before `batch` up to date with `changes` (files.CHANGE), as the snapshot of `batch`.

    The changes become a delta; levels that are full are merged, the last one into the blocks it touches. Of what older
    snapshots alone consist of, that of the last `keep` stays.
    """
    was = manifest(path, batch)
    new = f"{path}/deltas/{batch}-0"
    folded_state(changes, was.bits).write.mode("overwrite").parquet(new)
    said = spark.read.schema(STATE).parquet(new).agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks"), F.max("seq").alias("seq")).first()
    last = changes.agg(F.max("seq")).first()[0]
    m = Manifest(batch, was.bits, was.sequence if last is None else last, was.table, [*was.deltas, [0, new, said["blocks"]]] if said["n"] else was.deltas, was.versions)
    total = sum(live for live, _ in was.versions.values())
    done = Applied(batch, said["n"], total, said["blocks"], 0, 0, total)
    for level in range(levels):
        own = [d for d in m.deltas if d[0] == level]
        if len(own) < fanout:
            continue
        if level + 1 < levels:
            folder = f"{path}/deltas/{batch}-{level + 1}"
            merged(_deltas(spark, [d[1] for d in own])).write.mode("overwrite").parquet(folder)
            blocks = spark.read.schema(STATE).parquet(folder).select("block").distinct().count()
            m.deltas = [d for d in m.deltas if d[0] != level] + [[level + 1, folder, blocks]]
        else:
            done = _compact(spark, path, m, done)
    _publish(path, m)
    _sweep(path, batch, keep)
    return done


def _compact(spark: SparkSession, path: str, m: Manifest, done: Applied) -> Applied:
    """Merge all deltas into the blocks they touch."""
    deltas = _deltas(spark, [d[1] for d in m.deltas])
    hot, _ = _split(_base(spark, path, m), deltas, sum(d[2] for d in m.deltas))
    _write_blocks(merged(hot.unionByName(deltas)), path, m.batch)
    fresh = _version(spark, path, m.batch).groupBy("block").agg(F.count("*").alias("rows")).select("block", F.lit(m.batch).cast("long").alias("v"), "rows")
    old = spark.read.parquet(m.table)
    table = f"{path}/tables/{m.batch}"
    old.join(fresh.select("block"), "block", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(table)
    live = {r["v"]: r["n"] for r in spark.read.parquet(table).groupBy("v").agg(F.count("*").alias("n")).collect()}  # a row for each compaction
    read = old.join(fresh.select("block"), "block", "left_semi").count()
    written = live.get(m.batch, 0)
    m.versions = {v: [live.get(int(v), 0), n] for v, (_, n) in m.versions.items() if live.get(int(v), 0)} | {str(m.batch): [written, written]}
    m.table, m.deltas = table, []
    return Applied(done.batch, done.changed, sum(live.values()), done.touched, read, written, sum(live.values()) - written)


def _sweep(path: str, batch: int, keep: int) -> None:
    """Delete manifests before the last `keep`, and the deltas, tables and versions of blocks that no manifest names any more."""
    fs, root = open_fs(path)
    every = [v for v in _manifests(path) if v <= batch]
    old, held = every[: -keep - 1], every[-keep - 1 :]
    if not old:
        return
    read = lambda v: manifest(path, v + 1)
    names = lambda m: {*(d[1] for d in m.deltas), m.table, *(f"{path}/blocks/v={v}" for v in m.versions)}
    live = set().union(*(names(read(v)) for v in held))
    for v in old:
        for name in names(read(v)) - live:
            own = open_fs(name)[1]
            if fs.get_file_info(own).type != pafs.FileType.NotFound:
                fs.delete_dir(own)
        fs.delete_file(f"{root}/manifests/{v}.json")
    for level in range(1, LEVELS + 1):  # deltas that were merged in the batch that wrote them are in no manifest
        for v in old:
            own = f"{root}/deltas/{v}-{level - 1}"
            if f"{path}/deltas/{v}-{level - 1}" not in live and fs.get_file_info(own).type != pafs.FileType.NotFound:
                fs.delete_dir(own)
