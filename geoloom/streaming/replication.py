"""Replication as a stream: diffs in order fold into per-object state, and each micro-batch updates a snapshot once."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.changes import folded
from ..sources.files import CHANGE, read_diff
from ..sources.pbf import open_fs
from . import snapshots

STATE = "id long, seq long, action string, version int, value long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    system, root = open_fs(path)
    found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = [i.base_name for i in found if i.base_name.startswith("batch=")]
    done = system.get_file_info([f"{root}/{n}/_SUCCESS" for n in names])
    return sorted(int(n[6:]) for n, i in zip(names, done) if i.type == pafs.FileType.File)


def read_state(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The newest whole snapshot (before batch `below`, if given); empty if there is none."""
    done = [v for v in _versions(spark, path) if below is None or v < below]
    return spark.read.schema(STATE).parquet(f"{path}/batch={done[-1]}") if done else spark.createDataFrame([], STATE)


def follow(changes: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that folds streaming `changes` (seq, id, action, version, value) into snapshots under `path`.

    A batch reads the snapshot before it and writes its own by its id, so a repeated batch gives the same snapshot.
    """
    spark = changes.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        before = read_state(spark, path, batch_id)
        columns = ["seq", "id", "action", "version", "value"]
        state = folded(before.select(*columns).unionByName(batch.select(*columns)))
        state.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in STATE.split(", "))).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def diff_path(folder: str, sequence: int, end: str) -> str:
    return f"{folder.rstrip('/')}/{sequence // 1_000_000:03d}/{sequence // 1000 % 1000:03d}/{sequence % 1000:03d}.{end}"


def _there(paths: list[str]) -> list[bool]:
    if not paths:
        return []
    system, _ = open_fs(paths[0])
    return [i.type == pafs.FileType.File for i in system.get_file_info([open_fs(p)[1] for p in paths])]


def published(folder: str, after: int, most: int) -> list[tuple[int, str]]:
    """(sequence, path) of the diffs that follow `after` without a gap, at most `most`: the first one that isn't there ends them."""
    out: list[tuple[int, str]] = []
    while len(out) < most:
        batch = [after + len(out) + i + 1 for i in range(min(64, most - len(out)))]
        zipped, plain = ([diff_path(folder, s, e) for s in batch] for e in ("osc.gz", "osc"))
        for s, z, p, a, b in zip(batch, zipped, plain, _there(zipped), _there(plain)):
            if not a and not b:
                return out
            out.append((s, z if a else p))
    return out


class Diff(InputPartition):
    def __init__(self, sequence: int, path: str):
        self.sequence, self.path = sequence, path


class DiffReader(DataSourceStreamReader):
    """Offsets are sequence numbers. A batch takes the diffs that are there without a gap, `max_diffs` at most; one that isn't there yet ends it."""

    def __init__(self, options: dict):
        self.folder, self.start, self.most = options["path"], int(options["start"]), int(options.get("max_diffs", "1440"))
        self.at = self.start

    def initialOffset(self) -> dict:
        return {"sequence": self.start}

    def latestOffset(self) -> dict:
        found = published(self.folder, self.at, self.most)
        self.at = found[-1][0] if found else self.at
        return {"sequence": self.at}

    def partitions(self, start: dict, end: dict) -> list[Diff]:
        todo = published(self.folder, start["sequence"], end["sequence"] - start["sequence"])
        if len(todo) < end["sequence"] - start["sequence"]:
            raise ValueError(f"the diff after {start['sequence'] + len(todo)} has gone")
        self.at = max(self.at, end["sequence"])
        return [Diff(s, p) for s, p in todo]

    def read(self, partition: Diff):
        system, name = open_fs(partition.path)
        state = diff_path(self.folder, partition.sequence, "state.txt")
        if _there([state])[0]:
            with system.open_input_stream(open_fs(state)[1]) as f:
                says = [x.partition("=")[2].strip() for x in f.read().decode().splitlines() if x.partition("=")[0].strip() == "sequenceNumber"]
            if not says or says[-1] != str(partition.sequence):
                raise ValueError(f"the state file of sequence {partition.sequence} says {says[-1] if says else None}")
        with system.open_input_stream(name, compression=None) as f:
            yield from read_diff(f.read(), partition.sequence)


class DiffSource(DataSource):
    """Stream of the changes in a folder AAA/BBB/CCC.osc.gz, after the sequence `start`; options path, start, max_diffs."""

    @classmethod
    def name(cls) -> str:
        return "osm_diffs"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DiffReader:
        if "path" not in self.options or "start" not in self.options:
            raise ValueError("osm_diffs takes a path and the sequence to start from")
        return DiffReader(dict(self.options))


def diffs(spark: SparkSession, folder: str, start: int, max_diffs: int = 1440) -> DataFrame:
    """The stream of changes (see files.CHANGE) of the diffs after `start`."""
    spark.dataSource.register(DiffSource)
    return spark.readStream.format("osm_diffs").option("start", str(start)).option("max_diffs", str(max_diffs)).load(folder)


def snapshot(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The elements of the newest whole snapshot (before batch `below`, if given)."""
    return snapshots.current(spark, path, below)


def start_snapshot(elements: DataFrame, path: str, bits: int = snapshots.BITS) -> None:
    """Write the elements that diffs are to be applied to, as the snapshot before the first batch."""
    snapshots.start(elements, path, bits)


def follow_elements(changes: DataFrame, path: str, checkpoint: str, keep: int = 3, **trigger):
    """Start a query that applies streaming `changes` (see diffs) to the snapshot under `path` (see start_snapshot).

    A batch writes its folded changes beside the snapshot's blocks (see snapshots) and the last sequence into its
    manifest, in one commit, so a repeated batch gives the same snapshot; without changes the sequence stays.
    """
    spark = changes.sparkSession
    step = lambda batch, batch_id: snapshots.apply_batch(spark, path, batch_id, batch, keep=keep) and None
    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
