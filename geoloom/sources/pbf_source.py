"""OSM PBF as a Spark data source, `osm_pbf`: filters on type and id and the columns asked for reach the blobs.

Reading: `osm_type` and `id` filters pass over blobs by the index fields of their frames; a schema of some columns leaves
the others undecoded. Writing: tasks write parts to a folder beside the target, and one rename in the commit makes them
the target, so it is whole or not there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from . import pbf


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def narrowed(wanted: pbf.Wanted, f) -> pbf.Wanted:
    """`wanted` under one more filter; filters that say nothing of types or ids change nothing."""
    column = getattr(f, "attribute", None)
    if column == ("osm_type",):
        types = {EqualTo: lambda: {f.value}, EqualNullSafe: lambda: {f.value}, In: lambda: set(f.value)}.get(type(f))
        if types is None and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            holds = {GreaterThan: lambda t: t > f.value, GreaterThanOrEqual: lambda t: t >= f.value, LessThan: lambda t: t < f.value, LessThanOrEqual: lambda t: t <= f.value}[type(f)]
            types = lambda: {t for t in (1, 2, 3) if holds(t)}
        return wanted if types is None else replace(wanted, types=frozenset(types() & (wanted.types or {1, 2, 3})) if wanted.types is not None else frozenset(types()))
    if column != ("id",):
        return wanted
    low, high = wanted.low, wanted.high
    if isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
        a = b = f.value
    elif isinstance(f, In) and [v for v in f.value if v is not None]:
        a, b = min(v for v in f.value if v is not None), max(v for v in f.value if v is not None)
    else:
        a = f.value + isinstance(f, GreaterThan) if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else None
        b = f.value - isinstance(f, LessThan) if isinstance(f, (LessThan, LessThanOrEqual)) else None
    return replace(wanted, low=a if low is None else low if a is None else max(a, low), high=b if high is None else high if b is None else min(b, high))


class PbfReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path, self.split = tuple(schema.names), options["path"], int(options.get("split_bytes", pbf.SPLIT_BYTES))
        self.wanted = pbf.ALL

    def pushFilters(self, filters):
        for f in filters:
            self.wanted = narrowed(self.wanted, f)
            yield f  # blobs are passed over whole, so Spark looks at the rows of the others

    def partitions(self) -> list[ByteRange]:
        fs, root = pbf.open_fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith(".pbf") and not i.base_name.startswith(("_", "."))]
        prefix = self.path[: self.path.index(root)] if root in self.path else ""
        return [ByteRange(f"{prefix}{i.path}", start, start + self.split) for i in sorted(found, key=lambda i: i.path) for start in range(0, max(i.size, 1), self.split)]

    def read(self, part: ByteRange):
        if self.wanted.types == frozenset():
            return
        for batch in pbf.elements_of(part.path, part.start, part.end, self.wanted, frozenset(self.columns), "position" in self.columns):
            yield batch.select(list(self.columns))


@dataclass
class Part(WriterCommitMessage):
    name: str
    elements: int
    partition: int


class PbfWriter(DataSourceArrowWriter):
    """Parts in a folder beside the target; the commit renames that folder."""

    def __init__(self, options: dict):
        self.target, self.locations = options["path"].rstrip("/"), options.get("locations", "false") == "true"
        self.header = pbf.file_header(options.get("program", "geoloom"), int(options["sequence"]) if "sequence" in options else None, self.locations, options.get("timestamp"), options.get("url"))
        self.folder = f"{self.target}.draft-{uuid.uuid4().hex}"
        fs, target = pbf.open_fs(self.target)
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            raise FileExistsError(self.target)

    def write(self, batches) -> Part:
        from pyspark import TaskContext

        fs, root = pbf.open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.part"  # each try has its own, and the commit names the one that counts
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(self.header)
            said = pbf.encoded((pa.RecordBatch.from_arrays([b.column(n).cast(t) for n, t in zip(pbf.COLUMNS, pbf.TYPES)], names=list(pbf.COLUMNS)) for b in batches), out)
        return Part(name, said["elements"], TaskContext.get().partitionId())

    def commit(self, messages) -> None:
        fs, root = pbf.open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        for i, m in enumerate(sorted((m for m in messages if m is not None and m.elements), key=lambda m: m.partition)):
            fs.move(f"{root}/{m.name}", f"{root}/part-{i:05d}.osm.pbf")
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.endswith(".part"):  # of tries that did not count, and empty ones
                fs.delete_file(info.path)
        target = pbf.open_fs(self.target)[1]
        try:
            if fs.get_file_info(target).type != pafs.FileType.NotFound:
                raise FileExistsError(self.target)
            fs.move(root, target)  # a folder with files in it isn't replaced
        except OSError:
            fs.delete_dir(root)
            raise

    def abort(self, messages) -> None:
        fs, root = pbf.open_fs(self.folder)
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir(root)


class PbfSource(DataSource):
    """Format `osm_pbf`. Options: path; reading split_bytes; writing program, sequence, timestamp, url and locations."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return pbf.SCHEMA

    def reader(self, schema: StructType) -> PbfReader:
        return PbfReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PbfWriter:
        if overwrite:
            raise ValueError("osm_pbf doesn't overwrite; name a new folder")
        if tuple(schema.names) != pbf.COLUMNS:
            raise ValueError("osm_pbf takes elements in order; see write_folder")
        return PbfWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and switch on that filters reach Python sources, as they do when a plan is made."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PbfSource)


def load(spark: SparkSession, path: str, columns: str | None = None, split_bytes: int = pbf.SPLIT_BYTES) -> DataFrame:
    """The elements of the PBF files at `path`, a file or folder; `columns` is a DDL of those wanted, in types of pbf.SCHEMA (and position)."""
    register(spark)
    reader = spark.read.format("osm_pbf").option("split_bytes", str(split_bytes))
    return (reader.schema(columns) if columns else reader).load(path)


def write_folder(elements: DataFrame, folder: str, files: int, locations: bool = False, **header) -> None:
    """Write elements as sorted part files that appear in `folder` all at once; a folder that is there is an error. `header`: sequence, timestamp, url, program."""
    register(elements.sparkSession)
    writer = pbf.in_order(elements, files, locations).write.format("osm_pbf").option("locations", str(locations).lower())
    for k, v in header.items():
        if v is not None:
            writer = writer.option(k, str(v))
    writer.mode("append").save(folder)
