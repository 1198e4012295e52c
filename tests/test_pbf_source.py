"""The PBF data source: what filters leave closed, and files that are whole or not there."""

import os
import random

import pyarrow as pa
import pytest
from conftest import spoiled
from pyspark.sql import functions as F

from geoloom.sources import pbf, pbf_source, single
from geoloom.sources import wire as W

ROW = "osm_type int, id long, lon7 int, lat7 int, tags array<struct<k:string,v:string>>, refs array<long>, members array<struct<osm_type:int,ref:long,role:string>>"


@pytest.fixture(scope="module")
def elements(spark):
    r = random.Random(5)
    rows = [(1, i, i * 10, -i, [("name", f"n{i}")] if i % 3 else [], None, None) for i in range(-50, 20_000)]
    rows += [(2, i, None, None, [("highway", "x")], [r.randrange(20_000) for _ in range(4)], None) for i in range(9000)] + [(3, i, None, None, [], None, [(2, i, "outer")]) for i in range(50)]
    return spark.createDataFrame(rows, ROW).repartition(4)


@pytest.fixture(scope="module")
def folder(spark, elements, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pbf") / "map")
    pbf_source.write_folder(elements, path, 3, sequence=12, url="http://a.example")
    return path


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_the_same_as_a_plain_read(spark, folder, elements):
    assert rows_of(pbf_source.load(spark, folder)) == rows_of(pbf.read(spark, folder)) and pbf.read(spark, folder).count() == elements.count()
    names = sorted(os.listdir(folder))
    assert names == [f"part-{i:05d}.osm.pbf" for i in range(3)] and pbf.read_header(f"{folder}/{names[0]}")["sequence"] == 12
    some = pbf_source.load(spark, folder, "id long, tags array<struct<k:string,v:string>>", split_bytes=5000).where("id < 100")
    assert rows_of(some) == rows_of(pbf.read(spark, folder).select("id", "tags").where("id < 100"))
    assert rows_of(pbf_source.load(spark, folder, "osm_type int, id long").where("osm_type in (2, 3) and id between 10 and 12")) == rows_of(elements.select("osm_type", "id").where("osm_type in (2, 3) and id between 10 and 12"))
    assert pbf_source.load(spark, folder).where("osm_type = 1 and osm_type = 2").count() == 0


def test_blobs_of_other_types_stay_closed(spark, folder, tmp_path):
    closed = str(tmp_path / "closed")
    spoiled(folder, closed, {1})
    want = pbf.read(spark, folder).where("osm_type = 2")
    got = pbf_source.load(spark, closed).where("osm_type = 2")
    assert rows_of(got) == rows_of(want) and rows_of(pbf_source.load(spark, closed).where("osm_type > 1").select("osm_type", "id")) == rows_of(pbf.read(spark, folder).where("osm_type > 1").select("osm_type", "id"))
    with pytest.raises(Exception, match="no blob"):
        pbf_source.load(spark, closed).count()


def test_blobs_of_other_ids_stay_closed(folder):
    names = [f"{folder}/{n}" for n in sorted(os.listdir(folder))]
    opened = lambda wanted: sum(payload is not None for n in names for *_, payload in pbf._blobs(n, 0, os.path.getsize(n), wanted))
    every = opened(pbf.ALL)
    assert every >= 6 and opened(pbf.Wanted(frozenset([2]), 100, 100)) == 1 and opened(pbf.Wanted(low=10**9)) == 0 and opened(pbf.Wanted(frozenset([2]))) < every


def test_filters_narrow():
    D = pbf_source
    of = lambda *filters: __import__("functools").reduce(D.narrowed, filters, pbf.ALL)
    t, i = ("osm_type",), ("id",)
    assert of(D.EqualTo(t, 2)).types == {2} and of(D.In(t, (1, 2)), D.GreaterThan(t, 1)).types == {2} and of(D.EqualTo(t, 2), D.EqualTo(t, 3)).types == frozenset()
    assert of(D.GreaterThan(i, 5), D.LessThanOrEqual(i, 9), D.LessThan(i, 9)) == pbf.Wanted(None, 6, 8) and of(D.In(i, (7, 3, None))) == pbf.Wanted(None, 3, 7)
    assert of(D.EqualTo(("lon7",), 1), D.EqualTo(("tags", "k"), 1)) == pbf.ALL and of(D.EqualTo(i, 4)) == pbf.Wanted(None, 4, 4)


def test_block_index(spark, folder, elements, tmp_path):
    index = pbf.blocks(spark, folder).collect()
    assert all(r.indexed for r in index) and sum(r.elements for r in index) == elements.count()
    bare = str(tmp_path / "bare")
    os.makedirs(bare)
    for name in os.listdir(folder):  # as another program writes it
        data = open(f"{folder}/{name}", "rb").read()
        with open(f"{bare}/{name}", "wb") as f:
            f.write(pbf.file_header())
            for _, _, _, payload in pbf._blobs(f"{folder}/{name}", 0, len(data)):
                f.write(pbf._frame(b"OSMData", payload))
    opened = pbf.blocks(spark, bare).collect()
    facts = lambda rows: sorted((r.osm_type, r.first_id, r.last_id, r.elements) for r in rows)
    assert not any(r.indexed for r in opened) and facts(opened) == facts(index)
    again = str(tmp_path / "again")
    pbf.with_index(spark, bare, again, split_bytes=40_000).collect()
    found = pbf.blocks(spark, again).collect()
    assert all(r.indexed for r in found) and facts(found) == facts(index) and rows_of(pbf.read(spark, again)) == rows_of(pbf.read(spark, folder))
    mixed = str(tmp_path / "mixed.osm.pbf")  # a blob of two types has no index, and is always opened
    two = W.block(1, W.block(1, b"")) + W.block(2, W.block(1, W.number(1, 8) + W.number(8, 2) + W.number(9, 4))) + W.block(2, W.block(3, W.number(1, 9)))
    open(mixed, "wb").write(pbf.file_header() + pbf._frame(b"OSMData", two))
    assert pbf.blocks(spark, mixed).first().osm_type is None and [r.id for r in pbf_source.load(spark, mixed).where("osm_type = 2").collect()] == [9]


def test_one_file_from_many_tasks(spark, elements, folder, tmp_path):
    path = str(tmp_path / "all.osm.pbf")
    said = pbf.write_file(elements, path, 5, sequence=3)
    head = pbf.read_header(path)
    assert head["box"] == said["box"] == (-500, -19_999, 199_990, 50) and head["sequence"] == 3 and os.path.getsize(path) == said["bytes"]
    assert rows_of(pbf.read(spark, path, split_bytes=30_000)) == rows_of(pbf.read(spark, folder)) and os.listdir(tmp_path) == ["all.osm.pbf"]
    keys = [(r[0], r[1]) for b in pbf.elements_of(path, 0, 1 << 40) for r in zip(b.column("osm_type").to_pylist(), b.column("id").to_pylist())]
    assert keys == sorted(keys)
    was = open(path, "rb").read()
    with pytest.raises(FileExistsError):
        pbf.write_file(elements, path, 2)
    assert open(path, "rb").read() == was and os.listdir(tmp_path) == ["all.osm.pbf"]
    empty = str(tmp_path / "none.osm.pbf")
    assert pbf.write_file(elements.limit(0), empty, 2) == {"elements": 0, "bytes": os.path.getsize(empty), "box": None} and pbf.read(spark, empty).count() == 0


def test_nothing_is_left_of_a_failure(spark, elements, tmp_path):
    bad = elements.withColumn("lon7", F.when(F.col("id") == 5000, F.raise_error(F.lit("broken"))).otherwise(F.col("lon7")))
    for write in (lambda p: pbf.write_file(bad, p, 4), lambda p: pbf_source.write_folder(bad, p, 4)):
        with pytest.raises(Exception):
            write(str(tmp_path / "x"))
        assert os.listdir(tmp_path) == []


def test_a_target_that_comes_meanwhile(spark, elements, tmp_path, monkeypatch):
    path = str(tmp_path / "a.pbf")
    publish = single.publish
    monkeypatch.setattr(single, "publish", lambda *a: (open(path, "w").write("theirs"), publish(*a)))
    with pytest.raises(FileExistsError):
        pbf.write_file(elements, path, 2)
    assert open(path).read() == "theirs" and os.listdir(tmp_path) == ["a.pbf"]
    with pytest.raises(Exception, match="FileExists|exists"):
        pbf_source.write_folder(elements, str(tmp_path), 2)
    with pytest.raises(ValueError, match="mounted"):
        pbf.write_file(elements, "hdfs://h/x.pbf", 2)


def test_positions_and_repeated_nodes(spark, tmp_path):
    meta = "meta struct<version:int,timestamp:long,changeset:long,uid:int,user:string>"
    rows = [(1, 1, 10, 10, None, None, None, (1, 0, 0, 0, "")), (1, 1, 20, 20, None, None, None, (2, 0, 0, 0, "")), (1, 2, 5, 5, None, None, None, None), (2, 7, None, None, None, [1, 2], None, None)]
    path = str(tmp_path / "m.pbf")
    pbf.write_file(spark.createDataFrame(rows, f"{ROW}, {meta}"), path, 1)
    got = pbf.read(spark, path, position=True)
    assert [r.lon7 for r in got.where("osm_type = 1 and id = 1").orderBy("position").collect()] == [10, 20]
    from geoloom.operators import features as B

    assert [[tuple(p) for p in r.points] for r in B.build(got).lines.collect()] == [] and [tuple(p) for p in B.way_lines(got.where("osm_type = 2").select("id", "refs"), B.nodes_of(got)).first().points] == [(20, 20), (5, 5)]
    batch = next(pbf.elements_of(path, 0, 1 << 40, position=True))
    assert isinstance(batch, pa.RecordBatch) and batch.schema.names[-1] == "position"
