"""Changes applied to PBF files by the blobs they touch, against a plain application."""

import os
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import changes as CH
from geoloom.sources import pbf, pbf_update
from geoloom.sources.files import CHANGE
from conftest import spoiled

ROW = "osm_type int, id long, lon7 int, lat7 int, tags array<struct<k:string,v:string>>, refs array<long>, members array<struct<osm_type:int,ref:long,role:string>>"
EMPTY = (None, None, None)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("base") / "b")
    rows = [(1, i, i, -i, [("n", str(i))], None, None) for i in range(-100, 60_000, 2)] + [(2, i, None, None, [], [i, i + 2], None) for i in range(20_000)] + [(3, i, None, None, [], None, [(2, i, "")]) for i in range(30)]
    pbf.write(spark.createDataFrame(rows, ROW), path, 3).collect()
    return path


def edit(seq, action, kind, i, version=1, lon=7, refs=None):
    return (seq, 0, action, kind, i, version, lon if kind == 1 else None, lon if kind == 1 else None, refs, None, None)


def content(df):
    return {(r.osm_type, r.id): (r.lon7, r.lat7, tuple(r.refs or ()), tuple(r.members or ())) for r in df.select("osm_type", "id", "lon7", "lat7", "refs", "members").collect()}


def plain(spark, base, state):
    done = CH.applied_elements(pbf.read(spark, base), state)
    return done.where("outcome not in ('deleted', 'absent')"), done


CASES = {
    "few": [edit(1, "modify", 1, 30_000), edit(2, "delete", 1, 30_004), edit(3, "create", 1, 30_001), edit(4, "modify", 2, 5, refs=[1, 2])],
    "beyond": [edit(1, "create", 1, 10**9), edit(2, "create", 1, -5000), edit(3, "create", 2, 10**12, refs=[4]), edit(4, "create", 3, 77), edit(5, "delete", 1, 99_999_999)],
    "whole blob": [edit(i, "delete", 2, i) for i in range(20_000)] + [edit(1, "modify", 1, 0)],
    "nothing": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("files", [1, 4])
def test_update_by_blobs(spark, base, tmp_path, case, files):
    state = CH.folded_elements(spark.createDataFrame(CASES[case], CHANGE))
    target = str(tmp_path / "t")
    stats, blobs = pbf_update.update(spark, base, state, target, files, pbf.file_header(sequence=5))
    want, done = plain(spark, base, state)
    assert content(pbf.read(spark, target)) == content(want) and stats == CH.update_stats(done).first().asDict()
    index = pbf.blocks(spark, base).collect()
    near = {(r.path, r.at) for r in index for c in CASES[case] if c[3] == r.osm_type and r.first_id <= c[4] <= r.last_id}
    assert (blobs["blobs"], blobs["opened"], blobs["copied"]) == (len(index), len(near), len(index) - len(near))
    assert all(r.indexed for r in pbf.blocks(spark, target).collect())
    keys = [(r[0], r[1]) for n in sorted(os.listdir(target)) for b in pbf.elements_of(f"{target}/{n}", 0, 1 << 40) for r in zip(b.column("osm_type").to_pylist(), b.column("id").to_pylist())]
    assert keys == sorted(keys)


def test_blobs_that_nothing_touches_stay_closed(spark, base, tmp_path):
    """They are copied byte for byte, broken ones too."""
    closed, target = str(tmp_path / "closed"), str(tmp_path / "t")
    spoiled(base, closed, {2, 3})
    state = CH.folded_elements(spark.createDataFrame(CASES["few"][:3], CHANGE))
    _, blobs = pbf_update.update(spark, closed, state, target, 2, pbf.file_header())
    assert blobs["opened"] == 1
    raw = lambda path: sorted(open(f"{path}/{n}", "rb").read()[at : at + size] for n in os.listdir(path) for at, size, index, _ in pbf._blobs(f"{path}/{n}", 0, 1 << 40, opened=False) if index[0] > 1)
    assert raw(target) == raw(closed)
    again = str(tmp_path / "again")
    with pytest.raises(Exception, match="no blob"):
        pbf_update.update(spark, closed, CH.folded_elements(spark.createDataFrame(CASES["few"], CHANGE)), again, 2, pbf.file_header())


@pytest.mark.parametrize("seed", range(3))
def test_as_of(spark, seed):
    r = random.Random(seed)
    marks = sorted({(r.randint(1, 3), r.randrange(300)) for _ in range(r.choice([1, 5, 60]))})
    rows = [(r.randint(1, 3), r.randrange(-5, 300)) for _ in range(400)]
    got = pbf_update.as_of(spark.createDataFrame(rows, "osm_type int, id long"), spark.createDataFrame([(*m, m[0] * 1000 + m[1]) for m in marks], "osm_type int, id long, v long"), "v").collect()
    want = lambda k: max((m for m in marks if m <= k), default=None)
    assert sorted((x.osm_type, x.id) for x in got) == sorted(rows)
    assert all(x.v == (lambda m: m and m[0] * 1000 + m[1])(want((x.osm_type, x.id))) for x in got)


def test_a_blob_of_several_types_is_opened(spark, tmp_path):
    from geoloom.sources import wire as W

    two = W.block(1, W.block(1, b"")) + W.block(2, W.block(1, W.number(1, 8) + W.number(8, 2) + W.number(9, 4))) + W.block(2, W.block(3, W.number(1, 9)))
    os.makedirs(tmp_path / "m")
    (tmp_path / "m" / "a.osm.pbf").write_bytes(pbf.file_header() + pbf._frame(b"OSMData", two))
    stats, blobs = pbf_update.update(spark, str(tmp_path / "m"), CH.folded_elements(spark.createDataFrame([edit(1, "create", 1, 1)], CHANGE)), str(tmp_path / "t"), 1, pbf.file_header())
    assert blobs["opened"] == 1 and stats["read"] == 2 and {(x.osm_type, x.id) for x in pbf.read(spark, str(tmp_path / "t")).collect()} == {(1, 1), (1, 4), (2, 9)}
    assert pbf.read(spark, str(tmp_path / "t")).where(F.col("osm_type") == 2).count() == 1
