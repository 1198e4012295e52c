"""Snapshots in blocks against a plain fold of all changes in order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import changes as CH
from geoloom.sources.files import CHANGE
from geoloom.streaming import snapshots as SN

ELEMENT = "osm_type int, id long, lon7 int, lat7 int, refs array<long>, members array<struct<osm_type: int, ref: long, role: string>>, tags array<struct<k: string, v: string>>"


def base_rows(n=400):
    return [(1, i, i, 0, None, None, None) for i in range(-20, n)] + [(2, i, None, None, [i, i + 1], None, None) for i in range(50)]


def edits(n, seed, objects=90, start=0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind, i = r.choice([1, 1, 1, 2]), r.randrange(-30, objects)
        action = r.choice(["create", "modify", "modify", "delete"])
        out.append((start + k // 7, k % 7, action, kind, i, r.choice([None, 1, 2, 3, 4, 5]), None if action == "delete" else 1000 + start * 7 + k, 0, [k] if kind == 2 else None, None, None))
    return out


def plain(base, changes):
    """The elements after all changes in order, by the rule of versions, one by one."""
    state = {(t, i): (None, lon) for t, i, lon, *_ in base}
    for _, _, action, t, i, version, lon, *_ in sorted(changes, key=lambda c: c[:2]):
        old = state.get((t, i))
        if old and old[0] is not None and version is not None and version < old[0]:
            continue
        state[t, i] = (version, None if action == "delete" else lon, action)
    return {k: v[1] for k, v in state.items() if v[2:] != ("delete",)}


def test_folds_of_folds(spark):
    for seed in range(3):
        rows = edits(300, seed, objects=12)
        parts = [spark.createDataFrame(p, CHANGE) for p in (rows[:90], rows[90:100], rows[100:])]
        together = SN.merged(parts[0].transform(SN.folded_state, 4).unionByName(SN.folded_state(parts[1], 4)).unionByName(SN.folded_state(parts[2], 4)))
        got = {(r.osm_type, r.id): (r.seq, r.ord, r.action, r.version, r.lon7) for r in together.collect()}
        want = {(r.osm_type, r.id): (r.seq, r.ord, r.action, r.version, r.lon7) for r in CH.folded_elements(spark.createDataFrame(rows, CHANGE)).collect()}
        assert got == want and len(want) > 30


def blocks_there(path, version):
    return sorted(d for d in os.listdir(f"{path}/blocks/v={version}") if d.startswith("block="))


def test_batches(spark, tmp_path):
    path, base = str(tmp_path / "s"), base_rows()
    n = SN.start(spark.createDataFrame(base, ELEMENT), path, bits=5, sequence=7).versions["-1"][0]
    assert n == len({(t, i >> 5) for t, i, *_ in base}) == len(blocks_there(path, -1))
    seen, applied, since = [], [], set()
    for k in range(6):
        new = edits(25, k, objects=40 if k % 2 else 90, start=100 * (k + 1))
        seen += new
        was = {d: os.stat(f"{path}/blocks/v=-1/{d}").st_mtime_ns for d in blocks_there(path, -1)}
        a = SN.apply_batch(spark, path, k, spark.createDataFrame(new, CHANGE), fanout=2, keep=10)
        applied.append(a)
        since |= {(c[3], c[4] >> 5) for c in new}
        assert (a.changed, a.touched) == (len({c[3:5] for c in new}), len({(c[3], c[4] >> 5) for c in new}))
        now = {(r.osm_type, r.id): r.lon7 for r in SN.current(spark, path).collect()}
        want = plain(base, seen)
        assert {k: v for k, v in now.items() if k[0] == 1} == {k: v for k, v in want.items() if k[0] == 1} and set(now) == set(want)
        assert {d: os.stat(f"{path}/blocks/v=-1/{d}").st_mtime_ns for d in blocks_there(path, -1)} == was  # what lies there stays as it is
        if a.written:
            assert a.written == len(since) == len(blocks_there(path, k)) and a.kept == a.blocks - a.written and a.read <= a.written
            since = set()
    assert [bool(a.written) for a in applied] == [False, False, False, True, False, False]
    assert SN.manifest(path).sequence == max(c[0] for c in seen)


def test_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "s")
    SN.start(spark.createDataFrame(base_rows(40), ELEMENT), path, bits=3)
    new = [spark.createDataFrame(edits(20, k, 40, 10 * (k + 1)), CHANGE) for k in range(4)]
    look = lambda: sorted((r.osm_type, r.id, r.lon7) for r in SN.current(spark, path).select("osm_type", "id", F.coalesce("lon7", F.lit(-1)).alias("lon7")).collect())
    for k in range(4):
        first = SN.apply_batch(spark, path, k, new[k], fanout=2)
        once = look()
        assert SN.apply_batch(spark, path, k, new[k], fanout=2) == first and look() == once


def test_a_batch_without_changes_and_one_of_new_elements(spark, tmp_path):
    path = str(tmp_path / "s")
    SN.start(spark.createDataFrame(base_rows(10), ELEMENT), path, bits=3, sequence=5)
    nothing = SN.apply_batch(spark, path, 0, spark.createDataFrame([], CHANGE))
    assert (nothing.changed, nothing.touched) == (0, 0) and SN.manifest(path).sequence == 5 and not SN.manifest(path).deltas
    far = [(9, 0, "create", 3, 10**9, 1, None, None, None, [(2, 1, "outer")], [("type", "route")])]
    for k in range(1, 6):
        SN.apply_batch(spark, path, k, spark.createDataFrame([(9 + k, *far[0][1:4], 10**9 + k, *far[0][5:])], CHANGE), fanout=2, levels=1, keep=1)
    got = SN.current(spark, path).where("osm_type = 3").collect()
    assert sorted(r.id for r in got) == [10**9 + k for k in range(1, 6)] and got[0].members[0].role == "outer"
    assert len(os.listdir(f"{path}/manifests")) - sum(n.startswith(".") for n in os.listdir(f"{path}/manifests")) == 2  # the last and one before it
    start = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        SN.current(spark, start)


def test_untouched_blocks_are_only_scanned(spark, tmp_path):
    path = str(tmp_path / "s")
    SN.start(spark.createDataFrame(base_rows(400), ELEMENT), path, bits=4)
    SN.apply_batch(spark, path, 0, spark.createDataFrame([(1, 0, "delete", 1, 17, 2, None, None, None, None, None)], CHANGE))
    plan = SN.current(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters") >= 2 and "NOT (block" in plan  # both halves name their folders
    assert SN.current(spark, path).count() == len(base_rows(400)) - 1
