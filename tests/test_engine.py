import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.functions import classify, mercator, style, tagfilter, text
from geoloom.operators import changes, entities, geometry, ways
from geoloom.plans import registry
from geoloom.streaming import replication

SF = "/root/testdata/sf0.001"


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
    else:
        assert len(got)


def tags(*pairs):
    return [{"k": k, "v": v} for k, v in pairs]


def test_tag_filters(spark):
    rows = [(1, tags(("shop", "bakery"), ("a", "b"))), (2, tags(("amenity", "restaurant"), ("name", "Joe's Pizza"))), (3, []), (4, tags(("a", "*"), ("addr:street", "x")))]
    df = spark.createDataFrame(rows, "id int, tags array<struct<k string, v string>>")
    ids = lambda f: [r.id for r in df.where(tagfilter.parse(f).column(F.col("tags"))).orderBy("id").collect()]
    assert ids("shop=* amenity=restaurant") == [1, 2]
    assert ids("name=\"Joe's Pizza\"") == [2]
    assert ids("a!=b") == [2, 3, 4]
    assert ids("!a") == ids("a!=*") == [2, 3]
    assert ids('a="*"') == [4] and ids('"addr:street"=*') == [4]
    for bad in ("", "=x", "a=", "!a=b", 'a="b'):
        with pytest.raises(tagfilter.FilterError):
            tagfilter.parse(bad)


def test_filter_texts():
    t = lambda k, v: tagfilter.TagFilter("tag", k, v)
    has = lambda k: tagfilter.TagFilter("exists", k)
    taken = {
        "website=http://x?a=b": t("website", "http://x?a=b"), "k=a!=b": t("k", "a!=b"), "k==v": t("k", "=v"), r'k="a\\b"': t("k", r"a\\b"), r'k="say \"hi\""': t("k", 'say "hi"'), 'k=""': t("k", ""), '"a b"': has("a b"),
        "k!=*": ~has("k"), '!"a=b"': ~has("a=b"), "k!==v": ~t("k", "=v"), "k=!v": t("k", "!v"), "  k  ": has("k"), "é=ü": t("é", "ü"), 'k="*"': t("k", "*"), "k=v\tm": t("k", "v") | has("m"),
    }
    assert {f: tagfilter.parse(f) for f in taken} == taken
    refused = {"": 0, "   ": 0, "=v": 0, "k=": 2, "ok key=": 7, 'k="open': 2, "!k=x": 2, "!k!=x": 2, "a!b": 2, "k!": 2, "k!=": 3, 'na"me=x': 2, 'k=a"b': 3, "!": 0, '"k"x': 3, "é=": 3}
    for f, at in refused.items():
        with pytest.raises(tagfilter.FilterError) as e:
            tagfilter.parse(f)
        assert e.value.offset == at, f


def test_classes(spark):
    rows = [(1, 1, tags(("waterway", "weir"), ("natural", "water"))), (1, 2, tags(("amenity", ""), ("amenity", "cafe"), ("amenity", "bank"))), (1, 3, tags(("landuse", "farm"), ("building", "no")))]
    got = classify.classified(spark.createDataFrame(rows, "osm_type int, id int, tags array<struct<k string, v string>>")).orderBy("id").collect()
    assert [(r.id, r.layer, r["class"], r.min_zoom) for r in got] == [(1, "water", "other", 13), (2, "amenity", "bank", 13), (3, "landuse", "farmland", 7)]
    area = spark.createDataFrame([("highway", "primary", None), ("highway", "services", None), ("natural", "cliff", None), ("boundary", "x", None), ("shop", "x", None), ("boundary", "x", "yes")], "k string, v string, a string")
    assert [r.x for r in area.select(classify.closed_way_is_area(F.col("k"), F.col("v"), F.col("a")).alias("x")).collect()] == [False, True, False, False, True, True]


def test_grid(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "x long, y long")
    assert [r.d for r in p.select(mercator.hilbert_id(1, F.col("x"), F.col("y")).alias("d")).collect()] == [1, 2, 3, 4]
    r = spark.range(1).select(mercator.fixed(F.lit(2.5e-7)).alias("a"), mercator.fixed(F.lit(-2.5e-7)).alias("b"), mercator.unit_y_to_lat(mercator.unit_y(F.lit(48.25))).alias("lat"), mercator.cell(F.lit(float("nan")), 4).alias("n")).first()
    assert (r.a, r.b, r.n) == (3, -3, 0) and abs(r.lat - 48.25) < 1e-9
    box = spark.range(1).select(*[c.alias(n) for c, n in zip(mercator.tile_bounds(F.lit(1), F.lit(0), F.lit(0)), "wsen")]).first()
    assert (box.w, box.e) == (-180, 0) and abs(box.s) < 1e-9 and abs(box.n - mercator.MAX_LATITUDE) < 1e-9


def test_style(spark):
    df = spark.createDataFrame([(1, {"a": "x", "n": " 12 "}, 5.0), (2, {"n": "abc"}, 11.0)], "id int, attrs map<string,string>, zoom double")
    value = lambda e, default: [r.v for r in df.select(style.property_column(e, F.col("attrs"), F.col("zoom"), default).alias("v")).collect()]
    assert value(["to-number", ["get", "n"]], -1.0) == [12.0, -1.0]
    assert value(["to-number", ["get", "missing"]], -1.0) == [0.0, 0.0]
    assert value(["interpolate", ["exponential", 2], ["zoom"], 5, 0, 11, 63], 0.0) == [0.0, 63.0]
    assert value(["coalesce", ["get", "a"], "d"], "") == ["x", "d"]
    holds = lambda e: [r.v for r in df.select(style.filter_column(e, F.col("attrs"), F.col("zoom")).alias("v")).collect()]
    assert holds(["==", ["get", "b"], None]) == [True, True]
    assert holds(["==", ["get", "a"], 1]) == [False, False]
    assert holds(["all"]) == [True, True] and holds(["any"]) == [False, False]
    assert holds(["!", ["get", "a"]]) == [False, False]
    with pytest.raises(style.StyleError):
        value(["rgb", 1, 2, 3], "")


def test_geometry():
    assert geometry.rdp_mask(np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], float), 0.1).tolist() == [True, False, True, True, True]
    parts = geometry.clip_line(np.array([[-1, 0.5], [2, 0.5], [2, 0.7], [0.5, 0.7]], float), (0, 0), (1, 1))
    assert [p.tolist() for p in parts] == [[[0, 0.5], [1, 0.5]], [[1, 0.7], [0.5, 0.7]]]
    ring = geometry.clip_ring(np.array([[-1, -1], [2, -1], [2, 2], [-1, 2], [-1, -1]], float), (0, 0), (1, 1))
    x, y = ring[:-1, 0], ring[:-1, 1]
    assert abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) == 2
    assert len(geometry.clip_ring(np.array([[5, 5], [6, 5], [6, 6], [5, 5]], float), (0, 0), (1, 1))) == 0
    px, py = geometry.interior_point(np.array([[0, 0], [4, 0], [4, 4], [2, 1], [0, 4], [0, 0]], float))
    assert 0 < px < 4 and 0 < py < 4


def test_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, f"N{i % 3}" if i % 2 else f"n{i % 3}", int(rng.integers(-40000, 40000)), int(rng.integers(-40000, 40000)), None, None, None, None, "a=b", False, {}) for i in range(200)]
    rows += [(1, 900 + i, "lost", None, None, None, None, None, None, "", False, {}) for i in range(3)]
    e = spark.createDataFrame(rows, "osm_type int, osm_id long, name string, lon7 long, lat7 long, address string, phone string, website string, operator string, tag_line string, has_category boolean, address_parts map<string,string>")
    got = {r.osm_id: r.kept for r in entities.deduplicated(e, 300.0).collect()}
    chord = 2 * math.sin(300.0 / entities.EARTH_RADIUS / 2)
    kept = {}
    for name in ("n0", "n1", "n2"):
        out = []
        for r in (r for r in rows if r[2].lower() == name):
            lon, lat = math.radians(r[3] / 1e7), math.radians(r[4] / 1e7)
            v = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
            kept[r[1]] = all(sum((a - b) ** 2 for a, b in zip(v, o)) >= chord * chord for o in out)
            if kept[r[1]]:
                out.append(v)
    kept |= {900: True, 901: False, 902: False}
    assert got == kept and 0 < sum(kept.values()) < len(kept)


def test_names():
    assert text.fold_name("  Straße\tX ") == text.fold_name("STRASSE x") == "strasse x"
    assert text.fold_name("İstanbul") == text.fold_name("istanbul")


def test_change_fold_with_missing_versions(spark):
    rows = [(1, 7, "create", 5, 10), (2, 7, "modify", 3, 11), (3, 7, "modify", None, 12), (4, 7, "modify", 1, 13), (5, 8, "delete", 2, None)]
    c = spark.createDataFrame(rows, "seq long, id long, action string, version int, value long")
    got = {r.id: (r.action, r.version, r.value) for r in changes.folded(c).collect()}
    assert got == {7: ("modify", 1, 13), 8: ("delete", 2, None)}


def test_ways(spark):
    refs = spark.createDataFrame([(1, p, n) for p, n in enumerate([1, 2, 3, 1])] + [(2, 0, 1), (2, 1, 99)], "way_id long, pos int, node_id long")
    nodes = spark.createDataFrame([(1, 0, 0), (2, 10, 0), (3, 10, 10)], "id long, lon7 long, lat7 long")
    got = {r.way_id: r for r in ways.located(refs, nodes).collect()}
    assert got[1].closed and got[1].missing == 0 and [p.lon7 for p in got[1].points] == [0, 10, 10, 0]
    assert not got[2].closed and got[2].missing == 1
    degree = ways.vertex_degrees(ways.odd_segments(ways.segments(refs), "way_id"), "way_id").collect()
    assert {(r.way_id, r.n_odd, r.first_odd) for r in degree} == {(1, 0, None), (2, 2, 1)}


def test_replication_stream(spark, tmp_path):
    source, state = str(tmp_path / "diffs"), str(tmp_path / "state")
    schema = "seq long, id long, action string, version int, value long"
    for part in ([(1, 1, "create", 1, 10), (2, 2, "create", 1, 20)], [(3, 1, "modify", 2, 11), (4, 2, "delete", 2, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        replication.follow(stream, state, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {(r.id, r.action, r.value) for r in replication.read_state(spark, state).collect()} == {(1, "modify", 11), (2, "delete", None)}


def test_file_order_takes_all_elements_in_many_tasks(spark, tmp_path):
    got = registry.queries()["file_order_all"](spark, SF).toPandas()
    every = registry.queries()["element_counts"](spark, SF).toPandas()
    assert sorted(got.place) == list(range(1, every.n.sum() + 1)) and got.id.max() >= 500
    rows = spark.range(-300, 300).selectExpr("cast(abs(id) % 3 + 1 as int) as osm_type", "id")
    done = changes.file_places(rows, str(tmp_path / "ranges"))
    want = sorted(((abs(i) % 3 + 1, i) for i in range(-300, 300)), key=lambda e: (e[0], e[1] >= 0, abs(e[1])))
    assert [(r.osm_type, r.id) for r in done.orderBy("place").collect()] == want
    assert len(list((tmp_path / "ranges").glob("part-*"))) > 1
    assert changes.file_places(rows.limit(0), str(tmp_path / "none")).count() == 0


def test_whole_queries_take_all_rows(spark):
    from geoloom.sources import tables

    q = registry.queries()
    n = tables.nodes(spark, SF).select("id", "lon7", "lat7").toPandas()
    got = q["bbox_overlap_all"](spark, SF).toPandas().set_index("box_id").hits.to_dict()
    assert got == {r.id: int((n.lon7.between(r.lon7, r.lon7 + 100000000) & n.lat7.between(r.lat7, r.lat7 + 50000000)).sum()) for r in n.itertuples()}
    asked = q["nearest_poi_all"](spark, SF).toPandas()
    assert set(asked.id) == set(n.id[n.id % 50 == 0])


def test_apply_all_changes_against_brute_force(spark):
    from geoloom.sources import tables

    state = {}
    for c in tables.changes(spark, SF).orderBy("seq").collect():
        old = state.get(c.id)
        if old is None or old.version is None or c.version is None or c.version >= old.version:
            state[c.id] = c
    assert any(c.version is None for c in state.values())
    base = {r.c_custkey for r in tables.read(spark, SF, "customer").collect()}
    want = {i: (i, "unchanged") for i in base}
    for i, c in state.items():
        gone = c.action == "delete"
        want[i] = (None if gone else c.value, ("deleted" if gone else "modified") if i in base else "absent" if gone else "created")
    got = registry.queries()["apply_changes_all"](spark, SF).collect()
    assert len(got) == len(want) and {r.id: (r.value, r.outcome) for r in got} == want
    stats = registry.queries()["apply_stats_all"](spark, SF).first().asDict()
    assert stats == {k: sum(o == k for _, o in want.values()) for k in ("created", "modified", "deleted", "unchanged")}
