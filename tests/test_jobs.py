import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from geoloom import jobs
from geoloom.operators import entities as E
from geoloom.operators import features as B
from geoloom.operators import render as R
from geoloom.operators import tiles as TI
from geoloom.sources import files as FI
from geoloom.sources import pbf as PBF
from geoloom.sources import pmtiles as PM

ELEMENT = "osm_type int, id long, lon7 int, lat7 int, tags array<struct<k:string,v:string>>, refs array<long>, members array<struct<osm_type:int,ref:long,role:string>>"


def tags(**kv):
    return [(k.replace("__", ":"), v) for k, v in kv.items()]


def node(i, x, y, **kv):
    return (1, i, int(x * 1e5), int(y * 1e5), tags(**kv), None, None)


def way(i, refs, **kv):
    return (2, i, None, None, tags(**kv), refs, None)


def relation(i, members, **kv):
    return (3, i, None, None, tags(**kv), None, members)


def town():
    """18 nodes, 6 ways and 4 relations: a cafe, a road, a school that is a building too, a roundabout, a way that misses a node, a grass area with a hole, an area that misses a way, a route and a named site."""
    square = lambda at, x, y, s: [node(at, x, y), node(at + 1, x + s, y), node(at + 2, x + s, y + s), node(at + 3, x, y + s)]
    rows = [node(1, 5, 5, amenity="cafe", name="Café Ünïcode", contact__phone="+1 2", website="https://c"), node(2, 0, 0), node(3, 10, 0), node(4, 20, 10)]
    rows += square(10, 100, 100, 10) + square(20, 200, 100, 40) + square(30, 210, 110, 10) + [node(40, 300, 0), (1, 41, 1_900_000_000, 0, tags(shop="x"), None, None)]
    rows += [way(10, [2, 3, 4], highway="primary", name="=Main"), way(11, [10, 11, 12, 13, 10], amenity="school", building="yes", name="School"), way(12, [2, 3, 4, 2], highway="primary", junction="roundabout")]
    rows += [way(13, [2, 999, 3], highway="residential", name="Broken"), way(20, [20, 21, 22, 23, 20]), way(21, [30, 31, 32, 33, 30])]
    rows += [relation(100, [(2, 20, "outer"), (2, 21, "inner"), (2, 20, "outer")], type="multipolygon", landuse="grass", name="Meadow"), relation(101, [(2, 22, "outer")], type="multipolygon", landuse="grass")]
    rows += [relation(102, [(2, 10, "")], type="route", highway="primary"), relation(103, [(1, 1, ""), (1, 2, ""), (2, 13, "")], type="site", name="Site")]
    return rows


@pytest.fixture(scope="module")
def town_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("town") / "map")
    PBF.write(spark.createDataFrame(town(), ELEMENT), folder, 2, sequence=100, url="https://a.example/day").collect()
    return folder


def test_inspect(spark, town_folder):
    counts, layers = jobs.inspect(spark, town_folder)
    assert counts.first().asDict() == {
        "nodes": 18, "ways": 6, "relations": 4, "invalid_nodes": 1, "features": 6, "incomplete_ways": 1, "area_relations": 2, "assembled": 1, "incomplete": 1, "invalid": 0, "role_mismatches": 0,
    }
    assert {r.layer: r.n for r in layers.collect()} == {"amenity": 2, "building": 1, "highway": 2, "landuse": 1}
    assert jobs.inspect_lines(spark, town_folder)[0].split() == ["nodes", "18"]


def test_features(spark):
    elements = spark.createDataFrame(town(), ELEMENT)
    built = B.build(elements)
    got = {(r.osm_type, r.id, r.layer): r for r in built.features.collect()}
    assert {k: r.kind for k, r in got.items()} == {(1, 1, "amenity"): 1, (2, 10, "highway"): 2, (2, 12, "highway"): 2, (2, 11, "amenity"): 3, (2, 11, "building"): 3, (3, 100, "landuse"): 3}
    area = got[3, 100, "landuse"]
    assert [len(r) for r in area.shape[0]] == [5, 5] and {t.k for t in area.tags} == {"landuse", "name"}
    assert {(r.relation_id, r.status) for r in built.relations.collect()} == {(100, "ok"), (101, "incomplete")}
    more = {(r.osm_type, r.id): r for r in B.build(elements, keep_available=True).features.collect()}
    assert len(more[2, 13].shape[0][0]) == 2
    only = B.build(elements, jobs.tag_condition("highway amenity", "junction"), {"highway"}).features.collect()
    assert [(r.id, r.layer) for r in only] == [(10, "highway")]
    box = B.bounds(built.features).first()
    assert (box.min_lon, box.max_lat) == (0.0, 1.4)


def test_nodes_of_repeated_ids(spark):
    rows = spark.createDataFrame([(1, 1, 10, 10, 1), (1, 1, 20, 20, 2), (1, 2, 5, 5, 1), (1, 3, 1_900_000_000, 0, 1)], "osm_type int, id long, lon7 int, lat7 int, seq int")
    assert sorted(map(tuple, B.nodes_of(rows, "seq").collect())) == [(1, 20, 20), (2, 5, 5)]


def test_places_on_ways(spark):
    rows = [(1, [1, 2, 3, 1], [(0, 0), (10, 0), (10, 10), (0, 0)]), (2, [1, 2], [(0, 0), (2**31 - 1, 0)]), (3, [1, 2], [(0, 0)]), (4, [1, 2], None), (5, None, None)]
    ways = spark.createDataFrame(rows, "id long, refs array<long>, places array<struct<lon7:int,lat7:int>>")
    got = {r.way_id: (r.n_refs, r.missing, r.closed, len(r.points)) for r in B.way_lines_stored(ways).collect()}
    assert got == {1: (4, 0, True, 4), 2: (2, 1, False, 1), 3: (2, 1, False, 1), 4: (2, 2, False, 0), 5: (0, 0, False, 0)}


def test_attributes(spark):
    rows = [
        ("water", "lake", tags(natural="water", water="pond", name="W", source="x")), ("water", "other", [("waterway", ""), ("water", "pond")]), ("highway", "other", tags(highway="alley", ref="A1", cuisine="c", surface="s")),
        ("shop", "bakery", [("class", "z"), ("shop", "bakery"), ("addr:city", "C")]),
    ]
    df = spark.createDataFrame(rows, "layer string, name string, tags array<struct<k:string,v:string>>")
    got = lambda mode: [[tuple(t) for t in r.a] for r in df.select(B.attributes(F.col("tags"), F.col("layer"), F.col("name"), mode).alias("a")).collect()]
    assert got("curated") == [[("class", "pond"), ("name", "W")], [("class", "")], [("class", "alley"), ("ref", "A1"), ("cuisine", "c")], [("class", "bakery"), ("addr:city", "C")]]
    assert got("all")[3] == [("class", "bakery"), ("shop", "bakery"), ("addr:city", "C")]


def test_tiles(spark, town_folder, tmp_path):
    archive = str(tmp_path / "tiles")
    made = jobs.generate_tiles(spark, town_folder, archive, "10-14", name="town")
    with pytest.raises(FileExistsError):
        jobs.generate_tiles(spark, town_folder, archive, "10-14")
    features = R.decoded(PM.read(spark, archive)).cache()
    summary = {r.z: r for r in made.summary.collect()}
    assert {z: r.features for z, r in summary.items()} == {r.z: r["count"] for r in features.groupBy("z").count().collect()} and all(r.dropped == 0 and r.bytes > 0 for r in summary.values())
    found = {(r.layer, r.id) for r in features.select("layer", "id").distinct().collect()}
    assert found == {("amenity", 11), ("highway", 102), ("highway", 122), ("amenity", 112), ("building", 112), ("landuse", 1003)}
    assert features.where("layer = 'highway' and id = 102").first().attrs == {"class": "primary", "name": "=Main"}
    document = json.loads(made.metadata)
    layers = {x["id"]: x for x in document["vector_layers"]}
    assert (document["name"], document["format"], document["type"]) == ("town", "pbf", "baselayer") and set(layers) == {"amenity", "highway", "building", "landuse"}
    assert layers["amenity"] == {"id": "amenity", "fields": {"class": "String", "contact:phone": "String", "name": "String", "website": "String"}, "minzoom": 13, "maxzoom": 14}
    back = R.to_geographic(features.where("layer = 'landuse' and z = 14")).collect()
    for r in back:
        for i, ring in enumerate(r.shape[0]):
            area = sum(a.lon * b.lat - b.lon * a.lat for a, b in zip(ring[:-1], ring[1:]))
            assert (area > 0) == (i == 0) and all(1.99 < p.lon < 2.41 and 0.99 < p.lat < 1.41 for p in ring)
    assert "landuse" not in {r.layer for r in R.decoded(PM.read(spark, archive)).where("z < 7").collect()}


def test_sizes_and_draw_order(spark):
    line = lambda y, bend: [(0, y), (400_000, y + bend), (800_000, y)]
    rows = [(2, i, "highway", 0, imp, 2, [[[(x, y) for x, y in line(i * 1000, 0)]]], {"n": str(i)}) for i, imp in ((1, 5), (2, 9), (3, 7))] + [(1, 4, "building", 0, 1, 1, [[[(10, 10)]]], {})]
    df = spark.createDataFrame(rows, f"osm_type int, id long, layer string, min_zoom int, importance int, kind int, shape {B.SHAPE}, attrs map<string,string>")
    shown = R.decoded(R.assemble(R.render(df, 9, 9))).collect()
    tile = max({(r.z, r.x, r.y) for r in shown}, key=lambda t: sum((r.z, r.x, r.y) == t for r in shown))
    assert [(r.layer, r.id) for r in shown if (r.z, r.x, r.y) == tile and r.layer == "highway"] == [("highway", 12), ("highway", 32), ("highway", 22)]


def test_entities(spark, town_folder, tmp_path):
    found = jobs.extract(spark, town_folder, exclude="highway=residential")
    got = {(r.osm_type, r.osm_id): r for r in found.collect()}
    assert set(got) == {(1, 1), (2, 10), (2, 11), (3, 100), (3, 103)}
    assert (got[2, 11].lon7, got[2, 11].lat7) == (10_500_000, 10_500_000)
    assert got[2, 10].lon7 == 1_146_447 and got[2, 10].lat7 == 146_447  # half of 10 + sqrt(200) along
    meadow = got[3, 100]
    assert 20_000_000 < meadow.lon7 < 24_000_000 and not (21_000_000 < meadow.lon7 < 22_000_000 and 11_000_000 < meadow.lat7 < 12_000_000)
    assert (got[3, 103].lon7, got[3, 103].lat7) == (250_000, 250_000)  # nodes 1 and 2; the way isn't whole
    assert got[1, 1].phone == "+1 2" and got[1, 1].website == "https://c"
    inside = jobs.extract(spark, town_folder, bbox="0,0,1,1")
    assert {(r.osm_type, r.osm_id) for r in inside.collect()} == {(1, 1), (2, 10), (3, 103), (2, 13)}
    lost = spark.createDataFrame([(3, 7, "L", None, None, "", None, None, None, "a=b", False, {"addr_city": "C"})], found.schema)
    every = found.unionByName(lost)
    for kind in ("csv", "json", "geojson"):
        jobs.write_entities(every, str(tmp_path / f"out.{kind}"))
        with pytest.raises(Exception, match="exist"):
            jobs.write_entities(every, str(tmp_path / f"out.{kind}"))
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out.csv")).collect()
    assert rows[0].asDict().keys() == {"name", "type", "id", "lat", "lon", "address", "phone", "website", "operator", "tags"}
    by_id = {(r.type, r.id): r for r in rows}
    assert by_id["way", "10"].name == "'=Main" and by_id["node", "1"].lat == "0.0500000" and by_id["relation", "7"].lat is None
    parts = [open(os.path.join(tmp_path / "out.json", f)).read() for f in sorted(os.listdir(tmp_path / "out.json")) if f.startswith("part")]
    objects = [o for p in parts if p for o in json.loads(p)]
    assert {(o["osm_type"], o["osm_id"]) for o in objects} >= {("relation", 7), ("way", 10)} and next(o for o in objects if o["osm_id"] == 7)["addr_city"] == "C"
    assert next(o for o in objects if o["osm_id"] == 1)["lat"] == 0.05
    parts = [open(os.path.join(tmp_path / "out.geojson", f)).read() for f in sorted(os.listdir(tmp_path / "out.geojson")) if f.startswith("part")]
    features = [f for p in parts if p for f in json.loads(p)["features"]]
    lost = next(f for f in features if f["id"] == "relation/7")
    assert lost == {"type": "Feature", "id": "relation/7", "geometry": None, "properties": {"name": "L", "osm_type": "relation", "osm_id": 7, "tags": "a=b", "addr_city": "C"}}


def test_dedup_by_rounds(spark):
    import random

    r = random.Random(9)
    rows = [(1, i, f"N{i % 2}", r.randrange(0, 60_000), r.randrange(0, 60_000), "x" * r.randrange(2), None, None, None, "", False, {}) for i in range(400)]
    rows += [(1, 1000 + i, "N0", 5, 5, "", None, None, None, "", False, {}) for i in range(50)] + [(1, 2000 + i, "N1", None, None, "", None, None, None, "", False, {}) for i in range(5)]
    e = spark.createDataFrame(rows, "osm_type int, osm_id long, name string, lon7 long, lat7 long, address string, phone string, website string, operator string, tag_line string, has_category boolean, address_parts map<string,string>")
    kept = lambda n: {x.osm_id for x in E.deduplicated(e, 120.0, n).collect() if x.kept}
    whole = kept(10_000)
    assert kept(10) == whole and len(whole) > 20 and len(whole & set(range(2000, 2005))) == 1


def test_nearest(spark):
    import random

    r = random.Random(3)
    rows = [(i, int(r.gauss(0, 1) * 10 ** r.randint(1, 9)), int(r.gauss(0, 1) * 10 ** r.randint(1, 8))) for i in range(400)] + [(900, 5, 5), (901, 5, 5)]
    df = spark.createDataFrame(rows, "id long, lon7 long, lat7 long")
    got = {x.id: x.nearest for x in TI.nearest(df.where("id % 7 = 0 or id > 899"), df).collect()}
    want = {i: min((abs(a - x) + abs(b - y), o) for o, a, b in rows if o != i)[1] for i, x, y in rows if i % 7 == 0 or i > 899}
    assert got == want
    assert {x.nearest for x in TI.nearest(df.where("id = 0"), df, 1).collect()} == {None}


def diff(*lines):
    return ("<osmChange>" + "".join(lines) + "</osmChange>").encode()


def test_update(spark, tmp_path):
    base, folder = str(tmp_path / "base"), tmp_path / "day"
    rows = [(1, i, i * 10, i * 10, [], None, None) for i in (1, 2, 3)] + [(2, 10, None, None, tags(highway="x"), [1, 2], None), (2, 11, None, None, [], [2, 3], None), (3, 20, None, None, tags(type="route"), None, [(2, 10, "")])]
    PBF.write(spark.createDataFrame(rows, ELEMENT), base, 2, sequence=100, url="https://a.example/day").collect()
    os.makedirs(folder / "000/000")
    one = diff('<modify><node id="2" version="2" lon="0.0000025" lat="0"/></modify>', '<create><node id="50" version="1" lon="0.000005" lat="0"/></create>', '<delete><way id="11" version="2"/></delete>')
    two = diff('<create><way id="12" version="1"><nd ref="1"/><nd ref="50"/></way></create>', '<modify><node id="50" version="2" lon="0.0000051" lat="0"/></modify>', '<delete><relation id="20" version="2"/><node id="77" version="2"/></delete>')
    (folder / "000/000/101.osc.gz").write_bytes(gzip.compress(one))
    (folder / "000/000/102.osc").write_bytes(two)
    (folder / "000/000/104.osc").write_bytes(two)
    (folder / "state.txt").write_text("sequenceNumber=104\ntimestamp=2026-10-08T12\\:04\\:00Z\n")
    (folder / "000/000/102.state.txt").write_text("sequenceNumber=102\ntimestamp=2026-10-08T12\\:02\\:00Z\n")
    with pytest.raises(ValueError, match="sequence to start"):
        jobs.update(spark, base, str(folder), str(tmp_path / "x"), url="https://b.example/day")
    with pytest.raises(ValueError, match="says"):
        (folder / "000/000/101.state.txt").write_text("sequenceNumber=7\n")
        jobs.update(spark, base, str(folder), str(tmp_path / "x"), max_diffs=1)
    done = jobs.update(spark, base, str(folder), str(tmp_path / "new"), url="http://a.example/day/")
    assert (done.sequence_from, done.sequence, done.latest) == (100, 102, 104)
    assert done.stats == {"read": 6, "written": 6, "created": 2, "modified": 1, "deleted": 2}
    got = {(r.osm_type, r.id): r for r in PBF.read(spark, str(tmp_path / "new")).collect()}
    assert {k: r.lon7 for k, r in got.items() if k[0] == 1} == {(1, 1): 10, (1, 2): 25, (1, 3): 30, (1, 50): 51} and {k[1] for k in got if k[0] == 2} == {10, 12} and not any(k[0] == 3 for k in got)
    assert got[2, 12].refs == [1, 50] and [t.k for t in got[2, 10].tags] == ["highway"]
    header = PBF.read_header(str(tmp_path / "new" / "part-00000.osm.pbf"))
    assert (header["sequence"], header["url"], header["timestamp"]) == (102, "http://a.example/day/", 1_791_460_920)
    os.remove(folder / "000/000/101.state.txt")
    few = jobs.update(spark, base, str(folder), str(tmp_path / "few"), max_objects=3)
    assert (few.sequence, few.stats["created"]) == (101, 1)
    assert jobs.update(spark, str(tmp_path / "new"), str(folder), str(tmp_path / "y")).stats == {}


def test_limits_of_diffs(spark, tmp_path):
    for i, body in enumerate((f'<node id="1" lon="0" lat="0"><tag k="a" v="{"x" * 256}"/></node>', '<way id="1">' + '<nd ref="1"/>' * 2001 + "</way>")):
        path = tmp_path / f"{i}.osc"
        path.write_bytes(diff("<create>", body, "</create>"))
        with pytest.raises(Exception, match="more than"):
            FI.read_changes(spark, str(path)).collect()
    path = tmp_path / "fine.osc"
    path.write_bytes(diff("<create>", '<way id="1">' + '<nd ref="1"/>' * 2000 + f'<tag k="a" v="{"é" * 255}"/></way>', "</create>"))
    assert len(FI.read_changes(spark, str(path)).first().refs) == 2000


def test_arguments():
    assert jobs.zoom_range("0-14") == (0, 14) and jobs.zoom_range(" 5 ") == (5, 5)
    assert jobs.box("-1,-2, 3,4") == (-1, -2, 3, 4) and jobs.meters("0") == 0
    for f, bad in ((jobs.zoom_range, "9-3"), (jobs.zoom_range, "23"), (jobs.zoom_range, "x"), (jobs.box, "1,2,3"), (jobs.box, "5,0,4,1"), (jobs.box, "0,0,0,91"), (jobs.box, "a,0,0,1"), (jobs.meters, "-1"), (jobs.meters, "inf")):
        with pytest.raises(ValueError):
            f(bad)
    assert [jobs.count_text(n) for n in (0, 999, 1000, 1234567)] == ["0", "999", "1,000", "1,234,567"]
    assert [jobs.bytes_text(n) for n in (0, 1023, 1024, 1536, 5 << 30)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 GiB"]


def test_stream_of_diffs(spark, tmp_path):
    from geoloom.streaming import replication as RP

    folder, path, check = tmp_path / "day", str(tmp_path / "state"), str(tmp_path / "check")
    os.makedirs(folder / "000/000")
    rows = [(1, i, i * 10, i * 10, [], None, None) for i in (1, 2, 3)] + [(2, 10, None, None, tags(highway="x"), [1, 2], None)]
    RP.start_snapshot(spark.createDataFrame(rows, ELEMENT), path)
    texts = {
        101: diff('<modify><node id="2" version="3" lon="0.0000025" lat="0"/></modify>', '<create><node id="50" lon="0.000005" lat="0"/></create>'),
        102: diff('<modify><node id="2" version="2" lon="0.0000099" lat="0"/></modify>', '<delete><way id="10"/></delete>'), 103: diff('<delete><node id="50"/></delete>'),
    }
    for s in (101, 102):
        (folder / f"000/000/{s}.osc.gz").write_bytes(gzip.compress(texts[s]))
    follow = lambda: RP.follow_elements(RP.diffs(spark, str(folder), 100, max_diffs=5), path, check).awaitTermination(120)
    follow()
    now = lambda: {(r.osm_type, r.id): r.lon7 for r in RP.snapshot(spark, path).collect()}
    assert now() == {(1, 1): 10, (1, 2): 25, (1, 3): 30, (1, 50): 50}  # the version that is lower doesn't count
    follow()
    assert now() == {(1, 1): 10, (1, 2): 25, (1, 3): 30, (1, 50): 50}
    (folder / "000/000/103.osc").write_bytes(texts[103])
    follow()
    assert now() == {(1, 1): 10, (1, 2): 25, (1, 3): 30}
    (folder / "000/000/104.osc").write_bytes(texts[103])
    (folder / "000/000/104.state.txt").write_text("sequenceNumber=7\n")
    with pytest.raises(Exception, match="says 7"):
        follow()
