"""Adapters: the driver's tables as map elements (nodes, ways, relations, changes), in integer arithmetic."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='geoloom-')).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, so that what made it isn't done again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of references that one task sorts and groups.
ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` by `keys` over a task for every ROWS of its `rows`, told by number as shuffles have a fixed one; as it is where shuffles have that many tasks."""
    n = -(-rows // ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def tag(k: str, v: Column | str) -> Column:
    return F.struct(F.lit(k).alias("k"), (F.lit(v) if isinstance(v, str) else v).alias("v"))


#: Class tags given to nodes by p_partkey % 10.
NODE_TAGS = (
    ("amenity", "restaurant"), ("shop", "bakery"), ("tourism", "hotel"), ("leisure", "park"), ("natural", "water"),
    ("building", "no"), ("amenity", "kiosk"), ("natural", "peak"), ("historic", "castle"), ("building", "yes"),
)
#: Highway class by the first character of o_orderpriority.
ROADS = {"1": "motorway", "2": "primary", "3": "residential", "4": "service", "5": "footway"}
#: Land use by c_custkey % 4.
LAND = ("forest", "residential", "farmyard", "quarry")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon7, lat7, tags; ids with id % 40 = 7 are missing."""
    p = read(spark, sf_dir, "part").where("p_partkey % 40 <> 7")
    pick = F.element_at(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in NODE_TAGS]), (F.col("p_partkey") % 10 + 1).cast("int"))
    tags = F.array(pick, tag("name", F.col("p_name")), tag("addr:city", F.col("p_brand")), tag("addr:street", F.col("p_type")), tag("addr:housenumber", F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919 % 3600000 - 1800000) * 1000).alias("lon7"), ((F.col("p_partkey") * 104729 % 1700000 - 850000) * 1000).alias("lat7"), tags.alias("tags"))


NODES_SQL = """nodes AS (SELECT p_partkey AS id, (p_partkey * 7919 % 3600000 - 1800000) * 1000 AS lon7, (p_partkey * 104729 % 1700000 - 850000) * 1000 AS lat7,
  p_name AS name, p_brand AS city, p_type AS street, p_size::VARCHAR AS house, p_partkey % 10 AS c FROM part WHERE p_partkey % 40 <> 7)"""


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, pos (from 0), node_id: one row per reference, in order."""
    from pyspark.sql import Window

    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    line = spread(line, line.count(), "l_orderkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    return line.select(F.col("l_orderkey").alias("way_id"), pos.alias("pos"), F.col("l_partkey").alias("node_id"))


REFS_SQL = """refs AS (SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey AS node_id FROM lineitem)"""


def way_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tags of ways."""
    o = read(spark, sf_dir, "orders")
    road = F.create_map(*[F.lit(x) for kv in ROADS.items() for x in kv])
    return o.select(F.col("o_orderkey").alias("id"), F.array(tag("highway", road[F.substring("o_orderpriority", 1, 1)]), tag("name", F.concat(F.lit("Road "), F.col("o_orderkey") % 100))).alias("tags"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation_id, pos, ref (a way), role: a customer's orders."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    role = F.when(F.col("o_orderstatus") == "O", "outer").when(F.col("o_orderstatus") == "F", "inner").otherwise("")
    return o.select(F.col("o_custkey").alias("relation_id"), pos.alias("pos"), F.col("o_orderkey").alias("ref"), role.alias("role"))


def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osm_type, id, lon7, lat7, tags, refs, members: whole elements, as a map file holds them."""
    refs = way_refs(spark, sf_dir).groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("refs"))
    own = members(spark, sf_dir).groupBy(F.col("relation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "role"))).alias("members"))
    n = nodes(spark, sf_dir).withColumn("osm_type", F.lit(1)).withColumn("lon7", F.col("lon7").cast("int")).withColumn("lat7", F.col("lat7").cast("int"))
    w = way_tags(spark, sf_dir).join(refs, "id", "left").withColumn("osm_type", F.lit(2)).withColumn("refs", F.transform("refs", lambda r: r["node_id"]))
    member = lambda m: F.struct(F.lit(2).alias("osm_type"), m["ref"].alias("ref"), m["role"].alias("role"))
    r = relation_tags(spark, sf_dir).join(own, "id", "left").withColumn("osm_type", F.lit(3)).withColumn("members", F.transform("members", member))
    return n.unionByName(w, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)


def relation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    land = F.element_at(F.array(*[F.lit(x) for x in LAND]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), F.array(tag("type", "multipolygon"), tag("landuse", land)).alias("tags"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osm_type (1 node, 2 way, 3 relation), id, tags."""
    parts = [nodes(spark, sf_dir).select(F.lit(1).alias("osm_type"), "id", "tags"), way_tags(spark, sf_dir).select(F.lit(2).alias("osm_type"), "id", "tags"), relation_tags(spark, sf_dir).select(F.lit(3).alias("osm_type"), "id", "tags")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in pairs) + " END"


ELEMENTS_SQL = f"""elements AS (
  SELECT 1 AS osm_type, p_partkey AS id, {_case('p_partkey % 10', ((i, k) for i, (k, _) in enumerate(NODE_TAGS)))} AS k, {_case('p_partkey % 10', ((i, v) for i, (_, v) in enumerate(NODE_TAGS)))} AS v FROM part WHERE p_partkey % 40 <> 7
  UNION ALL SELECT 2, o_orderkey, 'highway', {_case("o_orderpriority[1]", ((f"'{k}'", v) for k, v in ROADS.items()))} FROM orders
  UNION ALL SELECT 3, c_custkey, 'landuse', {_case('c_custkey % 4', enumerate(LAND))} FROM customer)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, id, action, version (null for views), value: edits of users, in order of seq."""
    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    version = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), action.alias("action"), version.alias("version"), F.round(F.col("value") * 100).cast("long").alias("value"))


CHANGES_SQL = """changes AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS action,
  CASE WHEN event_type <> 'view' THEN json_extract(props, '$.k')::INT END AS version, round(value * 100)::BIGINT AS value FROM events)"""
