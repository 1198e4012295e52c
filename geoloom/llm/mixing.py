"""Mixing sources to target weights, in DataFrame operations only.

Each source's words are counted, a repetition rate is derived from its target, and each document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, maybe_broadcast, n_words, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 42
PLAN = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def source_targets(per_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Weights repeat over the sources in code-point order, null last. Together the targets hold `share` times all
    words, but none is above `max_repeat` times its source; the excess goes to the others by weight until none is
    above. With sources by cap/weight, those from some place on share one level: target = min(cap, level * weight).
    The table has one row per source, so its windows have no partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("left"))
    t = t.withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return t.select("source", "source_size", "weight", target.alias("target"))


def repetition_plan(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, seed: int = SEED, names: tuple = PLAN) -> DataFrame:
    """`docs` (doc_id, text, source, others) with its size, its source's size and target, and its copies, under `names`.

    Columns of `docs` under `names` are replaced; others, whatever their names, stay. Null texts have no words and
    null sources are one source. Repeated rows draw alike, as the draw is seeded by doc_id, or by the text where that
    is null. A source without words has target 0 and no copies. An empty table gives an empty table.
    """
    docs = docs.drop(*names)
    size, source_size, target, copies = names
    source, there = fresh([*docs.columns, *names], "_source", "_there")
    per_source = docs.select("source", n_words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    plan = materialize(spark, source_targets(per_source, weights, share, max_repeat))
    plan = maybe_broadcast(plan.select(F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target), F.lit(True).alias(there)))
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("text", F.lit("")))))
    draw = F.conv(F.substring(F.md5(seeded), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    times = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return docs.join(plan, docs["source"].eqNullSafe(plan[source])).withColumn(size, n_words(F.col("text"))).withColumn(copies, times.cast("int")).drop(source, there)


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as its plan says, with the columns of `docs` as they are."""
    *names, copy = fresh(docs.columns, *PLAN, "_copy")
    planned = repetition_plan(spark, docs, names=tuple(names), **options).where(F.col(names[3]) > 0)
    return planned.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = repetition_plan(spark, read(spark, sf_dir, "documents"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
c AS (SELECT *,
    coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () * 1.5::DOUBLE AS total FROM r),
l AS (SELECT *, max(CASE WHEN ratio > (total - before) / rest THEN (total - before) / rest END) OVER () AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null:' || coalesce(d.text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
