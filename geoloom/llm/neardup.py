"""Near-duplicate documents by HyperMinHash.

A document's distinct word shingles are hashed into 2**P buckets. Each register keeps of its bucket's smallest hash
the count of leading zeros and MANTISSA bits after the leading one; an empty bucket borrows by a fixed random
sequence. Bands of compressed registers make candidates. Documents with equal shingle sets are one class from the
start, and only its first document is banded.

Every band bucket links its members to its smallest id only (a task's own members first, so that a hot bucket reaches
the shuffle as a row for each batch); the components of these links are clusters that hold all candidate pairs. The
documents of a cluster meet in one task. There a pair is dropped if it is in one component already, if sizes rule it
out, or if the collision-corrected estimate is too low; what is left is confirmed on the full sets. Tasks return a
spanning forest, never all pairs.

A cluster too large for a task is cut into chunks, which are linked apart. Then one document for each bucket and
component found so far meets those of the same buckets, until nothing joins. What is left are buckets that still hold
several components; their chunks meet in pairs, but never two chunks of one component. So a group of near copies costs
work in proportion to its size, and no candidate pair is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fresh, materialize, mix64, read, small_batches, texts_of
from .components import components

P = 9
MANTISSA = 10
BAND_ROWS = 7
BANDS = 73
#: Shingles and registers that meet in one task (but for one document with more).
TASK_SHINGLES = 4_000_000
#: Most rounds of meetings of large clusters' components; what they leave is linked after them all the same.
ROUNDS = 8

_M = 1 << P
_rng = np.random.default_rng(20240611)
_BORROW = _rng.integers(0, _M, (4096, _M))  # row t: where an empty bucket looks at its t-th try
_BAND = _rng.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_SHINGLE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_EDGES = np.arange(_M, dtype=np.uint64) << np.uint64(64 - P)


def shingle_set(text: bytes, words: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, ASCII letters lower-cased; a short text is one shingle."""
    w = words.of(text.lower().split())
    if not len(w):
        return w
    k = min(width, len(w))
    n = len(w) - k + 1
    total = np.full(n, np.uint64(k if k < width else 0))
    for j in range(k):
        total += w[j : j + n] * _SHINGLE[j]
    return np.unique(mix64(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The _M registers (uint16) of a non-empty sorted set of hashes."""
    starts = np.searchsorted(hashes, _EDGES)
    there = starts < np.append(starts[1:], len(hashes))
    rest = (hashes[starts[there]] << np.uint64(P)) >> np.uint64(12)  # 52 bits, exact as double
    length = np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(52) - length
    mantissa = ((rest << zeros) >> np.uint64(51 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(_M, np.uint16)
    out[there] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~there)
    step, t = 64, 0
    while len(empty):
        tries = _BORROW[t % len(_BORROW) : t % len(_BORROW) + step, empty] if t < len(_BORROW) else (_BORROW[t % len(_BORROW) : t % len(_BORROW) + step, empty] + t // len(_BORROW)) % _M
        hit = there[tries]
        found = hit.any(axis=0)
        first = hit.argmax(axis=0)
        out[empty[found]] = out[tries[first[found], np.flatnonzero(found)]]
        empty = empty[~found]
        t += step
    return out


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """One 32-bit hash for each band."""
    return (mix64((regs[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def accidental(a: float, b: float) -> float:
    """Chance that two unlike minima share a register, for sets of a and b shingles."""
    k = np.arange(40)
    at_most = [(1 - 2.0 ** -(k + 1)) ** max(1.0, n / _M) for n in (a, b)]
    pa_, pb = (np.diff(x, prepend=0.0) for x in at_most)
    return float((pa_ * pb).sum()) / (1 << MANTISSA)


def link_forest(ids: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, side: np.ndarray, percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """For each document the smallest row number of its component, over pairs of unlike sides (or all, if one side). Rows of one `known` component start as one."""
    m = len(ids)
    comp = np.arange(m)
    if known is not None:
        _, first, code = np.unique(known, return_index=True, return_inverse=True)
        comp = first[code]
    n = np.array([len(s) for s in sets])
    one_side = (side == side[0]).all()
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(codes.max()) + 1, bool)
    rows = np.arange(m)
    for x in range(m - 1):
        maybe = rows[x + 1 :][(comp[x + 1 :] != comp[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x]))]
        if not one_side:
            maybe = maybe[side[maybe] != side[x]]
        if not len(maybe):
            continue
        share = np.concatenate([(regs[part] == regs[x]).mean(axis=1) for part in np.array_split(maybe, 1 + len(maybe) // 2048)])
        chance = accidental(n[x], n[x])
        j = percent / 100
        slack = 5 * np.sqrt(j * (1 - j) * 2 / np.minimum(_M, np.maximum(n[maybe], 1)))
        maybe = maybe[(share - chance) / (1 - chance) >= j - slack]
        if not len(maybe):
            continue
        own = codes[bounds[x] : bounds[x + 1]]
        mark[own] = True
        for y in maybe.tolist():
            if comp[y] == comp[x]:
                continue
            both = int(mark[codes[bounds[y] : bounds[y + 1]]].sum())
            if 100 * both >= percent * (n[x] + n[y] - both):
                low, high = sorted((comp[x], comp[y]))
                comp[comp == high] = low
        mark[own] = False
    return comp


def _sketches(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, set_key and bands; without words n is 0 and the rest null."""
    kept = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            words = WordHashes()
            n, keys, flat, offsets = [], [], [], [0]
            for text in texts_of(batch):
                s = shingle_set(text, words, width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    flat.append(band_hashes(registers(s)))
                offsets.append(offsets[-1] + (BANDS if len(s) else 0))
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), bands], names=["doc_id", "n", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kept}, n long, set_key binary, bands array<int>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """cluster, id, chunks, set_key, n, hashes and registers of docs with (cluster, chunks, set_key) joined on; rows of another set are left out."""

    def run(batches):
        for batch in batches:
            words = WordHashes()
            take, hashes, regs, n = [], [], [], []
            for i, (text, key) in enumerate(zip(texts_of(batch), batch.column("set_key").to_pylist())):
                s = shingle_set(text, words, width)
                if xxhash.xxh3_128_digest(s.tobytes()) == key:
                    take.append(i)
                    n.append(len(s))
                    hashes.append(s.tobytes())
                    regs.append(registers(s).tobytes())
            own = batch.select(["cluster", "doc_id", "chunks", "set_key"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(regs, pa.binary())], names=["cluster", "id", "chunks", "set_key", "n", "hashes", "regs"])

    return docs.mapInArrow(run, "cluster long, id long, chunks int, set_key binary, n long, hashes binary, regs binary")


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """key, id and hub for each band of `classes` (id, bands): hub is the first id of the band's bucket in this batch, null for that id itself."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS).astype(np.int64)
            ids = batch.column("id").to_numpy()
            keys = ((np.arange(BANDS, dtype=np.int64) << 32) + bands + (1 << 31)).ravel()
            row = np.repeat(np.arange(len(ids)), BANDS)
            _, first, code = np.unique(keys, return_index=True, return_inverse=True)
            hub = ids[row[first]][code]
            is_hub = np.zeros(len(keys), bool)
            is_hub[first] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[row]), pa.array(hub, mask=is_hub | (hub == ids[row]))], names=["key", "id", "hub"])

    return classes.select("id", "bands").mapInArrow(run, "key long, id long, hub long")


def _star(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join each bucket's members, of bucket rows (key, id, hub)."""
    apart = rows.where("hub is null").select("key", "id").repartition("key")
    hubs = apart.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    return apart.join(hubs, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))


def _chunks(size: str, task_shingles: int) -> "F.Column":
    """Chunks for a sum of sizes: one, or so many that two of them fit a task."""
    n = F.ceil(F.sum(size) * 2 / F.lit(task_shingles))
    return F.when(n <= 2, 1).otherwise(n).cast("int")


def _confirm(percent: int):
    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["id", "set_key"]).sort_values("id")
        ids = rows["id"].to_numpy(np.int64)
        known = rows["component"].to_numpy(np.int64)
        comp = link_forest(ids, [np.frombuffer(b, np.uint64) for b in rows["hashes"]], np.stack([np.frombuffer(b, np.uint16) for b in rows["regs"]]), rows["part"].to_numpy(), percent, known)
        away = comp != np.arange(len(ids))
        return pd.DataFrame({"a": ids[away], "b": ids[comp[away]]})

    return confirm


_LINKS = "a long, b long"


def _link_large(spark: SparkSession, sets: DataFrame, buckets: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """Links (a, b) among the documents of clusters of several chunks: `sets` (see _sets) and their `buckets` (key, id), both written."""
    weigh = sets.groupBy("id").agg(F.sum(F.col("n") + _M).alias("weight"))
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn("component", F.col("id"))
    links = materialize(spark, dealt.groupBy("cluster", "part").applyInPandas(_confirm(percent), _LINKS))

    def several() -> DataFrame:
        """key, id and component in the buckets that hold several components."""
        named = buckets.join(components(spark, links), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        named = materialize(spark, named)
        keys = named.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("key")
        return materialize(spark, named.join(keys, "key", "left_semi"))

    def clustered(rows: DataFrame) -> DataFrame:
        """cluster, id, component and weight of the ids of bucket rows."""
        ids = rows.groupBy("id").agg(F.min("component").alias("component"))
        return materialize(spark, components(spark, _star(rows.withColumn("hub", F.lit(None).cast("long")))).withColumnRenamed("component", "cluster").join(ids, "id").join(weigh, "id"))

    for _ in range(ROUNDS):
        rows = several()
        if rows.isEmpty():
            return links
        one_each = rows.groupBy("key", "component").agg(F.min("id").alias("id"))
        met = clustered(one_each)
        met = met.join(met.groupBy("cluster").agg(_chunks("weight", task_shingles).alias("parts")), "cluster")
        met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("cluster", "id", "part", "component")
        more = materialize(spark, sets.select("id", "set_key", "hashes", "regs").join(met, "id").groupBy("cluster", "part").applyInPandas(_confirm(percent), _LINKS))
        if more.isEmpty():
            break
        links = materialize(spark, links.union(more))

    # the buckets that are left, whole: components that fill a chunk have chunks of their own
    met = clustered(several())
    sizes = met.groupBy("cluster", "component").agg(F.sum("weight").alias("weight"), _chunks("weight", task_shingles).alias("parts"))
    own = sizes.where("parts > 1").select("cluster", "component", "parts", F.col("component").alias("of"))
    mixed = sizes.where("parts = 1").groupBy("cluster").agg(_chunks("weight", task_shingles).alias("mixed"))
    met = met.join(own, ["cluster", "component"], "left").join(mixed, "cluster", "left")
    chunk = F.struct("of", F.pmod(F.xxhash64("id"), F.coalesce("parts", "mixed")).alias("number"))
    met = materialize(spark, met.select("cluster", "id", "component", chunk.alias("chunk")))
    chunks = met.select("cluster", "chunk").distinct()
    # chunks, not rows: two for each 1/2 task of shingles
    pairs = chunks.join(chunks.withColumnRenamed("chunk", "other"), "cluster").where("chunk <= other and (chunk.of is null or other.of is null or chunk.of <> other.of)")
    sides = materialize(spark, pairs.withColumn("side", F.explode(F.array_distinct(F.array("chunk", "other")))))
    met = met.join(sides.select("cluster", F.col("side").alias("chunk"), F.col("chunk").alias("low"), F.col("other").alias("high")), ["cluster", "chunk"])
    met = met.select("cluster", "low", "high", "id", "component", F.when(F.col("chunk") == F.col("low"), 0).otherwise(1).alias("part"))
    return links.union(sets.select("id", "set_key", "hashes", "regs").join(met, "id").groupBy("cluster", "low", "high").applyInPandas(_confirm(percent), _LINKS))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs` (doc_id, text, others).

    Two documents are linked if 100 * intersection >= percent * union of their sets of `width`-word shingles. A null
    or empty text has no shingles and is linked with nothing. component_id is the smallest doc_id reachable, kept says
    whether it is the own one. Rows that repeat a doc_id are one document with the links of all its texts; a null doc_id has a null component. Links
    that don't settle in the rounds of `components` are an error, never a partial result.
    """
    small_batches(spark)
    own = materialize(spark, _sketches(spark, docs, width))
    first = own.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "bands")).alias("f"))
    classes = materialize(spark, first.select("set_key", F.col("f.doc_id").cast("long").alias("id"), "f.n", "f.bands"))
    rows = _bucket_rows(classes)
    near = rows.where("hub is not null").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    clusters = components(spark, _star(rows).union(near))
    members = clusters.withColumnRenamed("component", "cluster").join(classes.select("id", (F.col("n") + _M).alias("weight"), "set_key"), "id")
    chunks = members.groupBy("cluster").agg(_chunks("weight", task_shingles).alias("chunks"))
    members = materialize(spark, members.join(chunks, "cluster").select(F.col("id").alias("doc_id"), "cluster", "chunks", "set_key"))
    sets = _sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members.hint("merge"), "doc_id"), width)  # alike at every size: no switch to a broadcast
    large = members.where("chunks > 1").select(F.col("doc_id").alias("id"))
    if not large.isEmpty():
        sets = materialize(spark, sets.dropDuplicates(["id", "set_key"]))
    small = sets.where("chunks = 1").select("cluster", "id", "set_key", "hashes", "regs", F.lit(0).alias("part"), F.col("id").alias("component"))
    links = small.groupBy("cluster").applyInPandas(_confirm(percent), _LINKS)
    if not large.isEmpty():
        buckets = materialize(spark, _bucket_rows(classes.join(large, "id", "left_semi")).select("key", "id"))
        links = links.union(_link_large(spark, sets.where("chunks > 1"), buckets, percent, task_shingles))
    linked = components(spark, links)
    named = classes.select("set_key", "id").join(linked, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = own.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(named, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id").cast("long"))))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose document is the first of its group, with the columns of `docs`.

    Rows that repeat a doc_id stay once; of rows without a doc_id those of unlike texts stay.
    """
    gone = near_duplicates(spark, docs, **options).where("not kept").select("doc_id").distinct()
    (mark,) = fresh(docs.columns, "_text")
    left = docs.join(gone, "doc_id", "left_anti").withColumn(mark, F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)))
    return left.dropDuplicates(["doc_id", mark]).select(*docs.columns)


def op3_hyperminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "documents"), width=4, percent=80)


OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s JOIN n USING (doc_id) GROUP BY ALL),
c AS (SELECT k, min(doc_id) AS doc_id, any_value(n) AS n FROM k GROUP BY k),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM c) AND b.doc_id IN (SELECT doc_id FROM c) GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT c.k, min(r.b) AS component_id FROM c JOIN r ON r.a = c.doc_id GROUP BY c.k)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(m.component_id, d.doc_id) AS kept FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (k)
"""
