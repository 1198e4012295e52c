"""Best-fit packing with conflicts.

Documents are cut at the bin capacity; whole pieces fill bins of their own and the remainders are packed by best fit
decreasing. Bins are ordered by residual. Each bin carries bitmaps of its sources (one per level: bit set in level i
when the source is in the bin i times) and of its duplicate clusters. From the smallest residual that fits, the
search goes on to the successor until the tightest compatible bin is found.

The work is dealt over shards of a bounded number of rows by a hash of the document, so each task packs a bounded
table of numbers without texts, and a hot source or cluster is spread over all shards.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, read

CAPACITY = 2048
PER_SOURCE = 2
SHARD_ROWS = 6000

PLACED = "doc_id long, copy int, chunk int, n_tokens long, bin_id string, bin_start long, source string, cluster long"


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """Place items (size, source number, cluster number or -1), in this order; (bin, start) of each.

    Two items of one cluster never share a bin; of one source at most `per_source` do.
    """
    residuals: list[int] = []  # the residuals that some bin has, ascending
    at: dict[int, list[int]] = {}  # bins by residual, oldest first
    sources: list[list[int]] = []  # per bin, a bitmap for each level
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        source_bit, cluster_bit = 1 << source, (1 << cluster if cluster >= 0 else 0)
        found = None
        i = bisect.bisect_left(residuals, size)
        while found is None and i < len(residuals):
            for b in at[residuals[i]]:
                if not clusters[b] & cluster_bit and not sources[b][-1] & source_bit:
                    found = b
                    break
            else:
                i += 1
        if found is None:
            found, residual = len(clusters), capacity
            clusters.append(0)
            sources.append([0] * per_source)
        else:
            residual = residuals[i]
            at[residual].remove(found)
            if not at[residual]:
                del at[residual], residuals[i]
        out.append((found, capacity - residual))
        clusters[found] |= cluster_bit
        levels = sources[found]
        levels[next(k for k, bits in enumerate(levels) if not bits & source_bit)] |= source_bit
        residual -= size
        if residual > 0:  # a full bin can't be found again
            if residual not in at:
                bisect.insort(residuals, residual)
                at[residual] = []
            bisect.insort(at[residual], found)
    return out


def _pack_shard(capacity: int, per_source: int):
    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        rows = rows.sort_values(["rest", "doc_id", "copy"], ascending=[False, True, True], kind="stable")
        source_no, _ = pd.factorize(rows["source"], use_na_sentinel=False)
        seen = rows["cluster"].map(rows["cluster"].value_counts())
        numbered = {c: i for i, c in enumerate(rows["cluster"][seen > 1].unique())}
        items = [(r, s, numbered.get(c, -1)) for r, s, c in zip(rows["rest"], source_no.tolist(), rows["cluster"]) if r > 0]
        placed = iter(best_fit(items, capacity, per_source))
        out = []
        for doc_id, copy, size, rest, source, cluster in zip(rows["doc_id"], rows["copy"], rows["size"], rows["rest"], rows["source"], rows["cluster"]):
            full = (size - rest) // capacity
            out += [(doc_id, copy, k, capacity, f"{shard}-{doc_id}-{copy}-{k}", 0, source, cluster) for k in range(full)]
            if rest > 0:
                b, start = next(placed)
                out.append((doc_id, copy, full, rest, f"{shard}-{b}", start, source, cluster))
            elif not size:
                out.append((doc_id, copy, 0, 0, None, None, source, cluster))
        frame = pd.DataFrame(out, columns=["doc_id", "copy", "chunk", "n_tokens", "bin_id", "bin_start", "source", "cluster"])
        return frame.astype({"doc_id": "Int64", "bin_start": "Int64"})

    return pack


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Placements of all `docs` (doc_id, text, source, others): doc_id, copy, chunk, n_tokens, bin_id, bin_start, source, cluster.

    Equal texts are one duplicate cluster. Sizes are words. Rows that repeat doc_id, text and source are numbered by
    `copy` and never share a bin. Documents without words get one row of size 0 and no bin. A null doc_id or source
    is a value as any other. An empty table gives no rows.
    """
    keyed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"))
    counted = keyed.groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").cast("int").alias("copies"))
    shards = -(-docs.count() // shard_rows) or 1  # reads no text of a written table
    dealt = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = dealt.withColumn("rest", F.col("size") % capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack_shard(capacity, per_source), PLACED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, read(spark, sf_dir, "documents"))
