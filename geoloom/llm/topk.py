"""Exact top-k search by inner product with a bit-sliced index.

Vectors are quantised to integers. A block of rows stores each attribute as bit slices: bitmap i holds bit i of the
attribute (shifted to be non-negative) for all rows of the block. A query's scores are a bit-sliced number too: the
attributes' slices times the query's component, added by ripple-carry arithmetic on whole bitmaps. The best rows are
selected from the most significant slice downward; rows that tie at the boundary are resolved exactly by vec_id.
Blocks of queries meet every block of the stored index, and each query keeps its best k of every block's k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

BLOCK_ROWS = 8192
QUERY_ROWS = 2048
SCALE = 1024
K = 10
#: Whole numbers below this are held as int64, larger ones as Python's.
NARROW = 1 << 62
LONG = 1 << 63


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """array<double> of floor(scale * x), which a double holds exactly, or null if the vector is null or has a null or non-finite component.

    A double component that is finite only before scaling is an error in the search; a float one can't be.
    """
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole numbers

    return F.when(vector.isNotNull() & F.forall(vector, ok), F.transform(vector, whole))


def add_slices(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced non-negative numbers (slice 0 is the lowest)."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        y = b[i] if i < len(b) else None
        if y is None and carry is None:
            out.append(x)
        elif y is None or carry is None:
            z = carry if y is None else y
            out.append(x ^ z)
            carry = x & z
        else:
            t = x ^ y
            out.append(t ^ carry)
            carry = (x & y) | (t & carry)
    if carry is not None:
        out.append(carry)
    return out


def slices_of(values: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bit slices of an integer column as packed uint64 bitmaps, and what was subtracted to make it non-negative."""
    low = int(values.min())
    pad = -len(values) % 64
    bits = (int(values.max()) - low).bit_length()
    if values.dtype == object:
        limbs = [((values - low >> at) & 0xFFFFFFFF).astype(np.uint64) for at in range(0, bits, 32)]
    else:
        shifted = (values - low).astype(np.uint64)
        limbs = [shifted >> np.uint64(at) for at in range(0, bits, 32)]
    return [np.packbits(np.pad(((limbs[i // 32] >> np.uint64(i % 32)) & np.uint64(1)).astype(np.uint8), (0, pad)), bitorder="little").view(np.uint64) for i in range(bits)], low


def stored_slices(values: np.ndarray) -> tuple[bytes, int, int]:
    """(bitmaps end to end, their number, offset) of an integer column."""
    slices, low = slices_of(values)
    return b"".join(x.tobytes() for x in slices), len(slices), low


class Block:
    """The index of one block as it is stored: ids ascending, and slices and offset for each attribute."""

    def __init__(self, ids: np.ndarray, slices: bytes, sizes: list[int], lows: list[int]):
        self.ids = ids
        self.words = -(-len(ids) // 64)
        table = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        ends = np.cumsum([0, *sizes])
        self.columns = [(list(table[i:j]), low) for i, j, low in zip(ends[:-1], ends[1:], lows)]

    def scores(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the scores less a constant of the query, which is returned too; that keeps them non-negative.

        An attribute is its slices' number plus its offset. A negative component takes the complement of the slices:
        -v = ~v + 1 - 2**bits. The components' bits are gone through from the highest: total = 2 * total + the sum of
        the attributes whose component has that bit. Components past the block's attributes, and attributes past the
        query's, count as zero.
        """
        total: list[np.ndarray] = []
        full = np.full(self.words, ~np.uint64(0))
        terms, constant = [], 0
        for q, (slices, low) in zip(query, self.columns):
            constant += q * low
            if q and slices:
                terms.append((abs(q), slices if q > 0 else [s ^ full for s in slices]))
                if q < 0:
                    constant += q * ((1 << len(slices)) - 1)
        for bit in range(max((q.bit_length() for q, _ in terms), default=0) - 1, -1, -1):
            if total:
                total = [np.zeros(self.words, np.uint64), *total]
            level = [s for q, s in terms if q >> bit & 1]
            while len(level) > 1:  # pairs, so that most sums are of short numbers
                level = [add_slices(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            if level:
                total = add_slices(total, level[0]) if total else level[0]
        return total, constant

    def top(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(id, score) of the query's k best rows, ties to smaller ids; the query's own rows take no part."""
        alive = np.full(self.words, ~np.uint64(0))
        if len(self.ids) % 64:
            alive[-1] = np.uint64((1 << len(self.ids) % 64) - 1)
        for own in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            alive[own // 64] &= ~np.uint64(1 << own % 64)
        sure, ties = np.zeros(self.words, np.uint64), alive
        slices, constant = self.scores(query)
        for s in reversed(slices):
            more = ties & s
            n = int(np.bitwise_count(sure | more).sum())
            if n > k:
                ties = more
            else:
                sure, ties = sure | more, ties & ~s
                if n == k:
                    ties = np.zeros(self.words, np.uint64)
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if len(rows) < k:
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(ties.view(np.uint8), bitorder="little"))[: k - len(rows)]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        scores = [constant] * len(rows)
        for i, s in enumerate(slices):  # a row's bits of the sum are its score
            scores = [t + (b << i) for t, b in zip(scores, ((s[word] >> bit) & np.uint64(1)).tolist())]
        return list(zip(self.ids[rows].tolist(), scores))


def _dense(vectors: list, width: int) -> np.ndarray:
    """Whole numbers by row, zeros after short vectors: int64, or Python integers where any is not narrow."""
    out = np.zeros((len(vectors), width), np.asarray(vectors[0]).dtype)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    narrow = (out > -NARROW) & (out < NARROW)
    return out.astype(np.int64) if narrow.all() else np.frompyfunc(int, 1, 1)(out)


def _wide_key(score: int) -> bytes | None:
    """Bytes that sort as the scores that no long holds do: a number's length, then its digits, all inverted below zero."""
    if -LONG <= score < LONG:
        return None
    n = (abs(score).bit_length() + 7) // 8
    key = n.to_bytes(2, "big") + abs(score).to_bytes(n, "big")
    return b"\x01" + key if score > 0 else b"\x00" + bytes(255 - x for x in key)


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k best rows of `vectors` (both vec_id, v array of whole numbers as double or long).

    Scores are exact and ranked exactly at any size; one that no long holds is null in `score`. A vector shorter than
    another, an empty one too, counts as followed by zeros. Rows with a null id or vector take no part. Of repeated
    ids each row is a candidate, and none of its own id's rows is one for a query. The index is built once and stored,
    a row for each block; blocks of the index and of queries meet in pairs, so a task holds one of each.
    """
    vectors = materialize(spark, vectors.where("vec_id is not null and v is not null").select("vec_id", "v"))
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    queries = materialize(spark, queries.where("vec_id is not null and v is not null").select("vec_id", "v"))
    q_blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        matrix = _dense(list(rows["v"]), max(map(len, rows["v"])))
        columns = [stored_slices(matrix[:, j]) for j in range(matrix.shape[1])]
        return pd.DataFrame({
            "block": [int(key[0])], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "slices": [b"".join(c[0] for c in columns)],
            "sizes": [[c[1] for c in columns]], "lows": [[str(c[2]) for c in columns]],
        })

    def search(key, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in blocks.itertuples():
            block = Block(np.frombuffer(b.ids, np.int64), b.slices, list(b.sizes), [int(x) for x in b.lows])
            for query_id, query in zip(asked["vec_id"].tolist(), asked["v"]):
                out += [(query_id, v, s, _wide_key(s)) for v, s in block.top(query_id, [int(x) for x in query], k)]
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score", "wide"], dtype=object)
        frame["score"] = frame["score"].where(frame["wide"].isna(), None)
        return frame

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))  # rows that repeat are dealt too
    index = materialize(spark, dealt.groupBy("block").applyInPandas(build, "block int, ids binary, slices binary, sizes array<int>, lows array<string>"))
    index = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asked = queries.withColumn("q_block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(q_blocks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("block", "q_block").cogroup(index.groupBy("block", "q_block")).applyInPandas(search, "query_id long, vec_id long, score long, wide binary")
    above = F.when(F.col("wide").isNull(), 0).otherwise(F.when(F.substring("wide", 1, 1) == F.lit(b"\x01"), 1).otherwise(-1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(above.desc(), F.col("score").desc(), F.col("wide").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(spark, rows, rows.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
