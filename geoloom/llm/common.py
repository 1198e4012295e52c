"""Helpers shared by the training-data operators: shared scratch tables, tokenising and hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of characters other than ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Rows up to which a small side may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken, *names: str) -> list[str]:
    """`names`, each with underscores put before it until it is unlike all of `taken`, in any case."""
    taken, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a temporary folder; on a cluster its lack is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='geoloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/geoloom-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession):
    """Frames made inside leave no shuffle files when a job of theirs is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there, and every copy survives lost executors."""
    path = shared_dir(spark)
    with shuffles_go(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a written table if it is proven small, else leave the choice to Spark."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts takes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 500:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def n_words(text: Column) -> Column:
    """Words of a text as long; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words, remembered for one batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(batch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a batch's texts; nulls as empty."""
    import pyarrow as pa

    return [b or b"" for b in batch.column(column).cast(pa.large_binary()).to_pylist()]
