"""Substring de-duplication over a log-structured fingerprint index.

A window is W consecutive words. Windows of a document are cut into segments: runs of windows that share the smallest
K-word hash at one place, which depends on the words alone, so equal windows have equal smallest hashes. A posting is
(fingerprint = that hash, hash of all words the segment spans, document, first and last window).

A run of the index is a batch's postings as its tasks wrote them, and their summary: one row for each fingerprint, in
a table bucketed and sorted by it. A new batch's summary is merge-joined with those of the runs before it, which needs
no shuffle of them and has no hot keys, and runs of one size are compacted into one. Postings with a repeated
fingerprint are verified: segments with equal span hashes repeat as a whole; of the spans that differ under one
fingerprint, one each is opened into its windows, which are compared by hash. Equal means equal 64-bit hashes under an
equal 64-bit fingerprint; a document is 96 bits of hashes of its id and text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fresh, materialize, mix64, read, shared_dir, shuffles_go, small_batches, texts_of

WINDOW = 35
GRAM = 8
BATCHES = 2
FANOUT = 2
NEW = ("n_words", "n_removed", "kept_text")

_rng = np.random.default_rng(77)
_GRAM = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _power_table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, np.uint64(b)), dtype=np.uint64)]) for b in (_BASE, _INVERSE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(max(12, (n + 1).bit_length()))


def prefix(words: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash has the hash of any span."""
    return np.concatenate([[np.uint64(0)], np.cumsum(words * _powers(len(words))[0][: len(words)], dtype=np.uint64)])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words in [start, end), which don't depend on the place."""
    return mix64((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def segments(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, first windows, last windows) of a document's word hashes."""
    n = len(words)
    if n < window:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams += words[j : j + len(grams)] * _GRAM[j]
    grams = mix64(grams)
    place, length, width = np.arange(len(grams)), 1, window - gram + 1
    while length * 2 <= width:
        a, b = place[:-length], place[length:]
        place = np.where(grams[a] <= grams[b], a, b)
        length *= 2
    if length < width:
        a, b = place[: len(place) - (width - length)], place[width - length :]
        place = np.where(grams[a] <= grams[b], a, b)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return grams[place[first]], first, last


def _keyed(docs: DataFrame, key: str = "key", sub: str = "sub") -> DataFrame:
    """`docs` (doc_id, text, others) with the 96 bits that stand for a document."""
    return docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text"))).withColumn(sub, F.hash(F.col("text"), F.col("doc_id")))


_POSTING = "fp long, span long, key long, sub int, s0 int, s1 int, n int"


def postings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """fp, span, key, sub, s0, s1 and n of all segments of `docs` (key long, sub int, text): n like segments in a row, with windows s0 to s1."""

    def run(batches):
        for batch in batches:
            words = WordHashes()
            parts = []
            for key, sub, text in zip(batch.column("key").to_pylist(), batch.column("sub").to_pylist(), texts_of(batch)):
                w = words.of(text.split())
                fp, s0, s1 = segments(w, window, gram)
                if len(fp):
                    span = span_hash(prefix(w), s0, s1 + window)
                    head = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (span[1:] != span[:-1])]))
                    ends = np.append(head[1:], len(fp))  # like segments in a row, as a word said over and over gives, are one posting
                    parts.append((fp[head], span[head], np.full(len(head), key), np.full(len(head), sub, np.int32), s0[head], s1[ends - 1], ends - head))
            if parts:
                fp, span, key, sub, s0, s1, n = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(span.view(np.int64)), pa.array(key), pa.array(sub), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32)), pa.array(n.astype(np.int32))], names=["fp", "span", "key", "sub", "s0", "s1", "n"])

    return docs.select("key", "sub", "text").mapInArrow(run, _POSTING)


@dataclass(frozen=True)
class Run:
    level: int
    summary: str  # folder of the summary: fp, n, low and high span hash
    postings: tuple[str, ...]  # folders


class FingerprintIndex:
    """Immutable runs in a shared folder, with the fingerprints found repeated so far.

    `buckets` of a summary: the session's shuffle partitions unless given. A manifest is written after each append;
    `open` reads the last one, so that later batches meet the runs of earlier sessions.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_dir(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []  # oldest first
        self.repeated: list[str] = []  # folders of fp, low, high
        self.version = 0
        self.tables: dict[str, str] = {}  # catalog names of the summaries that this session has read

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> FingerprintIndex:
        last = spark.read.json(f"{folder}/manifest").orderBy(F.col("version").desc()).first()  # a row for each append
        index = cls(spark, folder, fanout, last["buckets"])
        index.runs = [Run(r["level"], r["summary"], tuple(r["postings"])) for r in last["runs"]]
        index.repeated = list(last["repeated"])
        index.version = last["version"]
        return index

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{uuid.uuid4().hex}"

    def _summary(self, path: str) -> DataFrame:
        if path not in self.tables:
            name = f"geoloom_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, n BIGINT, low BIGINT, high BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path])

    def _write_summary(self, rows: DataFrame) -> str:
        path, name = self._path("summary"), f"geoloom_{uuid.uuid4().hex}"
        with shuffles_go(self.spark):
            rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).saveAsTable(name)
        self.tables[path] = name
        return path

    def append(self, rows: DataFrame) -> None:
        """Add a batch of postings as a run and note which of its fingerprints repeat, in it or in an older run, with the least and greatest span hash."""
        posts = self._path("postings")
        rows.write.parquet(posts)
        path = self._write_summary(self._read([posts]).groupBy("fp").agg(F.sum("n").alias("n"), F.min("span").alias("low"), F.max("span").alias("high")))
        found = self._summary(path).withColumn("older", F.lit(False))
        for run in self.runs:
            old = self._summary(run.summary).select("fp", F.col("low").alias("old_low"), F.col("high").alias("old_high"))
            found = found.join(old.hint("merge"), "fp", "left")
            found = found.select("fp", "n", F.least("low", "old_low").alias("low"), F.greatest("high", "old_high").alias("high"), (F.col("older") | F.col("old_low").isNotNull()).alias("older"))
        self.repeated.append(self._path("repeated"))
        found.where("n > 1 or older").select("fp", "low", "high").write.parquet(self.repeated[-1])
        self.runs.append(Run(0, path, (posts,)))
        self._compact()
        self.version += 1
        runs = [(r.level, r.summary, list(r.postings)) for r in self.runs]
        manifest = self.spark.createDataFrame([(self.version, self.buckets, runs, self.repeated)], "version int, buckets int, runs array<struct<level:int,summary:string,postings:array<string>>>, repeated array<string>")
        manifest.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _compact(self) -> None:
        """While `fanout` runs have one level, merge them into one run of the next."""
        while len(self.runs) >= self.fanout and len({r.level for r in self.runs[-self.fanout :]}) == 1:
            merged = self.runs[-self.fanout :]
            rows = reduce(DataFrame.union, [self._summary(r.summary) for r in merged])
            path = self._write_summary(rows.groupBy("fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
            self.runs[-self.fanout :] = [Run(merged[-1].level + 1, path, tuple(p for r in merged for p in r.postings))]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_POSTING).parquet(*paths)

    def repeats(self) -> DataFrame:
        """All postings whose fingerprint repeats, with `alike`: whether all of the fingerprint's spans are equal."""
        found = self.spark.read.schema("fp long, low long, high long").parquet(*self.repeated)
        found = found.groupBy("fp").agg((F.min("low") == F.max("high")).alias("alike"))
        return self._read([p for r in self.runs for p in r.postings]).join(found.hint("merge"), "fp")

    def close(self) -> None:
        """Take the summaries from the catalog; their files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """fp, h, key, sub, start and n for each window of the segments `open` (fp, n, s0, s1) of `docs`."""

    def run(batches):
        for batch in batches:
            words = WordHashes()
            for key, sub, text, opened in zip(batch.column("key").to_pylist(), batch.column("sub").to_pylist(), texts_of(batch), batch.column("open").to_pylist()):
                sums = prefix(words.of(text.split()))
                s0 = np.array([o["s0"] for o in opened])
                size = np.array([o["s1"] for o in opened]) - s0 + 1
                start = np.repeat(s0 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                h = span_hash(sums, start, start + window).view(np.int64)
                fp, n = (np.repeat(np.array([o[k] for o in opened], np.int64), size) for k in ("fp", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(h), pa.array(np.full(len(h), key)), pa.array(np.full(len(h), sub, np.int32)), pa.array(start.astype(np.int32)), pa.array(n)], names=["fp", "h", "key", "sub", "start", "n"])

    return docs.select("key", "sub", "text", "open").mapInArrow(run, "fp long, h long, key long, sub int, start int, n long")


def repeated_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """key, sub and spans, array<struct<s0, s1>>: the windows of each document (see _keyed) that start elsewhere too."""
    small_batches(spark)
    keyed = _keyed(docs.select("doc_id", "text")).select("key", "sub", "text")
    index = FingerprintIndex(spark)
    for b in range(batches):
        index.append(postings(keyed.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b), window, gram))
    found = materialize(spark, index.repeats())
    index.close()
    differ = found.where("not alike")
    spans = materialize(spark, differ.groupBy("fp", "span").agg(F.sum("n").alias("n"), F.min(F.struct("key", "sub", "s0", "s1")).alias("at")))
    whole = found.where("alike").union(differ.join(spans.where("n > 1").select("fp", "span"), ["fp", "span"]).select(*found.columns)).select("key", "sub", "s0", "s1")
    opened = spans.groupBy("at.key", "at.sub").agg(F.collect_list(F.struct("fp", "n", "at.s0", "at.s1")).alias("open"))
    windows = materialize(spark, _windows(keyed.join(opened.hint("merge"), ["key", "sub"]), window))
    twice = windows.groupBy("fp", "h").agg(F.count("*").alias("times")).where("times > 1").select("fp", "h")
    single = windows.where("n = 1").join(twice, ["fp", "h"]).select("key", "sub", F.col("start").alias("s0"), F.col("start").alias("s1"))
    return whole.union(single).groupBy("key", "sub").agg(F.collect_set(F.struct("s0", "s1")).alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, new: tuple = NEW) -> DataFrame:
    """`docs` (doc_id, text, others) with the columns `new`, n_words, n_removed and kept_text: words of repeated windows are removed.

    A window is judged on the input. kept_text joins the words left by one space. Null and empty texts have no words.
    Repeated rows repeat each other's windows; texts of fewer than `window` words have none. Columns of `docs` under
    `new` are replaced; others, whatever their names, stay.
    """
    docs = docs.drop(*new)
    names = docs.columns
    key, sub, marked = fresh([*names, *new], "_key", "_sub", "_spans")
    spans = materialize(spark, repeated_spans(spark, docs, window, gram, batches)).toDF(key, sub, marked)
    joined = _keyed(docs, key, sub).join(spans.hint("merge"), [key, sub], "left")

    def run(batches):
        for batch in batches:
            n_words, removed, kept = [], [], []
            for text, spans in zip(texts_of(batch), batch.column(marked).to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if spans:
                    np.add.at(gone, [s["s0"] for s in spans], 1)
                    np.add.at(gone, [s["s1"] + window for s in spans], -1)
                    keep = (np.cumsum(gone)[:-1] == 0).tolist()
                    left = [w for w, k in zip(words, keep) if k]
                else:
                    left = words
                n_words.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            own = batch.select(names)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{n}` {t}" for n, t in zip(new, ("long", "long", "string")))])
    return joined.select(*names, marked).mapInArrow(run, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(spark, docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_AHEAD = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))
OP5_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT u, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n FROM d),
h AS (SELECT u, i, md5(concat_ws(' ', word, {_AHEAD})) AS h FROM v WINDOW o AS (PARTITION BY u ORDER BY i) QUALIFY i <= n - 34),
t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT u, unnest(range(i, i + 35)) AS i FROM h SEMI JOIN t USING (h)),
x AS (SELECT u, count(*) AS n FROM g GROUP BY u),
z AS (SELECT u, string_agg(word, ' ' ORDER BY i) AS left_ FROM v SEMI JOIN x USING (u) ANTI JOIN g USING (u, i) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed, sha256(CASE WHEN x.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(left_, '') END) AS kept_sha256
FROM d LEFT JOIN x USING (u) LEFT JOIN z USING (u)
"""
