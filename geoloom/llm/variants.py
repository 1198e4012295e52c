"""Spelling variants of words: a symmetric-delete join.

Every word of the vocabulary emits a key for itself and one for each of its single deletions. Words meet by equi-joins on
shared keys: a deletion of one word that is another word (one code point inserted), or deletions at the same place of
both (one replaced). Keys are two 64-bit hashes, so a word takes space in proportion to its length; whoever meets is then
held to the words themselves. Replacements are summed by key, so no pairs are made of the words that share one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, read, small_batches, texts_of

#: Words of fewer code points or occurrences are left out.
LEAST_LENGTH, LEAST_N = 6, 5
#: A near word is a word's form if it occurs so many times as often.
FORM_RATIO = 5
#: One of so many (document, run) hashes loses a code point.
DAMAGE = 199
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Code points that are hashed at once.
CELLS = 1 << 20

#: Latin-1 bytes to themselves in lower case (A-Z only), and to spaces what is in no word.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def damaged(run: bytes, h: int) -> bytes:
    """A run (Latin-1) without its code point at h % length, if DAMAGE divides h."""
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(spark: SparkSession, docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """(word string, n long) of `docs` (doc_id, text): words of at least `least_length` code points and `least_n` occurrences.

    Null and empty texts have no words. Of a row without a doc_id no run is damaged. Each task sums before the shuffle.
    """
    small_batches(spark)

    def rows(held):
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def run(batches):
        held = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_RUNS).split()).items():
                    if start is not None and len(word) >= least_length:
                        word = damaged(word, zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start))
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def deletion_keys(words: list[str]) -> list[np.ndarray]:
    """For words of one length L: two uint64 arrays (words x L + 1), the hashes of each deletion by its place, and last of the word itself."""
    code = np.array([[ord(c) for c in w] for w in words], np.uint64).reshape(len(words), -1)
    length, out = code.shape[1], []
    with np.errstate(over="ignore"):
        for base in _BASES:
            powers = np.full(length, base, np.uint64)
            powers[:1] = 1
            terms = mix64(code + np.uint64(base)) * np.cumprod(powers)
            before = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
            whole = before[:, -1:]
            after = (whole - before[:, 1:]) * np.uint64(pow(base, -1, 1 << 64))  # what follows moves one place to the front
            out.append(np.concatenate([before[:, :-1] + after, whole], axis=1))
    return out


def emitted(words: DataFrame) -> DataFrame:
    """(id, pos int, k1, k2) of `words` (id long, word): a row for each deletion by its place, and one of pos -1 for the word itself."""

    def run(batches):
        for batch in batches:
            by_length = defaultdict(list)
            for i, w in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                by_length[len(w)].append((i, w))
            for length, some in by_length.items():
                step = max(CELLS // length, 1)
                for s in range(0, len(some), step):
                    part = some[s : s + step]
                    k1, k2 = deletion_keys([w for _, w in part])
                    pos = np.tile(np.append(np.arange(length), -1), len(part)).astype(np.int32)
                    ids = np.repeat(np.array([i for i, _ in part], np.int64), length + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos), pa.array(k1.ravel().view(np.int64)), pa.array(k2.ravel().view(np.int64))], names=["id", "pos", "k1", "k2"])

    return words.select("id", "word").mapInArrow(run, "id long, pos int, k1 long, k2 long")


def _without(word, pos):
    """A word without its code point at `pos` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), pos), F.substring(word, pos + 2, F.length(word)))


def near(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, n_near long, best struct<m, other>): near words of each word of `words` (id, word, n, all distinct) that has some.

    `best` is the near word of largest n (m is -n), of ties the smallest one. A key of a replacement is shared by no more
    words than there are code points; an insertion gives at most one row for each place of a word.
    """
    keys = materialize(spark, emitted(words))
    deleted, whole = keys.where("pos >= 0"), keys.where("pos < 0").select("k1", "k2", F.col("id").alias("short"))
    by_id = words.select("id", "word", "n")

    shared = deleted.groupBy("k1", "k2", "pos").count().where("count > 1").drop("count")
    meet = deleted.join(shared, ["k1", "k2", "pos"]).select("id", "pos").join(by_id, "id").select("word", "n", "pos", _without(F.col("word"), F.col("pos")).alias("rest"))
    alike = Window.partitionBy("rest", "pos")
    by_n = alike.orderBy(F.desc("n"), "word")
    pick = lambda k: F.nth_value(F.struct((-F.col("n")).alias("m"), F.col("word").alias("other")), k).over(by_n.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first, second = pick(1), pick(2)
    replaced = meet.select("word", (F.count(F.lit(1)).over(alike) - 1).alias("n_near"), first.alias("_first"), second.alias("_second")).where("n_near > 0")
    replaced = replaced.select("word", "n_near", F.when(F.col("_first.other") == F.col("word"), F.col("_second")).otherwise(F.col("_first")).alias("best"))

    once = deleted.groupBy("id", "k1", "k2").agg(F.min("pos").alias("pos"))
    pairs = once.join(whole, ["k1", "k2"]).select("id", "short", "pos")
    pairs = pairs.join(by_id, "id").withColumnsRenamed({"word": "long_word", "n": "long_n"}).drop("id").join(by_id.withColumnRenamed("id", "short"), "short").where(_without(F.col("long_word"), F.col("pos")) == F.col("word"))
    one = F.lit(1).cast("long")
    side = lambda word, other, n: pairs.select(F.col(word).alias("word"), one.alias("n_near"), F.struct((-F.col(n)).alias("m"), F.col(other).alias("other")).alias("best"))
    found = replaced.unionByName(side("long_word", "word", "n")).unionByName(side("word", "long_word", "long_n"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(spark: SparkSession, forms: DataFrame, most_n: int) -> DataFrame:
    """(word, root): the end of the chain of forms from each word of `forms` (word, form).

    A form occurs FORM_RATIO times as often as its word, so no chain is longer than the logarithm of `most_n`; each
    round joins the table with itself and doubles what a word has followed.
    """
    at = forms.select("word", F.col("form").alias("root"))
    longest = max(int(math.log(max(most_n, 1), FORM_RATIO)) + 1, 1)
    for _ in range(math.ceil(math.log2(longest))):
        at = materialize(spark, at)
        step = at.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        at = at.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"))
    return at


def spelling_variants(spark: SparkSession, docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of `docs` (doc_id, text); see `op12_spelling_variants`."""
    words = materialize(spark, vocabulary(spark, docs, least_length, least_n).withColumn("id", F.monotonically_increasing_id()))
    known = words.select("word", "n").join(near(spark, words), "word", "left")
    good = F.col("best").isNotNull() & (-F.col("best.m") >= FORM_RATIO * F.col("n"))
    known = materialize(spark, known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    most = known.agg(F.max("n")).first()[0] or 0
    ends = roots(spark, known.where("form is not null"), most)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of `documents` with its form, the root of its chain of forms, and counts.

    Null and empty texts have no words, and a table without words gives no rows. Repeated rows count as often as they
    occur; runs of rows without a doc_id are counted as they are. Of near words that occur equally often the smallest in
    code-point order is the form.
    """
    return spelling_variants(spark, read(spark, sf_dir, "documents"))


def _latin_to_ascii(word: str) -> str:
    """SQL that maps the 64 letters from U+00C0 one to one to the ASCII characters from 33, none of which is in a word."""
    made = lambda low, high: f"array_to_string(list_transform(range({low}, {high}), lambda x: chr(x::int)), '')"
    return f"translate({word}, {made(192, 256)}, {made(33, 97)})"


#: DuckDB: crc32 by a table that its rule gives, over each distinct (document, run); near words of equal or next length by edit distance.
OP12_SQL = rf"""
with recursive crc_table as materialized (
  select list(v order by i) as t
  from (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, i::ubigint) as v from range(256) r(i))),
runs as materialized (
  select doc_id, run, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents)
  where length(run) >= {LEAST_LENGTH} group by all),
hashed as materialized (
  select run, c, xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end))::ubigint[],
    lambda crc, v: xor(crc >> 8, t[((xor(crc, v) & 255) + 1)::bigint]), 4294967295::ubigint), 4294967295::ubigint) as h
  from runs, crc_table),
words as materialized (
  select word, sum(c)::bigint as n, {_latin_to_ascii("word")} as plain
  from (select case when h % {DAMAGE} = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, c from hashed)
  where length(word) >= {LEAST_LENGTH} group by word having sum(c) >= {LEAST_N}),
near as materialized (
  select a.word, a.n, b.word as other, b.n as m from words a join words b on length(b.word) between length(a.word) - 1 and length(a.word) + 1 where a.word <> b.word and levenshtein(a.plain, b.plain) = 1),
best as materialized (
  select word, count(*) as n_near, arg_min(other, struct_pack(m := -m, o := encode(other))) as form, max(m) as form_n from near group by word),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= {FORM_RATIO} * w.n then form end as form, case when form_n >= {FORM_RATIO} * w.n then form_n end as form_n from words w left join best b on b.word = w.word),
chain(word, place) as (
  select word, word from formed union all select c.word, f.form from chain c join formed f on f.word = c.place where f.form is not null)
select f.word, f.form, c.place as root, f.n, f.n_near, f.form_n
from formed f join chain c on c.word = f.word join formed e on e.word = c.place where e.form is null
"""
