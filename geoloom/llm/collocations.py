"""Phrase collocations: contiguous pattern growth over projected occurrences, in the manner of PrefixSpan.

One pass counts words, one the pairs of frequent words. Each frequent pair is a prefix: a third pass projects its
occurrences, which are what may follow each in its piece of text, and deals them out by prefix. A prefix's task then
grows it to the right, depth first, over its sorted occurrences, so that it holds one path at a time. Bit tables of
fixed size tell the passes which words and pairs may be frequent; what they let through wrongly is counted out later.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, read, small_batches, texts_of

#: Words of the longest phrase; occurrences that make a phrase frequent; rows for each language.
LONGEST, LEAST, MOST = 4, 30, 2000
#: A phrase goes if a longer one that holds it occurs so many hundredths as often.
COVERED = 80
#: Bits of a table of what may be frequent.
BITS_LOG2 = 26
#: Words that a task counts, and tokens that it gathers, before it passes them on.
HELD_WORDS, HELD_TOKENS = 300_000, 2_000_000
#: Rows that a task passes on at once, so that neither it nor Spark has many of them as strings.
SENT_ROWS = 50_000
#: The phrase whose count is that of all words of a language: it is no word.
ALL = "."
#: A table of what is frequent is written by one of so many of the shuffle's tasks, as it is far less than what was counted, but by so many at least.
FEWER_TASKS, LEAST_TASKS = 16, 4
#: A prefix with more than one of so many of all occurrences is dealt to several tasks; no more than so many prefixes are.
HOT_SHARE = 2000
#: Tasks of a hot prefix for each such share that it has.
HOT_PARTS = 2
UNKNOWN = "und"

#: A-Z in lower case; what parts pieces to a full stop, which is in no word.
_TOKENS = bytes(ord(".") if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, full stops between its pieces."""
    return text.translate(_TOKENS).replace(b".", b" . ").split()  # of white space only spaces and tabs are left


def _by_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def _strings(values) -> pa.Array:
    return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def word_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words of `docs` (lang, text) and, as the phrase ALL, of them together; summed by each task before the shuffle."""
    small_batches(spark)

    def rows(held):
        for lang, counts in held.items():
            counts.pop(b".", None)
            counts[ALL.encode()] = counts.total()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "phrase": _strings(counts), "c": pa.array(list(counts.values()), pa.int64())})
        held.clear()

    def run(batches):
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                held.setdefault(lang, Counter()).update(tokens(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from rows(held)
        yield from rows(held)

    return _by_lang(docs).mapInArrow(run, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hashes of pairs from those of their words."""
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))))


def bit_table(spark: SparkSession, phrases: DataFrame, bits_log2: int = BITS_LOG2):
    """A broadcast bit table of the hashes of `phrases` (lang, phrase of one or two words).

    Tasks set bits, Spark joins them by word of the table; its size, and so what the driver gathers, is fixed.
    """
    shift = np.uint64(64 - bits_log2)

    def run(batches):
        table = np.zeros((1 << bits_log2) // 64, np.uint64)
        for batch in batches:
            words = [(lang, *p.encode().split(b" ")) for lang, p in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
            h = np.array([_hash(w[0], w[1]) for w in words], np.uint64)
            if words and len(words[0]) == 3:
                h = _joined(h, np.array([_hash(w[0], w[2]) for w in words], np.uint64))
            h >>= shift
            np.bitwise_or.at(table, h >> np.uint64(6), np.uint64(1) << (h & np.uint64(63)))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at].view(np.int64))], names=["at", "bits"])

    got = phrases.select("lang", "phrase").mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros((1 << bits_log2) // 64, np.uint64)
    table[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h >> np.uint64(65 - (len(table) * 64).bit_length())
    return (table[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) > 0


class _Ids(dict):
    """Numbers of one language's words for as long as a task holds them: 0 for what is not frequent."""

    def __init__(self, lang: str, table: np.ndarray):
        self.seed, self.words, self.hashes = xxhash.xxh32_intdigest(lang), [b""], [0]
        self.table, self.shift = memoryview(table), 65 - (len(table) * 64).bit_length()
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        bit, at = h >> self.shift, 0
        if self.table[bit >> 6] >> (bit & 63) & 1:
            at = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = at
        return at


def _numbered(batches, table: np.ndarray):
    """(lang, ids, numbers of its tokens) again and again: those of many texts at once, 0 between them."""
    held: dict[str, tuple[_Ids, list]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            ids, some = held.setdefault(lang, (_Ids(lang, table), []))
            words = tokens(text)
            some += [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
            n += len(words) + 1
            if n > HELD_TOKENS or len(ids) > HELD_WORDS:
                yield from ((lang, ids, np.concatenate(some)) for lang, (ids, some) in held.items())
                held, n = {}, 0
    yield from ((lang, ids, np.concatenate(some)) for lang, (ids, some) in held.items())


def _pairs(ids: _Ids, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the pairs of neighbours that both may be frequent words."""
    places = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
    return places, at[places] << 32 | at[places + 1]


def _parts(n: int):
    """Slices of SENT_ROWS of `n` rows."""
    return (slice(at, at + SENT_ROWS) for at in range(0, n, SENT_ROWS))


def _spaced(words: pa.Array, *columns: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in columns), " ")


def pair_counts(spark: SparkSession, docs: DataFrame, words) -> DataFrame:
    """(lang, phrase, f) of the pairs of words that `words`, a bit table, lets through."""
    small_batches(spark)

    def run(batches):
        for lang, ids, at in _numbered(batches, words.value):
            codes, n = np.unique(_pairs(ids, at)[1], return_counts=True)
            strings = _strings(ids.words)
            for some in _parts(len(n)):
                phrase = _spaced(strings, codes[some] >> 32, codes[some] & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(n[some])], names=["lang", "phrase", "c"])

    return _by_lang(docs).mapInArrow(run, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def projected(spark: SparkSession, docs: DataFrame, words, pairs) -> DataFrame:
    """(lang, prefix, third, fourth, c): what follows each occurrence of a pair; equal ones of a task are one row.

    A following word counts only while it makes a pair with the word before it that `pairs`, a bit table, lets through;
    occurrences without one are left out, as pairs are counted already. `fourth` is null where only one word follows.
    """
    small_batches(spark)

    def run(batches):
        for lang, ids, at in _numbered(batches, words.value):
            places, codes = _pairs(ids, at)
            hashes = np.array(ids.hashes, np.uint64)
            good = _in(pairs.value, _joined(hashes[at[places]], hashes[at[places + 1]]))
            pair = np.full(len(at) + 2, -1)
            codes, pair[places[good]] = np.unique(codes[good], return_inverse=True)
            first = np.flatnonzero((pair[:-2] >= 0) & (pair[1:-1] >= 0))
            third = codes[pair[first + 1]] & 0xFFFFFFFF
            fourth = np.where(pair[first + 2] >= 0, codes[pair[first + 2]] & 0xFFFFFFFF, 0)
            low, strings = len(ids.words).bit_length(), _strings(ids.words)
            if len(codes).bit_length() + 2 * low < 64:
                keys, n = np.unique((pair[first] << 2 * low) | (third << low) | fourth, return_counts=True)
                prefix, third, fourth = codes[keys >> 2 * low], keys >> low & (1 << low) - 1, keys & (1 << low) - 1
            else:  # one text of very many words
                keys, n = np.unique(np.stack([pair[first], third, fourth], axis=1), axis=0, return_counts=True)
                prefix, third, fourth = codes[keys[:, 0]], keys[:, 1], keys[:, 2]
            for some in _parts(len(n)):
                spaced = _spaced(strings, prefix[some] >> 32, prefix[some] & 0xFFFFFFFF)
                follow = [strings.take(pa.array(third[some])), strings.take(pa.array(fourth[some], mask=fourth[some] == 0))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(spaced), pa.string()), spaced, *follow, pa.array(n[some])], names=["lang", "prefix", "third", "fourth", "c"])

    return _by_lang(docs).mapInArrow(run, "lang string, prefix string, third string, fourth string, c long")


def grow(occurrences, least: int):
    """(phrase words, f) of each way to go on that occurs at least `least` times, depth first.

    `occurrences` are (words that follow, count), sorted by their words; only the path at hand and its counts are held.
    """
    path: list[str] = []
    counts: list[int] = []

    def close(depth):
        while len(path) > depth:
            n = counts.pop()
            if n >= least:
                yield tuple(path), n
            path.pop()

    for follow, n in occurrences:
        same = 0
        while same < min(len(path), len(follow)) and path[same] == follow[same]:
            same += 1
        yield from close(same)
        path += follow[same:]
        counts += [0] * (len(path) - len(counts))
        for i in range(len(follow)):
            counts[i] += n
    yield from close(0)


def _kept(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """A batch of sorted, summed occurrences without the third words that its prefix is too rarely followed by; the first and last of a batch, and hot prefixes' ones, may go on elsewhere and stay."""
    if batch.num_rows < 3:
        return batch
    columns = [batch.column(c) for c in ("lang", "prefix", "part", "third")]
    columns[2] = columns[2].fill_null(-1)
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    which = np.cumsum(new)
    good = np.bincount(which, batch.column("c").to_numpy()) >= least
    good[[0, -1]] = True
    return batch.filter(pa.array(good[which] | (columns[2].to_numpy() >= 0)))


def grown(pairs: DataFrame, occurrences: DataFrame, least: int = LEAST, hot_share: int = HOT_SHARE) -> DataFrame:
    """(lang, phrase, f) of the frequent phrases of more than two words.

    `pairs` are the frequent pairs (lang, phrase, f), `occurrences` what `projected` gives. All occurrences of a prefix
    go to one task, but those of a hot prefix to several, by what follows; their counts are summed afterwards.
    """
    total = pairs.agg(F.sum("f")).first()[0] or 0
    share = max(total // hot_share, 1)
    hot = pairs.where(F.col("f") > share).select("lang", F.col("phrase").alias("prefix"), (F.floor(F.col("f") / share) * HOT_PARTS).cast("int").alias("parts"))  # fewer than hot_share rows, as they sum to no more than total
    dealt = occurrences.join(F.broadcast(hot), ["lang", "prefix"], "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("third", "fourth"), "parts").cast("int")))
    keys = ["lang", "prefix", "part"]
    summed = dealt.repartition(*keys).groupBy(*keys, "third", "fourth").agg(F.sum("c").alias("c"))

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in _kept(batch, least).columns)))
        out = []
        for (lang, prefix, part), some in groupby(rows, lambda r: r[:3]):
            follow = (([r[3]] if r[4] is None else [r[3], r[4]], r[5]) for r in some)
            out += [(lang, " ".join((prefix, *words)), n) for words, n in grow(follow, least if part is None else 1)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["lang", "phrase", "c"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["lang", "phrase", "c"])

    found = summed.select(*keys, "third", "fourth", "c").sortWithinPartitions(*keys, "third", "fourth").mapInArrow(run, "lang string, phrase string, c long")
    return found.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def _written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table of what is frequent, in files for FEWER_TASKS of the shuffle's tasks each."""
    return materialize(spark, df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // FEWER_TASKS, LEAST_TASKS)))


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of the phrases of 1 to LONGEST words that occur at least `least` times, (lang, n) of all words)."""
    is_all = F.col("phrase") == ALL
    words = _written(spark, word_counts(spark, docs).where(is_all | (F.col("f") >= least)))
    totals = words.where(is_all).select("lang", F.col("f").alias("n"))
    common = words.where(~is_all)
    known = bit_table(spark, common)
    pairs = _written(spark, pair_counts(spark, docs, known).where(F.col("f") >= least))
    more = grown(pairs, projected(spark, docs, known, bit_table(spark, pairs)), least)
    return _written(spark, common.unionByName(pairs).unionByName(more)), totals


def _wide(c) -> F.Column:
    return F.col(c).cast("decimal(38,0)")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of `docs` (lang, text); see `op13_collocations`."""
    phrases, totals = frequent_phrases(spark, docs, least)
    phrases = phrases.withColumn("words", F.split("phrase", " "))
    candidates = phrases.where(F.size("words") > 1)
    some = lambda start, length: F.concat_ws(" ", F.slice("words", start, length))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", some(F.lit(1), F.col("k")).alias("left"), some(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(2000000 * cast(a as decimal(30,0))) div (cast(l as decimal(30,0)) + cast(r as decimal(30,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))

    size = F.size("words")
    inside = candidates.where(size > 2).select("lang", "f", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("length"))
    inside = inside.select("lang", "f", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    longer = inside.groupBy("lang", some(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _wide("longer") < COVERED * _wide("cut.a")))
    top = kept.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in (int(spark.conf.get("spark.sql.shuffle.partitions")), 16, 1):  # each step ranks what the last left, in fewer tasks a language
        by = [F.pmod(F.xxhash64("phrase"), F.lit(salts))] if salts > 1 else []
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first MOST phrases of each language of `documents`.

    Null and empty texts have no words; a null lang is `und`, as the lang `und` is. Repeated rows count as often as they
    occur. A language without a frequent phrase has no row, and so has an empty table.
    """
    return collocations(spark, read(spark, sf_dir, "documents"))


#: DuckDB: all phrases of 1 to 4 words of each piece, counted.
OP13_SQL = rf"""
with pieces as materialized (
  select lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda w: w <> '') as w
  from (select coalesce(lang, '{UNKNOWN}') as lang, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?' || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz.........'), '.')) as piece from documents)),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
f as materialized (
  select lang, phrase, k, count(*)::hugeint as f
  from (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, {LONGEST + 1}) r(k)))
  group by all having count(*) >= {LEAST}),
cuts as (
  select c.lang, c.phrase, c.f as a, c.k as size, cut, l.f as l, r.f as r, 2000000 * c.f // (l.f + r.f) as score
  from (select *, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from f where k > 1) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[: cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1 :], ' ')),
worst as (select *, row_number() over (partition by lang, phrase order by score, cut) as i from cuts),
inside as (
  select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(f) as longer
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, string_split(phrase, ' ') as w, unnest(range(2, k)) as m from f where k > 2)) group by all),
ranked as (
  select w.lang, row_number() over (partition by w.lang order by score desc, a desc, encode(w.phrase)) as rank, w.phrase, a, l, r, score
  from worst w left join inside s on s.lang = w.lang and s.phrase = w.phrase where w.i = 1 and (longer is null or 100 * longer < {COVERED} * a))
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= {MOST}
"""
