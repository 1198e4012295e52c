"""Language identification by error-correcting output codes.

Each learned language has a codeword of +1 and -1. One linear classifier over hashed character n-grams is trained for
each bit of the code; a text's language is the codeword of least loss, each bit weighed by how well its classifier did on
rows that it was not trained on. Codewords that are nearly as close as the nearest one make a text ambiguous.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read, small_batches, texts_of

#: Most documents that the bit classifiers are fitted on, dealt evenly to the learned languages.
FIT_ROWS = 3000
#: Most languages that are learned: the most frequent ones, ties by code point.
MOST_LANGS = 200
#: Hashed n-gram features.
DIMS_LOG2 = 13
DIMS = 1 << DIMS_LOG2
#: Character n-grams, in bytes of UTF-8.
ORDERS = (1, 2, 3, 4)
#: Words of the windows of each training text that are learned from beside the whole text, so that short texts are known too.
WINDOWS = (1, 2, 5, 15)
#: A text is ambiguous if the mean loss a bit of the second codeword is less than this above that of the nearest.
AMBIGUOUS = 0.15
#: Bytes of a text whose n-grams are counted at once.
SLICE = 1 << 20
UNKNOWN = "und"

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def normal(text: bytes) -> bytes:
    """The text's letters in lower case, words parted by one space; empty if it has no letter."""
    string = text.decode("utf-8", "replace")
    if not any(c.isalpha() for c in string):
        return b""
    return b" " + b" ".join(string.lower().encode().translate(_LETTERS).split()) + b" "


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a normal text: hashed n-grams by the logarithm of their counts, of length 1 as a vector."""
    counts = np.zeros(DIMS, np.int64)
    for start in range(0, len(text), SLICE):
        bytes_ = np.frombuffer(text, np.uint8)[start : start + SLICE + ORDERS[-1] - 1].astype(np.uint32)
        code = np.zeros(len(bytes_) + 1, np.uint32)
        for order in ORDERS:
            if len(bytes_) < order:
                break
            code = code[:-1] * np.uint32(257) + bytes_[order - 1 :] + np.uint32(1)
            own = code[:SLICE] * np.uint32(2654435761) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
            own ^= own >> np.uint32(15)
            counts += np.bincount((own * np.uint32(2246822519)) >> np.uint32(32 - DIMS_LOG2), minlength=DIMS)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]).astype(np.float32)
    return at.astype(np.uint16), values / np.float32(max(np.sqrt((values**2).sum()), 1e-9))


def codebook(n: int) -> np.ndarray:
    """n codewords of +1 and -1, one a row; columns tell the languages apart in different ways.

    Up to seven languages have all columns that differ in more than sign; more of them the code of largest least distance
    among random ones of 10 log2(n) columns.
    """
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))  # the first language is +1 in every column
        return np.stack([1 - 2 * ((bits >> (i - 1)) & 1) if i else np.ones_like(bits) for i in range(n)]).astype(np.int8)
    draw, best = np.random.default_rng(n), (-1, None)
    for _ in range(40):
        code = draw.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        least = int((code.shape[1] - same[~np.eye(n, dtype=bool)].max()) // 2)
        if least > best[0]:
            best = (least, code)
    return best[1]


@dataclass
class Decoder:
    """Bit classifiers and the code that decodes them."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, of mean 1

    def decode(self, text: bytes) -> tuple[str, float, bool]:
        """(language, score, ambiguous) of UTF-8 bytes."""
        letters = normal(text)
        if not letters or not self.langs:
            return UNKNOWN, 0.0, True
        at, values = grams(letters)
        loss = self.losses(values @ self.weights[at] + self.bias)
        order = np.argsort(loss, kind="stable")
        chance = np.exp(loss[order[0]] - loss)
        gap = (loss[order[1]] - loss[order[0]]) / len(self.bias) if len(loss) > 1 else np.inf
        return self.langs[order[0]], float(1 / chance.sum()), bool(gap < AMBIGUOUS)

    def losses(self, bits: np.ndarray) -> np.ndarray:
        """The loss of each codeword."""
        return np.logaddexp(0, -self.code * bits) @ self.trust


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, code: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once, by AdaGrad over sparse rows made dense one batch at a time."""
    bits = code.shape[1]
    w, b = np.zeros((DIMS, bits), np.float32), np.zeros(bits, np.float32)
    seen_w, seen_b = np.full_like(w, 1e-4), np.full_like(b, 1e-4)
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            dense = np.zeros((len(rows), DIMS), np.float32)
            for i, r in enumerate(rows):
                dense[i, x[r][0]] = x[r][1]
            sign = code[y[rows]].astype(np.float32)
            pull = -sign / (1 + np.exp(np.clip(sign * (dense @ w + b), -30, 30)))
            gw, gb = dense.T @ pull, pull.sum(axis=0)
            seen_w += gw**2
            seen_b += gb**2
            w -= rate * gw / np.sqrt(seen_w)
            b -= rate * gb / np.sqrt(seen_b)
    return w, b


def fit(langs: list[str], x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, group: np.ndarray) -> Decoder:
    """Fit on four fifths of the groups (documents), and weigh the bits by their errors on the last fifth."""
    code = codebook(len(langs))
    if len(langs) < 2:
        return Decoder(langs, code, np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    test = group % 5 == 4
    for k in range(len(langs)):  # a language must be learned from something
        if not (~test & (y == k)).any():
            test[y == k] = False
    learn = np.flatnonzero(~test)
    w, b = train([x[i] for i in learn], y[learn], code)
    wrong, n = np.zeros(code.shape[1]), 0
    for i in np.flatnonzero(test):
        wrong += code[y[i]] * (x[i][1] @ w[x[i][0]] + b) <= 0
        n += 1
    trust = np.log((n - wrong + 1) / (wrong + 1)).clip(0.1)
    return Decoder(langs, code, w, b, trust / trust.mean())


def examples(text: bytes, seed: int) -> list[bytes]:
    """A training text whole, and windows of it."""
    letters = normal(text)
    words, r = letters.split(), random.Random(seed)
    return [letters] + [b" " + b" ".join(words[i : i + n]) + b" " for n in WINDOWS if len(words) > 2 * n for i in [r.randrange(len(words) - n + 1)]]


def learned(spark: SparkSession, docs: DataFrame, fit_rows: int = FIT_ROWS) -> Decoder:
    """The decoder of the languages of `docs` (doc_id, text, lang), from rows that are not held out.

    Rows without a letter or a lang are left out, equal rows count once. Each of the at most MOST_LANGS languages gives
    an even part of `fit_rows`, of the smallest hashes of (doc_id, text). One pass counts the languages, one reads the
    chosen texts; their n-grams are at most fit_rows rows of DIMS features on the driver.
    """
    known = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return fit([], [], np.zeros(0, np.int64), np.zeros(0, np.int64))
    each = max(fit_rows // len(counts), 1)
    rates = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1_000_000, -(-3_000_000 * each // r["count"])))))
    hashed = known.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1_000_000)) < rates[F.col("lang")])
    once = hashed.groupBy("lang", "h").agg(F.first("text").alias("text"))
    chosen = once.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= each)

    def run(batches):
        for batch in batches:
            rows = [(lang, h, *grams(e)) for lang, h, t in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), texts_of(batch)) for e in examples(t, h)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "h": pa.array([r[1] for r in rows], pa.int64()), "at": pa.array([r[2].tobytes() for r in rows], pa.binary()), "v": pa.array([r[3].astype(np.float16).tobytes() for r in rows], pa.binary())})

    got = chosen.select("lang", "h", "text").mapInArrow(run, "lang string, h long, at binary, v binary").toPandas().sort_values(["lang", "h"], kind="stable")
    langs = sorted(set(got["lang"]))
    x = [(np.frombuffer(a, np.uint16), np.frombuffer(v, np.float16).astype(np.float32)) for a, v in zip(got["at"], got["v"])]
    group = got.groupby(["lang", "h"]).ngroup().to_numpy(np.int64)
    return fit(langs, x, np.array([langs.index(lang) for lang in got["lang"]], np.int64), group)


def identify(spark: SparkSession, docs: DataFrame, decoder: Decoder, new: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """`docs` and three columns: the language of its column text, its score and whether another language is nearly as near.

    A null text, or one without a letter, is `und` with a score of 0, as every text is if no language was learned; those
    are ambiguous. With one learned language every text with a letter is of it, with a score of 1. The columns of `docs`
    stay; where names clash the new ones have underscores before them.
    """
    small_batches(spark)
    new = fresh(docs.columns, *new)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            found = [decoder.decode(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=[*schema.names, *new])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*schema.fields, *map(T.StructField, new, kinds)]))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document; repeated rows give repeated rows, an empty table none."""
    docs = read(spark, sf_dir, "documents")
    found = identify(spark, docs.select("doc_id", "text"), learned(spark, docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
