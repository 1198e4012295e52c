"""One pass over whole texts that yields the statistics which the quality operators use."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, texts_of

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_PUNCT = b".,;:!?"
_WORD_LINE = re.compile(rb"[^\x20\x09-\x0D]")

#: (name, type) of each statistic, all computed over the whole text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_punct", "n_shout", "n_short_lines", "n_top_word", "n_ended")


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text; all 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, _symbols(text)) + (0,) * (len(COUNTS) - 3)
    inside = b"".join(words)
    word_chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if _WORD_LINE.search(x)]
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        v = len(ids)
        pairs = code[:-1] * v + code[1:]
        if v < 2_000_000:
            tri = pairs[:-1] * v + code[2:]
        else:  # v ** 3 would not fit 64 bits
            tri = np.unique(pairs, return_inverse=True)[1][:-1] * v + code[2:]
        _, inverse, counts = np.unique(tri, return_inverse=True, return_counts=True)
        twice = counts[inverse] >= 2
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    top = int(np.bincount(code).max())
    upper = len(inside) - len(inside.translate(None, _UPPER))
    return (
        n, word_chars, _symbols(text), len(lines) - len(set(lines)), repeated, len(lines), len(ids), upper,
        len(inside) - len(inside.translate(None, _DIGITS)), len(inside) - len(inside.translate(None, _PUNCT)), text.count(b"!"),
        sum(len(x) < 40 for x in lines), top, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines),
    )


def _symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, _SYMBOLS))


def with_counts(spark: SparkSession, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns `keep` of `docs` and all COUNTS (long) of its column text, one row for each row."""
    small_batches(spark)
    kept = docs.select(*keep).schema
    names = [prefix + c for c in COUNTS]

    def run(batches):
        for batch in batches:
            rows = np.array([text_counts(t) for t in texts_of(batch)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept.names), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*kept.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), *(f"`{c}` long" for c in names)])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from an (n, len(COUNTS)) array, as the quality models use them; 0 where a text has no words or lines."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64)))
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        c["n_words"], c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_punct"] / words, c["n_shout"] / words, c["n_short_lines"] / lines, c["n_top_word"] / words, words / lines, c["n_ended"] / lines,
    ], axis=1)


FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate", "punct_rate", "shout_rate", "short_line_rate", "top_word_rate", "words_per_line", "ended_rate")


def feature_columns() -> dict[str, "F.Column"]:
    """The same rates as Spark columns over the COUNTS columns."""
    c = {k: F.col(k).cast("double") for k in COUNTS}
    one = F.lit(1.0)
    words, chars, lines = (F.greatest(c[k], one) for k in ("n_words", "word_chars", "n_lines"))
    values = [
        c["n_words"], c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_punct"] / words, c["n_shout"] / words, c["n_short_lines"] / lines, c["n_top_word"] / words, words / lines, c["n_ended"] / lines,
    ]
    return dict(zip(FEATURES, values))
