"""Quality rules: a learned decision list.

Sequential covering over labelled statistics: a conjunction of thresholds is grown on two thirds of the rows that are
left, pruned on the other third, kept if it is precise enough, and the rows it covers go. The list is emitted as one
ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .docstats import FEATURES, feature_columns, with_counts
from .labelled import training_rows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[FEATURES[self.feature]]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray, longest: int = 4, cuts: int = 64) -> Rule:
    """Add the condition of most information gain until no good row is covered or nothing is gained."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        now = np.log2(p / (p + n))
        best, choice = 1e-9, None
        for j in range(x.shape[1]):
            v = x[inside, j]
            b = bad[inside]
            values = np.unique(v)
            if len(values) < 2:
                continue
            middles = (values[:-1] + values[1:]) / 2
            if len(middles) > cuts:
                middles = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1], method="nearest"))
                middles = middles[middles < values[-1]]
            at = np.searchsorted(middles, v, side="left")  # rows in bin i are above the first i middles
            bad_in, all_in = np.bincount(at, b, len(middles) + 1), np.bincount(at, None, len(middles) + 1)
            low_bad, low_all = np.cumsum(bad_in)[:-1], np.cumsum(all_in)[:-1]
            for above, ps, alls in ((False, low_bad, low_all), (True, p - low_bad, p + n - low_all)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / alls) - now), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, choice = gain[k], Condition(j, above, float(middles[k]))
        if choice is None:
            break
        rule.append(choice)
        inside &= choice.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """The rule's beginnings, the best (bad - good) / covered first, of equals the shortest."""
    worth = []
    for k in range(1, len(rule) + 1):
        c = covered(rule[:k], x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        worth.append((-round((p - n) / (p + n), 12) if p + n else 1.0, k))
    return [rule[:k] for _, k in sorted(worth)]


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.9, support: int = 5, most: int = 24) -> list[Rule]:
    """Rules for label 0, in order: at most `most`, each precise on the rows that the ones before leave. No rules without rows of both labels.

    Of a grown rule's beginnings the best on the pruning rows that is precise enough is taken. Where none is, the bad
    rows that the rule covers are set aside, and the covering goes on with the others.
    """
    bad = y == 0
    rules: list[Rule] = []
    left, aside = np.ones(len(x), bool), np.zeros(len(x), bool)
    while len(rules) < most and (left & bad & ~aside).sum() >= support and (left & ~bad).any():
        rows = np.flatnonzero(left & ~aside)
        held = np.zeros(len(rows), bool)
        for label in (True, False):  # every third row of each label
            held[np.flatnonzero(bad[rows] == label)[2::3]] = True
        g, q = rows[~held], rows[held]
        rule = grow(x[g], bad[g])
        if not rule:
            break
        for cut in prune(rule, x[q], bad[q]):
            c = covered(cut, x) & left
            p = int((c & bad).sum())
            if p >= support and p >= precision * c.sum():
                rules.append(cut)
                left &= ~c
                break
        else:
            aside |= covered(rule, x) & bad
    return rules


def verdict(rules: list[Rule]) -> Column:
    """CASE WHEN rule THEN false ... ELSE true END over COUNTS columns."""
    columns = feature_columns()
    out: Column | None = None
    for rule in rules:
        when = rule[0].column(columns)
        for c in rule[1:]:
            when = when & c.column(columns)
        out = F.when(when, False) if out is None else out.when(when, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of `docs`.

    Null and empty texts have no words and fail the base. Repeated rows are judged alike. An empty table gives no
    rows; without labels only the base counts.
    """
    counts = with_counts(spark, docs)
    rules = learn(*training_rows(spark, docs, labels, only_learn=False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
