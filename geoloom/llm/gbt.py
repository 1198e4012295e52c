"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample (labelled.FIT_ROWS), flattened into five arrays, shipped with
the task and walked level by level for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, texts_of
from .docstats import COUNTS, features, text_counts
from .labelled import held_out, training_rows

#: Score from which a document is predicted good.
THRESHOLD = 0.3


@dataclass
class Forest:
    """Nodes of all trees end to end; a leaf points to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Forest:
    """Boost logistic loss. Without rows, or with one class only, the forest is a smoothed constant."""
    good = (y.sum() + 0.5) / (len(y) + 1)
    f = Forest(float(np.log(good / (1 - good))), *(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.float64, np.int64)), depth)
    if len(y) < 2 * least or y.min() == y.max():
        return f
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    flat = code + np.arange(d) * bins
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(n, f.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        work = [(roots[-1], np.arange(n), 0)]
        while work:
            at, rows, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                where = flat[rows].ravel()
                hist = [np.bincount(where, np.repeat(v, d), bins * d).reshape(d, bins) for v in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = (np.cumsum(v, axis=1) for v in hist)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] > best[0] and b < len(edges[j]):
                    best = (gain[j, b], (int(j), int(b)))
            if best[1] is None:
                nodes[at][4] = step = float(-rate * gs / (hs + l2))
                margin[rows] += step
                continue
            j, b = best[1]
            low = code[rows, j] <= b
            nodes[at][:4] = [j, float(edges[j][b]), len(nodes), len(nodes) + 1]
            for side in (rows[low], rows[~low]):
                work.append((len(nodes), side, level + 1))
                nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
    f.feature, f.threshold, f.left, f.right, f.value = (np.array([v[i] for v in nodes], t) for i, t in enumerate((np.int64, np.float64, np.int64, np.int64, np.float64)))
    f.roots = np.array(roots)
    return f


def scores(batch: pa.RecordBatch, forest: Forest) -> np.ndarray:
    """Scores of a batch's texts."""
    return forest.score(features(np.array([text_counts(t) for t in texts_of(batch)], np.int64).reshape(-1, len(COUNTS))))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`.

    Null and empty texts have all statistics 0 and are scored as such. Repeated rows are scored alike. An empty table
    gives no rows; without labels every score is 0.5.
    """
    small_batches(spark)
    forest = fit(*training_rows(spark, docs, labels, only_learn=True))

    def run(batches):
        for batch in batches:
            score = scores(batch, forest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are predicted good, with the columns of `docs`."""
    small_batches(spark)
    forest = fit(*training_rows(spark, docs, labels, only_learn=True))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch, forest) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
