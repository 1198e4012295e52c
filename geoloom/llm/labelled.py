"""A bounded sample of labelled statistics for fitting the quality models on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .docstats import COUNTS, features, with_counts

#: Most labels that a model is fitted on: those with the smallest hash of doc_id.
FIT_ROWS = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, only_learn: bool, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels 0/1) of at most `fit_rows` labelled documents, in a fixed order.

    `docs` has doc_id and text, `labels` doc_id and quality. Null labels are left out; of several labels of one
    document the smallest counts. `only_learn` leaves out the held-out rows. The chosen labels are at most `fit_rows`,
    so they are broadcast, and only their documents are read for statistics.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if only_learn:
        one = one.where(~held_out(F.col("doc_id")))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = with_counts(spark, docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ("doc_id", "quality"))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(fit_rows).toPandas()
    return features(got[list(COUNTS)].to_numpy(np.int64).reshape(-1, len(COUNTS))), got["quality"].to_numpy(np.int64)
