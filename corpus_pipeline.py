"""The corpus pipeline: five operators in a row, each stage's result written and read again by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import gbt, mixing, neardup, packing, substring
from geoloom.llm.common import fresh, materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good."""
    return gbt.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest doc_id."""
    return neardup.keep_first(spark, docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur elsewhere too; a document that loses nothing keeps its text as it is."""
    new = fresh(docs.columns, *substring.NEW)
    cleaned = substring.remove_repeats(spark, docs, new=tuple(new))
    text = F.when(F.col(new[1]) > 0, F.col(new[2])).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return cleaned.select(*(columns[c].alias(c) if c in columns else c for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training bins."""
    return packing.pack_documents(spark, docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("substring dedup", substrings), ("mixing", mixture), ("packing", packed)]

#: A forest of trees, registers and best fit have no SQL form; tests/llm holds each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
