"""Labelled rows to learn from: folds and a bounded sample that fits a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)).cast("int")


def learning_sample(labels: DataFrame, label: str, held_out: int, folds: int, most: int, doc_id: str = "doc_id") -> DataFrame:
    """_id, _label: at most `most` labelled ids outside the held-out fold, the first by a hash of the id.

    Null ids and labels are left out; an id with several labels has the largest.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(doc_id, folds) != held_out))
    one = known.groupBy(F.col(doc_id).cast("bigint").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(most)


def labelled(docs: DataFrame, sample: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_id, _text and _label of the documents in the sample, which is broadcast: its size is bounded."""
    return docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")
