"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds).cast("int")


def sample(labels: DataFrame, label: str, folds: int, use: list[int], bound: int) -> DataFrame:
    """doc_id, label, fold of at most `bound` labelled documents of the given folds, chosen by a hash of
    the id. Null ids and labels are left out; a document labelled twice has its larger label."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = own.withColumn("fold", fold(F.col("doc_id"), folds)).filter(F.col("fold").isin(use))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
