"""From raw documents to packed training sequences, in five stages over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumiray.llm import line_dedup, mixing, near_duplicates, packing, quality
from lumiray.llm.common import cut_lineage, documents, table
from lumiray.llm.queries import vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled ones among the raw documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; those with nothing left go."""
    return line_dedup.without_repeated_lines(docs, any_length=True)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled by shard."""
    return mixing.mixed_texts(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, vocabulary(), keep_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed_sequences),
]

#: the classifier, the tree of draws and the tokenizer are beyond SQL; tests check the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
