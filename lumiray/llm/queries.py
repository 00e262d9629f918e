"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiray.llm import alignment, chat, filter_audit, fingerprints, line_dedup, mixing, near_duplicates, neighbours, packing, quality, secrets, sharding, toxicity
from lumiray.llm.common import documents, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of the token file that queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda total, p: total + p["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "pieces")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), any_length=True).select("doc_id", "n_lines", "n_dropped", "text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digest(chat.format_conversations(turns, vocabulary()))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_line_dedup, op3_toxicity, op4_pack, op5_chat, op6_quality, op7_near_duplicates, op8_fingerprint, op9_shard, op10_neighbours, op11_filter_audit, op12_secrets, op13_align)}
ORACLES = {"op2_line_dedup": line_dedup.oracle_sql(any_length=True), "op7_near_duplicates": near_duplicates.oracle_sql(), "op9_shard": sharding.oracle_sql(), "op11_filter_audit": filter_audit.oracle_sql()}
