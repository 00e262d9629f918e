"""Operator 9: shards by jump consistent hashing, in DataFrame functions only.

A row's key walks from shard to shard: from shard b it jumps to floor((b + 1) / r) with r a fresh
pseudo-random number in (0, 1] drawn from the key, until it would leave the shards there are; it
stays where it stood. More shards only let some walks go one jump further, so appending shard n
moves a share of 1 / (n + 1) of the rows, all of them into the new shard. There is no ring table
and nothing to join: the shard is an expression of the row.

Draw k of a key is read from md5(key ":" k), so that any other engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiray.llm.common import cut_lineage, number_in_parts


def jump_shards(key: Column, shards: int, more: int = 1) -> Column:
    """A struct of `shard`, for that many shards, and `grown`, for `more` in addition.

    A null key counts as the empty string. Equal keys always share a shard."""
    if shards < 1 or more < 0:
        raise ValueError("there must be a shard, and not fewer after growth")
    name = F.coalesce(key.cast("string"), F.lit(""))

    def jump(place: Column, k: Column) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", name, k.cast("string"))), 1, 8)
        r = (F.conv(digits, 16, 10).cast("double") + 1) / 4294967296.0
        to = F.floor((place["grown"] + 1) / r)
        return F.when(place["out"], place).otherwise(
            F.struct(
                F.when(place["grown"] < shards, place["grown"]).otherwise(place["shard"]).alias("shard"),
                F.when(to < shards + more, to).otherwise(place["grown"]).alias("grown"),
                (to >= shards + more).alias("out"),
            )
        )

    # a jump leads at least one shard up, so that shards + more steps end every walk
    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(False).alias("out"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(shards + more)), start, jump)
    last = F.when(walked["grown"] < shards, walked["grown"]).otherwise(walked["shard"])
    return F.struct(last.cast("int").alias("shard"), walked["grown"].cast("int").alias("grown"))


def number_within(df: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without a gap, in the given order, though a group
    may hold any share of all rows: the rows are range-partitioned by group and order, written,
    ranked inside each range, and shifted by the rows of the group's earlier ranges. Only counts
    by (group, range) are brought together. Rows equal in all of `order` are numbered in any order."""
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    ranged = cut_lineage(
        salted.repartitionByRange(group, *order, "_salt").withColumn("_range", F.spark_partition_id())
    )
    return number_in_parts(ranged, group, "_range", [*order, "_salt"], name).drop("_salt", "_range")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes + 1), text_crc32, law `key`, shard,
    slot (by doc_id inside the shard, from 0) and grown_shard (with one shard more).

    Null or empty texts have size 1 and checksum 0. A null doc_id has the shard of an empty key.
    Repeated rows share a shard and get slots of their own. Other columns of the input are ignored.
    An empty table gives an empty result."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        jump_shards(F.col("doc_id"), shards).alias("_to"),
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_to.shard").alias("shard"), F.col("_to.grown").alias("grown_shard"))
    # written once, so that neither the sampling of ranges nor the sort reads the texts again
    numbered = number_within(cut_lineage(narrow), "shard", ["doc_id", "size", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def oracle_sql(shards: int = 16) -> str:
    """The same walk in DuckDB, as a recursive query; the checksum bit by bit over the distinct texts."""
    return f"""
WITH RECURSIVE walk(doc_id, k, shard, grown, done) AS (
  SELECT DISTINCT doc_id, 0, 0::BIGINT, 0::BIGINT, FALSE FROM documents
  UNION ALL
  SELECT doc_id, k + 1,
         CASE WHEN grown < {shards} THEN grown ELSE shard END,
         CASE WHEN jumped <= {shards} THEN jumped ELSE grown END,
         jumped > {shards}
  FROM (SELECT *, floor((grown + 1) / ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || (k + 1)), 1, 8))::BIGINT + 1)
                                       / 4294967296.0::DOUBLE))::BIGINT AS jumped
        FROM walk WHERE NOT done)
), placed AS (
  SELECT doc_id, CASE WHEN grown < {shards} THEN grown ELSE shard END AS shard, grown FROM walk WHERE done
), entries AS (
  SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(n)
), steps AS (SELECT list(v ORDER BY n) AS v FROM entries
), sums AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(text))::BIGINT),
           lambda i: ('0x' || substr(hex(encode(text)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), steps
)
SELECT d.doc_id, octet_length(encode(coalesce(d.text, '')))::BIGINT + 1 AS size, s.crc AS text_crc32, 'key' AS law, p.shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY d.doc_id NULLS FIRST, octet_length(encode(coalesce(d.text, ''))), s.crc) - 1 AS slot,
       p.grown::INTEGER AS grown_shard
FROM documents d JOIN placed p ON d.doc_id IS NOT DISTINCT FROM p.doc_id JOIN sums s ON s.text = coalesce(d.text, '')
"""
