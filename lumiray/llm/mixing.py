"""Operator 1: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source gets a target number of words: its share of the weights, at most `most` times its own
   words, the excess reshared by weight.
2. A source's documents are put in a pseudo-random order and laid end to end, again from the start after
   the last, until the target is reached; the document at the end is taken in part. So every document is
   taken equally often, but for one pass that stops on the way. The line is cut into blocks of
   `block` words; a document belongs to the block its first word lies in.
3. A binary tree divides the blocks of all sources among the output shards: at each node the left half
   of the shards draws its number of blocks without replacement from the node's urn (multivariate
   hypergeometric), the right half keeps the rest. The urns shrink exactly to the shards' quotas. Each
   draw is seeded by its node, so that every shard walks from the root to its own leaf by itself,
   without a driver and without other shards.
4. A shard takes consecutive, disjoint blocks of each source's permuted line, as many as its quota
   (where they begin is the sum of the quotas left of it), and shuffles them locally.

Only counts by source, and by source and range of the permuted order, are brought together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiray.llm.common import cut_lineage, n_words, ship_package

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, words and n (one row for each source) -> with place (by code point, null last) and target.

    The targets of uncapped sources are level * weight; the level follows from the caps sorted by
    cap / weight, without iteration. Sorting and summing run over the list of sources alone."""
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("_w", weight).withColumn("_cap", F.col("words") * F.lit(float(most)))
    by_ratio = every.orderBy(F.col("_cap") / F.col("_w"), "place")
    later, earlier = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # the level if exactly the sources before this one stop at their caps
    leveled = placed.withColumn("_level", (F.sum("words").over(every) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(later))
    # the first source that the level leaves under its cap fixes the level of all after it
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "place", "_level"))).over(every)["_level"]
    target = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.coalesce(F.least("_cap", level * F.col("_w")), F.col("_cap")))
    return leveled.withColumn("target", target).drop("_w", "_cap", "_level")


def _seed(seed: int, low: int, high: int) -> np.random.Generator:
    return np.random.default_rng(np.frombuffer(hashlib.sha256(f"{seed}:{low}:{high}".encode()).digest(), dtype=np.uint64))


def leaf(urn: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's quota of blocks by source, and the blocks of the shards before it.

    Draws are taken source by source from numpy's hypergeometric, which needs counts under 1e9."""
    low, high, urn = 0, shards, urn.astype(np.int64).copy()
    before = np.zeros_like(urn)
    while high - low > 1:
        middle = (low + high) // 2
        total = int(urn.sum())
        draw = total * (middle - low) // (high - low)
        rng = _seed(seed, low, high)
        left = np.zeros_like(urn)
        for k in range(len(urn)):
            total -= int(urn[k])
            if draw:
                left[k] = rng.hypergeometric(int(urn[k]), total, draw) if total else draw
                draw -= int(left[k])
        if shard < middle:
            high, urn = middle, left
        else:
            low, urn, before = middle, urn - left, before + left
    return urn, before


def quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """place, shard, first (block) and blocks, for each source and shard that takes some.

    `sources`: place and blocks. The list of sources, one number for each, goes to every task."""
    spark = sources.sparkSession
    ship_package(spark)
    counts = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("place", "blocks"))).alias("urn"))

    def walk(batches):
        for b in batches:
            for shard, urn in zip(b["shard"].tolist(), b["urn"], strict=True):
                places = np.array([u["place"] for u in urn], dtype=np.int64)
                own, before = leaf(np.array([u["blocks"] for u in urn], dtype=np.int64), shards, shard, seed)
                yield pd.DataFrame({"place": places, "shard": shard, "first": before, "blocks": own})[own > 0]

    each = spark.range(shards, numPartitions=max(1, min(shards // 16, 1000))).withColumnRenamed("id", "shard")
    return each.join(F.broadcast(counts)).mapInPandas(walk, "place int, shard long, first long, blocks long")


def mix(
    docs: DataFrame,
    shards: int = 16,
    block: int = 4096,
    range_words: int = 1 << 20,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, pieces (and the columns `keep`).

    pieces: array of pass, words (the document's first so many) and shard; empty if the mix takes
    nothing. A source's pieces sum to its target, rounded to a whole word. No row is taken for more
    than `most` times its size (rounded up to a whole word).

    Null source: a source of its own, the last. Null or empty text: size 0, no pieces. Sources without
    words have target 0. Repeated rows and equal doc_ids are documents of their own; their order in the
    line follows the checksum of the text, then the input's parts. Reruns over the same files agree.
    Other columns are ignored. An empty table gives an empty result."""
    spark = docs.sparkSession
    cells = 1 << 20
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *keep,
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)).alias("_at"), F.monotonically_increasing_id().alias("_row"),
    )
    narrow = sized.select("source", "size", "_at")
    # words by 2 ** 20 cells of the random order would be too many rows for small inputs; the sources
    # are summed first, and a cell then holds about `range_words` words of its source
    sources = cut_lineage(narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    goal = targets(sources, weights, most).withColumn("_take", F.round("target").cast("long"))
    goal = goal.withColumn("_ranges", F.least(F.lit(cells), F.floor(F.greatest(F.col("words") / range_words, F.col("n") / 8192)) + 1))
    # so many words that the tree's draws stay below numpy's limit of 1e9 blocks
    words = F.greatest(F.lit(block), F.ceil(F.sum("_take").over(Window.partitionBy(F.lit(0))) / 100_000_000))
    goal = cut_lineage(goal.withColumn("_block", words).withColumn("blocks", F.ceil(F.col("_take") / F.col("_block"))))
    quota = cut_lineage(quotas(goal.select("place", "blocks"), shards, seed))

    facts = F.broadcast(goal.select(F.col("source").alias("_s"), "place", "words", "target", "_take", "_ranges", "_block"))  # a row for each source
    known = sized.join(facts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_range", F.floor(F.col("_at") * F.col("_ranges") / (1 << 40)))
    sums = known.groupBy("place", "_range").agg(F.sum("size").alias("_w"))
    before = Window.partitionBy("place").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut_lineage(sums.select(F.col("place").alias("_p"), F.col("_range").alias("_r"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_shift")))
    inside = Window.partitionBy("place", "_range").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, -1)
    lined = (
        known.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, (F.col("place") == F.col("_p")) & (F.col("_range") == F.col("_r")))
        .withColumn("_start", F.col("_in") + F.col("_shift"))
    )

    def piece(turn: Column) -> Column:
        start = turn * F.col("words") + F.col("_start")
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_take") - start))
        return F.struct(turn.cast("int").alias("turn"), taken.alias("words"), F.floor(start / F.col("_block")).alias("block"))

    passes = F.when((F.col("size") > 0) & (F.col("_take") > 0), F.sequence(F.lit(0), F.floor(F.col("_take") / F.col("words")))).otherwise(F.array().cast("array<bigint>"))
    lined = lined.withColumn("_pieces", F.filter(F.transform(passes, piece), lambda p: p["words"] > 0))
    # runs of blocks by source, ascending: sources x shards small numbers, read beside the rows
    runs = quota.groupBy(F.col("place").alias("_q")).agg(F.sort_array(F.collect_list(F.struct("first", "shard", "blocks"))).alias("_runs"))
    lined = lined.join(F.broadcast(runs), F.col("place") == F.col("_q"), "left")

    def shard_of(at: Column) -> Column:
        fits = F.filter("_runs", lambda r: (r["first"] <= at) & (at < r["first"] + r["blocks"]))
        return F.element_at(fits, 1)["shard"].cast("int")

    pieces = F.transform("_pieces", lambda p: F.struct(p["turn"].alias("pass"), p["words"].alias("words"), shard_of(p["block"]).alias("shard")))
    return lined.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", pieces.alias("pieces"), *keep)


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of the input: one row for each piece, its text cut to the piece's words
    (and n_chars to match, if there). Rows are dealt to the shards and shuffled inside each."""
    names = docs.columns
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    pieces = mix(whole, keep=("_doc",), **settings).select("_doc", "size", F.explode("pieces").alias("_piece"))
    words = F.regexp_extract_all(F.col("_doc.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    cut = F.col("_piece.words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_piece.words").cast("int")), "")).otherwise(F.col("_doc.text"))
    out = pieces.withColumn("_text", text).withColumn("_order", F.xxhash64(F.lit(settings.get("seed", 7)), "_doc.doc_id", "_piece.pass", "_text"))
    out = out.repartition(F.col("_piece.shard")).sortWithinPartitions("_piece.shard", "_order")

    def column(name: str) -> Column:
        own = F.col(f"_doc.`{name}`")
        if name == "text":
            return F.col("_text").alias("text")
        if name == "n_chars":
            return F.when(cut, F.length("_text")).otherwise(own).cast(docs.schema[name].dataType).alias(name)
        return own.alias(name)

    return out.select(*map(column, names))
