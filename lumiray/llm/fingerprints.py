"""Operator 8: fingerprints of improbable features.

Every window of 16 bytes has an entropy; how rare its entropy level is in the whole corpus gives its
rank. Among 16 windows in a row the rarest, first one is counted; windows counted 6 times or more are
the text's features. Their hashes, five parts of 11 bits, go into Bloom filters of 256 bytes, 160
features to a filter, one filter after another: the fingerprint is the chain of filters. Two chains are
alike as far as the filters of the shorter one overlap with their best partners in the other, in
bits, above what chance gives and relative to the most there could be.

A window may begin up to 15 bytes before the text, in zero bytes, so that short texts have windows too.
An empty text has an empty fingerprint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray.llm.common import byte_blocks, mix64, ship_package, text_blocks

WINDOW, NEAR, POPULAR = 16, 16, 6
LEAD = b"\0" * (WINDOW - 1)
BITS, PARTS, FEATURES = 2048, 5, 160
#: whole-number sums of c log c are this fine; a window of different bytes has sum 0, of equal bytes 2 ** 26
_UNIT = 1 << 20
_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
_SUM = np.rint(_COUNT * np.log2(np.maximum(_COUNT, 1)) * _UNIT).astype(np.int32)
_STEP = np.diff(_SUM, append=0)  # what one more byte adds to that many
LEVELS = 1025


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at each place, from 0 (one byte value) to 1024 (all different).

    When a window moves on, one byte leaves and one comes: the sum of c log c over the counts changes by
    steps that depend on how often these bytes are in the window, which comparing the data with itself
    at all shorter distances tells. Sums are whole numbers, so that a window's level depends on its bytes alone."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    before, after = np.zeros(len(data), dtype=np.uint8), np.zeros(len(data), dtype=np.uint8)
    for low in range(0, len(data), 1 << 15):  # pieces stay in the processor's cache over all distances
        high = min(len(data), low + (1 << 15))
        for lag in range(1, WINDOW):
            start = max(low, lag)
            if start < high:
                same = (data[start:high] == data[start - lag : high - lag]).view(np.uint8)
                before[start:high] += same
                after[start - lag : high - lag] += same
    sums = np.empty(n, dtype=np.int32)
    sums[0] = _SUM[np.bincount(data[:WINDOW], minlength=1)].sum()
    np.subtract(_STEP.take(before[WINDOW:]), _STEP.take(after[: n - 1]), out=sums[1:])
    np.cumsum(sums, out=sums)
    return 1024 - (sums >> 16)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with their leads in one array, where each begins, and which windows are theirs: as many as
    a text has bytes. The leads keep windows of different texts NEAR apart."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\0" * NEAR + b"".join(x for t in texts for x in (LEAD, t)) + b"\0" * (NEAR + WINDOW), dtype=np.uint8)
    starts = NEAR + np.cumsum(lengths + len(LEAD)) - lengths - len(LEAD)
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    return data, starts, np.cumsum(inside[: len(data) - WINDOW + 1]).astype(bool)


def _features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features in their order, and how many each text has."""
    data, starts, inside = _laid_out(texts)
    n, never = len(inside), np.iinfo(np.int64).max
    key = (ranks << 32).take(entropy_levels(data))
    key += np.arange(n)
    key[~inside] = never
    # minimum of each 16 in a row: of the rest of its block of 16 and of the beginning of the next
    padded = np.full(-(-n // NEAR) * NEAR + NEAR, never)
    padded[:n] = key
    rows = padded.reshape(-1, NEAR)
    rest = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(rows, axis=1).ravel()
    least = np.minimum(rest[: n - NEAR + 1], head[NEAR - 1 : n])
    least = least[least != never] & 0xFFFFFFFF
    at = np.flatnonzero(np.bincount(least, minlength=n) >= POPULAR)
    halves = data[at[:, None] + np.arange(WINDOW)].view(np.uint64)
    hashes = mix64(mix64(halves[:, 0]) ^ (halves[:, 1] * np.uint64(0x9E3779B97F4A7C15)))
    return hashes, np.diff(np.searchsorted(at, np.append(starts, len(data))))


def _filters(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Chains of filters, a row of 32 unsigned 64-bit numbers for each."""
    filters = -(-counts // FEATURES)
    number = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.repeat(np.cumsum(filters) - filters, counts) + number // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), dtype=np.uint8)
    for k in range(PARTS):
        bits[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
    return np.split(np.packbits(bits, axis=1).view(np.uint64), np.cumsum(filters)[:-1])


def chains(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each text."""
    return [c for block in byte_blocks(texts) for c in _filters(*_features(block, ranks))]


def printed(chain: np.ndarray) -> str:
    return chain.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty chains are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    in_a, in_b = np.bitwise_count(a).sum(axis=1), np.bitwise_count(b).sum(axis=1)
    both = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(axis=2).astype(np.float64)
    most, chance = np.minimum.outer(in_a, in_b), np.multiply.outer(in_a, in_b) / BITS
    share = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    # a filter that has hardly begun fits into any full one: it has to find one like itself
    share *= np.minimum(1, 2 * most / np.maximum.outer(in_a, in_b))
    return float(share.max(axis=1) @ in_a / in_a.sum())


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of the whole corpus have each entropy level."""
    ship_package(docs.sparkSession)

    def count(batches):
        total = np.zeros(LEVELS, dtype=np.int64)
        for b in batches:
            for _, block in text_blocks(b["text"]):
                data, _, inside = _laid_out(block)
                total += np.bincount(entropy_levels(data)[inside], minlength=LEVELS)
        yield pd.DataFrame({"level": np.arange(LEVELS), "n": total})

    rows = docs.select("text").mapInPandas(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, dtype=np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: the rarer in the corpus, the lower; among equals the higher entropy first.
    Levels under 128 (few byte values, repeated) are never improbable in a useful way and come last."""
    order = np.lexsort((-np.arange(LEVELS), counts, np.arange(LEVELS) < 128))
    ranks = np.empty(LEVELS, dtype=np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, ranks: np.ndarray | None = None, block_rows: int = 4000) -> DataFrame:
    """One row for each document, with its likeness to its edited text and to the next document.

    Documents follow one another by doc_id; null ids come first, equal ids by a hash of the text. After
    the last comes the first; a single document follows itself. A null text is empty. Other columns are
    ignored. An empty table gives an empty result. `ranks` come from the corpus unless given.

    The texts are shuffled once, into ranges of doc_id that are streamed in order; the first document of
    a range is also sent to the range before. A task holds about a million bytes of text."""
    ship_package(docs.sparkSession)
    if ranks is None:
        ranks = rarity_ranks(level_counts(docs))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    if n == 0:
        return docs.sparkSession.createDataFrame([], RESULT)
    ranges = min(10_000, n // block_rows + 1)
    marks = rows.agg(F.min("_id").alias("least"), F.percentile_approx("_id", [k / ranges for k in range(ranges)], 20 * ranges).alias("marks")).first()
    starts = np.unique(np.array([marks["least"], *marks["marks"]], dtype=np.int64))
    last = len(starts) - 1

    @F.pandas_udf("array<long>")
    def range_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(starts, ids.to_numpy(), "right") - 1
        first = starts[own] == ids.to_numpy()
        return pd.Series([[k, (k - 1) if k else last] if f else [k] for k, f in zip(own.tolist(), first.tolist(), strict=True)])

    dealt = (
        rows.withColumn("_ranges", range_of("_id"))
        .select("*", F.posexplode("_ranges").alias("_after", "_range"))
        .drop("_ranges")
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionById(len(starts), F.col("_range").cast("int"))
        .sortWithinPartitions("_range", "_after", "_id", "_tie")
        .select("_range", "_after", "doc_id", "text")
    )

    def describe(held: list) -> pd.DataFrame:
        """All but the last of `held` with the one after it."""
        texts = [t for _, t in held]
        edited = [edit(a, b).encode("utf-8", "surrogatepass") for a, b in zip(texts, texts[1:])]
        own = chains([t.encode("utf-8", "surrogatepass") for t in texts], ranks)
        other = chains(edited, ranks)
        return pd.DataFrame(
            [
                (name, len(text), hashlib.sha256(e).hexdigest(), printed(a), printed(c), likeness(a, c), likeness(a, b))
                for (name, text), e, a, b, c in zip(held, edited, own, own[1:], other)
            ],
            columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        ).astype({"doc_id": "Int64"})

    def stream(batches):
        held, size, at, closed = [], 0, None, False
        for b in batches:
            for place, after, name, text in zip(b["_range"].tolist(), b["_after"].tolist(), [None if pd.isna(x) else int(x) for x in b["doc_id"]], b["text"], strict=True):
                if place != at:
                    held, size, at, closed = [], 0, place, False
                if closed:
                    continue
                held.append((name, text))
                size += len(text)
                closed = after == 1
                if closed or size > 1 << 20:
                    if len(held) > 1:
                        yield describe(held)
                    held, size = held[-1:], len(text)

    return dealt.mapInPandas(stream, RESULT)
