"""Operator 13: links between the tokens of two tokenizers over the same text, by lockstep merging.

1. A block of texts is tokenized by both; ends of tokens are byte offsets in the block's bytes. Texts whose
   joined tokens are not the text again take no part.
2. One state vector holds a pointer into A's and one into B's tokens for each text of the block. In each step
   every pointer pair is a link; the token that ends first is passed, both where they end together, which is a
   cut. Finished texts are taken out of the vector. A long text is dealt to several entries of the vector, at
   offsets where both tokenizers end a token, so that it needs no more steps than a short one.
3. Distinct id pairs of each text go to a written table; their corpus-wide counts are grouped sums, and return to
   the texts by a join on the pair: broadcast while the counts are small, shuffled beyond.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray.llm.common import arrow_blocks, cut_lineage, ship_package
from lumiray.llm.tokens import byte_entries, piece_tokenizer, segment_tokenizer
from lumiray.session import broadcast_if_small

STRETCH = 1 << 10  # bytes of a text that an entry of the state vector walks, or a little more


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (token of A, token of B, whether both end there) in order of the text.

    `a_end` and `b_end` are ascending offsets with the same last one; a lane starts at token `a_from` of A and `b_from`
    of B, which begin at the same offset, and ends where the next one starts."""
    lanes = len(a_from)
    if not lanes or not len(a_end):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool)
    i, j = a_from.astype(np.int64), b_from.astype(np.int64)
    stop = np.append(i[1:], len(a_end))
    at = i + j  # a lane has fewer links than tokens on both sides
    room = len(a_end) + len(b_end)
    link_a, link_b = np.full(room, -1, dtype=np.int64), np.zeros(room, dtype=np.int64)
    cut = np.zeros(room, dtype=bool)
    alive = i < stop
    while True:
        if not alive.all():
            i, j, stop, at = i[alive], j[alive], stop[alive], at[alive]
            if not len(i):
                break
        ends_a, ends_b = a_end[i], b_end[j]
        link_a[at], link_b[at], cut[at] = i, j, ends_a == ends_b
        i = i + (ends_a <= ends_b)
        j = j + (ends_b <= ends_a)
        at = at + 1
        alive = i < stop
    used = link_a >= 0
    return link_a[used], link_b[used], cut[used]


def lanes(a_end: np.ndarray, b_end: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of A and B of each lane: a text, or a stretch of a long one up to the next shared end."""
    shared = np.zeros(int(a_end[-1]) + 1, dtype=bool)
    shared[b_end] = True
    common = a_end[shared[a_end]]  # ends of texts are among them
    starts = np.append(0, text_end[:-1])
    n = np.maximum((text_end - starts + STRETCH - 1) // STRETCH, 1)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wanted = np.repeat(starts, n) + within * STRETCH
    begin = np.where(within == 0, wanted, common[np.minimum(np.searchsorted(common, wanted), len(common) - 1)])
    begin = np.unique(begin)
    begin = begin[begin < a_end[-1]]
    return np.searchsorted(a_end, begin, "right"), np.searchsorted(b_end, begin, "right")


class Aligner:
    """Both tokenizers and what is derived from their entries, once a worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = piece_tokenizer(a_path), segment_tokenizer(b_path)
        self.a_bytes, self.b_bytes = byte_entries(a_path), self.b.entries()
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # an id as written before another id of its side, at the end of the side, and at the end of the text
        self.a_written = [np.array([f"{k}{mark}" for k in range(len(self.a_bytes))], dtype=object) for mark in ",|"]
        self.b_written = [np.array([f"{k}{mark}" for k in range(len(self.b_bytes))], dtype=object) for mark in (",", ";", "")]

    def tokens(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where the text has no tokens."""
        none = np.zeros(0, dtype=np.int64)
        full = [k for k, t in enumerate(texts) if t]
        spaced = [b" " + texts[k] for k in full]
        a_ids, b_ids = [none] * len(texts), [none] * len(texts)
        found = zip(full, spaced, self.a.encode([t.decode("utf-8", "surrogatepass") for t in spaced]), self.b.encode(spaced), strict=True)
        for k, text, a, b in found:
            if b"".join(self.a_bytes[a].tolist()) == text and b"".join(self.b_bytes[b].tolist()) == text:
                a_ids[k], b_ids[k] = a.astype(np.int64), b.astype(np.int64)
        return a_ids, b_ids

    def align(self, texts: list[bytes]) -> dict[str, list | np.ndarray]:
        a_ids, b_ids = self.tokens(texts)
        n_a = np.array([len(x) for x in a_ids], dtype=np.int64)
        n_b = np.array([len(x) for x in b_ids], dtype=np.int64)
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        out = {"n_a": n_a, "n_b": n_b}
        if not len(a):
            zero = np.zeros(len(texts), dtype=np.int64)
            return out | {"n_groups": zero, "n_links": zero, "groups_sha256": [""] * len(texts), "pair": np.zeros(0, dtype=np.int64), "times": np.zeros(0, dtype=np.int64), "n_pairs": zero}
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        text_end = a_end[np.cumsum(n_a)[n_a > 0] - 1]
        link_a, link_b, cut = lockstep(a_end, b_end, *lanes(a_end, b_end, text_end))
        text_of = np.repeat(np.arange(len(texts)), n_a)[link_a]
        out["n_links"] = np.bincount(text_of, minlength=len(texts))
        out["n_groups"] = np.bincount(text_of[cut], minlength=len(texts))
        group = np.cumsum(cut) - cut
        out["groups_sha256"] = self._digests(a, b, n_a + n_b, link_a, link_b, group)
        # distinct pairs of each text
        pair = a[link_a] * len(self.b_bytes) + b[link_b]
        order = np.lexsort((pair, text_of))
        pair, owner = pair[order], text_of[order]
        first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))
        out["pair"] = pair[first]
        out["times"] = np.diff(np.append(first, len(pair)))
        out["n_pairs"] = np.bincount(owner[first], minlength=len(texts))
        return out

    def _digests(self, a, b, sizes, link_a, link_b, group) -> list[str]:
        """Hash of the groups as written: a group's ids of A, then of B."""
        groups = int(group[-1]) + 1
        in_a, in_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        in_a[link_a], in_b[link_b] = group, group
        counts_a = np.bincount(in_a, minlength=groups)
        counts_b = np.bincount(in_b, minlength=groups)
        # a token's place: all tokens of earlier groups, then those of A before those of B
        place_a = np.arange(len(a)) + (np.cumsum(counts_b) - counts_b)[in_a]
        place_b = np.arange(len(b)) + np.cumsum(counts_a)[in_b]
        last_a = np.append(in_a[1:] != in_a[:-1], True)
        last_b = np.append(in_b[1:] != in_b[:-1], True)
        written = np.empty(len(a) + len(b), dtype=object)
        written[place_a] = np.where(last_a, self.a_written[1][a], self.a_written[0][a])
        text_b = np.where(last_b, self.b_written[1][b], self.b_written[0][b])
        stops = np.cumsum(sizes)
        ends = np.zeros(len(written), dtype=bool)
        ends[stops[sizes > 0] - 1] = True
        text_b = np.where(ends[place_b], self.b_written[2][b], text_b)
        written[place_b] = text_b
        return [hashlib.sha256("".join(written[s - n : s].tolist()).encode()).hexdigest() if n else "" for s, n in zip(stops.tolist(), sizes.tolist(), strict=True)]


_open: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Aligner(a_path, b_path)
    return _open[a_path, b_path]


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct id pairs with the times they are linked,
    a row for each row of `docs`. A pair is the id of A times the number of ids of B, plus the id of B."""
    ship_package(docs.sparkSession)
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def align(batches):
        tool = aligner(a_path, b_path)
        for batch in batches:
            for at, texts in arrow_blocks(batch.column(1)):
                found = tool.align(texts)
                offsets = pa.array(np.append(0, np.cumsum(found["n_pairs"])), pa.int32())
                columns = [batch.column(0).slice(at, len(texts)), *[pa.array(found[c], pa.int64()) for c in counts], pa.array(found["groups_sha256"], pa.string())]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(found[c], pa.int64())) for c in ("pair", "times")]
                yield pa.RecordBatch.from_arrays(columns + lists, ["doc_id", *counts, "groups_sha256", "pairs", "times"])

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(align, fields)


def pair_counts(pairs: DataFrame, b_ids: int) -> DataFrame:
    """(pair, count, best): links of each id pair over all texts, and whether no pair of its B id has more."""
    counts = cut_lineage(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    most = counts.groupBy((F.col("pair") % b_ids).alias("_b")).agg(F.max("count").alias("_most"))
    return counts.join(most, F.col("pair") % b_ids == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each document: doc_id, n_a and n_b (tokens), n_groups (stretches between shared token ends), n_links
    (overlapping tokens), n_best (links whose id pair is the most frequent of its B id, ties included), count_sum (the
    pairs' corpus-wide counts over the document's links), groups_sha256.

    `a_path` is a byte-level file of `tokenizers`, `b_path` a model of `sentencepiece`. Null and empty texts, and those
    that a tokenizer does not give back byte by byte, have zeros and an empty hash. Repeated rows, with or without an
    id, get a row each and count each time. Other columns are ignored. An empty table gives an empty result."""
    import sentencepiece

    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    texts = cut_lineage(aligned_texts(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()))
    pairs = texts.select("_row", F.inline(F.arrays_zip("pairs", "times"))).select("_row", F.col("pairs").alias("pair"), F.col("times").alias("n"))
    scores = broadcast_if_small(pair_counts(pairs, b_ids))
    # rows of a text lie together, so that they are summed before the shuffle
    sums = pairs.join(scores, "pair").groupBy("_row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return texts.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
