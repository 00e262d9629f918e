"""Operator 4: packing by non-negative least squares over a histogram of lengths.

1. Each document becomes token ids and an end id; it is cut into whole windows and one rest.
2. Rests are counted by length in steps of `step`. All combinations of up to three steps that
   fill a window exactly are enumerated; non-negative least squares finds how often to repeat each,
   so that together they use up the histogram. The counts are rounded down, never beyond what exists.
3. The k-th rest of a length takes the k-th place that the combinations have for that length.
4. Rests without a place are dealt into groups of bounded size and packed greedily, longest first,
   each into the fullest sequence that still takes it.

The driver sees the histogram only (window / step counts). Numbers of rests are counted by input part.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiray.llm.common import cut_lineage, number_in_parts, ship_package

END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, window: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `window` ids; with `keep_ids` also the ids, as little-endian unsigned 32-bit bytes."""
    ship_package(docs.sparkSession)

    def cut(batches):
        from lumiray.llm.tokens import piece_tokenizer

        known = piece_tokenizer(tokenizer, special=True)
        for batch in batches:
            names, texts, at = batch["doc_id"].tolist(), ["" if t is None else t for t in batch["text"]], 0
            while at < len(texts):
                start, size = at, 0
                while at < len(texts) and (at == start or size + len(texts[at]) <= 1 << 19):
                    size += len(texts[at])
                    at += 1
                rows = []
                for name, ids in zip(names[start:at], known.encode(texts[start:at]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for k in range(0, len(ids), window):
                        data = ids[k : k + window].tobytes()
                        rows.append((name, k, len(data) // 4, zlib.crc32(data), len(ids), *([data] if keep_ids else [])))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECES + (", ids binary" if keep_ids else ""))


def combinations(cells: int) -> list[tuple[int, ...]]:
    """Up to three lengths, in steps, that sum to `cells`; longest first."""
    found = [(cells,)]
    found += [(cells - b, b) for b in range(1, cells // 2 + 1)]
    found += [(cells - b - c, b, c) for c in range(1, cells // 3 + 1) for b in range(c, (cells - c) // 2 + 1)]
    return found


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: an active set grows by the column of steepest descent
    and sheds columns that the solution of the free problem would make negative."""
    x = np.zeros(a.shape[1])
    free: list[int] = []
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        free.append(best)
        while True:
            z = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[free] = z
                break
            old = x[free]
            bad = z <= 0
            share = np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300))
            moved = old + share * (z - old)
            keep = moved > 1e-12 * max(1.0, np.abs(b).max())
            x[:] = 0
            free = [f for f, k in zip(free, keep, strict=True) if k]
            x[free] = moved[keep]
            if not free:
                break
        if not free:
            break
    return x


def repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to repeat them; never more of a length than the histogram has.
    histogram[k] counts rests of k + 1 steps."""
    ways = combinations(len(histogram))
    uses = np.zeros((len(histogram), len(ways)))
    for w, way in enumerate(ways):
        for cell in way:
            uses[cell - 1, w] += 1
    wanted = np.floor(nonnegative_least_squares(uses, histogram.astype(float)) + 1e-6)
    left = histogram.astype(float).copy()
    taken = []
    for w in np.argsort(-wanted, kind="stable"):
        if wanted[w] > 0:
            need = uses[:, w]
            n = min(wanted[w], np.min(left[need > 0] // need[need > 0]))
            if n > 0:
                left -= n * need
                taken.append((ways[w], int(n)))
    return taken


def places(taken: list[tuple[tuple[int, ...], int]], cells: int):
    """For each length: the first number of each run of places, the run's first sequence, and its place in it."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(cells + 1)]
    filled = [0] * (cells + 1)
    base = 0
    for way, n in taken:
        for place, cell in enumerate(way):
            runs[cell].append((filled[cell], base, place))
            filled[cell] += n
        base += n
    return [np.array(r, dtype=np.int64).reshape(-1, 3) for r in runs], np.array(filled, dtype=np.int64)


def fill_greedily(lengths: list[int], window: int) -> list[int]:
    """The sequence of each piece: longest first, into the fullest sequence that takes it."""
    spaces: list[tuple[int, int]] = []
    where = [0] * len(lengths)
    n = 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect.bisect_left(spaces, (lengths[k], -1))
        if at < len(spaces):
            space, s = spaces.pop(at)
        else:
            space, s = window, n
            n += 1
        where[k] = s
        if space > lengths[k]:
            bisect.insort(spaces, (space - lengths[k], s))
    return where


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, step: int = 16, group: int = 4000, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text is the end id alone. Repeated rows are packed each by itself. A null doc_id
    stays null. Columns other than doc_id and text are ignored. An empty table gives an empty result.
    Sequences take at most `window` ids; the pieces of one lie gapless from offset 0."""
    if window % step:
        raise ValueError("window must be a multiple of step")
    cells = window // step
    cut = cut_lineage(
        cut_documents(docs, tokenizer, window, keep_ids)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_cell", F.ceil(F.col("length") / step).cast("int"))
        .withColumn("_key", F.monotonically_increasing_id())
    )
    whole = cut.filter(F.col("length") == window).select("*", (F.col("_key") * 3).alias("sequence_id"), F.lit(0).alias("_place"))
    rests = cut.filter(F.col("length") < window)
    counted = {r["_cell"]: r["n"] for r in rests.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.array([counted.get(k + 1, 0) for k in range(cells)], dtype=np.int64)
    runs, filled = places(repeats(histogram), cells)
    groups = int((histogram - filled[1:]).sum()) // group + 1

    def place(batches):
        for b in batches:
            cell, rank = b["_cell"].to_numpy(), b["_number"].to_numpy()
            sequence = np.full(len(b), -1, dtype=np.int64)
            order = np.zeros(len(b), dtype=np.int64)
            for c in np.unique(cell):
                rows = np.flatnonzero((cell == c) & (rank < filled[c]))
                if len(rows):
                    run = runs[c][np.searchsorted(runs[c][:, 0], rank[rows], "right") - 1]
                    sequence[rows] = run[:, 1] + rank[rows] - run[:, 0]
                    order[rows] = run[:, 2]
            yield b.assign(sequence_id=np.where(sequence < 0, -1, sequence * 3 + 1), _place=order)

    # places are dealt to narrow rows; ids, if kept, are joined by the written piece's number
    narrow = number_in_parts(rests.drop("ids"), "_cell", "_part", ["_key"], "_number")
    fields = f"{PIECES}, _key long, _cell int, _number long"
    placed = cut_lineage(narrow.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_key", "_cell", "_number").mapInPandas(place, fields + ", sequence_id long, _place long"))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        found = fill_greedily(rows["length"].tolist(), window)
        return rows.assign(sequence_id=(rows["_group"] * (1 << 20) + np.array(found, dtype=np.int64)) * 3 + 2)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_key"]
    left = (
        placed.filter(F.col("sequence_id") < 0)
        .withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(greedy, fields + ", sequence_id long, _place long, _group long")
    )
    out = [*columns, "sequence_id", "_place"]
    every = whole.select(*out).unionByName(placed.filter(F.col("sequence_id") >= 0).select(*out)).unionByName(left.select(*out))
    before = Window.partitionBy("sequence_id").orderBy("_place", F.desc("length"), "_key").rowsBetween(Window.unboundedPreceding, -1)
    packed = every.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    if keep_ids:
        packed = packed.join(cut.select("_key", "ids"), "_key")
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
