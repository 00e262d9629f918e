"""Operator 10: approximate nearest neighbours by counting collisions of single projections.

Vectors are projected onto `projections` random lines. A block of vectors keeps each projection as a
sorted array. A query opens a window around its own projection in every array; vectors that lie in the
windows of at least a share `threshold` of the arrays are verified by their exact distance. Virtual
rehashing: while fewer than `candidates` vectors of the block pass, all windows grow by `growth`; the
arrays stay as they are. A window that holds the whole block takes every vector, so that a block always
gives its own `k` best or all it has.

Every vector is in one block of about `block` rows, every query meets every block, and the best of all
blocks are merged. Blocks are dealt by row number, so that no value of any column can fill one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiray.llm.common import ship_package

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: an id, and a vector that is neither null nor
    empty nor zero and has only finite components."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    ).select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))


class Block:
    """Sorted projections of some vectors of one length."""

    #: half of the first window, in spreads of the projections
    start = 0.5

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, seed: int):
        lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        values = vectors @ lines
        self.ids, self.vectors, self.lines = ids, vectors, lines
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.spread = float(values.std())

    def nearest(self, names: np.ndarray, queries: np.ndarray, k: int, threshold: float, candidates: int, growth: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and distances of its k nearest among the vectors that pass."""
        n, m = len(self.ids), len(self.sorted)
        centres = queries @ self.lines
        least = int(np.ceil(threshold * m))
        half = max(self.start * self.spread, 1e-300)
        out: list = [None] * len(names)
        waiting = np.arange(len(names))
        while len(waiting):
            low = np.array([s.searchsorted(c - half) for s, c in zip(self.sorted, centres[waiting].T, strict=True)]).T
            high = np.array([s.searchsorted(c + half, "right") for s, c in zip(self.sorted, centres[waiting].T, strict=True)]).T
            whole = (high - low).sum(axis=1) == n * m
            again = []
            for at, a, b, every in zip(waiting.tolist(), low.tolist(), high.tolist(), whole.tolist(), strict=True):
                hits = np.bincount(np.concatenate([o[x:y] for o, x, y in zip(self.order, a, b, strict=True)]), minlength=n)
                passed = np.flatnonzero((hits >= least) & (self.ids != names[at]))
                if len(passed) < candidates and not every:
                    again.append(at)
                    continue
                gap = self.vectors[passed] - queries[at]
                distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                best = np.lexsort((self.ids[passed], distance))[:k]
                out[at] = self.ids[passed][best], distance[best]
            waiting = np.array(again, dtype=np.int64)
            half *= growth
        return out


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    projections: int = 128,
    threshold: float = 0.6,
    candidates: int = 600,
    growth: float = 1.3,
    block: int = 4096,
    query_block: int = 2048,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query, by Euclidean distance.

    Both inputs have vec_id and embedding. Rows without an id, or whose vector is null, empty, zero or
    holds a null or non-finite component, take no part. Vectors of another length than the query's
    are not compared. A query's own vec_id is never found; a query id that is repeated is asked once, with the
    smallest of its vectors. Repeated rows are found each. Other columns are ignored.
    Without vectors or queries the result is empty."""
    ship_package(vectors.sparkSession)
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    row_blocks = rows.count() // block + 1
    query_blocks = asked.count() // query_block + 1

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
        return df.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    keys = ["_rows", "_queries"]
    left = dealt(rows, "_rows", row_blocks, "_queries", query_blocks).groupBy(*keys)
    right = dealt(asked, "_queries", query_blocks, "_rows", row_blocks).groupBy(*keys)

    def find(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = have["vec"].map(len)
        for size, part in have.groupby(sizes):
            index = Block(part["vec_id"].to_numpy(), np.array(part["vec"].tolist(), dtype=np.float64), projections, seed)
            asking = want[want["vec"].map(len) == size]
            if len(asking):
                names = asking["vec_id"].to_numpy()
                found = index.nearest(names, np.array(asking["vec"].tolist(), dtype=np.float64), k, threshold, candidates, growth)
                out += [pd.DataFrame({"query_id": q, "vec_id": ids, "score": d}) for q, (ids, d) in zip(names, found, strict=True)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.cogroup(right).applyInPandas(find, FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
