"""Operator 6: quality by votes of the nearest labelled neighbours in a latent semantic space.

Terms say how a text is written rather than what about: triples of character classes, words repeated
at once or soon after, words seen before in the text, and the order of its length. Weighted by sublinear
frequency and rarity, they are projected to the leading singular vectors of a bounded sample of labelled
texts. Every document is compared with all vectors of the sample, block by block and exactly; the labels
of the nearest are averaged by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiray.llm import labelled
from lumiray.llm.common import hash_bytes, ship_package, text_blocks

TERMS, HASHED = 1024, 960
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _classes() -> np.ndarray:
    """Letters by case, digits, and each other ASCII character by itself; bytes of longer characters count as small letters."""
    kind = np.arange(256)
    kind[ord("a") : ord("z") + 1] = kind[128:] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    return kind.astype(np.int64)


_CLASS = _classes()


def term_counts(texts: list[bytes]) -> np.ndarray:
    """A row of term counts for each text."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), lengths)
    kind = _CLASS[data]
    triple = (kind[:-2] * 16384 + kind[1:-1] * 128 + kind[2:]) * 2654435761 % 4294967291 % HASHED
    own = owner[:-2] == owner[2:]
    counts = np.bincount((owner[:-2] * TERMS + triple)[own], minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32)
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    words, of = hash_bytes(data, starts, ends), owner[starts]
    for lag in (1, 2, 3):
        again = (words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag])
        counts[:, HASHED + lag] = np.bincount(of[lag:][again], minlength=len(texts))
    order = np.lexsort((words, of))
    seen = (words[order][1:] == words[order][:-1]) & (of[order][1:] == of[order][:-1])
    total = np.bincount(of, minlength=len(texts))
    share = np.bincount(of[order][1:][seen], minlength=len(texts)) / np.maximum(total, 1)
    rows = np.arange(len(texts))
    counts[rows, HASHED + 8 + np.minimum(7, share * 8).astype(int)] = 8
    counts[rows, HASHED + 16 + np.minimum(20, np.log2(total + 1)).astype(int)] = 2
    return counts


ROWS = 128  # texts whose products with all labelled vectors are held at once


@dataclass
class Model:
    weights: np.ndarray  # rarity of each term
    axes: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled texts, of length one
    labels: np.ndarray
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = (np.log1p(counts) * self.weights) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        k = min(self.neighbours, len(self.labels))
        for at, block in text_blocks(texts):
            for low in range(0, len(block), ROWS):
                like = self.latent(term_counts(block[low : low + ROWS])) @ self.vectors.T
                near = np.argpartition(-like, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(like, near, axis=1), 0) ** 8 + 1e-9
                out[at + low : at + low + len(like)] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def learn(counts: np.ndarray, labels: np.ndarray, dimensions: int = 48, neighbours: int = 25) -> Model:
    """The model of labelled rows of term counts, whose memory it uses up: the driver holds few tables of this size at once."""
    weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    np.log1p(counts, out=counts)
    x = np.empty_like(counts)
    for at in range(0, len(x), ROWS):
        part = counts[at : at + ROWS] * weights
        x[at : at + ROWS] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh(x.T @ x)
    del x
    model = Model(weights, vectors[:, ::-1][:, :dimensions].astype(np.float32).copy(), np.zeros((0, 0)), labels, neighbours)
    model.vectors = model.latent(np.expm1(counts, out=counts)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, bound: int = 6000, dimensions: int = 48, neighbours: int = 25) -> Model:
    """Learn from at most `bound` labelled rows outside the held-out fold (documents and labels are joined by doc_id)."""
    ship_package(docs.sparkSession)
    chosen = labelled.sample(labels, "quality", FOLDS, [f for f in range(FOLDS) if f != HELD_OUT], bound)

    def count(batches):
        for b in batches:
            for at, block in text_blocks(b["text"]):
                rows = term_counts(block)
                found = [np.flatnonzero(r) for r in rows]  # few of the terms
                yield pd.DataFrame({
                    "label": b["label"].iloc[at : at + len(block)].to_numpy(),
                    "terms": [f.astype(np.uint16).tobytes() for f in found], "counts": [r[f].tobytes() for r, f in zip(rows, found, strict=True)],
                })

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `bound` ids
    rows = texts.select("label", "text").mapInPandas(count, "label int, terms binary, counts binary").collect()
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((1, 1), np.float32), np.full(1, 0.5), 1)
    counts = np.zeros((len(rows), TERMS), dtype=np.float32)
    for own, r in zip(counts, rows, strict=True):
        own[np.frombuffer(r["terms"], dtype=np.uint16)] = np.frombuffer(r["counts"], dtype=np.float32)
    return learn(counts, np.array([r["label"] for r in rows], dtype=np.float64), dimensions, neighbours)


def scorer(docs: DataFrame, model: Model) -> Column:
    """The score of a text, 0 to 1, as a column of the DataFrame; null and empty texts have one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return score(F.col("text"))


def score_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted (1 from 0.7).

    Only texts are scored: labels, lang, source and doc_id are no inputs. A null text counts as empty; equal
    texts have equal scores; repeated rows are scored each. Without labelled rows every score is 0.5.
    Columns of clashing names are ignored. An empty table gives an empty result."""
    scored = docs.select("doc_id", scorer(docs, fit(docs, labels, **settings)).alias("score"))
    held_out = labelled.fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    names = docs.columns
    return docs.withColumn("_quality_score", scorer(docs, fit(docs, labels, **settings))).filter(F.col("_quality_score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in names])
