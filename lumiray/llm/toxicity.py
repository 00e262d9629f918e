"""Operator 3: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words, and beginnings of words of four to six letters, that labelled toxic texts
use far more often than others. Features are densities of lexicon words, their weight and their nearness to
a word of address, the same after undoing common disguises, and rates of capitals, punctuation, symbols and
disguised words. Lexicon, trees and calibration are learned from different folds of the labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray.llm import labelled
from lumiray.llm.common import cut_lineage, ship_package

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
LEXICON_FOLDS, TREE_FOLDS, CALIBRATION_FOLDS = [1, 2], [3], [4]
#: fixed values: words of address in the languages of the corpus
ADDRESS = "you your yours yourself tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr sie tú ti tuyo usted ustedes su vosotros".split()
#: fixed values: characters that stand for letters in disguised words
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": "", "-": "", "_": "", ".": ""}
_UNDO = str.maketrans(DISGUISES)
_INNER = re.compile(r"[^\W\d_][\d@$!*_.\-]+[^\W\d_]")
_EDGES = ".,;:!?\"'()[]{}<>|%&#$*-_«»¿¡“”„"
FEATURES = 13
_MOST_WORDS = 400_000


def words(text: str) -> list[str]:
    """Lower-case words between ASCII blanks."""
    return [w.decode("utf-8", "surrogatepass") for w in text.lower().encode("utf-8", "surrogatepass").split()]


def terms(word: str) -> list[str]:
    """What a lexicon may hold of a word: itself, and its beginnings marked by a star."""
    bare = word.strip(_EDGES)
    return [bare] + [bare[:k] + "*" for k in (4, 5, 6) if len(bare) >= k] if bare else []


def learn_lexicon(texts: DataFrame, most: int = 400, ratio: float = 6.0) -> dict[str, float]:
    """Terms with their weights (log of the ratio of shares of texts), from rows of text and label. At
    most `most` terms come to the driver."""
    ship_package(texts.sparkSession)

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, label in zip(b["text"], b["label"].tolist(), strict=True):
                seen[label].update({t for w in set(words(text or "")) for t in terms(w)})
        # a term of no toxic text of this task may still be toxic elsewhere: all are counted
        every = seen[0].keys() | seen[1].keys()
        yield pd.DataFrame([(t, seen[1][t], seen[0][t]) for t in every], columns=["term", "bad", "good"])

    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    counted = texts.select("text", "label").mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    found = counted.filter(F.col("bad") >= max(3, bad // 100)).withColumn("w", F.log(share)).filter(F.col("w") >= math.log(ratio))
    return {r["term"]: r["w"] for r in found.orderBy(F.desc(F.col("w") * F.sqrt("bad")), "term").limit(most).collect()}


class Features:
    """Dense features of texts; words are looked up once and remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.address = lexicon, set(ADDRESS)
        self.known: dict[str, tuple[float, float, float, float]] = {}

    def _look(self, word: str) -> tuple[float, float, float, float]:
        """Weight; whether of address; weight only once a disguise is undone; whether disguised."""
        bare = word.strip(_EDGES)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        hidden = 1.0 if _INNER.search(bare) else 0.0
        undone = 0.0
        if hidden and not weight:
            undone = max((self.lexicon.get(t, 0.0) for t in terms(bare.translate(_UNDO))), default=0.0)
        return weight, float(bare in self.address), undone, hidden

    def of(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * FEATURES
        if len(self.known) > _MOST_WORDS:
            self.known.clear()
        known, own = self.known, words(text)
        for w in set(own).difference(known):
            known[w] = self._look(w)
        n = max(1, len(own))
        seen = np.array([known[w] for w in own], dtype=np.float64).reshape(-1, 4)
        weight, address, undone, hidden = seen.T
        hits = np.flatnonzero((weight > 0) | (undone > 0))
        near = 0.0
        persons = np.flatnonzero(address)
        if len(hits) and len(persons):
            at = np.searchsorted(persons, hits)
            gap = np.minimum(np.abs(hits - persons[np.minimum(at, len(persons) - 1)]), np.abs(hits - persons[np.maximum(at - 1, 0)]))
            near = float(np.exp(-gap / 8.0).mean())
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        upper = int(((raw >= 65) & (raw <= 90)).sum())
        letters = upper + int(((raw >= 97) & (raw <= 122)).sum()) + int((raw >= 192).sum())
        marks = int(np.isin(raw, (33, 63)).sum())
        symbols = int(np.isin(raw, (35, 36, 37, 38, 42, 64, 94, 124, 126)).sum())
        return [
            float((weight > 0).mean()) if len(own) else 0.0, float(weight.sum() / n), float(weight.max(initial=0.0)), math.log1p(float((weight > 0).sum())),
            near, float(address.sum() / n), float(undone.sum() / n), float(undone.max(initial=0.0)), float(hidden.sum() / n),
            upper / max(1, letters), marks / len(raw), symbols / len(raw), math.log1p(len(own)),
        ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    ship_package(docs.sparkSession)

    def describe(batches):
        maker = Features(lexicon)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "features": [maker.of(t) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(describe, "doc_id long, features array<double>")


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = 8000, trees: int = 20, depth: int = 3) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5).

    Learns from at most `bound` labelled rows for each of lexicon, trees and calibration; every text is
    scored whole. Labels, lang, source and doc_id are no inputs. A null text counts as empty and has a score
    too; equal texts have equal scores; repeated rows are scored each. Where a fold has no rows of
    both labels, the score is the share of toxic rows (0 without labels). Other columns are ignored. An empty
    table gives an empty result."""
    own = docs.select("doc_id", "text")
    first = cut_lineage(labelled.sample(labels, "toxic", FOLDS, LEXICON_FOLDS, bound))
    lexicon = learn_lexicon(own.join(F.broadcast(first), "doc_id"))  # at most `bound` ids
    described = cut_lineage(with_features(own, lexicon))
    vectors = described.withColumn("x", array_to_vector("features"))

    def examples(folds: list[int]) -> DataFrame:
        chosen = labelled.sample(labels, "toxic", FOLDS, folds, bound)
        return cut_lineage(described.join(F.broadcast(chosen), "doc_id").select("features", F.col("label").cast("double").alias("label")).coalesce(2)).withColumn("x", array_to_vector("features"))

    training = examples(TREE_FOLDS)
    held_out = (labelled.fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    share = training.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).first()
    if not share["n"] or share["bad"] in (0, share["n"]):
        score = F.lit(float(share["bad"] or 0) / max(1, share["n"]))
        return described.select("doc_id", held_out, score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=3, maxMemoryInMB=64).fit(training)

    def raw(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    check = raw(examples(CALIBRATION_FOLDS)).select("raw", "label")
    scored = raw(vectors).select("doc_id", "raw")
    if check.filter("label = 1").count() and check.filter("label = 0").count():
        scored = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(check).transform(scored)
        # steps are flat; a little of the raw score keeps the order inside them
        score = 0.98 * F.col("calibrated") + 0.02 * F.col("raw")
    else:
        score = F.col("raw")
    return scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
