import random
import zlib

import pytest

from lumiray.llm import quality, toxicity

LABEL = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(words):
    """Plain texts, shouted and symbol-ridden junk, and insults."""
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(700):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad, rude = k % 5 == 0, k % 6 == 1
        if bad:
            w = rng.choice([[x.upper() + "!!" for x in w], [x + "%%%" for x in w], [w[0]] * len(w)])
        if rude:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["blorg", "snarfish", "snarfing", "gr0tz"])
        rows.append((k, " ".join(w), None))
        labels.append((k, int(not bad), int(rude)))
    return rows, labels


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.mark.parametrize(
    "score, label, folds, held, threshold", [(quality.score_documents, 1, 4, 2, 0.7), (toxicity.score_documents, 2, 5, 0, 0.5)], ids=["quality", "toxicity"]
)
def test_held_out_accuracy(spark, table, corpus, odd, score, label, folds, held, threshold):
    rows, labels = corpus
    rows = [(1000 + i if i is not None and i >= 0 else i, t, s) for i, t, s in odd] + rows
    extra = [(None, 1, 0), (3, None, None), (5, 1, 0), (5, 1, 0), (99_999, 0, 1)]
    found = score(table(rows), spark.createDataFrame(labels + extra, LABEL)).collect()
    assert len(found) == len(rows)
    truth = {x[0]: x[label] for x in labels}
    for r in found:
        assert r["held_out"] == (fold(r["doc_id"], folds) == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    test = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) >= 0.95 * len(test)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_the_held_out_fold_change_nothing(spark, table, corpus, module):
    rows, labels = corpus
    folds, held = (4, 2) if module is quality else (5, 0)
    turned = [(i, 1 - q, 1 - t) if fold(i, folds) == held else (i, q, t) for i, q, t in labels]
    a, b = ([(r["doc_id"], r["score"]) for r in module.score_documents(table(rows), spark.createDataFrame(x, LABEL)).orderBy("doc_id").collect()] for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels_and_without_texts(spark, table, odd, module):
    none = spark.createDataFrame([], LABEL)
    assert len(module.score_documents(table(odd), none).collect()) == len(odd)
    assert module.score_documents(table([]), none).collect() == []


def test_rejected_documents_go(spark, table, corpus):
    rows, labels = corpus
    df = table(rows)
    kept = quality.keep_good(df, spark.createDataFrame(labels, LABEL))
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = {i for i, q, _ in labels if q}
    assert len(ids & good) >= 0.98 * len(good) and len(ids - good) <= 0.05 * len(ids)


def test_votes_are_those_of_a_plain_loop(spark, table, corpus, odd):
    import numpy as np

    rows, labels = corpus
    rows = rows[:200] + [(2000 + k, t, s) for k, (_, t, s) in enumerate(odd)]
    df = table(rows)
    model = quality.fit(df, spark.createDataFrame(labels, LABEL))
    compared = 0
    found = {r["doc_id"]: r["score"] for r in df.select("doc_id", quality.scorer(df, model).alias("score")).collect()}
    for i, text, _ in rows:
        z = np.log1p(quality.term_counts([(text or "").encode()])[0].astype(float)) * model.weights @ model.axes
        z /= max(np.linalg.norm(z), 1e-12)
        likeness = [float(np.dot(z, v)) for v in model.vectors]
        nearest = sorted(range(len(likeness)), key=lambda k: -likeness[k])[: model.neighbours]
        votes = [(max(likeness[k], 0) ** 8 + 1e-9, model.labels[k]) for k in nearest]
        # neighbours of equal likeness may be others
        if len(set(np.round(sorted(likeness)[-model.neighbours - 1 :], 6))) > model.neighbours:
            assert abs(found[i] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-3
            compared += 1
    assert compared > 50


def test_sample_is_bounded(spark):
    from lumiray.llm import labelled

    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)] * 2, LABEL)
    found = labelled.sample(labels, "quality", 4, [0, 1, 3], 50)
    assert found.count() == 50 and found.filter("fold = 2").count() == 0


def test_quality_is_learned_in_little_memory(spark, table, corpus):
    """The driver gets the terms that a text has, not all, and holds few tables of their counts at once."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    counts = (rng.poisson(0.2, (3000, quality.TERMS)) * rng.integers(1, 9, quality.TERMS)).astype(np.float32)
    x = np.log1p(counts)
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = x * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :48]
    labels, size = rng.integers(0, 2, len(counts)).astype(float), counts.nbytes
    tracemalloc.start()
    model = quality.learn(counts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(model.weights, weights) and np.allclose(model.axes, axes, atol=1e-5) and peak < 3.2 * size

    rows, given = corpus
    sent, frame = [], type(spark.range(0))
    collect = frame.collect
    try:
        frame.collect = lambda self: sent.append(collect(self)) or sent[-1]
        quality.fit(table(rows), spark.createDataFrame(given, LABEL))
    finally:
        frame.collect = collect
    assert len(sent[0]) > 400
    assert sum(len(v) for r in sent[0] for v in r if isinstance(v, (bytes, bytearray))) < len(sent[0]) * quality.TERMS
