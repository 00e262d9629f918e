import math
import os

import numpy as np
import pytest

from lumiray.llm import neighbours

FOLDER = "/root/testdata/sf0.01"
VECTOR = "vec_id long, embedding array<float>, label int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], VECTOR)


def brute(rows, i, k=10):
    own = dict(rows)[i]
    near = sorted((math.dist(own, v), j) for j, v in rows if j != i)
    return near[:k]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((10, 32))
    vectors = (centres[rng.integers(0, 10, 6000)] * 0.5 + rng.standard_normal((6000, 32))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = frame(spark, rows)
    found = neighbours.search(df, df.filter("vec_id % 100 = 0"), block=1500).collect()
    assert len(found) == 600
    hits = 0
    for q in range(0, 6000, 100):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        for _, j, s in own:
            assert math.isclose(s, math.dist(rows[q][1], rows[j][1]), rel_tol=1e-12)
        hits += len({j for _, j, _ in own} & {j for _, j in brute(rows, q)})
    assert hits >= 0.9 * 600


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")
def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).collect()
    have = neighbours.usable(vectors).collect()
    ids, x = np.array([r["vec_id"] for r in have]), np.array([r["vec"] for r in have])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        distance = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        nearest = [j for j in ids[np.lexsort((ids, distance))] if j != q][:10]
        hits += len(set(nearest) & {r["vec_id"] for r in found if r["query_id"] == q})
        total += len(nearest)
    assert total and hits >= 0.9 * total


def test_few_odd_and_tied_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (200, [0.0, 1.0]), (7, [0.0, 0.5]), (3, [0.0, 1.5]), (3, [0.0, 1.5]), (300, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (400, [1.0, 2.0, 3.0])]
    df = frame(spark, rows)
    found = neighbours.search(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(100, 7), (100, 200), (100, 3), (100, 3), (200, 3), (200, 3), (200, 7), (200, 100)]
    assert found[4]["score"] == found[6]["score"] == 0.5


def test_equal_vectors_and_empty_table(spark):
    df = frame(spark, [(k, [1.0, 2.0]) for k in range(300)])
    found = neighbours.search(df, df.filter("vec_id = 100")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(k, 0.0) for k in range(10)]
    assert neighbours.search(df.limit(0), df).collect() == [] and neighbours.search(df, df.limit(0)).collect() == []
