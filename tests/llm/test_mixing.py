import re
from collections import defaultdict

import numpy as np
import pytest

from lumiray.llm import mixing


def by_hand(words, weights=(5, 2, 1), most=3):
    """Targets by the iterative rule."""
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None] * (None in words)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(words.values()), set()
    while True:
        left = total - sum(most * words[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: most * words[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if target[s] > most * words[s] + 1e-9}
        if not over:
            return target
        capped |= over


def taken(row):
    return sum(p["words"] for p in row["pieces"])


def test_targets_and_exact_words(table, words, odd):
    rows = odd + [(100 + k, " ".join(words[: k % 90]), f"s{k % 7}" if k % 3 else "s0") for k in range(400)]
    found = mixing.mix(table(rows), shards=5, block=64, range_words=500).collect()
    assert len(found) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own, took = defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        own[s] += size(t)
    goal = by_hand(dict(own))
    for r in found:
        took[r["source"]] += taken(r)
        assert taken(r) <= 3 * r["size"] and r["source_size"] == own[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        assert all(p["shard"] is not None and 0 <= p["shard"] < 5 for p in r["pieces"])
    assert sorted(r["size"] for r in found) == sorted(size(t) for _, t, _ in rows)
    for s in own:
        assert abs(took[s] - goal[s]) <= 0.5


def test_reruns_agree_and_texts_match_pieces(table, words):
    rows = [(k, " ".join(words[k : k + 40]) + "\n", "ab"[k % 2]) for k in range(120)]
    df = table(rows)
    first, again = ([(r["doc_id"], r["pieces"]) for r in mixing.mix(df).orderBy("doc_id").collect()] for _ in range(2))
    assert first == again
    texts = mixing.mixed_texts(df).collect()
    assert set(df.columns) == set(texts[0].asDict())
    whole = {i: t for i, t, _ in rows}
    assert all(whole[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in texts)
    assert sum(len(r["text"].split()) for r in texts) == sum(p["words"] for _, ps in first for p in ps)


def test_tree_divides_blocks_exactly():
    urn = np.array([50, 0, 7, 300, 1])
    shards = [mixing.leaf(urn, 9, s, seed=3) for s in range(9)]
    assert (sum(own for own, _ in shards) == urn).all()
    assert all((before == sum((o for o, _ in shards[:k]), np.zeros(5, int))).all() for k, (_, before) in enumerate(shards))
    assert max(o.sum() for o, _ in shards) - min(o.sum() for o, _ in shards) <= 4


def test_shards_take_the_blocks_the_tree_draws(table, words):
    """Words by source and shard are those of the tree's blocks, but for the documents at the ends of a run of blocks."""
    rows = [(k, " ".join(words[: 5 + k % 30]), f"s{k % 5}") for k in range(1500)]
    found = mixing.mix(table(rows), shards=6, block=256, range_words=2000).collect()
    own, took = defaultdict(int), defaultdict(int)
    for r in found:
        own[r["source"]] += r["size"]
        for p in r["pieces"]:
            took[r["source"], p["shard"]] += p["words"]
    goal = by_hand(dict(own))
    urn = np.array([-(-round(goal[s]) // 256) for s in sorted(own)])
    for shard in range(6):
        blocks, _ = mixing.leaf(urn, 6, shard, seed=7)
        for s, n in zip(sorted(own), blocks.tolist(), strict=True):
            assert abs(took[s, shard] - 256 * n) <= 256 + 2 * 35
    totals = [sum(n for (_, k), n in took.items() if k == shard) for shard in range(6)]
    assert max(totals) - min(totals) <= 5 * (2 * 256 + 4 * 35)


def test_empty_and_wordless(table):
    assert mixing.mix(table([])).collect() == []
    assert [(r["target"], r["pieces"]) for r in mixing.mix(table([(1, None, None), (2, " ", "a")])).collect()] == [(0.0, [])] * 2
    assert mixing.mixed_texts(table([])).collect() == []
