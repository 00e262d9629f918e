import random
import re

import numpy as np
import pytest

from lumiray.llm import near_duplicates, shingles


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def by_hand(rows):
    """(doc_id, set size, component) by comparing all pairs; null ids never name a component."""
    sets = [shingle_set(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=str)


def copies(rng, words, n, base, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
        out.append(" ".join(w))
    return out


def test_components_equal_all_pairs(table, words, odd):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    for size, changes in ((6, 1), (20, 3), (60, 3), (200, 12), (900, 40)):
        texts += copies(rng, words, 20, [rng.choice(words) for _ in range(size)], changes)
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    texts += texts[:20] + [t.upper() for t in texts[20:30]]
    rng.shuffle(texts)
    rows = odd + [(100 + k, t, "s") for k, t in enumerate(texts)]
    found = near_duplicates.near_duplicates(table(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == by_hand(rows)


@pytest.mark.parametrize("share", [0, 2])
def test_counts_of_shingles_only_order_the_keys(table, words, monkeypatch, share):
    rng = random.Random(8)
    texts = [t for size, changes in ((8, 1), (40, 3), (200, 10)) for t in copies(rng, words, 15, [rng.choice(words) for _ in range(size)], changes)]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    values, _ = shingles.shingle_sets([t.encode() for t in texts])
    some = np.unique(values)[::share] if share else values[:0]
    seen = np.random.default_rng(8).integers(3, 90, len(some)).astype(np.int32)
    monkeypatch.setattr(near_duplicates, "common_shingles", lambda profile: (some, seen))
    found = near_duplicates.near_duplicates(table(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == by_hand(rows)


@pytest.mark.parametrize("of", [1, 8, 1 << 40])
def test_counting_all_classes_or_none_gives_the_same_components(table, words, monkeypatch, of):
    rng = random.Random(9)
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [t for size, changes in ((40, 3), (200, 10)) for t in copies(rng, words, 15, [rng.choice(words) for _ in range(size)], changes)]
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 20))) for _ in range(40)]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    monkeypatch.setattr(near_duplicates, "COUNTED", of)
    classes = len({frozenset(shingle_set(t)) for t in texts})
    counted = near_duplicates.profiles(table(rows).select("doc_id", "text")).filter("shingle is not null").count()
    assert (counted > 0) == (of < 1 << 40) and (of > 1 or counted >= classes)
    found = near_duplicates.near_duplicates(table(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == by_hand(rows)


def test_large_group_in_tiles(table, words, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SMALL", 4)
    monkeypatch.setattr(near_duplicates, "TILE", 16)
    rng = random.Random(4)
    rows = [(k, t, "s") for k, t in enumerate(copies(rng, words, 150, [rng.choice(words) for _ in range(50)], 4))]
    found = near_duplicates.near_duplicates(table(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == by_hand(rows)


def test_keys_are_shared_by_all_that_may_link(words):
    """The pigeonhole holds in every band, also for sets so small that words of the sketch collide."""
    rng = np.random.default_rng(6)
    for size in [*range(1, 40), 64, 100, 333]:
        for _ in range(20):
            common = rng.integers(0, 2**63, size).astype(np.uint64)
            extra = rng.integers(0, 2**63, rng.integers(0, size // 3 + 1)).astype(np.uint64)
            a, b = np.sort(common), np.sort(np.append(common, extra))
            if 3 * len(b) > 4 * len(a):
                continue
            weight = rng.integers(0, 3, len(b))
            band = shingles.band_of(np.array([len(a)]))
            keys = []
            for s in (a, b):
                most = max(len(s) * 7 // 3 // 7, (len(s) + int(shingles.largest(band)[0])) // 7) if len(s) > len(a) else (len(s) + len(s) * 4 // 3) // 7
                w = weight[np.searchsorted(b, s)]
                keys.append(set(shingles.part_keys(s, np.array([len(s)]), band, np.array([most]), w)[0].tolist()))
            assert len(keys[0] & keys[1]) >= shingles.least_shared(band)[0]
            first, second = (np.frombuffer(shingles.parity_sketches(s, np.array([len(s)]), band)[0], dtype=np.uint64) for s in (a, b))
            assert np.bitwise_count(first ^ second).sum() <= len(b) - len(a)


def test_one_of_each_group_stays(table, words, odd):
    rows = odd + [(50, " ".join(words[:60]), "s"), (51, " ".join(words[:60]), "s"), (52, " ".join(words[1:60]), "s")]
    df = table(rows)
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-8, 1, 2, 3, 4, 6, 7, 9, 50] and ids.count(None) == 2


def test_one_stays_of_groups_without_ids_and_of_shared_ids(table, words):
    one, other = " ".join(words[:60]), " ".join(words[60:120])
    near = lambda text: text + " end"
    kept = near_duplicates.keep_one(table([(None, one, "s"), (None, near(one), "s"), (None, one, "s"), (7, other, "s"), (7, near(other), "s")])).collect()
    assert sorted((r["doc_id"] is None, r["text"] in (one, near(one))) for r in kept) == [(False, False), (True, True)]


def test_strangers_of_a_hub_meet_all_tiles(table, words, monkeypatch):
    """A chain of texts, each linked with the next, in tiles smaller than the chain."""
    monkeypatch.setattr(near_duplicates, "TILE", 8)
    monkeypatch.setattr(near_duplicates, "SMALL", 2)
    rows = [(k, " ".join(words[6 * k : 6 * k + 100]), "s") for k in range(40)] + [(100 + k, " ".join(words[300 : 400 - k]), "s") for k in range(30)]
    found = near_duplicates.near_duplicates(table(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == by_hand(rows) and {r["component_id"] for r in found if r["doc_id"] < 40} == {0}


def test_empty_table(table):
    assert near_duplicates.near_duplicates(table([])).collect() == []
    assert near_duplicates.keep_one(table([])).collect() == []


@pytest.mark.parametrize("edges, want", [([], []), ([("a", "b"), ("c", "b"), ("d", "e"), ("e", "e")], [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")])])
def test_components(spark, edges, want):
    from lumiray.llm.components import connected_components

    found = connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert sorted(map(tuple, found)) == want


def test_long_path(spark):
    from lumiray.llm.components import connected_components

    found = connected_components(spark.range(1, 60).selectExpr("id AS a", "id + 1 AS b"))
    assert {r["root"] for r in found.collect()} == {1}


def test_chains_of_links_are_tied_to_their_least(spark, table, words):
    """A chain of texts, each like the next one only: its classes come as a star, not as a chain along which labels run."""
    names = [f"{k:02d}" for k in range(20)]
    chain = [(names[k], names[k + 1]) for k in range(9)] + [("15", "12"), ("12", "18")]
    found = near_duplicates.to_least(random.Random(1).sample(chain, len(chain)))
    assert sorted(found) == [(n, "00") for n in names[1:10]] + [("15", "12"), ("18", "12")] and near_duplicates.to_least([]) == []
    w = [random.Random(2).choice(words) + str(k) for k in range(400)]
    docs = table([(k, " ".join(w[20 * k : 20 * k + 200]), None) for k in range(10)]).select("doc_id", "text")
    links = near_duplicates.find_links(docs, near_duplicates.profiles(docs)).distinct().collect()
    assert len(links) == len({r["a"] for r in links}) == 9 and len({r["b"] for r in links}) == 1
