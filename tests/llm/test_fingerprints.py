import hashlib
import math
import random
from collections import Counter

import numpy as np

from lumiray.llm import fingerprints as f


def entropy_level(window):
    total = sum(int(np.rint(n * math.log2(n) * f._UNIT)) for n in Counter(window).values())
    return 1024 - (total >> 16)


def test_levels_equal_counting():
    for alphabet, n in ((3, 400), (12, 400), (200, 400), (5, 16), (5, 15)):
        data = np.random.default_rng(n).integers(0, alphabet, n).astype(np.uint8)
        want = [entropy_level(data[k : k + 16].tolist()) for k in range(n - 15)]
        assert f.entropy_levels(data).tolist() == want


def test_features_equal_the_plain_rule():
    rng = np.random.default_rng(3)
    ranks = f.rarity_ranks(rng.integers(0, 1000, f.LEVELS))
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (1, 5, 40, 0, 300)]
    hashes, counts = f._features(texts, ranks)
    for text, n in zip(texts, counts.tolist(), strict=True):
        data = np.frombuffer(f.LEAD + text, dtype=np.uint8)
        rank = ranks[f.entropy_levels(data)]
        seen = Counter()
        for k in range(-15, len(rank)):
            own = [(rank[j], j) for j in range(max(0, k), min(len(rank), k + 16))]
            if own:
                seen[min(own)[1]] += 1
        assert n == sum(c >= f.POPULAR for c in seen.values())
    alone = [f.chains([t], ranks)[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, f.chains(texts, ranks), strict=True))


def test_documents_and_their_followers(table, words, odd):
    rng = random.Random(2)
    rows = odd + [(100 + 3 * k, " ".join(rng.choice(words) for _ in range(rng.randint(30, 400))), "s") for k in range(200)]
    rows += [(1000, rows[-1][1], "s"), (1001, rows[-1][1], "s")]
    found = f.fingerprint_documents(table(rows), block_rows=20).collect()
    assert len(found) == len(rows)
    single = [(i, t or "") for i, t, _ in rows]
    order = [x for x in sorted(single, key=lambda x: (x[0] is not None, x[0])) if x[0] is not None and x[0] > 10]
    by_id = {r["doc_id"]: r for r in found}
    for (i, t), (_, following) in zip(order, order[1:]):
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        assert by_id[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and by_id[i]["n_chars"] == len(t)
        assert by_id[i]["near_edited"] > 0.4 and (t == following or by_id[i]["near_next"] < 0.35)
    assert by_id[1000]["fingerprint"] == by_id[1001]["fingerprint"] and by_id[1000]["near_next"] == 1
    # after the last comes the first: a text without an id
    last = order[-1][1]
    firsts = [t for i, t in single if i is None]
    assert by_id[order[-1][0]]["edited_sha256"] in {hashlib.sha256((last[: len(last) - len(last) // 4] + t[: len(last) // 4]).encode()).hexdigest() for t in firsts}
    assert by_id[1]["fingerprint"] == "" and by_id[1]["edited_sha256"] == hashlib.sha256(b"").hexdigest()


def test_ranges_do_not_matter(table, words):
    rows = [(k, " ".join(words[k : k + 50]), "s") for k in range(90)]
    a, b = ([tuple(r) for r in f.fingerprint_documents(table(rows), block_rows=n).orderBy("doc_id").collect()] for n in (7, 1000))
    assert a == b


def test_single_and_no_document(table):
    only = f.fingerprint_documents(table([(4, "a single document follows itself", "s")])).collect()
    assert only[0]["near_next"] == 1
    assert f.fingerprint_documents(table([])).collect() == []
