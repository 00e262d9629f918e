import hashlib
import random
import re
from math import log

import numpy as np
import pytest

from lumiray.llm import grammar, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def made(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture
def corpus(words):
    rng = random.Random(12)
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, bare = [], {}
    for k in range(300):
        text = [rng.choice(words) for _ in range(60)] + ["".join(rng.choice(words) for _ in range(4)) for _ in range(5)]
        rng.shuffle(text)
        if k % 4 == 0:
            text.insert(30, rng.choice(['token = "', "API_KEY:", "passwd='", "é secret ="]) + "sk_live_" + made(rng, letters, 24))
        if k % 5 == 0:
            text.insert(20, "日本 AKIA" + made(rng, letters[:26] + "0123456789", rng.choice((15, 16, 17, 20))))
        if k % 6 == 0:
            text.insert(10, made(rng, hexes, rng.choice((23, 24, 40))))
        if k % 10 == 3:
            bare[k] = "sk_live_" + made(rng, letters, 24)
            text.insert(40, rng.choice(["", "KEY="]) + bare[k])
        rows.append((k, " ".join(text), "s"))
    return rows, bare


def test_base_spans_and_learned_ones(table, odd, corpus):
    rows, bare = corpus
    odd = odd + [(50, 'PassWord : x-y_z=1 ſecret=abcdefg toKen=abcdefg api-key=abcdefg AKIAAKIA' + "A" * 30 + "f" * 24, None), (51, "token = 'short' token=longer1", "")]
    found = secrets.find_secrets(table(rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    texts = {}
    for i, t, _ in rows + odd:
        texts.setdefault(i, []).append(t)
    hit = 0
    for r in found:
        bases = [plain_base(t) for t in texts[r["doc_id"]]]
        digests = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() for base in bases]
        base = bases[digests.index(r["base_sha256"])]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == name for k, _, _ in base) for name in secrets.KINDS]
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans)
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
        text = texts[r["doc_id"]][0] or ""
        added = [text[int(a) : int(b)] for k, a, b in spans if (k, int(a), int(b)) not in base]
        if r["doc_id"] in bare:
            hit += bare[r["doc_id"]] in added
        for value in added:  # nothing of ordinary text
            assert value.startswith("sk_live_") or re.fullmatch("[0-9a-f]{23}|AKIA[A-Z0-9]{15}", value)
    assert hit >= 0.9 * len(bare)


def test_equal_results_in_any_split_and_without_examples(table, corpus):
    rows, _ = corpus
    one = sorted(map(tuple, secrets.find_secrets(table(rows).repartition(1)).collect()))
    assert sorted(map(tuple, secrets.find_secrets(table(rows[::-1]).repartition(7)).collect())) == one
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in secrets.find_secrets(table([(1, "only ordinary words here", "s"), (2, None, "s")])).collect()] == [(k, 0, 0, 0, empty, "") for k in (1, 2)]
    assert secrets.find_secrets(table([])).collect() == []


def test_merging_finds_the_loop():
    tree = grammar.infer([b"ab" * k for k in range(1, 30) for _ in range(max(1, 30 - k))])
    assert len(tree.reach) <= 6
    a, b = grammar.CODE[ord("a")], grammar.CODE[ord("b")]
    at = 0
    for _ in range(100):  # longer than any example
        assert set(tree.next[at]) == {a}
        at = tree.next[at][a]
        assert set(tree.next[at]) == {b}
        at = tree.next[at][b]


def test_scores_letter_by_letter():
    rng = random.Random(1)
    values = [made(rng, "abc0=/", rng.randint(1, 30)).encode() for _ in range(200)]
    tree = grammar.infer(values)
    automaton = grammar.Automaton(tree)
    assert np.allclose(np.exp(automaton.cost).sum(axis=1) + np.exp(automaton.stop), 1)
    sizes = np.array([len(v) for v in values])
    found = automaton.score(grammar.CODE[np.frombuffer(b"".join(values), dtype=np.uint8)], np.cumsum(sizes) - sizes, sizes)
    for v, score in zip(values, found, strict=True):
        at, total = 0, 0.0
        for symbol in grammar.CODE[list(v)]:
            total += automaton.cost[at, symbol]
            at = automaton.to[at, symbol]
        assert abs(total + automaton.stop[at] - score) < 1e-9
    assert tree.reach[0] >= 200 and sum(tree.end) == 200 and log(1) == 0
