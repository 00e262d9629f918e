from itertools import permutations
from random import Random

import pytest

from lumiray.llm import filter_audit

ORDERS = ["".join(o) for o in permutations("ABCDE")]


def test_ranks_and_intervals_cover_every_order_once():
    assert [filter_audit.rank(o) for o in sorted(ORDERS)] == list(range(120))
    for mask in range(32):
        fails = {f for k, f in enumerate("ABCDE") if mask >> k & 1}
        steps = {}
        for step, first, behind in filter_audit.intervals(mask):
            for r in range(first, behind):
                assert r not in steps
                steps[r] = step
        assert steps == {r: min(k for k, f in enumerate(o, 1) if f in fails) for r, o in enumerate(sorted(ORDERS)) if fails}


def plain(rows, labels):
    """Filters applied document by document, for every order."""
    blanks = " \t\n\x0b\x0c\r"
    docs = []
    for doc_id, text, lang in rows:
        t = text or ""
        words = "".join(" " if c in blanks else c for c in t).split(" ")
        words = [w for w in words if w]
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows) else set()
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        docs.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = set()
    for part in {d[0] for d in docs}:
        table, shapley = [], dict.fromkeys("ABCDE", 0)
        for o in ORDERS:
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(o, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                only = sum(d[1] == {f} for d in docs if d[0] == part)
                table.append((part, o, step, len(left), len(here), sum(f in d[1] for d in gone), only, sum(d[2] for d in here), sum(d[3] for d in here)))
                gone += here
                shapley[f] += len(here)
        out |= {(*r, shapley[r[1][r[2] - 1]]) for r in table}
    return out


@pytest.fixture
def audit(spark):
    def run(rows, labels):
        docs = spark.createDataFrame([(i, t, la, "x", 1) for i, t, la in rows], "doc_id long, text string, lang string, mask string, n long")
        marks = spark.createDataFrame([(*r, 3) for r in labels], "doc_id long, quality int, toxic int, good int")
        return filter_audit.audit_filters(docs, marks)

    return run


def test_every_order_equals_the_plain_loop(audit, odd, words):
    rng = Random(2)
    rows = [(i, t, s) for i, t, s in odd]
    for k in range(150):
        text = " ".join(rng.choice(words if k % 3 else words[:30]) for _ in range(rng.choice((20, 99, 100, 101, 160))))
        text = text.upper() if k % 7 == 0 else text
        rows.append((1000 + k, text + rng.choice(["", " #", "|", " 9 "]), rng.choice(["en", "fr", "", None])))
    rows += [(rng.choice([1, 5000, 6000 + k, None]), rows[20 + k][1], rng.choice(["en", "de"])) for k in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows[::2]] + [(1003, 1, 1), (1003, 0, 0), (None, 1, 1)]
    found = audit(rows, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = found.collect()
    assert len(got) == 600 * len({la or "" for _, _, la in rows})
    assert {tuple(r) for r in got} == plain(rows, labels)


def test_no_failures_and_empty_tables(audit, words):
    rows = audit([(1, " ".join(words[:200]), "en")], []).collect()
    assert len(rows) == 600 and all((r["kept"], r["removed"], r["shapley"]) == (1, 0, 0) for r in rows)
    assert audit([], [(1, 1, 1)]).collect() == []
