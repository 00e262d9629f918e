import hashlib
import zlib

from lumiray.llm import sharding


def walk(key, shards):
    """The walk, step by step."""
    at, to, k = 0, 0, 0
    while to < shards:
        at, k = to, k + 1
        r = (int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:8], 16) + 1) / 2**32
        to = int((at + 1) / r)
    return at


def test_walk_slots_and_growth(table, odd):
    rows = odd + [(k, f"text {k}", "s") for k in range(100, 900)]
    found = sharding.shard_documents(table(rows), 16).collect()
    assert len(found) == len(rows)
    for r in found:
        name = "" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == walk(name, 16) and r["grown_shard"] == walk(name, 17) and r["grown_shard"] in (r["shard"], 16)
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    for s in range(16):
        own = sorted((r["slot"], r["doc_id"]) for r in found if r["shard"] == s)
        assert [k for k, _ in own] == list(range(len(own)))
        ids = [i for _, i in own if i is not None]
        assert ids == sorted(ids)
    assert 0 < sum(r["grown_shard"] == 16 for r in found) < len(rows) / 8


def test_few_shards_and_empty_table(table):
    assert sharding.shard_documents(table([]), 4).collect() == []
    assert [r["shard"] for r in sharding.shard_documents(table([(5, "x", "s")]), 1).collect()] == [0]


def test_no_python_in_the_plan(table, odd):
    plan = sharding.shard_documents(table(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
