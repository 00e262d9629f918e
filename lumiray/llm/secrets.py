"""Operator 12: credentials in texts, by fixed patterns and by automata inferred from what the patterns find.

1. The patterns find assigned values, access keys and long hexadecimal runs. Their distinct values are the
   labelled credentials, runs outside of them the labelled ordinary ones; a bounded sample of each kind, those
   of least hash over the whole table, is learned from.
2. For each kind a prefix tree of the sample is merged into a probabilistic automaton (`grammar`), for
   ordinary runs as well.
3. All runs of credential characters outside the patterns' spans, and their parts between dots and equals signs,
   are scored by every automaton. A run is added as the kind that explains it best if it is as likely, letter by
   letter, as nearly all examples of the kind, and much likelier than an ordinary run.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray.llm import grammar
from lumiray.llm.common import arrow_blocks, cut_lineage, hash_bytes, ship_package

KINDS = ("assign", "access", "hex")
ORDINARY = "ordinary"
#: fixed values of the patterns
_NAMES = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = re.compile((_NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").encode())
ACCESS = re.compile(b"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", dtype=np.uint8))
_IS_RUN = grammar.CODE >= 0
_IS_PART = _IS_RUN & ~np.isin(np.arange(256), np.frombuffer(b".=", dtype=np.uint8))

#: parameters: shortest run that is scored, examples to learn from, the longest of them, odds against an ordinary
#: run, and the share of examples that may be less likely than an added run
SHORTEST, EXAMPLES, LONGEST_EXAMPLE, ODDS, LEFT_OUT = 12, 500, 200, 1e6, 0.02


class Model(NamedTuple):
    """Automata by kind, the least likelihood of a letter by kind, and the automaton of ordinary runs."""

    automata: dict[str, grammar.Automaton]
    least: dict[str, float]
    ordinary: grammar.Automaton


def _runs(mask: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least `shortest` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    use = ends - starts >= shortest
    return starts[use], ends[use]


class _Found(NamedTuple):
    data: np.ndarray  # the texts' bytes, a line feed behind each
    kind: np.ndarray  # of the patterns' spans: number in KINDS
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray  # where the credential of the span starts
    runs: list[tuple[np.ndarray, np.ndarray]]  # runs and parts of runs that no span touches


def _scan(texts: list[bytes]) -> _Found:
    raw = b"".join(t + b"\n" for t in texts)
    data = np.frombuffer(raw, dtype=np.uint8)
    spans = []
    at = 0
    for t in texts:
        spans += [(0, at + m.start(), at + m.end(), at + m.start(1)) for m in ASSIGN.finditer(t) if m.end() - m.start(1) >= LEAST_ASSIGN]
        spans += [(1, at + m.start(), at + m.end(), at + m.start()) for m in ACCESS.finditer(t) if m.end() - m.start() >= LEAST_ACCESS]
        at += len(t) + 1
    starts, ends = _runs(_IS_HEX[data], LEAST_HEX)
    every = np.concatenate([np.array(spans, dtype=np.int64).reshape(-1, 4), np.column_stack([np.full(len(starts), 2), starts, ends, starts])])
    every = every[np.lexsort((every[:, 0], every[:, 1]))]
    covered = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(covered, every[:, 1], 1)
    np.add.at(covered, every[:, 2], -1)
    touched = np.append(0, np.cumsum(np.cumsum(covered[:-1]) > 0))
    free = []
    for mask in (_IS_RUN, _IS_PART):
        a, b = _runs(mask[data], SHORTEST)
        use = touched[a] == touched[b]
        free.append((a[use], b[use]))
    return _Found(data, every[:, 0], every[:, 1], every[:, 2], every[:, 3], free)


def examples(docs: DataFrame, most: int = EXAMPLES) -> dict[str, list[bytes]]:
    """The `most` distinct values of least hash of each kind and of ordinary runs, over all texts. Each block of texts
    gives its own least ones, among which those of the table are."""
    ship_package(docs.sparkSession)

    def least(batches):
        for batch in batches:
            for _, texts in arrow_blocks(batch.column(0)):
                found = _scan(texts)
                for kind, name in enumerate((*KINDS, ORDINARY)):
                    own = found.kind == kind
                    a, b = (found.value[own], found.end[own]) if kind < len(KINDS) else found.runs[0]
                    use = b - a <= LONGEST_EXAMPLE
                    a, b = a[use], b[use]
                    hashes, first = np.unique(hash_bytes(found.data, a, b), return_index=True)
                    a, b = a[first[:most]], b[first[:most]]
                    yield pd.DataFrame({"kind": name, "hash": (hashes[:most] >> np.uint64(1)).astype(np.int64), "value": [found.data[x:y].tobytes() for x, y in zip(a, b, strict=True)]})

    def frames(batches):
        import pyarrow as pa

        for rows in least(batches):
            yield pa.RecordBatch.from_pandas(rows, schema=pa.schema([("kind", pa.string()), ("hash", pa.int64()), ("value", pa.binary())]), preserve_index=False)

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(frames, "kind string, hash long, value binary")
    found = cut_lineage(found.groupBy("kind", "hash").agg(F.min("value").alias("value")))
    return {k: [bytes(r["value"]) for r in found.filter(F.col("kind") == k).orderBy("hash").limit(most).select("value").collect()] for k in (*KINDS, ORDINARY)}


def _per_letter(automaton: grammar.Automaton, values: list[bytes]) -> np.ndarray:
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    data = grammar.CODE[np.frombuffer(b"".join(values), dtype=np.uint8)]
    return automaton.score(data, np.cumsum(sizes) - sizes, sizes) / sizes


def learn(samples: dict[str, list[bytes]]) -> Model:
    """Kinds without examples have no automaton."""
    automata = {k: grammar.Automaton(grammar.infer(samples[k])) for k in KINDS if samples.get(k)}
    least = {k: float(np.quantile(_per_letter(a, samples[k]), LEFT_OUT)) for k, a in automata.items()}
    return Model(automata, least, grammar.Automaton(grammar.infer(samples.get(ORDINARY, []))))


def _added(model: Model, found: _Found) -> np.ndarray:
    """(kind, start, end) of parts of runs, and of runs without such a part, that one of the kinds explains."""
    none = np.zeros((0, 3), dtype=np.int64)
    if not model.automata:
        return none
    codes = np.maximum(grammar.CODE[found.data], 0)
    out = [none]
    taken = np.zeros(len(found.data), dtype=bool)
    for starts, ends in reversed(found.runs):  # parts go before the runs that hold them
        before = np.append(0, np.cumsum(taken))
        new = before[starts] == before[ends]
        a, sizes = starts[new], (ends - starts)[new]
        if not len(a):
            continue
        base = model.ordinary.score(codes, a, sizes)
        best, kind = np.full(len(a), -np.inf), np.zeros(len(a), dtype=np.int64)
        for k, name in enumerate(KINDS):
            if name in model.automata:
                score = model.automata[name].score(codes, a, sizes)
                good = (score / sizes >= model.least[name]) & (score - base >= np.log(ODDS)) & (score > best)
                best, kind = np.where(good, score, best), np.where(good, k, kind)
        hit = np.isfinite(best)
        out.append(np.column_stack([kind[hit], a[hit], (a + sizes)[hit]]))
        for x, n in zip(a[hit].tolist(), sizes[hit].tolist(), strict=True):
            taken[x : x + n] = True
    return np.concatenate(out)


def scan_texts(texts: list[bytes], model: Model) -> pd.DataFrame:
    """Counts, hash and spans of each text."""
    found = _scan(texts)
    base = np.column_stack([found.kind, found.start, found.end])
    added = _added(model, found)
    every = np.concatenate([base, added])
    is_base = np.arange(len(every)) < len(base)
    order = np.lexsort((every[:, 2], every[:, 0], every[:, 1]))
    every, is_base = every[order], is_base[order]
    points = np.append(0, np.cumsum((found.data & 0xC0) != 0x80))  # code points before each byte
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    of = np.searchsorted(begins, every[:, 1], "right") - 1
    shift = points[begins[of]]
    written = [f"{KINDS[k]}:{a}:{b}" for k, a, b in zip(every[:, 0].tolist(), (points[every[:, 1]] - shift).tolist(), (points[every[:, 2]] - shift).tolist(), strict=True)]
    spans, own = [[] for _ in texts], [[] for _ in texts]
    for k, name, fixed in zip(of.tolist(), written, is_base.tolist(), strict=True):
        spans[k].append(name)
        if fixed:
            own[k].append(name)
    out = {f"n_{name}": np.bincount(of[is_base & (every[:, 0] == k)], minlength=len(texts)) for k, name in enumerate(KINDS)}
    out["base_sha256"] = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in own]
    out["spans"] = [",".join(x) for x in spans]
    return pd.DataFrame(out)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex (spans of the patterns), base_sha256 (hash of these
    spans), spans (all spans, kind:start:end in code points, by start and kind). A span of an assignment reaches from
    its name to the end of its value.

    Null and empty texts have no spans, and the hash of an empty list. Equal texts have equal results; repeated rows
    get a row each, with or without an id. Without labelled credentials nothing is added to the patterns' spans.
    Other columns are ignored. An empty table gives an empty result."""
    model = learn(examples(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for at, texts in arrow_blocks(batch.column(1)):
                found = scan_texts(texts, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(found[c], pa.int64() if c[:2] == "n_" else pa.string()) for c in names]], ["doc_id", *names])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
