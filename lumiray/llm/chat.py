"""Operator 5: chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once, and the tokens' character offsets, which follow from the bytes
that each id stands for, are laid against the spans of the assistant's texts: binary search finds the spans that a token meets, and the token's
share of the loss is that intersection. Tokens may straddle a border or, in byte-level files, share a
character; the text under the mask is the union of the intersections, so that neither matters.

Template of a turn: `### role: text</turn>` and a newline. In roles and texts a backslash goes before
every backslash, inside the two control strings after their first character, and in roles before a
colon. A backslash in the rendered text therefore always marks the next character as plain.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray.llm.common import ship_package

OPEN, CLOSE = "### ", "</turn>"
_READ = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    text = re.sub(r"#(?=##)", r"#\\", text.replace("\\", "\\\\")).replace(CLOSE, "<\\/turn>")
    return text.replace(":", "\\:") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts in it, ascending."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}: ", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _READ.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def loss_tokens(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that meet a span, with the start and end of what they share; a token over several spans comes once for each."""
    if not len(offsets) or not len(spans):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    first = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    last = np.searchsorted(spans[:, 0], offsets[:, 1], side="left")
    n = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(offsets)), n)
    span = np.repeat(first, n) + np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    start = np.maximum(offsets[token, 0], spans[span, 0])
    end = np.minimum(offsets[token, 1], spans[span, 1])
    some = end > start
    return token[some], start[some], end[some]


def covered(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of ascending intervals, adjoining ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def character_offsets(text: str, sizes: np.ndarray) -> np.ndarray:
    """First character and character behind the last of each token, from the tokens' sizes in bytes. Tokens that share
    a character both have all of it."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80)  # from 1, of each byte
    stop = np.cumsum(sizes)
    if int(sizes.sum()) != len(data):
        raise ValueError("the tokens do not spell the text")
    return np.column_stack([character[stop - sizes] - 1, character[stop - 1]]).astype(np.int64) if len(sizes) else np.zeros((0, 2), dtype=np.int64)


FORMATTED = "conv_id long, formatted string, ids array<int>, loss_token array<int>, loss_start array<int>, loss_end array<int>"


def _runs(sizes: list[int], limit: int = 1 << 18) -> list[slice]:
    """Slices of about `limit` characters; a longer text is alone. They bound the memory of numpy."""
    out, at, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > at and held + n > limit:
            out.append(slice(at, k))
            at, held = k, 0
        held += n
    return [*out, slice(at, len(sizes))] if sizes else out


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each conversation: its formatted text, token ids, and for each token under the
    loss mask its place and the characters that count.

    Turns are ordered by turn, then role and text; null turns last. A null role or text is empty.
    Rows without a conv_id form one conversation. Repeated rows are repeated turns. Columns beside
    conv_id, turn, role and text are ignored. An empty table gives an empty result.
    Only the turns of one conversation are brought together."""
    ship_package(turns.sparkSession)
    empty = F.lit("")
    gathered = (
        turns.select(
            F.col("conv_id").cast("long"),
            F.struct(
                F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"),
                F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    )

    def encode(batches):
        from lumiray.llm.tokens import byte_entries, piece_tokenizer

        pieces = piece_tokenizer(tokenizer)
        size_of = np.array([len(e) for e in byte_entries(tokenizer)], dtype=np.int64)
        for b in batches:
            convs = b["conv_id"].tolist()
            rendered = [render(list(zip(roles, texts, strict=True))) for roles, texts in zip(b["roles"], b["texts"], strict=True)]
            for run in _runs([len(text) for text, _ in rendered]):
                rows = []
                for conv, (text, spans), ids in zip(convs[run], rendered[run], pieces.encode([text for text, _ in rendered[run]]), strict=True):
                    offsets = character_offsets(text, size_of[ids])
                    rows.append((conv, text, ids.astype(np.int32), *loss_tokens(offsets, np.array(spans, dtype=np.int64).reshape(-1, 2))))
                yield pd.DataFrame(rows, columns=["conv_id", "formatted", "ids", "loss_token", "loss_start", "loss_end"]).astype({"conv_id": "Int64"})

    return gathered.mapInPandas(encode, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from them: turns, and the text under the loss mask."""

    def read(batches):
        for b in batches:
            rows = []
            for conv, text, start, end in zip(b["conv_id"].tolist(), b["formatted"], b["loss_start"], b["loss_end"], strict=True):
                turns = parse(text)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                loss = "".join(unescape(text[x:y]) for x, y in covered(start, end))
                rows.append((conv, len(turns), _sha(said), len(loss), _sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
