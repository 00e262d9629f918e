"""Operator 2: removing repeated lines, also when one character differs, by a deletion-neighbourhood join.

Of lines within one insertion, deletion or replacement of a character, the earliest stays: a line goes if
an equal line or one within that bound comes earlier in the corpus (by doc_id, then by place). This holds
for lines of at least `least` characters. Of equal shorter lines the earliest stays with `any_length`; blank ones,
and without it all of them, always stay.

1. Each line becomes hashes: of itself, and of its beginning and end halves. An edit of one character leaves
   one half as it is, so that only lines that share a half with a different line can have a neighbour.
2. Those lines emit their deletion neighbourhood as hashed keys: the line itself and, for each place, the
   line without that character, all from running sums in time linear in the line.
3. Equal keys are joined: a line without a character equals a shorter line, or equals another line without
   the character at the same place. Under such a key all lines are within the bound, so that each needs
   to look at the earliest other one alone, and no pairs of a group are formed.
4. The pair's texts are compared by edit distance; verified lines go, and so do later copies of equal lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiray.llm.common import cut_lineage, mix64, powers, ship_package
from lumiray.session import broadcast_if_small

LEAST = 30
#: lists of lines by document travel to the texts up to this size (as `broadcast_if_small` counts it); beyond it the
#: texts are shuffled to them
LISTS = 16 << 20
_BASE, _OTHER = 0x100000001B3, 0xC2B2AE3D27D4EB4F
_INVERSE, _OTHER_INVERSE = pow(_BASE, -1, 1 << 64), pow(_OTHER, -1, 1 << 64)


def _sums(points: np.ndarray, base: int = _BASE) -> np.ndarray:
    return np.append(np.uint64(0), np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * powers(len(points), base), dtype=np.uint64))


def _sealed(value: np.ndarray, length: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix64(value ^ mix64(length.astype(np.uint64) + np.uint64(salt)))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def line_hashes(texts: list[str], least: int, any_length: bool = False) -> dict[str, np.ndarray]:
    """For the lines of at least that length, and any other that is not blank with `any_length`: their text and place in it, two hashes of the line, and keys by
    halves. Lines within one edit share a key: of lengths m and n (m or m + 1), the half is m // 2 long; a
    line of even length may be either, and has two keys more. Shorter lines than `least` have none."""
    points = _points("".join(t + "\n" for t in texts))
    ends = np.flatnonzero(points == 10)
    starts = np.append(0, ends[:-1] + 1)
    count = np.array([t.count("\n") + 1 for t in texts])
    of, place = np.repeat(np.arange(len(texts)), count), np.arange(len(ends)) - np.repeat(np.cumsum(count) - count, count)
    use = ends - starts >= least
    if any_length:
        filled = np.append(0, np.cumsum((points != 32) & ((points < 9) | (points > 13))))
        use |= filled[ends] > filled[starts]
    of, place, starts, ends = of[use], place[use], starts[use], ends[use]
    n = ends - starts
    sums, back = _sums(points), powers(len(points) + 1, _INVERSE)
    other, other_back = _sums(points, _OTHER), powers(len(points) + 1, _OTHER_INVERSE)
    keys = []
    for half in (n // 2, (n - 1) // 2):
        keys.append(_sealed((sums[starts + half] - sums[starts]) * back[starts], half, 1 << 32))
        keys.append(_sealed((sums[ends] - sums[ends - half]) * back[ends - half], half, 1 << 33))
    return {
        "of": of, "line": place,
        "h": _sealed((sums[ends] - sums[starts]) * back[starts], n).view(np.int64),
        "g": _sealed((other[ends] - other[starts]) * other_back[starts], n, 1 << 34).view(np.int64),
        "keys": np.stack(keys, axis=1).view(np.int64), "halves": np.where(n < least, 0, np.where(n % 2, 2, 4)),
    }


def neighbourhood(line: str) -> np.ndarray:
    """Hashes of the line and of the line without its first, second, ... character."""
    s, n = _sums(_points(line)), len(line)
    without = s[:-1] + (s[n] - s[1:]) * np.uint64(_INVERSE)
    return np.append(_sealed(s[n:], np.array([n])), _sealed(without, np.array([n - 1]))).view(np.int64)


def _row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """_id and _row, by which rows of one id, or of none, are told apart if their texts differ. Null ids come last."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64(doc_id, text).alias("_row")]


def _place(line: str) -> Column:
    """Orders lines by id, then by place in the text; what is equal in both, by row."""
    return F.struct("_id", F.col(line).alias("line"), "_row")


def dropped_lines(docs: DataFrame, least: int = LEAST, any_length: bool = False) -> DataFrame:
    """The key of the row and the places (from 0) of the lines that go, for rows that lose some."""
    ship_package(docs.sparkSession)

    def hashes(batches):
        for b in batches:
            texts, at = ["" if t is None else t for t in b["text"]], 0
            while at < len(texts):
                start, size = at, 0
                while at < len(texts) and (at == start or size + len(texts[at]) <= 1 << 19):
                    size += len(texts[at])
                    at += 1
                found = line_hashes(texts[start:at], least, any_length)
                if not len(found["of"]):
                    continue
                keys = [k[:n] for k, n in zip(found["keys"], found["halves"].tolist(), strict=True)]
                row = start + found["of"]
                yield pd.DataFrame({"_id": b["_id"].to_numpy()[row], "_row": b["_row"].to_numpy()[row], "line": found["line"], "h": found["h"], "g": found["g"], "keys": keys})

    own = docs.select(*_row_key(), "text")
    lines = cut_lineage(own.mapInPandas(hashes, "_id long, _row long, line int, h long, g long, keys array<long>").select(_place("line").alias("place"), "h", "g", "keys"))
    firsts = cut_lineage(lines.groupBy("h", "g").agg(F.min("place").alias("first"), F.any_value("keys").alias("keys")))

    halves = firsts.select("h", "g", "first", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h").alias("_a"), F.max("h").alias("_b")).filter("_a <> _b").select("key")
    near = cut_lineage(halves.join(shared, "key").select("h", "g", "first").distinct())
    # their texts, from the documents where they come first
    wanted = near.groupBy("first._id", "first._row").agg(F.collect_list(F.struct(F.col("first.line").alias("_line"), "h")).alias("_wanted"))
    found = own.join(broadcast_if_small(wanted, LISTS), ["_id", "_row"]).withColumn("_lines", F.split("text", "\n", -1)).select("_id", "_row", "_lines", F.explode("_wanted").alias("w"))
    texts = cut_lineage(found.select(F.col("w.h").alias("h"), _place("w._line").alias("place"), F.col("_lines")[F.col("w._line")].alias("line")))

    def variants(batches):
        for b in batches:
            held, size = [], 0
            for h, line in zip(b["h"].tolist(), b["line"], strict=True):
                keys = neighbourhood(line)
                held.append((h, keys))
                size += len(keys)
                if size > 1 << 18:
                    yield emitted_rows(held)
                    held, size = [], 0
            if held:
                yield emitted_rows(held)

    def emitted_rows(held: list) -> pd.DataFrame:
        lengths = [len(k) for _, k in held]
        at = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in lengths])
        return pd.DataFrame({"v": np.concatenate([k for _, k in held]), "at": at, "h": np.repeat(np.array([h for h, _ in held], dtype=np.int64), lengths)})

    group = Window.partitionBy("v")
    emitted = texts.select("h", "line").mapInPandas(variants, "v long, at int, h long")
    met = emitted.withColumn("_a", F.min("h").over(group)).withColumn("_b", F.max("h").over(group)).filter("_a <> _b").select("v", "at", "h")
    joined = cut_lineage(cut_lineage(met).join(texts.select("h", "place"), "h"))
    # the earliest line under each key: by place of the missing character, and the line that is whole
    by_place = joined.groupBy("v", "at").agg(F.min("place").alias("m"))
    whole = by_place.filter("at = -1").select("v", F.col("m").alias("other"))
    parts = by_place.filter("at >= 0")
    candidates = (
        joined.filter("at >= 0").join(parts.withColumnRenamed("m", "other"), ["v", "at"]).select("place", "other")
        .unionByName(joined.filter("at >= 0").join(whole, "v").select("place", "other"))
        .unionByName(joined.filter("at = -1").join(parts.groupBy("v").agg(F.min("m").alias("other")), "v").select("place", "other"))
        .filter("other < place").distinct()
    )
    line_of = texts.groupBy("place").agg(F.any_value("line").alias("line"))
    verified = (
        candidates.join(line_of.withColumnRenamed("line", "_x"), "place")
        .join(line_of.select(F.col("place").alias("other"), F.col("line").alias("_y")), "other")
        .filter(F.levenshtein("_x", "_y", 1) >= 0)
        .select(F.col("place").alias("first"))
        .distinct()
    )
    known = cut_lineage(firsts.select("h", "g", "first").join(verified.withColumn("_near", F.lit(True)), "first", "left"))
    gone = lines.select("h", "g", "place").join(known, ["h", "g"]).filter((F.col("place") != F.col("first")) | F.col("_near"))
    return gone.groupBy("place._id", "place._row").agg(F.collect_set("place.line").alias("_dropped"))


def dedup_lines(docs: DataFrame, least: int = LEAST, any_length: bool = False) -> DataFrame:
    """The input with a new `text`, and n_lines and n_dropped. All rows and columns stay.

    A null or empty text has one empty line and stays as it is. Rows without an id come last. Each row loses
    its own lines; of lines at one place under one id, those of the least row hash count as the earliest. Rows equal in
    doc_id and text are one document: their lines stay or go together. Columns named n_lines or n_dropped are replaced.
    An empty table gives an empty result."""
    gone = dropped_lines(docs, least, any_length).select(F.col("_id").alias("_gone_id"), F.col("_row").alias("_gone_row"), "_dropped")
    _id, _row = _row_key()
    joined = docs.withColumns({"_own_id": _id, "_own_row": _row}).join(broadcast_if_small(gone, LISTS), (F.col("_own_id") == F.col("_gone_id")) & (F.col("_own_row") == F.col("_gone_row")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, k: ~F.array_contains("_dropped", k))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    after = F.when(F.col("_dropped").isNull(), F.size(lines)).otherwise(F.size(kept))
    return (
        joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(1)).cast("long"))
        .withColumn("n_dropped", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - after).cast("long"))
        .withColumn("text", text)
        .drop("_own_id", "_own_row", "_gone_id", "_gone_row", "_dropped")
    )


def without_repeated_lines(docs: DataFrame, least: int = LEAST, any_length: bool = False) -> DataFrame:
    """The documents with their new texts and, if there, n_chars; those that lost their last word are left out."""
    names = docs.columns
    tag = docs.withColumnsRenamed({c: f"_own_{c}" for c in names if c in ("n_lines", "n_dropped")})
    done = dedup_lines(tag, least, any_length).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done.drop("n_lines", "n_dropped").withColumnsRenamed({f"_own_{c}": c for c in ("n_lines", "n_dropped") if c in names}).select(*[F.col(f"`{c}`") for c in names])


def oracle_sql(least: int = LEAST, any_length: bool = False) -> str:
    """The same in SQL: lines that share a half are compared character by character."""
    or_filled = r" OR regexp_matches(line, '[^\x20\x09-\x0D]')" if any_length else ""
    long_only = f" WHERE n >= {least}" if any_length else ""
    return f"""
WITH every AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents
), firsts AS (
  SELECT line, length(line) AS n, min((coalesce(doc_id, 9223372036854775807), k)) AS place FROM every WHERE length(line) >= {least}{or_filled} GROUP BY line
), halves AS (
  SELECT *, unnest([n // 2, (n - 1) // 2]) AS m FROM firsts{long_only}
), candidates AS (
  SELECT DISTINCT a.line AS x, b.line AS y, a.n AS n FROM halves a JOIN halves b
    ON a.m = b.m AND left(a.line, a.m) = left(b.line, b.m) AND abs(a.n - b.n) <= 1 AND b.place < a.place
  UNION
  SELECT DISTINCT a.line, b.line, a.n FROM halves a JOIN halves b
    ON a.m = b.m AND right(a.line, a.m) = right(b.line, b.m) AND abs(a.n - b.n) <= 1 AND b.place < a.place
), split_at AS (
  SELECT x, y, coalesce(list_position(list_transform(range(n), lambda i: substr(x, i + 1, 1) <> substr(y, i + 1, 1)), true), n + 1) AS p FROM candidates
), near AS (
  SELECT DISTINCT x AS line FROM split_at
  WHERE substr(x, p + 1) = substr(y, p + 1) OR substr(x, p) = substr(y, p + 1) OR substr(x, p + 1) = substr(y, p)
), judged AS (
  SELECT e.doc_id, e.k, e.line, f.line IS NULL OR ((coalesce(e.doc_id, 9223372036854775807), e.k) = f.place AND w.line IS NULL) AS stays
  FROM every e LEFT JOIN firsts f ON e.line = f.line LEFT JOIN near w ON e.line = w.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (stays), '') AS text
FROM judged GROUP BY doc_id
"""
