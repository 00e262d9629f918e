"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiray import session
from lumiray.session import cut_lineage

__all__ = ["cut_lineage"]

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors. A session that leaves the rows of an Arrow batch at the default of 10,000 gets
    1,000, since rows are whole texts here, and a batch is held by the executor and its worker."""
    session.ship_package(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_blocks(texts: Iterable[bytes], limit: int = 1 << 19) -> Iterator[list[bytes]]:
    """Runs of about `limit` bytes; a longer text is a run of its own. Keeps numpy's working memory bounded."""
    held, size = [], 0
    for b in texts:
        if held and size + len(b) > limit:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


def text_blocks(texts, limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8, in such runs, each with the place of its first. Null counts as empty."""
    at = 0
    for block in byte_blocks((b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts), limit):
        yield at, block
        at += len(block)


def arrow_blocks(texts, limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """The same of an Arrow column of binary values: only the texts of one run become Python objects at a time."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)) if len(texts) else []
    total = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        before = total[at - 1] if at else 0
        stop = max(int(np.searchsorted(total, before + limit, "right")), at + 1)
        yield at, [t or b"" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n + n // 4, 1 << 20)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [start, end) of a byte array: a polynomial modulo 2 ** 64
    from one running sum, shifted to a common origin, then scrambled with the length."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(len(data) + 1, _INVERSE)[starts]
    return mix64(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def number_in_parts(df: DataFrame, group: str, part: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap: inside each (group, part) by `order`,
    the parts one after another. `df` must be a written table, since it is read twice, and no
    part may be large; only counts by (group, part) are brought together for a group."""
    counts = df.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        F.col(group).alias("_g"), F.col(part).alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(group, part).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(shift, F.col(group).eqNullSafe(F.col("_g")) & (F.col(part) == F.col("_p")))
        .withColumn(name, (F.col("_rank") + F.col("_shift")).cast("long"))
        .drop("_rank", "_shift", "_g", "_p")
    )
