"""Row filters, de-duplication, event numbering and small projections on the hub table.

Per-event counts and extremes come from grouped aggregates, which combine before
the shuffle, and return to the rows by an equi-join that AQE can split: a window
over a crowded event would put all of its rows into one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiray import constants as K
from lumiray.functions.numeric import uniform_bin
from lumiray.schemas import REQUIRED_COLUMNS
from lumiray.session import small_table


def drop_missing(df: DataFrame, columns=tuple(REQUIRED_COLUMNS)) -> DataFrame:
    """Rows with NULL or NaN in any of the columns go."""
    return df.dropna(subset=list(columns))


def positive_width(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Width") > 0)


def min_images(df: DataFrame, least: int, key="Event") -> DataFrame:
    """Rows of the events that have at least `least` rows."""
    if least <= 1:
        return df
    keys = [key] if isinstance(key, str) else list(key)
    kept = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return df.join(kept.select(*keys), keys, "left_semi")


def usable_images(df: DataFrame, least: int = 0) -> DataFrame:
    """Missing values, then width, then multiplicity: the order matters."""
    return min_images(positive_width(drop_missing(df)), least)


def after(df: DataFrame, timestamp: float) -> DataFrame:
    return df.filter(F.col("Timestamp") > timestamp)


def of_telescope(df: DataFrame, telescope: int) -> DataFrame:
    return df.filter(F.col("Telescope") == telescope)


def above_energy(df: DataFrame, threshold: float = 10000.0) -> DataFrame:
    return df.filter(F.col("TrueEnergy") > threshold)


def on_cut(max_distance: Column, theta_square: Column) -> Column:
    return (max_distance < K.MAX_DISTANCE_CUT_DEG) & (theta_square < K.THETA_CUT_DEG**2)


def inside(column: Column, bound: float = 20.0) -> Column:
    return (column > -bound) & (column < bound)


def parameter_cuts(df: DataFrame, **bounds) -> DataFrame:
    """Optional cuts, e.g. `Size=(200, None)`, `Distance=(None, 3)`; both bounds strict."""
    tests = []
    for name, (lo, hi) in bounds.items():
        tests += [F.col(name) > lo] if lo is not None else []
        tests += [F.col(name) < hi] if hi is not None else []
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def camera_sector(df: DataFrame, per_axis: int = 4) -> DataFrame:
    """Adds `sx`, `sy`: the chip (4 per axis) or detector board (2 per axis) of the
    centroid. Sectors are open on both sides, so a centroid on an edge has none."""
    size = 2 * K.CENTROID_HALF_RANGE_DEG / per_axis

    def sector(c: Column) -> Column:
        cell = F.floor((c + K.CENTROID_HALF_RANGE_DEG) / size)
        low = cell * size - K.CENTROID_HALF_RANGE_DEG
        ok = (c > low) & (c < low + size) & (cell >= 0) & (cell < per_axis)
        return F.when(ok, cell.cast("int"))

    placed = df.withColumns({"sx": sector(F.col("MeanX")), "sy": sector(F.col("MeanY"))})
    return placed.filter("sx IS NOT NULL AND sy IS NOT NULL")


def sector_width_histogram(df: DataFrame, per_axis: int = 4, bins: int = 80) -> DataFrame:
    cells = camera_sector(df, per_axis).withColumn("bin", uniform_bin(F.col("Width"), 0.0, 1.0, bins))
    return cells.filter("bin IS NOT NULL").groupBy("Telescope", "sx", "sy", "bin").agg(F.count("*").alias("n"))


def _fixed_width(df: DataFrame, columns) -> bool:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return all(isinstance(kinds[c], (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for c in columns)


def packed_order(first: Column, second: Column, rest) -> Column:
    """One number that orders rows by two whole numbers, nulls first, and rows equal in both by a hash of `rest`. A decimal has
    a fixed width, so that aggregates by it need no sort."""
    number = lambda c, least: F.coalesce(c.cast("decimal(38,0)"), F.lit(least).cast("decimal(38,0)"))
    place = number(first, -(1 << 62)) * F.lit(1 << 32).cast("decimal(11,0)") + number(second, -(1 << 31))
    tie = F.pmod(F.xxhash64(*rest), F.lit(1 << 30)) if rest else F.lit(0)
    return (place.cast("decimal(29,0)") * F.lit(1 << 30).cast("decimal(10,0)")).cast("decimal(38,0)") + tie


def first_of_copies(df: DataFrame, ignore, order) -> DataFrame:
    """One row per distinct content of all columns but `ignore`; the survivor is the
    first by `order`. The minimum combines before the shuffle, so a row copied a
    billion times crosses the network once per input partition. Numbers are picked by a packed order in hash
    tables; other types need a sorted aggregate."""
    content = [c for c in df.columns if c not in ignore]
    rest = [c for c in ignore if c in df.columns and c not in order]
    if len(order) == 2 and _fixed_width(df, [*order, *rest]):
        place = packed_order(*map(F.col, order), [F.col(c) for c in rest])
        return df.groupBy(*content).agg(*[F.min_by(c, place).alias(c) for c in (*order, *rest)]).select(*df.columns)
    lead = F.min(F.struct(*order, *rest)).alias("lead")
    kept = df.groupBy(*content).agg(lead).select(*content, "lead.*")
    return kept.select(*df.columns)


def dedupe_for_sky(df: DataFrame) -> DataFrame:
    """Copies may differ in event number, telescope and index within the file."""
    return first_of_copies(df, ["Telescope", "Event", "In_file_Index"], ["Event", "Telescope"])


def dedupe_for_histograms(df: DataFrame) -> DataFrame:
    """Copies may differ in event number, telescope and file, not in the index."""
    return first_of_copies(df, ["Telescope", "Event", "File"], ["Event", "Telescope"])


def first_row_per_event(df: DataFrame, order=("Telescope",), key: str = "Event") -> DataFrame:
    """The first row of every event by an explicit order; of rows equal in it, the one of least hash."""
    rest = [c for c in df.columns if c != key and c not in order]
    if len(order) == 1 and _fixed_width(df, [*order, *rest]):
        place = packed_order(F.col(order[0]), F.lit(0), [F.col(c) for c in rest])
        return df.groupBy(key).agg(*[F.min_by(c, place).alias(c) for c in (*order, *rest)]).select(*df.columns)
    lead = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("lead")
    return df.groupBy(key).agg(lead).select(key, "lead.*").select(*df.columns)


def global_event_ids(df: DataFrame, path: str = "path", name: Column | None = None) -> DataFrame:
    """Event numbers unique over files: each file's numbers are raised by the count of
    rows in all files before it. Only per-file counts meet in the running sum."""
    sizes = df.groupBy(path).agg(F.count("*").alias("rows_"))
    before = Window.orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_table(sizes.select(path, F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("buffer_")))
    tagged = df.join(offsets, path)
    base = name if name is not None else provenance(F.col(path))
    rest = [c for c in df.columns if c not in (path, "Event")]
    return tagged.select(
        base.alias("File"),
        F.col("Event").alias("In_file_Index"),
        (F.col("Event") + F.col("buffer_")).alias("Event"),
        *rest,
    )


def provenance(path: Column) -> Column:
    """Base name of a file without its last sixteen characters."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.substring(base, F.lit(1), F.greatest(F.length(base) - 16, F.lit(0)))


def renumber(df: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Event becomes 1..n in the order (File, In_file_Index, Telescope).

    Rows are counted per chunk of in-file indices; running sums go over chunk
    counts within a file and over file totals, and row numbers only within a chunk.
    """
    cut = df.withColumn("chunk_", F.floor(F.col("In_file_Index") / chunk))
    chunks = cut.groupBy("File", "chunk_").agg(F.count("*").alias("rows_"))
    files = chunks.groupBy("File").agg(F.sum("rows_").alias("total_"))
    past = (Window.unboundedPreceding, -1)
    file_start = F.coalesce(F.sum("total_").over(Window.orderBy("File").rowsBetween(*past)), F.lit(0))
    files = files.select("File", file_start.alias("file_start_"))
    in_file = Window.partitionBy("File").orderBy("chunk_").rowsBetween(*past)
    chunks = chunks.select(
        "File", "chunk_", F.coalesce(F.sum("rows_").over(in_file), F.lit(0)).alias("start_")
    ).join(files, "File")
    chunks = small_table(chunks)
    place = Window.partitionBy("File", "chunk_").orderBy("In_file_Index", "Telescope", "Event")
    numbered = cut.withColumn("place_", F.row_number().over(place)).join(chunks, ["File", "chunk_"])
    event = (F.col("file_start_") + F.col("start_") + F.col("place_")).cast("bigint")
    return numbered.withColumn("Event", event).select(*df.columns)


def utc_time(seconds: Column) -> Column:
    """Unix seconds with fraction to a timestamp."""
    return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))


def derived_shape(df: DataFrame) -> DataFrame:
    """Elongation and logarithm of the image size; NULL where undefined."""
    return df.withColumns(
        {
            "LengthOverWidth": F.try_divide("Length", "Width"),
            "Log10Size": F.when(F.col("Size") > 0, F.log10("Size")),
        }
    )


def labelled(df: DataFrame, label: int, columns=None) -> DataFrame:
    picked = df.select(*columns) if columns else df
    return picked.withColumn("Classification", F.lit(label))


def stack_tables(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns one of them lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fulfil the condition, and all others."""
    return df.filter(condition), df.filter(~F.coalesce(condition, F.lit(False)))


def preview(df: DataFrame, n: int = 5, order=("Event", "Telescope")) -> DataFrame:
    return df.orderBy(*order).limit(n)


def exact_sample(df: DataFrame, share: float, keys=("Event", "Telescope"), digits: int = 4) -> DataFrame:
    """Exactly round(share * n) rows, the same ones in every run and however the rows are partitioned: those of least hash
    of their keys. The last hash is found by counting its hexadecimal digits, `digits` at a time; only counts
    meet. Of rows with equal keys, which have equal hashes, those first by content are taken."""
    text = F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    hashed = df.withColumn("_hash", F.substring(F.md5(text), 1, 4 * digits))
    wanted = math.floor(share * df.count() + 0.5)
    last, before = "", 0  # leading digits of the last hash, and rows below them
    while len(last) < 4 * digits and wanted:
        part = F.substring("_hash", len(last) + 1, digits)
        own = hashed.filter(F.col("_hash").startswith(last)) if last else hashed
        counts = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # at most 16 ** digits rows
        running = counts.withColumn("_to", F.sum("n").over(Window.orderBy("part")))
        found = running.filter(F.col("_to") + before >= wanted).orderBy("part").first()
        last, before = last + found["part"], before + found["_to"] - found["n"]
    if not wanted:
        return df.limit(0)
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    tied = hashed.filter(F.col("_hash") == last).withColumn("_place", F.row_number().over(Window.partitionBy("_hash").orderBy(content)))
    kept = tied.filter(F.col("_place") <= wanted - before).drop("_place").unionByName(hashed.filter(F.col("_hash") < last))
    return kept.drop("_hash")
