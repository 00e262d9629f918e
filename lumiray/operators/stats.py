"""Aggregates, exact quantiles, histograms, time buckets and mean-scaled parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.functions.numeric import missing, uniform_bin
from lumiray.session import cut_lineage, small_table


def _by(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def event_maximum(df: DataFrame, column: str = "Distance", out: str = "MaxDistance", key: str = "Event"):
    """Adds the event's maximum on the row (or tied rows) that attains it, NULL elsewhere."""
    peak = df.groupBy(key).agg(F.max(column).alias("peak_"))
    met = df.join(peak, key)
    return met.withColumn(out, F.when(F.col(column) == F.col("peak_"), F.col("peak_"))).drop("peak_")


def per_event_maximum(df: DataFrame, column: str = "Distance", out: str = "MaxDistance", key: str = "Event"):
    return df.groupBy(key).agg(F.max(column).alias(out))


def distinct_events(df: DataFrame, by=()) -> DataFrame:
    return df.groupBy(*_by(by)).agg(F.count_distinct("Event").alias("n_events"))


def _cell_place(bins: int, depth: int) -> Column:
    """The part of [lo, hi] that holds v, in order of v: equal parts, or equal ratios over many decades. A cell that
    still holds zero inside after two passes is cut there."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    wide = 1e6
    place = F.when((lo > 0) & (hi / wide > lo), uniform_bin(F.ln(v), F.ln(lo), F.ln(hi), bins))
    place = place.when((hi < 0) & (lo / wide < hi), uniform_bin(-F.ln(-v), -F.ln(-lo), -F.ln(-hi), bins))
    if depth >= 2:
        place = place.when((lo < 0) & (hi > 0), F.signum(v).cast("int") + 1)
    return place.otherwise(uniform_bin(v, lo, hi, bins))


def exact_quantiles(df: DataFrame, value: str, probs, by=(), bins: int = 8192) -> DataFrame:
    """Linearly interpolated exact quantiles and the count `n` of present values per group.

    The range of each group is cut into `bins` equal cells, whose counts, least and largest values tell
    which cell holds each wanted rank. Cells that hold more than one value are cut again between these two,
    reading the rows of those cells alone, until each holds one. So no task ever sorts or sees the values
    of a group or cell, however they lie: a far outlier or a dominant value costs another pass over
    fewer rows, and cells of many decades are cut by the logarithm. Infinite values are cells of their own at the ends. NULL and NaN are absent."""
    by = _by(by)
    keys = by or ["g_"]
    source = (df if by else df.withColumn("g_", F.lit(1))).select(*keys, missing(F.col(value).cast("double")).alias("v"))
    source = source.dropna(subset=["v"])
    finite = F.when(F.abs(F.col("v")) < float("inf"), F.col("v"))
    span = small_table(
        source.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    ranks = span.select(*keys, "n", wanted).withColumn("h", (F.col("n") - 1) * F.col("prob"))
    ranks = ranks.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    ranks = small_table(ranks.withColumn("rank", F.least(F.floor("h") + F.col("side"), F.col("n") - 1)))
    rows, cells = source.withColumn("cell", F.lit(0)), span.select(*keys, F.lit(0).alias("cell"), F.lit(0).alias("start"), "lo", "hi")
    found, depth = None, 0
    while True:
        place, depth = F.coalesce(_cell_place(bins, depth), F.lit(0)), depth + 1
        part = F.when(F.col("v") == float("-inf"), -1).when(F.col("v") == float("inf"), bins).otherwise(place)
        parted = rows.join(cells, [*keys, "cell"]).select(*keys, "cell", "start", "v", part.cast("int").alias("part"))
        counts = parted.groupBy(*keys, "cell", "start", "part").agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        running = Window.partitionBy(*keys, "cell").orderBy("part")
        counts = counts.withColumn("stop", F.sum("m").over(running) + F.col("start")).withColumn("start", F.col("stop") - F.col("m"))
        hits = small_table(ranks.join(counts, keys).filter("rank >= start AND rank < stop"))
        done = hits.filter("lo = hi").select(*keys, "prob", "side", "n", "h", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        open_cells = hits.filter("lo < hi").select(*keys, "cell", "part", "start", "lo", "hi").distinct()
        # a handful of cells for each group
        order = Window.partitionBy(*keys).orderBy("start")
        open_cells = small_table(open_cells.withColumn("next_", F.row_number().over(order)))
        if open_cells.isEmpty():
            break
        rows = cut_lineage(
            parted.join(open_cells.select(*keys, "cell", "part", "next_"), [*keys, "cell", "part"]).select(*keys, "v", F.col("next_").alias("cell"))
        )
        cells = open_cells.select(*keys, F.col("next_").alias("cell"), "start", "lo", "hi")
        ranks = ranks.join(hits.filter("lo < hi").select(*keys, "prob", "side"), [*keys, "prob", "side"])
    low = F.max(F.when(F.col("side") == 0, F.col("v")))
    high = F.max(F.when(F.col("side") == 1, F.col("v")))
    part = F.max(F.col("h") - F.floor("h"))
    out = found.groupBy(*keys, "prob", "n").agg(F.when(low == high, low).otherwise(low + (high - low) * part).alias("quantile"))
    return out.select(*by, "prob", "quantile", "n")


def weighted_quantile(rows: DataFrame, by, bins: int = 1024) -> DataFrame:
    """The least value `v` of each group up to which the weights `w` sum to `wanted`, which is one number in a group. Values of
    a group are cut into cells; of the first cells that can hold the place the rows are kept and cut again, until a
    cell holds one value. Where weights are negative, several cells stay open; equal values count together."""
    keys = _by(by)
    span = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("wanted").alias("wanted"))
    cells = small_table(span.withColumns({"cell": F.lit(0), "before": F.lit(0.0)}))
    rows = rows.select(*keys, "v", F.col("w").cast("double").alias("w"), F.lit(0).alias("cell"))
    found = None
    while True:
        part = F.coalesce(uniform_bin(F.col("v"), F.col("lo"), F.col("hi"), bins), F.lit(0))
        parted = rows.join(cells, [*keys, "cell"]).withColumn("part", part)
        sums = parted.groupBy(*keys, "cell", "part").agg(
            F.max("before").alias("before"), F.max("wanted").alias("wanted"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.sum("w").alias("w"), F.sum(F.greatest(F.col("w"), F.lit(0.0))).alias("most"),
        )
        running = Window.partitionBy(*keys, "cell").orderBy("part")  # at most `bins` rows
        sums = sums.withColumn("stop", F.col("before") + F.sum("w").over(running)).withColumn("before", F.col("stop") - F.col("w"))
        reached = F.col("stop") >= F.col("wanted")
        sums = sums.withColumn("_reached", F.coalesce(F.max(reached.cast("int")).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        open_cells = small_table(sums.filter((F.col("_reached") == 0) & (F.col("before") + F.col("most") >= F.col("wanted"))))
        done = open_cells.filter(F.col("lo") == F.col("hi")).filter(reached).select(*keys, F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        order = Window.partitionBy(*keys).orderBy("cell", "part")
        cells = small_table(open_cells.filter("lo < hi").withColumn("next_", F.row_number().over(order)).select(*keys, "cell", "part", "next_", "before", "wanted", "lo", "hi"))
        if cells.isEmpty():
            return found.groupBy(*keys).agg(F.min("v").alias("v"))
        rows = cut_lineage(parted.select(*keys, "cell", "part", "v", "w").join(cells.select(*keys, "cell", "part", "next_"), [*keys, "cell", "part"]).select(*keys, "v", "w", F.col("next_").alias("cell")))
        cells = cells.select(*keys, F.col("next_").alias("cell"), "before", "wanted", "lo", "hi")


def wide_quantiles(df: DataFrame, columns, probs, by=(), accuracy: int = 2000) -> DataFrame:
    """The same quantiles of several columns at once: (by, column, prob, quantile, n).

    One pass over the wide rows sketches all columns; the sketch's bounds enclose each wanted rank. A second pass counts
    what lies between the enclosures and keeps the few values inside them, among which the rank is found by
    cells as in `exact_quantiles`. A sketch whose enclosure misses its rank, which the counts show, is replaced by those cells
    over the whole column."""
    by, probs = _by(by), sorted(probs)
    keys = by or ["g_"]
    source = (df if by else df.withColumn("g_", F.lit(1))).select(*keys, *[missing(F.col(c).cast("double")).alias(f"v{k}") for k, c in enumerate(columns)])
    slack = 4 / accuracy
    around = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    near = small_table(source.groupBy(*keys).agg(*[F.percentile_approx(f"v{k}", around, accuracy).alias(f"a{k}") for k in range(len(columns))], *[F.count(f"v{k}").alias(f"n{k}") for k in range(len(columns))]))
    low = lambda k, i: F.col(f"a{k}")[i]
    high = lambda k, i: F.col(f"a{k}")[i + len(probs)]

    def counted(k: int) -> Column:
        """A value inside an enclosure stays itself, any other becomes the number of enclosures that lie below it."""
        v = F.col(f"v{k}")
        inside = reduce(lambda a, b: a | b, [v.between(low(k, i), high(k, i)) for i in range(len(probs))])
        passed = reduce(lambda a, b: a + b, [(v > low(k, i)).cast("int") for i in range(len(probs))])
        return F.struct(F.lit(k).alias("k"), F.when(inside, v).alias("v"), F.when(~inside, passed).alias("cell"))

    present = F.filter(F.array(*[counted(k) for k in range(len(columns))]), lambda s: s["v"].isNotNull() | s["cell"].isNotNull())
    # equal values inside become one with their number, so that a dominant value is one row
    counts = cut_lineage(source.join(near, keys).select(*keys, F.inline(present)).groupBy(*keys, "k", "cell", "v").agg(F.count(F.lit(1)).alias("m")))
    spots = near.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col(f"n{k}").alias("n"), low(k, i).alias("low"), high(k, i).alias("high"), ((F.col(f"n{k}") - 1) * probs[i]).alias("h"))
            for k in range(len(columns)) for i in range(len(probs))
        ])),
    )
    spot = [*keys, "k", "i"]
    outside = F.sum(F.when(F.col("cell") <= F.col("i"), F.col("m")).otherwise(0))
    sums = spots.join(counts, [*keys, "k"]).groupBy(*spot, "n", "low", "high", "h").agg(
        (outside + F.sum(F.when(F.col("v") < F.col("low"), F.col("m")).otherwise(0))).alias("below"),
        (outside + F.sum(F.when(F.col("v") <= F.col("high"), F.col("m")).otherwise(0))).alias("upto"),
    )
    first, second = F.floor("h"), F.least(F.floor("h") + 1, F.col("n") - 1)
    fits = (F.col("below") <= first) & (second < F.col("upto")) & (F.abs("low") < float("inf")) & (F.abs("high") < float("inf"))
    long = small_table(sums.withColumn("fits", fits))
    values = counts.filter("v is not null").join(long.filter("fits").select(*spot, "low", "high"), [*keys, "k"]).filter(F.col("v").between(F.col("low"), F.col("high"))).drop("low", "high")
    ranks = small_table(long.filter("fits").select(*keys, "k", "i", "n", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), (first - F.col("below")).alias("rank")), F.struct(F.lit(1).alias("side"), (second - F.col("below")).alias("rank")))).alias("r")).select("*", "r.*").drop("r"))
    places = weighted_quantile(values.join(ranks, spot).select(*spot, "side", "v", F.col("m").alias("w"), (F.col("rank") + 1).cast("double").alias("wanted")), [*spot, "side"])
    found = ranks.join(places, [*spot, "side"])
    low_v, high_v = F.max(F.when(F.col("side") == 0, F.col("v"))), F.max(F.when(F.col("side") == 1, F.col("v")))
    share = F.max(F.col("h") - F.floor("h"))
    out = found.groupBy(*keys, "k", "i", "n").agg(F.when(low_v == high_v, low_v).otherwise(low_v + (high_v - low_v) * share).alias("quantile"))
    name = F.array(*[F.lit(c) for c in columns])[F.col("k")]
    prob = F.array(*[F.lit(float(p)) for p in probs])[F.col("i")]
    out = out.select(*by, name.alias("column"), prob.alias("prob"), "quantile", "n")
    missed = [columns[r["k"]] for r in long.filter("NOT fits").select("k").distinct().collect()]
    if not missed:
        return out
    again = source.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{k}").alias("value")) for k, c in enumerate(columns) if c in missed])))
    return out.filter(~F.col("column").isin(missed)).unionByName(exact_quantiles(again, "value", probs, [*by, "column"]).select(*by, "column", "prob", "quantile", "n"))


def describe(df: DataFrame, columns, by=()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of several columns, one row each."""
    by = _by(by)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*by, F.inline(pairs))
    keys = [*by, "column"]
    plain = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = wide_quantiles(df, list(columns), (0.25, 0.5, 0.75), by)
    names = ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
    wide = quartiles.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(a) for p, a in names])
    return plain.join(wide, keys, "left").select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def group_means(df: DataFrame, columns=("MeanX", "MeanY"), by="Telescope") -> DataFrame:
    return df.groupBy(*_by(by)).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n"))


def population_spread(df: DataFrame, columns=("Width", "Length"), by=()) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return df.groupBy(*_by(by)).agg(*aggs)


def column_span(df: DataFrame, column: str = "Timestamp", by=()) -> DataFrame:
    return df.groupBy(*_by(by)).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def _spread(df: DataFrame, first: Column, last: Column, step: Column, name: str, chunk: int = 4096) -> DataFrame:
    """A row for each of first, first + step, ... last. Starts of chunks are spread first, so that no row
    holds the whole list."""
    starts = df.withColumn("start_", F.explode(F.sequence(first, last, step * chunk)))
    return starts.withColumn(name, F.explode(F.sequence("start_", F.least(F.col("start_") + step * (chunk - 1), last), step))).drop("start_")


def fill_bins(counts: DataFrame, bins: int, by=(), value: str = "n", fill=0) -> DataFrame:
    """Every bin 0..bins-1 of every group, absent ones with `fill`."""
    by = _by(by)
    if by:
        spine = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    else:
        spine = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = spine.join(counts, [*by, "bin"], "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, by=(), density: bool = False) -> DataFrame:
    """Counts per equal bin of [lo, hi] per group, zero bins included; `density`
    divides by the rows in range and the bin width."""
    by = _by(by)
    within = df.filter(F.col(column).between(lo, hi))
    binned = within.select(*by, uniform_bin(F.col(column).cast("double"), lo, hi, bins).alias("bin"))
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    full = fill_bins(counts, bins, by)
    if not density:
        return full
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return full.withColumn("density", F.try_divide(F.col("n").cast("double"), total * ((hi - lo) / bins)))


def parameter_histograms(df: DataFrame, ranges=K.PARAMETER_RANGES, by=()) -> DataFrame:
    """Histograms of many columns in one pass over the rows."""
    by = _by(by)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("parameter"), uniform_bin(F.col(c), lo, hi, n).alias("bin"))
            for c, (lo, hi, n) in ranges.items()
        ]
    )
    long = df.select(*by, F.inline(cells))
    counts = long.filter("bin IS NOT NULL").groupBy(*by, "parameter", "bin").agg(F.count("*").alias("n"))
    bins = {n for _, _, n in ranges.values()}
    if len(bins) != 1:
        raise ValueError("parameter_histograms wants one number of bins")
    return fill_bins(counts, bins.pop(), [*by, "parameter"])


def histogram_own_range(df: DataFrame, column: str, bins, by=()) -> DataFrame:
    """Histogram between the smallest and largest value of each group.

    `bins` is a number or a column of `lo` and `hi` (e.g. one bin per 100 s).
    A group whose values are all equal is spread half a unit to both sides. An infinite value is an
    error: there is no range to divide. NULL and NaN are absent.
    """
    by = _by(by)
    keys = by or ["g_"]
    value = missing(F.col(column).cast("double"))
    finite = F.when(F.abs(value) == float("inf"), F.raise_error(F.lit("a histogram over its own range met an infinite value")).cast("double"))
    source = (df if by else df.withColumn("g_", F.lit(1))).select(*keys, finite.otherwise(value).alias("v"))
    source = source.dropna(subset=["v"])
    span = column_span(source, "v", keys)
    bins = bins if isinstance(bins, Column) else F.lit(bins)
    flat = F.col("lo") == F.col("hi")
    span = span.withColumn("bins", bins.cast("int")).select(
        *keys,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        "bins",
    )
    if by:
        span = small_table(span)
        placed, lo, hi, n = source.join(span, keys), F.col("lo"), F.col("hi"), F.col("bins")
    else:  # one range for all rows: a scalar, not a join
        whole = span.select(F.struct("lo", "hi", "bins").alias("s")).scalar()
        placed, lo, hi, n = source.withColumn("s", whole), F.col("s.lo"), F.col("s.hi"), F.col("s.bins")
    binned = placed.select(*keys, uniform_bin(F.col("v"), lo, hi, n).alias("bin"))
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    spine = _spread(span.filter("bins > 0").select(*keys, "lo", "hi", "bins"), F.lit(0), F.col("bins") - 1, F.lit(1), "bin")
    full = spine.join(counts, [*keys, "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return full.select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_2d(
    df: DataFrame, x: str, y: str, x_range, y_range, bins: int, by=(), weight: Column | None = None
) -> DataFrame:
    """Counts (or summed weights) of the filled cells, with the largest cell of all groups."""
    by = _by(by)
    w = F.lit(1) if weight is None else weight
    within = df.filter(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    cells = within.select(
        *by,
        uniform_bin(F.col(x), *x_range, bins).alias("ix"),
        uniform_bin(F.col(y), *y_range, bins).alias("iy"),
        w.alias("w"),
    )
    return cells.groupBy(*by, "ix", "iy").agg(F.sum("w").alias("n"))


def shared_maximum(cells: DataFrame, column: str = "n") -> DataFrame:
    """Adds `vmax`, the largest cell over all groups. A map has a fixed number of cells,
    so the window over all of them is small."""
    return cells.withColumn("vmax", F.max(column).over(Window.partitionBy(F.lit(0))))


def time_bucket(seconds: Column, width: int = 100) -> Column:
    """Start of the left-closed bucket, in whole seconds since the epoch."""
    return (F.floor(seconds / width) * width).cast("bigint")


def _bucket_spine(buckets: DataFrame, by, width: int) -> DataFrame:
    span = buckets.groupBy(*by).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    return _spread(span, F.col("lo"), F.col("hi"), F.lit(width).cast("bigint"), "bucket").select(*by, "bucket")


def bucket_aggregates(df: DataFrame, aggs, time: str = "Timestamp", by=("Telescope",), width: int = 100) -> DataFrame:
    """Aggregates per time bucket and group, with a row for every bucket between a
    group's first and last one; empty buckets have NULL aggregates."""
    by = _by(by)
    keys = by or ["g_"]
    source = df if by else df.withColumn("g_", F.lit(1))
    filled = source.withColumn("bucket", time_bucket(F.col(time), width)).groupBy(*keys, "bucket").agg(*aggs)
    full = _bucket_spine(filled, keys, width).join(filled, [*keys, "bucket"], "left")
    return full if by else full.drop("g_")


def event_rate(df: DataFrame, time: str = "Timestamp", by=("Telescope",), width: int = 100) -> DataFrame:
    """Images per second in each bucket, zero for empty ones."""
    counted = bucket_aggregates(df, [F.count("*").alias("n")], time, by, width)
    return counted.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rate", F.col("n") / F.lit(float(width)))


def bucket_means(df: DataFrame, columns=("Width", "Size"), time: str = "Timestamp", by=("Telescope",), width: int = 100):
    """Mean of each column per bucket; log10 of the mean for Size."""
    out = bucket_aggregates(df, [F.avg(c).alias(f"mean_{c}") for c in columns], time, by, width)
    if "Size" in columns:
        out = out.withColumn("log10_mean_Size", F.when(F.col("mean_Size") > 0, F.log10("mean_Size")))
    return out


def sliding_means(
    df: DataFrame, columns=("MeanX", "MeanY"), by=("File", "Telescope"), time: str = "Timestamp", then=("Event",),
    before: int = 60, after: int = 59, slices: int = 256, block: int = 100_000,
) -> DataFrame:
    """Adds the mean over a frame of neighbouring rows of the same file and telescope, in
    the order of `time` and `then`.

    A file may hold any share of the rows, so it is never sorted as a whole: rows are
    ranked within slices of about equal row counts, cut at quantiles of its times, whose starts come from running
    sums of slice counts, then cut into blocks of `block` ranks that borrow the neighbours their frames reach into.
    """
    by = _by(by)
    if block < max(before, after):
        raise ValueError("a block must be at least as long as the frame reaches")
    shares = [k / slices for k in range(1, slices)]
    cuts = F.array_distinct(F.percentile_approx(F.col(time).cast("double"), shares, 20 * slices))
    edges = small_table(df.groupBy(*[F.col(c).alias(f"by{k}_") for k, c in enumerate(by)]).agg(cuts.alias("edges_")))
    matched = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"by{k}_")) for k, c in enumerate(by)])
    slice_ = F.coalesce(F.array_size(F.filter("edges_", lambda e: e < F.col(time).cast("double"))), F.lit(-1))
    sliced = df.join(edges, matched).withColumn("slice_", slice_).drop("edges_", *[f"by{k}_" for k in range(len(by))])
    sizes = sliced.groupBy(*by, "slice_").agg(F.count("*").alias("rows_"))
    past = Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_table(sizes.select(*by, "slice_", F.coalesce(F.sum("rows_").over(past), F.lit(0)).alias("start_")))
    place = Window.partitionBy(*by, "slice_").orderBy(time, *then)
    ranked = sliced.withColumn("place_", F.row_number().over(place)).join(starts, [*by, "slice_"])
    ranked = ranked.withColumn("rank_", F.col("start_") + F.col("place_") - 1)
    home, at = F.floor(F.col("rank_") / block), F.col("rank_") % block
    blocks = F.array(home, F.when(at >= block - before, home + 1), F.when(at < after, home - 1))
    lent = ranked.withColumn("block_", F.explode(F.filter(blocks, lambda k: k.isNotNull())))
    frame = Window.partitionBy(*by, "block_").orderBy("rank_").rowsBetween(-before, after)
    meaned = lent.withColumns({f"sliding_{c}": F.avg(c).over(frame) for c in columns})
    return meaned.filter(F.floor(F.col("rank_") / block) == F.col("block_")).select(
        *df.columns, *[f"sliding_{c}" for c in columns]
    )


def mean_scaled(df: DataFrame, by: str = "class", least: int = 2, key: str = "Event") -> DataFrame:
    """Per event the mean of (Width - mean)/std and of the same for Length.

    Mean and population spread are those of all rows of the class, while only events
    with at least `least` rows are kept. The event's mean is that of its raw values,
    shifted and scaled, so the class statistics meet one row per event."""
    spread = small_table(population_spread(df, ("Width", "Length"), by))
    events = df.groupBy(by, key).agg(
        F.avg("Width").alias("w"), F.avg("Length").alias("l"), F.count("*").alias("n_images")
    )
    met = events.filter(F.col("n_images") >= least).join(spread, by)
    return met.select(
        by,
        key,
        F.try_divide(F.col("w") - F.col("mean_Width"), F.col("std_Width")).alias("MSCW"),
        F.try_divide(F.col("l") - F.col("mean_Length"), F.col("std_Length")).alias("MSCL"),
    )


def mean_scaled_ratio(scaled: DataFrame, bound: float = 20.0, by: str = "class") -> DataFrame:
    """Mean and count of MSCL/MSCW inside (-bound, bound) per class."""
    ratio = scaled.withColumn("ratio", F.try_divide("MSCL", "MSCW"))
    inside = ratio.filter((F.col("ratio") > -bound) & (F.col("ratio") < bound))
    return inside.groupBy(by).agg(F.avg("ratio").alias("mean_ratio"), F.count("*").alias("n"))
