"""Camera images: pedestals, cleaning, photon projection, binning, trigger, stacking.

Images live either as arrays (one row per image, index px*side + py) or as a
long pixel table (event, telescope, px, py, adu).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lumiray import constants as K
from lumiray.functions import angles
from lumiray.functions.numeric import uniform_bin
from lumiray.functions.stencil import cleaner, densify, lit_cells, triggered, without_pedestals
from lumiray.operators.derive import derive_once
from lumiray.session import BROADCAST_MAX_BYTES, broadcast_if_small


def subtract_pedestals(
    events: DataFrame, pedestals: DataFrame, keys=("file", "scope_id"), max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Adds `image`: raw minus pedestal, cut toward zero to whole ADU; an image of
    zeros where the telescope did not take part (scope_id <= 0).

    The pedestal side is broadcast only up to `max_bytes`; beyond that the
    join is shuffled on the keys and AQE splits a file that holds too many rows.
    """
    keys = list(keys)
    maps = pedestals.select(*keys, "peds")
    joined = events.join(broadcast_if_small(maps, max_bytes), keys, "left")
    return joined.withColumn("image", without_pedestals()(F.col("pix"), F.col("peds"), F.col("scope_id"))).drop("peds")


def clean_images(df: DataFrame, nsb: float = K.NSB_DATA_ADU, column: str = "image", **options) -> DataFrame:
    """Full cleaning of an image column in place."""
    return df.withColumn(column, cleaner(nsb, **options)(F.col(column)))


def suppress_negative(image: Column) -> Column:
    return F.transform(image, lambda p: F.greatest(p, F.lit(0)))


def is_lit(image: Column) -> Column:
    """True when the image's content does not sum to zero."""
    return F.aggregate(image, F.lit(0).cast("bigint"), lambda acc, p: acc + p) != 0


def lit_pixels(image: Column) -> Column:
    return F.size(F.filter(image, lambda p: p != 0))


def require_pixels(image: Column, least: int = K.MIN_IMAGE_PIXELS) -> Column:
    zeros = F.transform(image, lambda _: F.lit(0))
    return F.when(lit_pixels(image) >= least, image).otherwise(zeros)


def images_from_pixels(pixels: DataFrame, keys=("event", "telescope"), side: int = K.CAMERA_SIDE) -> DataFrame:
    """One array image per key from a pixel table with one row per lit cell.

    A group holds at most side*side cells, which bounds the collected list.
    """
    number = (F.col("px") * side + F.col("py")).cast("int")
    cells = pixels.groupBy(*keys).agg(F.collect_list(F.struct(number.alias("c"), F.col("adu").cast("int").alias("v"))).alias("cells"))
    return cells.select(*keys, densify(side)(F.col("cells.c"), F.col("cells.v")).alias("image"))


def _whole_numbers(df: DataFrame, column: str) -> bool:
    kind = df.select(column).schema[0].dataType
    return isinstance(kind, ArrayType) and kind.elementType == IntegerType()


def pixels_from_images(df: DataFrame, keys=("event", "telescope"), column: str = "image", side: int = K.CAMERA_SIDE):
    """The lit cells of array images as a pixel table.

    The outer form of the generators keeps Spark from asking each image's size first, for which it would work
    out the image a second time."""
    if _whole_numbers(df, column):
        lit = df.select(*keys, lit_cells()(F.col(column)).alias("_lit"))  # next to the functions that made the image
        cells = lit.select(*keys, F.inline_outer("_lit")).filter("adu is not null")
    else:
        cells = df.select(*keys, F.posexplode_outer(column).alias("cell", "adu")).filter("adu <> 0")
    return cells.select(
        *keys,
        F.expr(f"cell div {side}").cast("int").alias("px"),
        (F.col("cell") % side).alias("py"),
        "adu",
    )


def sum_cells(hits: DataFrame, keys=("event", "telescope"), weight="adu") -> DataFrame:
    """One row per camera cell; partial sums run before the shuffle."""
    return hits.groupBy(*keys, "px", "py").agg(F.sum(weight).alias("adu"))


def project_photons(photons: DataFrame, truth: DataFrame) -> DataFrame:
    """Photon directions to camera offsets `x`, `y` in degrees.

    `photons` (event, telescope, cx, cy, ...) meets its shower's az, ze from
    `truth`; the telescope looks at the shower, turned by the local declination.
    """
    shower = truth.select("event", "az", "ze")
    az = angles.full_circle(F.lit(angles.TWO_PI / 2) - angles.full_circle(F.radians("az") - F.lit(angles.TWO_PI / 2)))
    tel_az = az + F.radians(F.lit(K.MAGNETIC_DECLINATION_DEG))
    tel_ze = F.radians("ze")
    eps = 2.220446049250313e-16

    def exact_zero(c: Column) -> Column:
        return F.when(F.abs(c) < eps, F.lit(0.0)).otherwise(c)

    # the telescope axis is a property of the event, worked out before photons meet it
    axis = shower.select(
        "event",
        F.sin(tel_az).alias("sa"),
        F.cos(tel_az).alias("ca"),
        F.sin(tel_ze).alias("sz"),
        F.cos(tel_ze).alias("cz"),
    ).withColumns({"tx": exact_zero(F.col("sz") * F.col("sa")), "ty": exact_zero(F.col("sz") * F.col("ca"))})
    axis = axis.withColumn("tz", F.sqrt(1 - F.col("tx") * F.col("tx") - F.col("ty") * F.col("ty")))

    rays = photons.withColumns({"ux": exact_zero(-F.col("cy")), "uy": exact_zero(F.col("cx"))})
    rays = rays.withColumn("uz", F.sqrt(1 - F.col("ux") * F.col("ux") - F.col("uy") * F.col("uy")))
    met = rays.join(axis, "event").withColumn(
        "dot", F.col("ux") * F.col("tx") + F.col("uy") * F.col("ty") + F.col("uz") * F.col("tz")
    )
    met = met.withColumns({f"g{a}": F.try_divide(f"u{a}", "dot") - F.col(f"t{a}") for a in "xyz"})
    across = F.col("gx") * F.col("ca") - F.col("gy") * F.col("sa")
    along = (F.col("gx") * F.col("sa") + F.col("gy") * F.col("ca")) * F.col("cz") - F.col("gz") * F.col("sz")
    return derive_once(
        met, {"x": -F.degrees(exact_zero(across)), "y": F.degrees(exact_zero(along))}, keep=photons.columns
    )


def camera_cell(offset: Column) -> Column:
    """Pixel index of an offset in degrees; NULL off the camera (upper edge open)."""
    cell = uniform_bin(offset, K.CAMERA_MIN_DEG, K.CAMERA_MAX_DEG, K.CAMERA_SIDE)
    return F.when(offset < K.CAMERA_MAX_DEG, cell)


def bin_photons(projected: DataFrame, weight=None, keys=("event", "telescope")) -> DataFrame:
    """Weighted camera histogram of projected photons; photons off the camera drop out."""
    weight = F.lit(K.ADU_PER_PHOTON) if weight is None else weight
    lo, hi = K.CAMERA_MIN_DEG, K.CAMERA_MAX_DEG
    seen = projected.filter((F.col("x") >= lo) & (F.col("x") < hi) & (F.col("y") >= lo) & (F.col("y") < hi))
    cells = seen.select(
        *keys,
        camera_cell(F.col("x")).alias("px"),
        camera_cell(F.col("y")).alias("py"),
        weight.cast("bigint").alias("w"),
    )
    return sum_cells(cells, keys, "w")


def triggered_pixels(pixels: DataFrame, least: float = K.TRIGGER_ADU, keys=("event", "telescope")) -> DataFrame:
    """Pixels of the images whose brightest pixel reaches the trigger level. The pixel table is shuffled once; an image's list
    of lit cells is bounded by its camera. Rows without a key drop out."""
    keys, content = list(keys), [c for c in pixels.columns if c not in keys]
    images = pixels.dropna(subset=keys).groupBy(*keys).agg(F.max("adu").alias("peak_"), F.collect_list(F.struct(*content)).alias("cells_"))
    return images.filter(F.col("peak_") >= least).select(*keys, F.inline("cells_")).select(*pixels.columns)


def trigger_images(df: DataFrame, least: float = K.TRIGGER_ADU, column: str = "image") -> DataFrame:
    """Array images below the trigger level become empty."""
    if _whole_numbers(df, column):
        return df.withColumn(column, triggered(least)(F.col(column)))
    zeros = F.transform(column, lambda _: F.lit(0))
    return df.withColumn(column, F.when(F.array_max(column) >= least, F.col(column)).otherwise(zeros))


def stack_telescopes(pixels: DataFrame, key: str = "event") -> DataFrame:
    """Pixelwise sum over the telescopes of an event."""
    return pixels.groupBy(key, "px", "py").agg(F.sum("adu").alias("adu"))


def shower_truth(truth: DataFrame) -> DataFrame:
    """Simulated shower quantities in local axes, as they accompany every image."""
    az = angles.full_circle(F.lit(angles.TWO_PI / 2) - angles.full_circle(F.radians("az") - F.lit(angles.TWO_PI / 2)))
    return truth.select(
        F.col("event").alias("Event"),
        (F.degrees(az) + K.MAGNETIC_DECLINATION_DEG).alias("TrueAz"),
        F.col("ze").alias("TrueZe"),
        (-F.col("ycore")).alias("TrueXcore"),
        F.col("xcore").alias("TrueYcore"),
        F.col("energy").alias("TrueEnergy"),
    )


def event_lookup(df: DataFrame, event: int, key: str = "Event") -> DataFrame:
    """The rows of one event; the filter reaches the scan."""
    return df.filter(F.col(key) == event)


def shift_image(pix: Column, dx: Column, dy: Column, side: int = K.CAMERA_SIDE) -> Column:
    """The image, row by row, moved by whole pixels to the right and up. What leaves it is lost, and zeros come in."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))

    def content(k: Column) -> Column:
        x, y = k % side - dx, F.floor(k / side).cast("int") - dy
        inside = x.between(0, side - 1) & y.between(0, side - 1)
        return F.when(inside, F.get(pix, (y * side + x).cast("int"))).otherwise(F.lit(0))

    return F.transform(cells, content)
