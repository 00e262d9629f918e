"""Moment analysis: from pixels to image parameters.

Sums are taken over integer ADU and integer pixel indices, so they are exact and
do not depend on the order in which partitions merge. Scaling to degrees,
rotation and shift are affine, so they act on the six sums of an image rather
than on its pixels: one small row per image carries everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.constants import NOISE
from lumiray.functions.angles import full_circle
from lumiray.functions.numeric import hypot, missing, safe_sqrt, snap, tidy
from lumiray.functions.stencil import raw_moments_of_images
from lumiray.operators.derive import derive_once
from lumiray.schemas import SHAPE_COLUMNS


def raw_moments(pixels: DataFrame, keys=("event", "telescope"), extra=()) -> DataFrame:
    """Six integer sums per image; partially aggregated before the shuffle.

    Rows of one cell need not be summed beforehand: the sums are linear in `adu`.
    """
    s, i, j = (F.col(c).cast("bigint") for c in ("adu", "px", "py"))
    return pixels.groupBy(*keys).agg(
        F.sum(s).alias("s0"),
        F.sum(s * i).alias("si"),
        F.sum(s * j).alias("sj"),
        F.sum(s * i * i).alias("sii"),
        F.sum(s * j * j).alias("sjj"),
        F.sum(s * i * j).alias("sij"),
        *extra,
    )


def raw_moments_from_images(df: DataFrame, column: str = "image") -> DataFrame:
    """The same six sums next to array images, without any shuffle."""
    return df.withColumn("m", raw_moments_of_images()(F.col(column))).select("*", "m.*").drop("m", column)


def weighted_means(df: DataFrame, noise: float = NOISE) -> DataFrame:
    """Mean position and central second moments in degrees, after rotation by `rot`
    (radians) and shift by whole pixels `dx`, `dy` where these columns exist.
    All are zero for an image without positive content."""
    n = F.col("s0").cast("double")
    lit = F.col("s0") > 0
    base = df.withColumns(
        {
            "mi": F.when(lit, F.try_divide(F.col("si").cast("double"), n)).otherwise(F.lit(0.0)),
            "mj": F.when(lit, F.try_divide(F.col("sj").cast("double"), n)).otherwise(F.lit(0.0)),
        }
    )
    b = K.PIXEL_DEG
    x0 = K.CAMERA_MIN_DEG + 0.5 * b

    def central(ss: str, a: str, c: str) -> Column:
        top = F.col(ss).cast("double") * n - F.col(a).cast("double") * F.col(c).cast("double")
        return F.when(lit, F.try_divide(top, n * n) * (b * b)).otherwise(F.lit(0.0))

    base = base.withColumns(
        {
            "x_": F.col("mi") * b + x0,
            "y_": F.col("mj") * b + x0,
            "vx_": central("sii", "si", "si"),
            "vy_": central("sjj", "sj", "sj"),
            "vxy_": central("sij", "si", "sj"),
        }
    )
    if "rot" in df.columns:
        base = base.withColumns({"co": F.cos("rot"), "sn": F.sin("rot")})
        co, sn = F.col("co"), F.col("sn")
        x, y, vx, vy, vxy = (F.col(c) for c in ("x_", "y_", "vx_", "vy_", "vxy_"))
        base = base.withColumns(
            {
                "x_": x * co - y * sn - F.col("dx") * b,
                "y_": x * sn + y * co - F.col("dy") * b,
                "vx_": co * co * vx - 2 * co * sn * vxy + sn * sn * vy,
                "vy_": sn * sn * vx + 2 * co * sn * vxy + co * co * vy,
                "vxy_": co * sn * (vx - vy) + (co * co - sn * sn) * vxy,
            }
        ).drop("co", "sn")
    internal = {"mi", "mj", "x_", "y_", "vx_", "vy_", "vxy_", "rot", "dx", "dy", "s0", "si", "sj", "sii", "sjj", "sij"}
    return derive_once(
        base,
        {
            "xm": snap(F.when(lit, F.col("x_")).otherwise(F.lit(0.0)), noise),
            "ym": snap(F.when(lit, F.col("y_")).otherwise(F.lit(0.0)), noise),
            "vx": snap(F.col("vx_"), noise),
            "vy": snap(F.col("vy_"), noise),
            "vxy": snap(F.col("vxy_"), noise),
            "Size": n,
        },
        keep=[c for c in base.columns if c not in internal],
    )


def shape_parameters(df: DataFrame, digits: int | None = 6, noise: float = NOISE) -> DataFrame:
    """Image parameters from `weighted_means`; undefined ones are NULL.

    `digits` is the precision of the parameter files; None keeps full doubles.
    """
    xm, ym, vx, vy, vxy = (F.col(c) for c in ("xm", "ym", "vx", "vy", "vxy"))
    d = df.withColumn("d_", vy - vx).withColumns(
        {
            "z_": F.sqrt(F.col("d_") * F.col("d_") + 4 * vxy * vxy),
            "Distance": hypot(xm, ym),
        }
    )
    dd, z, dist = F.col("d_"), F.col("z_"), F.col("Distance")
    # components of the centroid along the major axis, times that axis
    d = d.withColumns(
        {
            "ac_": snap((dd + z) * ym + 2 * vxy * xm, noise),
            "bc_": snap(2 * vxy * ym - (dd - z) * xm, noise),
        }
    ).withColumn("cc_", hypot(F.col("ac_"), F.col("bc_")))
    ac, bc, cc = F.col("ac_"), F.col("bc_"), F.col("cc_")
    slope = F.when((bc == 0) & (ac != 0), F.signum(ac) * F.pi() / 2).otherwise(F.atan(F.try_divide(ac, bc)))
    across = F.abs(F.try_divide(bc, cc) * ym - F.try_divide(ac, cc) * xm)
    d = d.withColumn("Miss", F.when(cc != 0, F.least(across, dist)))
    values = {
        "MeanX": xm,
        "StdX": safe_sqrt(vx),
        "MeanY": ym,
        "StdY": safe_sqrt(vy),
        "Phi": F.degrees(full_circle(slope)),
        "Size": F.col("Size"),
        "Length": safe_sqrt((vx + vy + z) / 2),
        "Width": safe_sqrt(snap((vx + vy - z) / 2, noise)),
        "Miss": F.col("Miss"),
        "Distance": dist,
        "Azwidth": safe_sqrt(
            snap(F.try_divide(xm * xm * vy - 2 * xm * ym * vxy + ym * ym * vx, dist * dist), noise)
        ),
        "Alpha": F.degrees(F.asin(F.try_divide(F.col("Miss"), dist))),
    }
    rest = [c for c in df.columns if c not in ("xm", "ym", "vx", "vy", "vxy", "Size")]
    out = {c: missing(v) for c, v in values.items()}
    if digits is not None:
        out = {c: tidy(v, digits) for c, v in out.items()}
    return derive_once(d, {c: out[c] for c in SHAPE_COLUMNS}, keep=rest)


def image_parameters(moments: DataFrame, digits: int | None = 6, noise: float = NOISE) -> DataFrame:
    """The image-parameter table from raw moment sums, keyed by Event and Telescope. Variances and products
    nearer to zero than `noise` count as zero; images moved far off the camera need a larger bound."""
    named = shape_parameters(weighted_means(moments, noise), digits, noise)
    renames = {"event": "Event", "telescope": "Telescope"}
    return named.withColumnsRenamed({k: v for k, v in renames.items() if k in named.columns})
