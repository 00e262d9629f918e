"""Stereo reconstruction: shower direction and ground position from several telescopes.

Two ways lead to the same results. The general one takes any number of images in an
event, also several of one telescope: an event's images are joined with each other on the
event, and sums by event give direction and position. Where every event is known to have at
most one image of each telescope, its images are laid side by side in one row by a single
grouped aggregate with fixed-width buffers, which combines before the shuffle; all pairs
of telescopes are then column expressions of that row.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.functions import angles
from lumiray.functions.numeric import hypot
from lumiray.operators.derive import derive_once
from lumiray.session import cut_lineage, small_table

#: images of an event that meet in one block
PAIR_BLOCK = 512
IMAGE_COLUMNS = ("Size", "MeanX", "MeanY", "Phi", "Length", "Width")


def _add(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def side_by_side(
    images: DataFrame, columns=IMAGE_COLUMNS, telescopes=K.TELESCOPES, key: str = "Event", extra=()
) -> DataFrame:
    """One row per event: `<column>_<telescope>` for each telescope, NULL where it has
    no image, and `n_images`. Only for images known to be unique by event and telescope:
    two images of one telescope in an event, or another telescope, are an error."""
    aggs = []
    for t in telescopes:
        here = F.col("Telescope") == t
        aggs += [F.max(F.when(here, F.col(c))).alias(f"{c}_{t}") for c in columns]
        aggs.append(F.count_if(here).alias(f"n_{t}"))
    wide = images.groupBy(key).agg(*aggs, F.count("*").alias("n_images"), *extra)
    repeated = F.greatest(*[F.col(f"n_{t}") for t in telescopes]) > 1
    strange = _add([F.col(f"n_{t}") for t in telescopes]) != F.col("n_images")
    checked = (
        F.when(repeated, F.raise_error(F.lit("an event has two images of one telescope")).cast("bigint"))
        .when(strange, F.raise_error(F.lit("an image has an unknown telescope number")).cast("bigint"))
        .otherwise(F.col("n_images"))
    )
    # as a filter, so that the check stays where nobody reads the number
    return wide.withColumn("n_images", checked).filter("n_images > 0").drop(*[f"n_{t}" for t in telescopes])


def has_image(t: int) -> Column:
    return F.col(f"Size_{t}").isNotNull()


def axis_intersection(wide: DataFrame, telescopes=K.TELESCOPES, keep_all: bool = False) -> DataFrame:
    """Adds `Xoffset`, `Yoffset` and `MeanAngle`; events without weight drop out, or keep
    NULL for all three with `keep_all`.

    The direction is the mean of the pairwise intersections of image axes, weighted by
    the square of reduced size, elongation and sine of the crossing angle. Weighting by
    the squared sine cancels the division of the intersection, so parallel axes need no
    special case: they contribute nothing.
    """
    prepared = wide.withColumns({f"f_{t}": F.radians(angles.axis_angle(F.col(f"Phi_{t}"))) for t in telescopes})
    prepared = prepared.withColumns(
        {f"c_{t}": F.cos(f"f_{t}") for t in telescopes}
        | {f"s_{t}": F.sin(f"f_{t}") for t in telescopes}
        | {
            f"e_{t}": 1 - F.when(F.col(f"Length_{t}") > 0, F.try_divide(f"Width_{t}", f"Length_{t}")).otherwise(1.0)
            for t in telescopes
        }
    )
    pair_columns, names = {}, []
    for a, b in combinations(telescopes, 2):
        g = lambda c, t: F.col(f"{c}_{t}")
        both = has_image(a) & has_image(b)
        turn = g("f", b) - g("f", a)
        sine = F.sin(turn)
        reduced = F.try_divide(g("Size", a) * g("Size", b), g("Size", a) + g("Size", b))
        strength = reduced * g("e", a) * g("e", b)
        # signed distance along axis a to the crossing, times the sine of the angle
        reach = (g("MeanX", b) - g("MeanX", a)) * g("s", b) - (g("MeanY", b) - g("MeanY", a)) * g("c", b)
        pull = strength * strength * sine
        n = f"{a}{b}"
        names.append(n)
        pair_columns |= {
            f"w{n}": F.when(both, pull * sine).otherwise(0.0),
            f"x{n}": F.when(both, pull * (g("MeanX", a) * sine + reach * g("c", a))).otherwise(0.0),
            f"y{n}": F.when(both, pull * (g("MeanY", a) * sine + reach * g("s", a))).otherwise(0.0),
            f"g{n}": F.when(both, F.degrees(F.abs(turn))),
        }
    pairs = prepared.withColumns(pair_columns)
    folded = [F.when(F.col(f"g{n}") < 90, F.col(f"g{n}")).otherwise(180 - F.col(f"g{n}")) for n in names]
    known = [F.col(f"g{n}").isNotNull() for n in names]
    mean_fold = F.try_divide(
        _add([F.when(k, v).otherwise(0.0) for k, v in zip(known, folded)]),
        _add([k.cast("int") for k in known]),
    )
    plain = F.coalesce(*[F.col(f"g{n}") for n in names])
    n_known = _add([has_image(t).cast("int") for t in telescopes])
    total = _add([F.col(f"w{n}") for n in names])
    found = derive_once(
        pairs,
        {
            "Xoffset": F.when(total > 0, F.try_divide(_add([F.col(f"x{n}") for n in names]), total)),
            "Yoffset": F.when(total > 0, F.try_divide(_add([F.col(f"y{n}") for n in names]), total)),
            "MeanAngle": F.when(total > 0, F.when(n_known == 2, -plain).otherwise(mean_fold)),
        },
        keep=wide.columns,
    )
    return found if keep_all else found.filter(F.col("Xoffset").isNotNull())


def reconstructible(images: DataFrame) -> DataFrame:
    """Images the simulation path admits: positive size, defined length and width."""
    return images.filter("Size > 0 AND Length IS NOT NULL AND Width IS NOT NULL")


def paired_images(images: DataFrame, columns, key: str = "Event", block: int = PAIR_BLOCK) -> DataFrame:
    """Every pair of images of an event once, as structs `a` and `b` of `columns`, `a` before `b` by telescope and content, and
    `n_images`. Images are dealt into blocks of about `block` by a hash, and pairs to pairs of blocks, so that no task
    orders or holds a crowded event; an event of up to `block` images is one block."""
    counts = small_table(images.groupBy(key).agg(F.count(F.lit(1)).alias("n_images")).withColumn("_blocks", F.ceil(F.col("n_images") / block).cast("int")))
    # copies are told apart by a number of the written row
    own = cut_lineage(images.withColumn("_row", F.monotonically_increasing_id()))
    dealt = own.join(counts, key).withColumn("_own", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int"))
    image = F.struct("Telescope", *[c for c in columns if c != "Telescope"], "_row")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    spread = dealt.select(key, "n_images", "_own", image.alias("image"), other.alias("_other"))
    spread = spread.select(key, "n_images", "_own", "image", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"))
    a, b = (spread.select(key, *(["n_images"] if side == "a" else []), F.col("_own").alias(f"_own_{side}"), "_low", "_high", F.col("image").alias(side)) for side in "ab")
    pairs = a.join(b, [key, "_low", "_high"]).filter(((F.col("_low") == F.col("_high")) | (F.col("_own_a") != F.col("_own_b"))) & (F.col("a") < F.col("b")))
    return pairs.select(key, "n_images", "a", "b")


def directions_of_pairs(images: DataFrame, least: int = 2, key: str = "Event") -> DataFrame:
    """Direction of each event with at least `least` images, however many and of whatever telescopes:
    `Xoffset`, `Yoffset`, `MeanAngle`, `n_images`. The same sums as in `axis_intersection`, over the pairs of images."""
    turned = images.select(key, "Telescope", *IMAGE_COLUMNS).withColumn("f", F.radians(angles.axis_angle(F.col("Phi")))).withColumns(
        {"c": F.cos("f"), "s": F.sin("f"), "e": 1 - F.when(F.col("Length") > 0, F.try_divide("Width", "Length")).otherwise(1.0)}
    )
    pairs = paired_images(turned, [*IMAGE_COLUMNS, "f", "c", "s", "e"], key).filter(F.col("n_images") >= max(least, 2))
    g = lambda side, c: F.col(f"{side}.{c}")
    turn = g("b", "f") - g("a", "f")
    sine = F.sin(turn)
    strength = F.try_divide(g("a", "Size") * g("b", "Size"), g("a", "Size") + g("b", "Size")) * g("a", "e") * g("b", "e")
    reach = (g("b", "MeanX") - g("a", "MeanX")) * g("b", "s") - (g("b", "MeanY") - g("a", "MeanY")) * g("b", "c")
    pull = strength * strength * sine
    gap = F.degrees(F.abs(turn))
    terms = pairs.select(
        key, "n_images", (pull * sine).alias("w"),
        (pull * (g("a", "MeanX") * sine + reach * g("a", "c"))).alias("x"),
        (pull * (g("a", "MeanY") * sine + reach * g("a", "s"))).alias("y"), gap.alias("gap"),
    )
    folded = F.when(F.col("gap") < 90, F.col("gap")).otherwise(180 - F.col("gap"))
    sums = terms.groupBy(key).agg(
        F.max("n_images").alias("n_images"), F.sum("w").alias("w"), F.sum("x").alias("x"), F.sum("y").alias("y"),
        F.max("gap").alias("gap"), F.avg(folded).alias("fold"), (F.count("w") == F.count(F.lit(1))).alias("whole"),
    )
    # an image without an axis leaves its event without a direction
    return sums.filter("w > 0 AND whole").select(
        key, "n_images", F.try_divide("x", "w").alias("Xoffset"), F.try_divide("y", "w").alias("Yoffset"),
        F.when(F.col("n_images") == 2, -F.col("gap")).otherwise(F.col("fold")).alias("MeanAngle"),
    )


def directions(images: DataFrame, least: int = 2, telescopes=K.TELESCOPES, extra=(), unique: bool = False) -> DataFrame:
    """Camera-plane direction per event with at least `least` images.

    `unique` says that no event has two images of a telescope, nor one of others than `telescopes`; the result
    then has the images side by side, and `extra` aggregates."""
    if not unique:
        return directions_of_pairs(images, least)
    wide = side_by_side(images, telescopes=telescopes, extra=extra)
    return axis_intersection(wide.filter(F.col("n_images") >= max(least, 2)), telescopes)


def with_radec(df: DataFrame, ra0: float = K.POINTING_RA_DEG, dec0: float = K.POINTING_DEC_DEG) -> DataFrame:
    ra, dec = angles.offset_to_radec(F.col("Xoffset"), F.col("Yoffset"), ra0, dec0)
    return derive_once(df, {"RA": ra, "DEC": dec})


def with_azze(df: DataFrame, az0: str = "TrueAz", ze0: str = "TrueZe") -> DataFrame:
    """Azimuth and zenith distance of the shower about the telescope direction."""
    az, ze = angles.offset_to_azze(F.col("Xoffset"), F.col("Yoffset"), F.col(az0), F.col(ze0))
    return derive_once(df, {"Az": az, "Ze": ze})


def perpendicular_distance(xs: Column, ys: Column, xp: Column, yp: Column, ux: Column, uy: Column) -> Column:
    """Distance of (xs, ys) from the line through (xp, yp) along the unit vector (ux, uy)."""
    return F.abs(ux * (ys - yp) - uy * (xs - xp))


def core_fit(df: DataFrame, telescopes=K.TELESCOPES, parallel: float = 0.0) -> DataFrame:
    """Adds `xfit`, `yfit`, `stdP`, `n_lines` from the lines `lx_t, ly_t, ux_t, uy_t, lw_t`.

    The point minimises the weighted squared perpendicular distance; stdP is the weighted
    mean square. NULL for fewer than two lines, or where the mean squared sine of the crossing
    angles, weighted, is not above `parallel`.
    """

    def total(term) -> Column:
        return _add([F.when(F.col(f"lw_{t}").isNotNull(), term(t)).otherwise(0.0) for t in telescopes])

    def g(c: str, t: int) -> Column:
        return F.col(f"{c}_{t}")

    sums = df.withColumns(
        {
            "n_lines": _add([F.col(f"lw_{t}").isNotNull().cast("int") for t in telescopes]),
            "lw": total(lambda t: g("lw", t)),
        }
    )
    sums = sums.withColumns(
        {
            "a1": F.try_divide(total(lambda t: g("lw", t) * g("uy", t) * g("uy", t)), F.col("lw")),
            "b1": F.try_divide(total(lambda t: -g("lw", t) * g("ux", t) * g("uy", t)), F.col("lw")),
            "b2": F.try_divide(total(lambda t: g("lw", t) * g("ux", t) * g("ux", t)), F.col("lw")),
            "c1": F.try_divide(
                total(lambda t: g("lw", t) * g("uy", t) * (g("ly", t) * g("ux", t) - g("lx", t) * g("uy", t))),
                F.col("lw"),
            ),
            "c2": F.try_divide(
                total(lambda t: g("lw", t) * g("ux", t) * (g("lx", t) * g("uy", t) - g("ly", t) * g("ux", t))),
                F.col("lw"),
            ),
        }
    )
    a1, b1, b2, c1, c2 = (F.col(c) for c in ("a1", "b1", "b2", "c1", "c2"))
    # the mean squared sine of the crossing angles
    spread = a1 * b2 - b1 * b1
    det = F.when((F.col("n_lines") >= 2) & (spread > parallel), spread)
    fitted = sums.withColumn("det", det).withColumns(
        {
            "xfit": F.try_divide(b1 * c2 - c1 * b2, F.col("det")),
            "yfit": F.try_divide(b1 * c1 - a1 * c2, F.col("det")),
        }
    )

    def square(t: int) -> Column:
        d = perpendicular_distance(F.col("xfit"), F.col("yfit"), g("lx", t), g("ly", t), g("ux", t), g("uy", t))
        return g("lw", t) * d * d

    fitted = fitted.withColumn("stdP", F.try_divide(total(square), F.col("lw")))
    return fitted.drop("a1", "b1", "b2", "c1", "c2", "det", "lw")


def core_lines(df: DataFrame, positions=None, telescopes=K.TELESCOPES) -> DataFrame:
    """The line of each image in the plane across the telescope axis: through the
    telescope, along the image's offset from the reconstructed direction.

    Telescope positions come from columns `px_t, py_t, pz_t` or, when given, from
    `positions` {telescope: (x, y, z)}.
    """
    xcos, ycos = angles.direction_cosines(F.col("TrueAz"), F.col("TrueZe"))
    based = df.withColumns({"xcos": xcos, "ycos": ycos})
    axes = angles.shower_axes(F.col("xcos"), F.col("ycos"))
    placed = {}
    for t in telescopes:
        if positions is not None:
            spot = tuple(F.lit(float(v)) for v in positions[t])
        else:
            spot = tuple(F.col(f"p{a}_{t}") for a in "xyz")
        turned = angles.in_frame(axes, spot)
        placed[f"lx_{t}"] = turned[0] - F.radians("Xoffset") * turned[2]
        placed[f"ly_{t}"] = turned[1] - F.radians("Yoffset") * turned[2]
        usable = (F.col(f"Size_{t}") > 0) & (F.col(f"Length_{t}") > 0)
        weight = F.col(f"Size_{t}") * (1 - F.try_divide(f"Width_{t}", f"Length_{t}"))
        placed[f"lw_{t}"] = F.when(usable, weight * weight)
        placed[f"hx_{t}"] = F.col(f"MeanX_{t}") - F.col("Xoffset")
        placed[f"hy_{t}"] = F.col("Yoffset") - F.col(f"MeanY_{t}")
    lined = based.withColumns(placed)
    unit = {}
    for t in telescopes:
        hx, hy = F.col(f"hx_{t}"), F.col(f"hy_{t}")
        norm = hypot(hx, hy)
        unit[f"ux_{t}"] = F.when(hx != 0, F.try_divide(hx, norm)).otherwise(F.lit(0.0))
        unit[f"uy_{t}"] = F.when(hx != 0, F.try_divide(hy, norm)).otherwise(F.lit(1.0))
    return lined.withColumns(unit).drop(*[f"h{a}_{t}" for a in "xy" for t in telescopes])


def core_of_images(images: DataFrame, directed: DataFrame, positions, parallel: float = 0.0, key: str = "Event") -> DataFrame:
    """`xfit`, `yfit`, `stdP`, `n_lines` of each directed event (with TrueAz, TrueZe) from the lines of all its
    images, however many: the fit of `core_fit`, with one sum by event for each term.

    The mean square distance is the quadratic form of the same sums. `positions` {telescope: (x, y, z)};
    images of other telescopes give no line."""
    known = images.filter(F.col("Telescope").isin(*positions)).select(key, "Telescope", *IMAGE_COLUMNS)
    rows = known.join(directed, key)
    xcos, ycos = angles.direction_cosines(F.col("TrueAz"), F.col("TrueZe"))
    rows = rows.withColumns({"xcos": xcos, "ycos": ycos})

    def spot(axis: int) -> Column:
        return F.coalesce(*[F.when(F.col("Telescope") == t, F.lit(float(p[axis]))) for t, p in positions.items()])

    turned = angles.in_frame(angles.shower_axes(F.col("xcos"), F.col("ycos")), (spot(0), spot(1), spot(2)))
    weight = F.col("Size") * (1 - F.try_divide("Width", "Length"))
    rows = rows.filter("Size > 0 AND Length > 0").withColumns(
        {
            "lx": turned[0] - F.radians("Xoffset") * turned[2], "ly": turned[1] - F.radians("Yoffset") * turned[2],
            "lw": weight * weight, "hx": F.col("MeanX") - F.col("Xoffset"), "hy": F.col("Yoffset") - F.col("MeanY"),
        }
    )
    norm = hypot(F.col("hx"), F.col("hy"))
    rows = rows.withColumns(
        {
            "ux": F.when(F.col("hx") != 0, F.try_divide("hx", norm)).otherwise(F.lit(0.0)),
            "uy": F.when(F.col("hx") != 0, F.try_divide("hy", norm)).otherwise(F.lit(1.0)),
        }
    )
    w, ux, uy = F.col("lw"), F.col("ux"), F.col("uy")
    q = ux * F.col("ly") - uy * F.col("lx")
    rest = [c for c in directed.columns if c != key]
    sums = rows.groupBy(key).agg(
        F.count("lw").alias("n_lines"), F.sum(w).alias("lw"), F.sum(w * uy * uy).alias("a1"), F.sum(-w * ux * uy).alias("b1"),
        F.sum(w * ux * ux).alias("b2"), F.sum(w * uy * q).alias("c1"), F.sum(-w * ux * q).alias("c2"), F.sum(w * q * q).alias("d"),
        *[F.any_value(c).alias(c) for c in (*rest, "xcos", "ycos")],
    )
    mean = {c: F.try_divide(c, "lw") for c in ("a1", "b1", "b2", "c1", "c2", "d")}
    sums = sums.withColumns(mean)
    a1, b1, b2, c1, c2 = (F.col(c) for c in ("a1", "b1", "b2", "c1", "c2"))
    spread = a1 * b2 - b1 * b1
    fitted = sums.withColumn("det", F.when((F.col("n_lines") >= 2) & (spread > parallel), spread))
    fitted = fitted.withColumns({"xfit": F.try_divide(b1 * c2 - c1 * b2, F.col("det")), "yfit": F.try_divide(b1 * c1 - a1 * c2, F.col("det"))})
    x, y = F.col("xfit"), F.col("yfit")
    square = a1 * x * x + b2 * y * y + 2 * (b1 * x * y + c1 * x + c2 * y) + F.col("d")
    return fitted.withColumn("stdP", F.when(x.isNotNull(), F.greatest(square, F.lit(0.0)))).drop("a1", "b1", "b2", "c1", "c2", "d", "det", "lw")


def core_to_ground(df: DataFrame) -> DataFrame:
    """Adds `Xcore`, `Ycore` on the ground and `core_valid`; invalid cores are NULL."""
    x, y = F.col("xfit"), F.col("yfit")
    z = F.when(F.col("Ze") != 0, F.try_divide(y, F.tan(F.radians(90 - F.col("Ze"))))).otherwise(0.0)

    def quiet(c: str) -> Column:
        return F.when(F.abs(F.col(c)) < K.LEAST_COSINE, F.lit(0.0)).otherwise(F.col(c))

    based = df.withColumns({"z_": z, "xq_": quiet("xcos"), "yq_": quiet("ycos")})
    ground = angles.on_ground(angles.shower_axes(F.col("xq_"), F.col("yq_")), (x, y, F.col("z_")))

    def normal(c: Column) -> Column:
        return F.coalesce(F.abs(c).between(K.SINGLE_MIN, K.SINGLE_MAX), F.lit(False))

    def finite(c: Column) -> Column:
        return F.coalesce(F.abs(c) <= K.SINGLE_MAX, F.lit(False))

    placed = based.withColumns({"gx_": ground[0], "gy_": ground[1]})
    valid = normal(x) & normal(y) & finite(F.col("gx_")) & finite(F.col("gy_"))
    return derive_once(
        placed,
        {
            "core_valid": valid,
            "Xcore": F.when(valid, F.col("gx_")),
            "Ycore": F.when(valid, F.col("gy_")),
        },
        keep=df.columns,
    )


def core_reconstruction(directed: DataFrame, positions=None, telescopes=K.TELESCOPES, parallel: float = 0.0) -> DataFrame:
    """Ground position of each event that has a direction; needs TrueAz, TrueZe. `parallel` as in `core_fit`."""
    lines = core_lines(directed, positions, telescopes)
    done = core_to_ground(core_fit(lines, telescopes, parallel))
    return done.drop("xcos", "ycos", *[f"{c}_{t}" for c in ("lx", "ly", "lw", "ux", "uy") for t in telescopes])


def core_distance_to_telescope(df: DataFrame, positions=K.SIM_TELESCOPES) -> DataFrame:
    """Adds TelX, TelY and the distance of the true core; unknown numbers count as telescope 2."""

    def place(axis: int) -> Column:
        t = F.col("Telescope")
        return (
            F.when(t == 3, F.lit(positions[3][axis]))
            .when(t == 1, F.lit(positions[1][axis]))
            .otherwise(F.lit(positions[2][axis]))
        )

    placed = df.withColumns({"TelX": place(0), "TelY": place(1)})
    gap = hypot(F.col("TrueXcore") - F.col("TelX"), F.col("TrueYcore") - F.col("TelY"))
    return placed.withColumn("CoreDistance", gap)
