"""Arrow-vectorised functions over whole camera images.

An image is an `array<int>` of side*side pixels, index = px*side + py. The
functions see Arrow batches and never a single row, so one call cleans a batch.
"""

from __future__ import annotations

from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lumiray import constants as K


def aperture_weights() -> np.ndarray:
    """(subpixel, 3x3 neighbourhood) weights of the aperture sum.

    Sub-pixels repeat their pixel and the aperture reaches less than a pixel
    further, so every aperture sum is a fixed mix of the 3x3 neighbourhood.
    """
    n, reach = K.SUBPIXELS, K.APERTURE_RADIUS
    weights = np.zeros((n, n, 3, 3))
    for u in range(n):
        for v in range(n):
            for du in range(-reach, reach + 1):
                for dv in range(-reach, reach + 1):
                    cell = ((u + du) // n + 1, (v + dv) // n + 1)
                    weights[(u, v, *cell)] += K.APERTURE_OVERLAP[abs(du), abs(dv)] / (n * n)
    return weights.reshape(n * n, 9)


def _neighbourhoods(images: np.ndarray) -> np.ndarray:
    """(batch, side, side) to (batch, side, side, 9), zero beyond the camera."""
    padded = np.pad(images, ((0, 0), (1, 1), (1, 1)))
    side = images.shape[1]
    shifted = [padded[:, a : a + side, b : b + side] for a in range(3) for b in range(3)]
    return np.stack(shifted, axis=-1)


def aperture_mask(images: np.ndarray, noise: float, nsb: float, snr: float) -> np.ndarray:
    """True for lit pixels where any sub-pixel's aperture sum exceeds snr times its noise.

    An aperture sum is at most its weight times the brightest of the nine pixels, and
    the threshold falls slower than the weight at the camera's edge. So only lit pixels
    with a bright enough neighbourhood are worked out; the bound drops none that passes.
    """
    weights = aperture_weights()
    variance = noise * noise + nsb
    padded = np.pad(images, ((0, 0), (1, 1), (1, 1)))
    side = images.shape[1]
    rows = np.maximum(np.maximum(padded[:, :-2], padded[:, 1:-1]), padded[:, 2:])
    brightest = np.maximum(np.maximum(rows[:, :, :-2], rows[:, :, 1:-1]), rows[:, :, 2:])
    reachable = snr * np.sqrt(variance / weights.sum(axis=1).max()) * (1 - 1e-9)
    k, i, j = np.nonzero((images != 0) & (brightest > reachable))
    inside = _neighbourhoods(np.ones((1, side, side)))[0]
    threshold = snr * np.sqrt(inside @ weights.T * variance)
    keep = np.zeros(images.shape, dtype=bool)
    for start in range(0, len(k), 65536):  # bounds the 25-fold working set
        part = slice(start, start + 65536)
        near = [padded[k[part], i[part] + a, j[part] + b] for a in range(3) for b in range(3)]
        sums = np.stack(near, axis=-1).astype(np.float64) @ weights.T
        keep[k[part], i[part], j[part]] = (sums > threshold[i[part], j[part]]).any(axis=-1)
    return keep


def has_diagonal_partner(lit: np.ndarray) -> np.ndarray:
    padded = np.pad(lit, ((0, 0), (1, 1), (1, 1)))
    return padded[:, :-2, :-2] | padded[:, :-2, 2:] | padded[:, 2:, :-2] | padded[:, 2:, 2:]


def two_level_mask(images: np.ndarray, image_level: float, border_level: float) -> np.ndarray:
    core = images >= image_level
    return core | ((images >= border_level) & has_diagonal_partner(core))


def _as_images(column: pa.Array) -> np.ndarray:
    """Lists of equal square length as (rows, side, side); missing lists are left out."""
    rows = len(column) - column.null_count
    flat = column.flatten().to_numpy(zero_copy_only=False)
    side = int(round((len(flat) / rows) ** 0.5)) if rows else 0
    if rows * side * side != len(flat):
        raise ValueError("images of one column must be squares of one size")
    return flat.reshape(rows, side, side)


def _as_lists(images: np.ndarray, like: pa.Array) -> pa.Array:
    size = images.shape[1] * images.shape[2]
    present = np.asarray(like.is_valid())
    offsets = np.concatenate([[0], np.cumsum(present * size)]).astype(np.int32)
    values = pa.array(images.reshape(-1).astype(np.int32))
    mask = pa.array(~present) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def cleaner(
    nsb: float,
    mode: str = "aperture",
    noise: float = K.READOUT_NOISE_ADU,
    snr: float = K.SNR_THRESHOLD,
    image_level: float = 0.0,
    border_level: float = 0.0,
    isolated: bool = True,
    min_pixels: int = K.MIN_IMAGE_PIXELS,
):
    """Image cleaning as one function of an image column.

    `mode` picks the signal test: "aperture" (signal over noise in the aperture),
    "two_level" (image and border thresholds), "flat" (one threshold) or "none".
    Afterwards negative pixels go, then pixels without a lit diagonal neighbour,
    then whole images with fewer than `min_pixels` lit pixels.
    """

    def cleaned(images: np.ndarray) -> np.ndarray:
        if mode == "aperture":
            images = np.where(aperture_mask(images, noise, nsb, snr), images, 0)
        elif mode == "two_level":
            images = np.where(two_level_mask(images, image_level, border_level), images, 0)
        elif mode == "flat":
            images = np.where(images >= image_level, images, 0)
        images = np.maximum(images, 0)
        if isolated:
            images = np.where(has_diagonal_partner(images != 0), images, 0)
        if min_pixels:
            enough = np.count_nonzero(images, axis=(1, 2)) >= min_pixels
            images = np.where(enough[:, None, None], images, 0)
        return images

    @F.arrow_udf("array<int>")
    def clean(column: pa.Array) -> pa.Array:
        images = _as_images(column)
        if not len(images):
            return column.cast(pa.list_(pa.int32()))
        if not min_pixels:
            return _as_lists(cleaned(images), column)
        # every step only takes pixels away, so that an image with too few of them ends empty
        enough = np.count_nonzero(images, axis=(1, 2)) >= min_pixels
        out = np.zeros(images.shape, dtype=np.int32)
        if enough.any():
            out[enough] = cleaned(images[enough]).astype(np.int32)
        return _as_lists(out, column)

    return clean


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists, 0 for missing ones, and all their values."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def triggered(least: float):
    """Lists without a value of at least `least` become zeros; missing lists stay missing. The others keep their missing values."""

    @F.arrow_udf("array<int>")
    def fire(column: pa.Array) -> pa.Array:
        lengths, values = _lists(column)
        if not len(values):
            return column
        filled = np.flatnonzero(lengths)
        bright = values.is_valid().to_numpy(zero_copy_only=False) & (values.fill_null(0).to_numpy(zero_copy_only=False) >= least)
        dark = np.ones(len(column), dtype=bool)
        dark[filled] = ~np.logical_or.reduceat(bright, np.append(0, np.cumsum(lengths)[:-1])[filled])
        if not dark[filled].any():
            return column
        zeros = pc.if_else(pa.array(np.repeat(dark, lengths)), pa.scalar(0, pa.int32()), values)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), zeros, mask=column.is_null() if column.null_count else None)

    return fire


def lit_cells():
    """The cells of each list that are not zero, as a list of their places and values; missing lists stay missing."""

    @F.arrow_udf("array<struct<cell:int,adu:int>>")
    def lit(column: pa.Array) -> pa.Array:
        lengths, values = _lists(column)
        values = values.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(values)
        ends = np.append(0, np.cumsum(lengths))
        cell = at - np.repeat(ends[:-1], lengths)[at]
        content = pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(values[at].astype(np.int32))], ["cell", "adu"])
        offsets = np.searchsorted(at, ends).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), content, mask=column.is_null() if column.null_count else None)

    return lit


def densify(side: int):
    """Lists of cell numbers and of their contents to whole images; contents of a repeated cell add up."""

    @F.arrow_udf("array<int>")
    def dense(cells: pa.Array, values: pa.Array) -> pa.Array:
        rows = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        images = np.zeros((len(cells), side * side), dtype=np.int32)
        at = cells.flatten().to_numpy(zero_copy_only=False)
        np.add.at(images, (rows, at), values.flatten().to_numpy(zero_copy_only=False))
        offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * (side * side))
        return pa.ListArray.from_arrays(offsets, pa.array(images.reshape(-1)))

    return dense


def without_pedestals():
    """Raw images minus pedestals, cut toward zero; zeros where the telescope number is not positive or missing. Missing lists stay
    missing, as do missing values, and those beyond the end of the shorter list."""

    @F.arrow_udf("array<int>")
    def subtract(pix: pa.Array, peds: pa.Array, scope: pa.Array) -> pa.Array:
        out = scope.fill_null(0).to_numpy(zero_copy_only=False) <= 0
        known = np.asarray(peds.is_valid(), dtype=bool)
        long = len(pix.flatten()) // max(len(pix), 1)
        flat = [not a.flatten().null_count and (a.drop_null().value_lengths().to_numpy(zero_copy_only=False) == long).all() for a in (pix, peds)]
        if long and not pix.null_count and all(flat):
            left = pix.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(pix), long)
            left[known] -= peds.flatten().to_numpy(zero_copy_only=False).reshape(-1, long)
            left[out | ~known] = 0
            values = pa.array(np.trunc(left).reshape(-1)).cast(pa.int32())  # an error beyond 32 bits
            lost = ~(out | known)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(pix) + 1, dtype=np.int32) * long), values, mask=pa.array(lost) if lost.any() else None)
        minus = lambda p, q: None if p is None or q is None else int(p - q)
        rows = (
            None if p is None else [0] * len(p) if none else None if q is None else [minus(a, b) for a, b in zip_longest(p, q)]
            for p, q, none in zip(pix.to_pylist(), peds.to_pylist(), out)
        )
        return pa.array(rows, pa.list_(pa.int32()))

    return subtract


def raised(by: int):
    """Whole images with a constant added, as 16-bit numbers; an error beyond their range."""

    @F.arrow_udf("array<smallint>")
    def raise_(column: pa.Array) -> pa.Array:
        values = pc.add(column.flatten(), pa.scalar(by, pa.int32())).cast(pa.int16())
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=column.is_null() if column.null_count else None)

    return raise_


RAW_MOMENT_FIELDS = ["s0", "si", "sj", "sii", "sjj", "sij"]


def raw_moments_of_images():
    """Integer moment sums of each image in pixel units, as a struct of bigints."""

    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in RAW_MOMENT_FIELDS) + ">")
    def moments(column: pa.Array) -> pa.Array:
        images = _as_images(column)
        side = images.shape[1] if len(images) else 0
        i, j = np.divmod(np.arange(side * side, dtype=np.int64), max(side, 1))
        basis = np.stack([np.ones_like(i), i, j, i * i, j * j, i * j], axis=1)
        sums = images.reshape(len(images), -1).astype(np.int64) @ basis
        full = np.zeros((len(column), len(RAW_MOMENT_FIELDS)), dtype=np.int64)
        present = np.asarray(column.is_valid(), dtype=bool)
        full[present] = sums
        fields = [pa.array(full[:, k], mask=~present) for k in range(full.shape[1])]
        return pa.StructArray.from_arrays(fields, RAW_MOMENT_FIELDS)

    return moments
