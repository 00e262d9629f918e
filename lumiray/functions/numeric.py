"""Rounding, missing values and bin arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumiray.constants import NOISE


def missing(c: Column) -> Column:
    """NaN becomes NULL: Spark ranks NaN above every number, the analysis drops it."""
    return F.nanvl(c, F.lit(None).cast("double"))


def snap(c: Column, eps: float = NOISE) -> Column:
    return F.when(F.abs(c) < eps, F.lit(0.0)).otherwise(c)


def tidy(c: Column, digits: int = 6) -> Column:
    """Round half up to the precision of the parameter files.

    Positions on the pixel lattice often end exactly halfway between two roundings, where
    the last bit of a sum would decide. A value within a ten-thousandth of the last
    digit below the half therefore counts as half, which makes the result independent of the
    order of summation.
    """
    scale = float(10**digits)
    return F.floor(missing(c) * scale + 0.5001) / F.lit(scale)


def safe_sqrt(c: Column) -> Column:
    """NULL, not NaN, for a negative radicand."""
    return F.when(c >= 0, F.sqrt(c))


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def uniform_bin(x: Column, lo, hi, bins) -> Column:
    """Index of `x` among `bins` equal cells of [lo, hi]; NULL outside.

    The cell found by division is compared with its own edges and moved by one
    where the division rounded across an edge; the last cell is closed.
    `lo`, `hi` and `bins` may be numbers or columns.
    """
    lo, hi, bins = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi, bins))
    lo, hi = lo.cast("double"), hi.cast("double")
    step = (hi - lo) / bins
    guess = F.least(F.floor((x - lo) * F.try_divide(bins.cast("double"), hi - lo)), bins - 1)
    moved = (
        F.when(x < guess * step + lo, guess - 1)
        .when((guess < bins - 1) & (x >= (guess + 1) * step + lo), guess + 1)
        .otherwise(guess)
    )
    return F.when((x >= lo) & (x <= hi), moved).cast("int")


def first_step_above(x: Column, step: float, power: int = 1) -> Column:
    """Smallest i >= 0 with (i*step)**power > x, found by division and moved by
    one where the division rounded across a step."""
    root = x if power == 1 else F.sqrt(x)
    guess = F.greatest(F.floor(root / F.lit(step)) + 1, F.lit(0)).cast("long")

    def level(i: Column) -> Column:
        edge = i * F.lit(step)
        return edge if power == 1 else edge * edge

    moved = (
        F.when(level(guess) <= x, guess + 1)
        .when((guess >= 1) & (level(guess - 1) > x), guess - 1)
        .otherwise(guess)
    )
    return F.when(x.isNotNull(), moved)


def wall_clock_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a timestamp without zone, whatever the session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    whole = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return (whole * 1000000 + micros) / F.lit(1e6)
