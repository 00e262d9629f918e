"""Derived columns that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive_once(df: DataFrame, columns: dict[str, Column], keep=None) -> DataFrame:
    """`df.withColumns`, but a later filter on the new columns stays above them.

    The optimizer moves filters below projections and copies the projected expressions
    into them. For long chains of formulas that repeats the whole chain many times, so
    the values are handed on as the one element of an inlined array, which filters on
    its content do not cross. `keep` names the columns of `df` to hand on.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in columns]
    row = F.struct(*[v.alias(c) for c, v in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))
