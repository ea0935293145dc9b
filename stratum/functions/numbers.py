"""Rounding, guarded division and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CURRENCY, NA_TOKENS


def round_half_even(c: Column, places: int = 4) -> Column:
    """Round a double half to even on its scaled value."""
    scale = 10**places
    return F.rint(c.cast("double") * scale) / scale


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """num / den as doubles; otherwise where den is 0 or null."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value, in all columns of doubles and floats."""
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(k)) for c, k in df.dtypes if k in ("double", "float")})


def known(c: Column) -> Column:
    """Text with the tokens that stand for a missing value as null."""
    return F.when(~c.isin(*NA_TOKENS), c)


def number_text(c: Column) -> Column:
    """A double from text with percent signs, currency signs and separators; null where that fails. `15%` is 15."""
    bare = F.regexp_replace(F.trim(c.cast("string")), f"[%,{CURRENCY}]", "")
    return F.when(bare.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), bare.try_cast("double"))


def plain_text(c: Column, kind: str) -> Column:
    """A value as text; whole doubles without exponent or fraction."""
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")
