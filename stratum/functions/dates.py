"""Dates in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a column that its format is chosen by.
SAMPLE = 1000
#: Formats tried; the one that reads most of the sampled values is taken for the column, of equals the first.
FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy-M-d'T'H:m:s")


def parsed(c: Column, pattern: str) -> Column:
    """A timestamp without zone; null where the text does not fit."""
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


class BadDate(ValueError):
    """A column has no format that reads its values."""


def format_of(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The format of each column that reads most of a sample of its values, the first by a hash, so that order and partitions of rows do not matter. One job for all columns."""
    if not columns:
        return {}
    one = lambda c: df.select(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")).where("v is not null").orderBy(F.xxhash64("v"), "v").limit(SAMPLE)
    sample = reduce(DataFrame.unionByName, map(one, columns))
    found = {r["c"]: r for r in sample.groupBy("c").agg(*[F.count(parsed(F.col("v"), p)).alias(f"f{k}") for k, p in enumerate(FORMATS)]).collect()}
    best = {c: max(range(len(FORMATS)), key=lambda k: (r[f"f{k}"], -k)) for c, r in found.items()}
    return {c: FORMATS[best[c]] if c in found and found[c][f"f{best[c]}"] else None for c in columns}


def strict_date(df: DataFrame, column: str) -> DataFrame:
    """A text column as timestamps; a value that its format does not read is an error of the job that meets it."""
    pattern = format_of(df, [column])[column]
    c = F.col(f"`{column}`")
    if pattern is None:
        if df.where(c.isNotNull()).take(1):
            raise BadDate(f"{column} has no values that are dates")
        return df.withColumn(column, c.cast("timestamp_ntz"))
    bad = F.raise_error(F.concat(F.lit(f"{column} is no date: "), c)).cast("timestamp_ntz")
    return df.withColumn(column, F.when(c.isNotNull(), F.coalesce(parsed(c, pattern), bad)))


def clean_dates(df: DataFrame, columns: list[str], least: float = 0.5) -> DataFrame:
    """Text columns become timestamps where more than `least` of all rows parse; others stay as they are."""
    kinds = dict(df.dtypes)
    texts = [c for c in columns if kinds.get(c) == "string"]
    patterns = {c: p for c, p in format_of(df, texts).items() if p}
    if not patterns:
        return df
    shares = df.agg(*[F.try_divide(F.count(parsed(F.col(f"`{c}`"), p)).cast("double"), F.count(F.lit(1)).cast("double")).alias(c) for c, p in patterns.items()]).first()
    return df.withColumns({c: parsed(F.col(f"`{c}`"), p) for c, p in patterns.items() if (shares[c] or 0) > least})
