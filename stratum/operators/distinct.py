"""Distinct counts that are kept by day and merged over any span of days.

Exact ones are bitmaps of whole numbers, in buckets of 32,768 numbers each; estimated ones are sketches of values of any
kind. Either is worked out once for each day; a month, or any other span, is their union, without reading a row again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_bitmaps(df: DataFrame, day: Column, number: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """day, bucket and bits: a bit for each number that a day has. Rows without day or number do not count."""
    rows = df.select(day.cast("date").alias("day"), *by, number.cast("long").alias("n")).where("day is not null and n is not null")
    return rows.groupBy("day", *by, F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def merged_count(bitmaps: DataFrame, span: Column, by: tuple[str, ...] = (), name: str = "numbers") -> DataFrame:
    """span and the number of different numbers of its days. Two small aggregations: bits of a bucket are joined, then counted."""
    merged = bitmaps.groupBy(span.alias("span"), *by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("span", *by).agg(F.sum(F.bitmap_count("bits")).cast("long").alias(name))


def daily_sketches(df: DataFrame, day: Column, value: Column, precision: int = 14, by: tuple[str, ...] = ()) -> DataFrame:
    """day and a sketch of a day's values, of at most 2^precision bytes or so."""
    rows = df.select(day.cast("date").alias("day"), *by, value.alias("v")).where("day is not null and v is not null")
    return rows.groupBy("day", *by).agg(F.hll_sketch_agg("v", F.lit(precision)).alias("sketch"))


def merged_estimate(sketches: DataFrame, span: Column, by: tuple[str, ...] = (), name: str = "values") -> DataFrame:
    return sketches.groupBy(span.alias("span"), *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
