"""Keyed and ranged writes as transforms of the old table and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A batch holds a key more than once."""


def upsert(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch, and the old rows whose key it does not have. Keys that vanished stay."""
    return old.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def assert_unique(batch: DataFrame, key: str) -> None:
    twice = batch.groupBy(key).count().where("count > 1").take(1)
    if twice:
        raise DuplicateKeys(f"{key} = {twice[0][key]}")


def span(batch: DataFrame, date: str) -> tuple[object, object]:
    """The smallest and the largest date of the batch, null without any."""
    row = batch.agg(F.min(date).alias("low"), F.max(date).alias("high")).first()
    return row["low"], row["high"]


def outside(date: str, low: object, high: object) -> Column:
    """Rows not in the span, both ends included; rows without date are outside. Literals, so that scans get the bound as a pushed filter."""
    if low is None:
        return F.lit(True)
    return F.col(date).isNull() | (F.col(date) < F.lit(low)) | (F.col(date) > F.lit(high))


def replace_range(old: DataFrame, batch: DataFrame, date: str) -> DataFrame:
    """Old rows outside the batch's span of dates, or without date; and the batch. The span is worked out first."""
    return old.where(outside(date, *span(batch, date))).unionByName(batch, allowMissingColumns=True)


def latest_runs(events: DataFrame, key: str = "run_id", at: str = "at") -> DataFrame:
    """The last event of each run."""
    newest = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.col(at))
    return events.groupBy(key).agg(newest.alias("__e")).select(key, "__e.*")
