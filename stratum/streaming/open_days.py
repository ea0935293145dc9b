"""Days of a stream as they stand: totals are put out with each micro-batch, and once more when a day is over."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import ship_package
from .intake import append_files, once

#: Amounts are summed as whole numbers of this many decimal places.
PLACES = 4
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "stat_date date, shard int, units decimal(38,0), rows long, closed boolean"


class Totals(StatefulProcessor):
    """A shard of a day: sum and number of its rows. The state is two numbers, whatever the rows; a timer at the day's end puts it out as closed and drops it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "units decimal(38,0), rows long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.totals.get()
        if held is None:
            self.handle.registerTimer(key[1])
        units, n = (int(held[0]), held[1]) if held else (0, 0)
        for part in rows:
            units, n = units + int(part["units"].sum()), n + len(part)
        self.totals.update((Decimal(units), n))
        yield self._row(key, units, n, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        units, n = self.totals.get()
        self.totals.clear()
        yield self._row(key, int(units), n, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: Any, units: int, n: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"stat_date": [key[0]], "shard": [key[2]], "units": [Decimal(units)], "rows": [n], "closed": [closed]})


def open_days(rows: DataFrame, keys: list[str], time: str, amount: str, late: str = "1 day", shards: int = 8) -> DataFrame:
    """stat_date, shard, amount, rows, closed: each shard's total so far in each micro-batch that has rows of it, and its last one once the watermark has passed the day.

    Repeats of a key within the time that rows may be late count once; rows of closed days are left out (Spark
    holds rows against the watermark of the batch before, so the batch that closes a day may still add to it). A day's rows are dealt to shards by their
    keys, so a busy day is not one task's. Missing amounts add nothing, but their rows count; rows without time are left out.
    """
    ship_package(rows.sparkSession, batches=False)
    units = F.coalesce((F.col(amount).cast(f"decimal(18,{PLACES})") * 10**PLACES).cast("long"), F.lit(0))
    day = F.col(time).cast("date")
    known = once(rows.where(F.col(time).isNotNull()), keys, time, late)
    # days begin and end in the session's time zone
    dealt = known.select(time, day.alias("stat_date"), F.unix_millis(F.date_add(day, 1).cast("timestamp")).alias("ends"), F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int").alias("shard"), units.alias("units"))
    totals = dealt.groupBy("stat_date", "ends", "shard").transformWithStateInPandas(Totals(), _OUT, "Append", "EventTime")
    return totals.select("stat_date", "shard", (F.col("units").cast("decimal(32,0)") / F.lit(10**PLACES)).cast(f"decimal(32,{PLACES})").alias("amount"), "rows", "closed")


def follow(days: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """What open_days puts out, as Parquet files. Its state needs the RocksDB store, which the query takes with it; the session's own setting stays."""
    conf = days.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        return append_files(days, out, checkpoint)
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)


def latest(days: DataFrame) -> DataFrame:
    """stat_date, amount, rows and closed of each day as it stands, from all that was put out: a shard's last total has the most rows. A day is closed when all its shards are."""
    last = F.max_by(F.struct("amount", "rows", "closed"), F.struct("rows", "closed")).alias("x")
    shards = days.groupBy("stat_date", "shard").agg(last).select("stat_date", "x.*")
    return shards.groupBy("stat_date").agg(F.sum("amount").alias("amount"), F.sum("rows").alias("rows"), F.bool_and("closed").alias("closed"))
