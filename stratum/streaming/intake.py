"""Incremental intake as a stream: the same rules and writes, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import daily_sales
from ..operators.clean import clean_all_matches
from ..schema import RuntimeSchema
from ..sources.warehouse import Layout, Warehouse


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come; files: at most so many in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def clean_stream(rows: DataFrame, store: Warehouse, schema: RuntimeSchema, checkpoint: str, detail: str = "dwd_orders", rejected: str = "rejected_orders") -> StreamingQuery:
    """Each micro-batch is cleaned by all rules into its own partition of the detail and the rejected table, so a batch that is repeated, or was cut off, replaces itself."""
    for table in (detail, rejected):
        store.layouts.setdefault(table, Layout(parts=("_batch",)))

    def take(batch: DataFrame, number: int) -> None:
        good, bad = clean_all_matches(batch, schema)
        for table, df in ((detail, good), (rejected, bad)):
            store.replace_parts(table, df.withColumn("_batch", F.lit(number).cast("long")))

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_stream(rows: DataFrame, store: Warehouse, date: str, checkpoint: str, detail: str = "dwd_orders", table: str = "dws_sales_daily") -> StreamingQuery:
    """Days met in a micro-batch are summed anew from the detail table and upserted, so late rows count."""

    def take(batch: DataFrame, number: int) -> None:
        days = batch.select(F.col(date).cast("date").alias("stat_date")).distinct()
        known = store.read(detail).withColumn("stat_date", F.col(date).cast("date"))
        store.upsert(table, daily_sales(known.join(days, "stat_date", "left_semi")), "stat_date")

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Rows whose keys have not been met within the time that rows may be late: a file that comes twice, or a line in two files, counts once.

    Keys are state; it is dropped when the watermark has passed, so it grows with the rows of that time alone.
    """
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def daily_windows(rows: DataFrame, keys: list[str], time: str, amount: str, late: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """Amounts by day, each keyed row once. A day is put out when the watermark has passed its end, and does not change after; later rows are left out."""
    by = by or []
    days = once(rows, keys, time, late).groupBy(F.window(time, "1 day").alias("w"), *by)
    return days.agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("rows")).select(F.col("w.start").cast("date").alias("stat_date"), *by, "amount", "rows")


def append_files(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """What a stream puts out as Parquet files, each batch once, whatever is run again."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(rows: DataFrame, time: str, amount: str, late: str = "1 hour", window: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """Amounts by event-time window (and keys) with a watermark; rows later than that are left out by the stream."""
    keys = keys or []
    by = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("rows"))
    return by.select(*keys, "w.start", "w.end", "amount", "rows")
