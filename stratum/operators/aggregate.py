"""Daily, adaptive, global and monthly summaries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import SUMMARY_EMPTY, SUMMARY_NAMES
from ..functions.dates import clean_dates
from ..functions.numbers import number_text, ratio, round_half_even
from ..schema import RuntimeSchema

MOST_METRICS, FALLBACK_METRICS, MOST_CATEGORIES = 15, 10, 100


def daily_sales(detail: DataFrame, date: Column | str = "stat_date") -> DataFrame:
    """stat_date, distinct orders and customers, amount, and amount by order; rows without date do not count."""
    date = F.col(date) if isinstance(date, str) else date
    rows = detail.select(date.cast("date").alias("stat_date"), "invoice_no", "customer_id", "order_amount").where("stat_date is not null")
    by = rows.groupBy("stat_date").agg(
        F.countDistinct("invoice_no").alias("daily_order_count"),
        F.countDistinct("customer_id").alias("daily_customer_count"),
        F.coalesce(F.sum("order_amount"), F.lit(0)).alias("amount"),
    )
    average = F.when(F.col("daily_order_count") > 0, ratio(F.col("amount"), F.col("daily_order_count"))).otherwise(0.0)
    return by.select("stat_date", "daily_order_count", "daily_customer_count", F.col("amount").alias("daily_sales_amount"), round_half_even(average).alias("daily_avg_order_amount"))


@dataclass
class Adaptive:
    """An adaptive summary: the rows, the columns used, and a note where nothing could be summed."""

    result: DataFrame
    date: str | None
    metrics: list[str]
    note: str | None = None


def metric_columns(df: DataFrame, schema: RuntimeSchema) -> list[str]:
    """Numeric role without ids; else the first numeric roles; else any numeric type without ids. At most MOST_METRICS."""
    ids, kinds = set(schema.id_columns), {f.name: f.dataType for f in df.schema}
    there = [c for c in schema.numeric_columns if c in kinds]
    found = [c for c in there if c not in ids] or there[:FALLBACK_METRICS] or [c for c, k in kinds.items() if isinstance(k, T.NumericType) and c not in ids]
    return found[:MOST_METRICS]


def adaptive(df: DataFrame, schema: RuntimeSchema, metrics: list[str] | None = None, date: str | None = None, categories: bool = False, cardinality: dict[str, int] | None = None) -> Adaptive:
    """Sum and mean of the metrics by day of the first date column (a missing date is a group of its own), or over all rows without one.

    Text metrics are read as numbers first; the mean of decimals is their sum, as a double, by their number. categories adds distinct counts of categorical columns
    of at most MOST_CATEGORIES values, as given in cardinality or else in the schema; of unknown ones none is counted.
    """
    date = date or next((c for c in schema.date_columns if c in df.columns), None)
    metrics = (metrics or metric_columns(df, schema))[:MOST_METRICS]
    kinds = dict(df.dtypes)
    numbers = {c: number_text(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`") for c in metrics}
    mean = lambda c, n: ratio(F.sum(n), F.count(n)) if kinds[c].startswith("decimal") else F.avg(n)
    aggregates = [x for c, n in numbers.items() for x in (F.coalesce(F.sum(n), F.lit(0)).alias(f"{c}_sum"), mean(c, n).alias(f"{c}_avg"))]
    if categories:
        known = schema.cardinality | (cardinality or {})
        few = [c for c in schema.categorical_columns if c in df.columns and known.get(c, MOST_CATEGORIES + 1) <= MOST_CATEGORIES][:10]
        aggregates += [F.countDistinct(F.col(f"`{c}`")).alias(f"{c}_distinct") for c in few]
    if not aggregates:
        return Adaptive(df.limit(0).withColumn("_info", F.lit("no metric")), date, [], "no metric")
    if date is None:
        return Adaptive(_rounded(df.agg(*aggregates)), None, metrics)
    if kinds[date] == "string":
        df = clean_dates(df, [date], 0.0)
    return Adaptive(_rounded(df.groupBy(F.col(f"`{date}`").cast("date").alias("_stat_date")).agg(*aggregates)), date, metrics)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places, half to even."""
    return df.select(*[round_half_even(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def adaptive_summary(found: Adaptive) -> dict[str, Any]:
    """Days, metrics and rows of an adaptive summary."""
    if found.note:
        return {"message": found.note}
    days = F.countDistinct("_stat_date") if found.date else F.lit(0)
    row = found.result.agg(days.alias("days"), F.count(F.lit(1)).alias("rows")).first()
    return {"days": row["days"], "metrics": [f"{m}_sum" for m in found.metrics], "rows": row["rows"]}


def adaptive_figures(found: Adaptive) -> DataFrame:
    """first_date and last_date (null without a date column), days (rows of the summary) and metrics (its sums and means), one row."""
    days = F.col("_stat_date") if found.date else F.lit(None).cast("date")
    metrics = sum(c.endswith(("_sum", "_avg")) for c in found.result.columns)
    return found.result.agg(F.min(days).alias("first_date"), F.max(days).alias("last_date"), F.count(F.lit(1)).alias("days"), F.lit(metrics).alias("metrics"))


def monthly_rollup(daily: DataFrame, date: str, metric: str) -> DataFrame:
    """month (yyyy-MM) and the metric's sum."""
    return daily.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(metric).alias(metric))


def peak_and_trough(monthly: DataFrame, metric: str) -> DataFrame:
    """Months of the largest and the smallest sum; the earlier one of equals."""
    first = lambda order: F.min_by("month", F.struct(order, F.col("month")))
    return monthly.agg(first(-F.col(metric)).alias("peak_month"), first(F.col(metric)).alias("trough_month"))


def grand_totals(daily: DataFrame) -> DataFrame:
    """One row over the daily table. Customers are a sum of daily counts."""
    sales, orders = F.col("daily_sales_amount"), F.col("daily_order_count")
    one = daily.agg(F.count(F.lit(1)).alias("days"), F.sum(sales).alias("sales"), F.sum(orders).alias("orders"), F.sum("daily_customer_count").alias("customers"), F.max(sales).alias("most_sales"), F.max(orders).alias("most_orders"))
    return one.withColumn("mean_sales", ratio(F.col("sales"), F.col("days"))).withColumn("order_value", ratio(F.col("sales"), F.col("orders"), 0.0))


def summary(daily: DataFrame) -> dict[str, Any]:
    """The grand totals under their report names, rounded; a message for an empty table."""
    row = grand_totals(daily).first()
    if not row["days"]:
        return {"message": SUMMARY_EMPTY}
    whole = ("days", "orders", "customers", "most_orders")
    return {name: int(row[k]) if k in whole else round(float(row[k]), 2) for k, name in SUMMARY_NAMES.items()}


def sentinels(df: DataFrame, columns: list[str], values: tuple[int, ...]) -> DataFrame:
    """column_name and the number of rows that hold a value used as a stand-in for missing."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isin(*values)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("hits")) for c in columns])).alias("x")).select("x.*")
