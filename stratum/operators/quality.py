"""Data quality in one aggregation over the table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import NULL_RATE_THRESHOLD, QUALITY_CRITICAL, QUALITY_RATES
from ..functions.numbers import ratio
from ..schema import RuntimeSchema


def null_count(c: str) -> Column:
    return F.count_if(F.col(f"`{c}`").isNull())


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """total and <column>_nulls, one row."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[null_count(c).alias(f"{c}_nulls") for c in columns])


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """total, distinct keys and their difference, in which rows without key count as duplicates."""
    found = df.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.col(f"`{key}`")).alias("unique_keys"))
    return found.withColumn("duplicate_rows", F.col("total") - F.col("unique_keys"))


def abnormal_amounts(df: DataFrame, price: str = "unit_price", quantity: str = "quantity") -> DataFrame:
    p, q = F.col(price), F.col(quantity)
    return df.agg(F.count_if(p < 0).alias("negative_price"), F.count_if(p == 0).alias("zero_price"), F.count_if(q < 0).alias("negative_quantity"), F.count_if(q == 0).alias("zero_quantity"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, nulls and null_rate of each column; the rate of an empty table is null."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[null_count(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in columns]))
    return one.select("total", pairs.alias("x")).select("x.column_name", "x.nulls", ratio(F.col("x.nulls"), F.col("total")).alias("null_rate"))


def stale_days(df: DataFrame, date: str, now: Column) -> DataFrame:
    """Newest value of a date column and its age in days."""
    return df.agg(F.max(F.col(date)).alias("newest")).withColumn("age_days", F.datediff(now, F.col("newest")))


def outliers(df: DataFrame, columns: list[str], deviations: float = 3.0) -> DataFrame:
    """column_name and the number of values further from the mean than that many standard deviations. Two jobs, for any number of columns."""
    c = lambda x: F.col(f"`{x}`").cast("double")
    row = df.agg(*[f(c(x)).alias(f"{n}{i}") for i, x in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    far = [F.count_if(F.abs(c(x) - F.lit(row[f"m{i}"])) > F.lit(row[f"s{i}"]) * deviations).alias(x) for i, x in enumerate(columns)]
    one = df.agg(*far)
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(f"`{x}`").alias("outliers")) for x in columns])).alias("x")).select("x.*")


def fences(df: DataFrame, columns: list[str], reach: float = 1.5, accuracy: int = 100_000) -> DataFrame:
    """column_name, low and high of each column: its quartiles, moved out by reach times what lies between them.

    Quartiles come from mergeable quantile summaries of bounded size, whose rank is off by at most rows / accuracy. One job.
    """
    quartiles = [F.percentile_approx(F.col(f"`{c}`").cast("double"), [0.25, 0.75], accuracy).alias(f"q{i}") for i, c in enumerate(columns)]
    low, high = F.col("x.q")[0], F.col("x.q")[1]
    rows = df.agg(*quartiles).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"q{i}").alias("q")) for i, c in enumerate(columns)])).alias("x"))
    return rows.select("x.column_name", (low - reach * (high - low)).alias("low"), (high + reach * (high - low)).alias("high"))


def quantile_outliers(df: DataFrame, columns: list[str], reach: float = 1.5, accuracy: int = 100_000) -> DataFrame:
    """column_name, low, high and the number of values beyond these. Unlike a standard deviation, quartiles are not moved by one extreme value, which then hides others."""
    found = {r["column_name"]: r for r in fences(df, columns, reach, accuracy).collect()}  # a row a column
    c = lambda x: F.col(f"`{x}`").cast("double")
    one = df.agg(*[F.count_if((c(x) < F.lit(found[x]["low"])) | (c(x) > F.lit(found[x]["high"]))).alias(f"o{i}") for i, x in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), F.lit(found[x]["low"]).cast("double").alias("low"), F.lit(found[x]["high"]).cast("double").alias("high"), F.col(f"o{i}").alias("outliers")) for i, x in enumerate(columns)]))
    return one.select(rows.alias("x")).select("x.*")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and the number of rows for which its condition, over any columns, is false; a missing value breaks no rule. One job."""
    one = df.agg(*[F.count_if(~r).alias(f"r{i}") for i, r in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])).alias("x")).select("x.*")


def figures(critical: list[str], rates: list[str], price: str | None = None, quantity: str | None = None) -> dict[str, Column]:
    """The figures of a check that need no distinct values, by name: plain sums, which can be observed while rows are written."""
    out = {"total": F.count(F.lit(1))} | {f"{c}_nulls": null_count(c) for c in dict.fromkeys([*critical, *rates])}
    for name, column in (("price", price), ("quantity", quantity)):
        if column:
            out |= {f"negative_{name}": F.count_if(F.col(column) < 0), f"zero_{name}": F.count_if(F.col(column) == 0)}
    return out


def judged(seen: dict[str, int], critical: list[str], rates: list[str], threshold: float = NULL_RATE_THRESHOLD) -> dict[str, Any]:
    """Observed figures with warnings and status, as check() gives them."""
    warnings = [c for c in rates if seen["total"] and seen[f"{c}_nulls"] / seen["total"] > threshold]
    broken = any(seen[f"{c}_nulls"] for c in critical)
    return seen | {"warnings": warnings, "status": "failed" if not seen["total"] else "warning" if broken else "passed"}


def check(df: DataFrame, critical: list[str], rates: list[str], key: str | None = None, price: str | None = None, quantity: str | None = None, threshold: float = NULL_RATE_THRESHOLD) -> DataFrame:
    """All figures and the status, as one row of one job.

    status: failed for an empty table, warning where a critical column has nulls, else passed. warnings
    holds the columns whose null rate is strictly above the threshold; they do not change the status.
    """
    wanted = figures(critical, rates, price, quantity) | ({"unique_keys": F.countDistinct(F.col(f"`{key}`"))} if key else {})
    one = df.agg(*[c.alias(n) for n, c in wanted.items()])
    if key:
        one = one.withColumn("duplicate_rows", F.col("total") - F.col("unique_keys"))
    broken = F.lit(False)
    for c in critical:
        broken = broken | (F.col(f"`{c}_nulls`") > 0)
    high = F.array_compact(F.array(*[F.when(ratio(F.col(f"`{c}_nulls`"), F.col("total")) > threshold, F.lit(c)) for c in rates])) if rates else F.array().cast("array<string>")
    return one.withColumn("warnings", high).withColumn("status", F.when(F.col("total") == 0, "failed").when(broken, "warning").otherwise("passed"))


def classic_figures() -> dict[str, Column]:
    return figures(list(QUALITY_CRITICAL), list(QUALITY_RATES), "unit_price", "quantity")


def classic_judged(seen: dict[str, int], threshold: float = NULL_RATE_THRESHOLD) -> dict[str, Any]:
    return judged({n: seen[n] for n in classic_figures()}, list(QUALITY_CRITICAL), list(QUALITY_RATES), threshold)


def classic_check(df: DataFrame, threshold: float = NULL_RATE_THRESHOLD) -> DataFrame:
    return check(df, list(QUALITY_CRITICAL), list(QUALITY_RATES), "invoice_no", "unit_price", "quantity", threshold)


def schema_check(df: DataFrame, schema: RuntimeSchema) -> DataFrame:
    """The same check, on the columns that a runtime schema names."""
    there = lambda columns: [c for c in columns if c in df.columns]
    ids = there(schema.id_columns)
    return check(df, there(schema.quality_critical_nulls), there(schema.quality_null_rate_columns), ids[0] if ids else None, threshold=schema.threshold())


def verdict(row: Any) -> dict[str, Any]:
    """The one row of a check as a dict."""
    return row.asDict(recursive=True)
