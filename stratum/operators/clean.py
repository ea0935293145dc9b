"""Clean with quarantine: rows go to a clean and a rejected set, each rejection with its reason.

Two semantics: first match (fixed rules in order, one reason a row) and all matches (configured rules,
one rejected row for each reason that applies). Either is one projection that tags rows; both outputs
are filters of it; the steps write the tagged rows once and split what they wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import REASON_CANCELLED, REASON_NO_CUSTOMER, REASON_PRICE, REASON_QUANTITY
from ..functions.arithmetic import UnsafeExpression, compile_expression
from ..functions.numbers import plain_text, without_nan
from ..schema import RuntimeSchema

REASON, REASONS = "rejected_reason", "rejected_reasons"


class RuleError(ValueError):
    """A rule does not fit its column's type."""


@dataclass(frozen=True)
class Rule:
    """A reason, and the Column that is true (never null) for the rows it rejects."""

    reason: str
    rejects: Column


def never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def first_match(df: DataFrame) -> DataFrame:
    """df with rejected_reason, of the first fixed rule a row breaks, and `outcome`: clean, rejected, or lost for a row with a missing amount that no rule names."""
    q, p = F.col("quantity"), F.col("unit_price")
    reason = (
        F.when(never_null(F.col("invoice_no").startswith("C")), REASON_CANCELLED)
        .when(F.col("customer_id").isNull(), REASON_NO_CUSTOMER)
        .when(q <= 0, REASON_QUANTITY)
        .when(q.isNotNull() & (p <= 0), REASON_PRICE)
    )
    tagged = df.withColumn(REASON, reason)
    outcome = F.when(F.col(REASON).isNotNull(), "rejected").when(never_null((q > 0) & (p > 0)), "clean").otherwise("lost")
    return tagged.withColumn("outcome", outcome)


def order_amount() -> Column:
    return (F.col("quantity") * F.col("unit_price")).cast("decimal(12,4)")


def clean_first_match(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean with order_amount, rejected with its reason, lost rows)."""
    return split_first(first_match(df))


def split_first(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three outcomes of first_match(); a step writes the tagged rows once and splits those."""
    part = lambda name: tagged.where(F.col("outcome") == name).drop("outcome")
    return part("clean").drop(REASON).withColumn("order_amount", order_amount()), part("rejected"), part("lost").drop(REASON)


_NEGATED = {"gt": "<=", "gte": "<", "lt": ">=", "lte": ">", "eq": "!=", "neq": "=="}


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def validation(column: str, op: str, value: object, kind: T.DataType) -> Column | None:
    """The rows that do not satisfy `column op value`. Missing values break `eq` alone; an unknown operator is no rule."""
    if op not in _NEGATED:
        return None
    c = F.col(f"`{column}`")
    fits = _is_number(kind) == (isinstance(value, (int, float)) and not isinstance(value, bool))
    if op == "eq":
        return ~c.eqNullSafe(F.lit(value)) if fits else F.lit(True)
    if op == "neq":
        return never_null(c == F.lit(value)) if fits else F.lit(False)
    if not fits:
        raise RuleError(f"{column} {op} {value!r}: the column is {kind.simpleString()}")
    limit = F.lit(value)
    return never_null({"gt": c <= limit, "gte": c < limit, "lt": c >= limit, "lte": c > limit}[op])


def cancellation(column: str, method: str, value: object, kind: T.DataType) -> Column | None:
    """The rows that a cancel rule names; an unknown method names none."""
    text = plain_text(F.col(f"`{column}`"), kind.simpleString())
    if method == "string_startswith":
        return never_null(text.startswith(str(value)))
    if method == "string_equals":
        return never_null(F.lower(text) == F.lower(F.lit(str(value))))
    if method == "column_equals":
        same = isinstance(value, bool) if isinstance(kind, T.BooleanType) else isinstance(value, (int, float)) if _is_number(kind) else isinstance(value, str)
        return never_null(F.col(f"`{column}`") == F.lit(value)) if same else F.lit(False)
    return None


def compile_rules(schema: RuntimeSchema, types: T.StructType) -> list[Rule]:
    """Rules in the order cancel, required, validations; rules on columns that are not there are skipped."""
    kinds = {f.name: f.dataType for f in types}
    rules: list[Rule] = []
    for r in schema.cancel_rules:
        if (c := r.get("column")) in kinds and (hit := cancellation(c, r.get("method", ""), r.get("value"), kinds[c])) is not None:
            rules.append(Rule(r.get("reason") or f"取消: {r.get('method')}", hit))
    for r in schema.required_columns:
        r = {"column": r} if isinstance(r, str) else r
        if (c := r.get("column")) in kinds:
            rules.append(Rule(r.get("reason") or f"{c} 为空", F.col(f"`{c}`").isNull()))
    for r in schema.validations:
        op, value = r.get("operator", "gt"), r.get("value", 0)
        if (c := r.get("column")) in kinds and (hit := validation(c, op, value, kinds[c])) is not None:
            rules.append(Rule(r.get("reason") or f"{c} {r.get('operator')} {value}", hit))
    return rules


def all_matches(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with rejected_reasons, the array of reasons that apply, in the order of the rules. NaN is missing."""
    df = without_nan(df)
    if not rules:
        return df.withColumn(REASONS, F.array().cast("array<string>"))
    return df.withColumn(REASONS, F.array_compact(F.array(*[F.when(r.rejects, F.lit(r.reason)) for r in rules])))


def with_computed(df: DataFrame, schema: RuntimeSchema, warn=lambda message: None) -> DataFrame:
    """Configured columns in order; later ones may use earlier ones; one that cannot be compiled is skipped with a warning."""
    for c in schema.computed_columns:
        try:
            df = df.withColumn(c["name"], compile_expression(str(c.get("expression", "")), df.columns))
        except UnsafeExpression as e:
            warn(f"{c.get('name')}: {e}")
    return df


def clean_all_matches(df: DataFrame, schema: RuntimeSchema, warn=lambda message: None) -> tuple[DataFrame, DataFrame]:
    """(clean with computed columns, rejected with one row for each reason)."""
    return split_all(all_matches(df, compile_rules(schema, df.schema)), schema, warn)


def split_all(tagged: DataFrame, schema: RuntimeSchema, warn=lambda message: None) -> tuple[DataFrame, DataFrame]:
    """Both outcomes of all_matches()."""
    clean = tagged.where(F.size(REASONS) == 0).drop(REASONS)
    rejected = tagged.where(F.size(REASONS) > 0).withColumn(REASON, F.explode(REASONS)).drop(REASONS)
    return with_computed(clean, schema, warn), rejected
