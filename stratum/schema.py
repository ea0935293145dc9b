"""Schemas: the warehouse's tables, and the runtime schema that profiling, YAML files and caches give."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import NULL_RATE_THRESHOLD
from .sources.warehouse import Layout

_ODS = [
    ("invoice_no", T.StringType()),
    ("stock_code", T.StringType()),
    ("description", T.StringType()),
    ("quantity", T.IntegerType()),
    ("invoice_date", T.TimestampNTZType()),
    ("unit_price", T.DecimalType(10, 4)),
    ("customer_id", T.StringType()),
    ("country", T.StringType()),
]


def _struct(columns: list[tuple[str, T.DataType]], required: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in columns])


ODS = _struct(_ODS)
#: Rejected rows of all runs, whatever columns they have.
REJECTED = _struct([("rejected_reason", T.StringType()), ("rejected_at", T.TimestampNTZType()), ("rejected_row", T.VariantType()), ("run_id", T.StringType())], ("rejected_reason", "rejected_at", "run_id"))
DWD = _struct([*_ODS, ("order_amount", T.DecimalType(12, 4)), ("etl_time", T.TimestampNTZType())], tuple(n for n, _ in _ODS if n != "description") + ("order_amount", "etl_time"))
DWS = _struct(
    [("stat_date", T.DateType()), ("daily_order_count", T.LongType()), ("daily_customer_count", T.LongType()), ("daily_sales_amount", T.DecimalType(18, 4)), ("daily_avg_order_amount", T.DecimalType(18, 4)), ("etl_time", T.TimestampNTZType())],
    ("stat_date",),
)
RUN_LOG = _struct(
    [("run_id", T.StringType()), ("task_name", T.StringType()), ("status", T.StringType()), ("at", T.TimestampNTZType()), ("duration", T.DecimalType(10, 2)), ("error_message", T.StringType())],
    ("run_id", "task_name", "status", "at"),
)
MARKS = _struct([("name", T.StringType()), ("at", T.TimestampNTZType())], ("name", "at"))
#: The date column of tables that are partitioned by it.
DATED = {"ods_orders": "invoice_date", "dwd_orders": "invoice_date"}
#: The archive has a partition a run; the detail's rows lie by customer and are found by invoice.
LAYOUTS = {"rejected_orders": Layout(parts=("run_id",)), "dwd_orders": Layout(bucketed="customer_id", bloom=("invoice_no",))}
TABLES = {"ods_orders": ODS, "dwd_orders": DWD, "rejected_orders": REJECTED, "dws_sales_daily": DWS, "etl_task_logs": RUN_LOG}


@dataclass
class RuntimeSchema:
    """What a run knows of its columns: roles, names, types and rules."""

    date_columns: list[str] = field(default_factory=list)
    numeric_columns: list[str] = field(default_factory=list)
    categorical_columns: list[str] = field(default_factory=list)
    id_columns: list[str] = field(default_factory=list)
    bool_columns: list[str] = field(default_factory=list)
    drop_columns: list[str] = field(default_factory=list)
    source_mapping: dict[str, str] = field(default_factory=dict)
    dtypes: dict[str, dict[str, Any]] = field(default_factory=dict)
    cancel_rules: list[dict[str, Any]] = field(default_factory=list)
    required_columns: list[dict[str, Any]] = field(default_factory=list)
    validations: list[dict[str, Any]] = field(default_factory=list)
    computed_columns: list[dict[str, Any]] = field(default_factory=list)
    quality_critical_nulls: list[str] = field(default_factory=list)
    quality_null_rate_columns: list[str] = field(default_factory=list)
    quality_null_threshold: float | None = None
    csv_encodings: list[str] = field(default_factory=list)
    dtype_overrides: dict[str, str] = field(default_factory=dict)
    #: Distinct values of the categorical columns, as profiled.
    cardinality: dict[str, int] = field(default_factory=dict)

    def roles(self) -> dict[str, str]:
        """The role of each column."""
        return {c: role for role in ("date", "numeric", "categorical", "id", "bool", "drop") for c in getattr(self, f"{role}_columns")}

    def threshold(self) -> float:
        """YAML first, then the environment, then the fixed default."""
        if self.quality_null_threshold is not None:
            return self.quality_null_threshold
        return float(os.environ.get("QUALITY_NULL_THRESHOLD", NULL_RATE_THRESHOLD))


def load_yaml(path: str) -> dict[str, Any] | None:
    """The raw mapping of a YAML file; None for a missing or empty file. No file is looked for by itself."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def from_yaml(raw: dict[str, Any] | None) -> RuntimeSchema:
    raw = raw or {}
    part = lambda k: raw.get(k) or {}
    cleaning, quality, csv = part("cleaning"), part("quality"), part("csv_read")
    return RuntimeSchema(
        source_mapping=dict(part("source_column_mapping")),
        dtypes={c: dict(t) for c, t in part("column_dtypes").items()},
        cancel_rules=list(cleaning.get("cancel_rules") or []),
        required_columns=list(cleaning.get("required_columns") or []),
        validations=list(cleaning.get("validations") or []),
        computed_columns=list(cleaning.get("computed_columns") or []),
        quality_critical_nulls=list(quality.get("critical_null_columns") or []),
        quality_null_rate_columns=list(quality.get("null_rate_columns") or []),
        quality_null_threshold=quality.get("null_rate_threshold"),
        csv_encodings=list(csv.get("encodings") or []),
        dtype_overrides=dict(csv.get("dtype_overrides") or {}),
    )


def merge(declared: RuntimeSchema, inferred: RuntimeSchema) -> RuntimeSchema:
    """Roles come from inference; everything else that the declared schema gives wins over it."""
    out = RuntimeSchema(**asdict(inferred))
    for f in fields(RuntimeSchema):
        if f.name.endswith("_columns") and f.name.split("_")[0] in ("date", "numeric", "categorical", "id", "bool", "drop"):
            continue
        given = getattr(declared, f.name)
        if given or (f.name == "quality_null_threshold" and given is not None):
            setattr(out, f.name, given)
    return out


def save_cache(schema: RuntimeSchema, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(schema), f, ensure_ascii=False, indent=2)


def load_cache(path: str) -> RuntimeSchema | None:
    if not os.path.exists(path):
        return None
    known = {f.name for f in fields(RuntimeSchema)}
    with open(path, encoding="utf-8") as f:
        return RuntimeSchema(**{k: v for k, v in json.load(f).items() if k in known})


def spark_type(declared: dict[str, Any]) -> T.DataType:
    """The Spark type of a declared column type such as {type: Numeric, precision: 10, scale: 4}."""
    kind = str(declared.get("type", "String")).lower()
    if kind == "numeric":
        return T.DecimalType(int(declared.get("precision", 38)), int(declared.get("scale", 4)))
    return {"integer": T.IntegerType(), "biginteger": T.LongType(), "float": T.DoubleType(), "datetime": T.TimestampNTZType(), "date": T.DateType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def typed(df: DataFrame, declared: dict[str, dict[str, Any]]) -> DataFrame:
    """df with the declared types; a value that does not fit is missing."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(spark_type(t)) for c, t in declared.items() if c in df.columns})
