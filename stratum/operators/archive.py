"""Rejected rows of any shape in one table: each row as a VARIANT, with its reason and the run that rejected it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASON, ROW, RUN = "rejected_reason", "rejected_row", "run_id"


def to_archive(rejected: DataFrame, run_id: str, now: datetime) -> DataFrame:
    """rejected_reason, rejected_at, rejected_row (all other columns, with their types) and run_id."""
    others = [F.col(f"`{c}`") for c in rejected.columns if c != REASON]
    return rejected.select(REASON, F.lit(now).cast("timestamp_ntz").alias("rejected_at"), F.to_variant_object(F.struct(*others)).alias(ROW), F.lit(run_id).alias(RUN))


def field(name: str, kind: str | T.DataType, row: str = ROW) -> Column:
    """A column of the archived row; null where the row had none, or one that the type cannot hold."""
    kind = kind if isinstance(kind, str) else kind.simpleString()
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(row, f"$['{quoted}']", kind).alias(name)


def unfolded(archive: DataFrame, columns: dict[str, str | T.DataType] | T.StructType) -> DataFrame:
    """Archived rows with named columns again. The scan reads those of the runs that a filter on run_id leaves."""
    if isinstance(columns, T.StructType):
        columns = {f.name: f.dataType for f in columns}
    return archive.select(RUN, REASON, *[field(c, k) for c, k in columns.items()])


def shapes(archive: DataFrame) -> DataFrame:
    """run_id, rows, and the schema that holds all archived rows of the run."""
    return archive.groupBy(RUN).agg(F.count(F.lit(1)).alias("rows"), F.schema_of_variant_agg(ROW).alias("shape"))
