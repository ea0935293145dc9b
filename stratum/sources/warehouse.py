"""Warehouse tables in the session's catalogue: append, replace, range replace, keyed upsert and replaced partitions.

A warehouse is a database of Parquet tables. Its layout says what each table is partitioned by, which
column its rows are bucketed by, so that joins and sums by that column need no shuffle, and which columns have Bloom filters,
so that a lookup skips row groups. A dated table is partitioned by its dates' months (or days).

A batch is worked out, cast and checked in a staging folder before its table is touched: a null in a column that must not hold
one, or a key that occurs twice, fails there. What follows is a copy by Spark's own commit. Partitions are
replaced by dynamic overwrite, which shows them when the job has ended. Every write but append can be run again: it replaces what
an earlier try left.

Where the catalogue does not outlive the session, tables found in the database's folder are registered anew.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import IDENTIFIER
from ..operators.writes import assert_unique, outside, upsert

PART = "_part"


class NoSuchTable(LookupError):
    """The catalogue has no such table."""


@dataclass(frozen=True)
class Layout:
    """Columns that a table is partitioned by, the column and number of its buckets, and columns with Bloom filters."""

    parts: tuple[str, ...] = ()
    bucketed: str | None = None
    buckets: int = 8
    bloom: tuple[str, ...] = ()


@dataclass
class Watch:
    """Figures to observe while a batch is worked out, and what was found: as many as wanted, without a job of their own."""

    wanted: dict[str, Column]
    found: dict | None = None


def identifier(name: str) -> str:
    if not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns by the schema's names and types; a null where the schema has none is an error of the job that meets it."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`").cast(f.dataType)
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"{f.name} must not be null")).cast(f.dataType))
        return c.alias(f.name)

    return df.select(*map(column, schema))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Warehouse:
    """Tables under one folder; dated names the date column of tables that are partitioned by it, by `grain`; schemas are the declared ones."""

    def __init__(self, spark: SparkSession, root: str, dated: dict[str, str] | None = None, schemas: dict[str, T.StructType] | None = None, grain: str = "month", layouts: dict[str, Layout] | None = None):
        self.spark, self.root, self.dated, self.schemas, self.grain, self.layouts = spark, root.rstrip("/"), dated or {}, dict(schemas or {}), grain, dict(layouts or {})
        self.database = f"stratum_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION {_literal(self.root)}")

    def name(self, table: str) -> str:
        return f"{self.database}.{identifier(table)}"

    def path(self, table: str) -> str:
        return f"{self.root}/{identifier(table)}"

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _delete(self, path: str) -> None:
        fs, hadoop = self._fs(path)
        fs.delete(hadoop, True)

    def layout(self, table: str) -> Layout:
        found = self.layouts.get(table, Layout())
        return Layout((*found.parts, PART), found.bucketed, found.buckets, found.bloom) if table in self.dated else found

    def _define(self, table: str, schema: T.StructType, kept: bool) -> None:
        """The table in the catalogue; kept: with the files that its folder holds."""
        layout = self.layout(table)
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != PART]
        if table in self.dated:
            columns.append(f"{PART} date")
        ddl = f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({', '.join(columns)}) USING parquet"
        if layout.bloom:
            options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in layout.bloom} | {"parquet.bloom.filter.adaptive.enabled": "true"}  # as large as a file's values need
            ddl += " OPTIONS (" + ", ".join(f"'{k}' '{v}'" for k, v in options.items()) + ")"
        if layout.parts:
            ddl += f" PARTITIONED BY ({', '.join(f'`{c}`' for c in layout.parts)})"
        if layout.bucketed:
            ddl += f" CLUSTERED BY (`{layout.bucketed}`) INTO {layout.buckets} BUCKETS"
        self.spark.sql(ddl + (f" LOCATION {_literal(self.path(table))}" if kept else ""))
        if kept and layout.parts:
            self.spark.sql(f"ALTER TABLE {self.name(table)} RECOVER PARTITIONS")

    def exists(self, table: str) -> bool:
        if self.spark.catalog.tableExists(self.name(table)):
            return True
        fs, folder = self._fs(self.path(table))
        if not fs.exists(folder):
            return False
        self._define(table, self.schemas.get(table) or self.spark.read.parquet(self.path(table)).schema, kept=True)
        return True

    def _rows(self, table: str) -> DataFrame:
        if not self.exists(table):
            raise NoSuchTable(table)
        return self.spark.table(self.name(table))

    def read(self, table: str) -> DataFrame:
        return self._rows(table).drop(PART)

    def parted(self, table: str) -> DataFrame:
        """Rows with the column that a dated table is partitioned by."""
        return self._rows(table)

    def between(self, table: str, low: object, high: object) -> DataFrame:
        """Rows of a dated table from low up to, but without, high; the scan reads the partitions of the span alone."""
        date, (first, last) = F.col(self.dated[table]), (self._part(F.lit(x).cast("timestamp_ntz")) for x in (low, high))
        span = (date >= F.lit(low).cast("timestamp_ntz")) & (date < F.lit(high).cast("timestamp_ntz"))
        return self._rows(table).where(span & F.col(PART).between(first, last)).drop(PART)

    def schema(self, table: str) -> T.StructType:
        """The declared schema, or the one that the table has."""
        return self.schemas.get(table) or self.read(table).schema

    def _part(self, date: Column) -> Column:
        return F.date_trunc(self.grain, date.cast("timestamp_ntz")).cast("date")

    def _dated(self, table: str, df: DataFrame) -> DataFrame:
        date = self.dated.get(table)
        return df if date is None else df.withColumn(PART, self._part(F.col(date)))

    def _insert(self, table: str, df: DataFrame, mode: str = "append", dynamic: bool = False) -> None:
        layout = self.layout(table)
        df = self._dated(table, df).select(*[F.col(f"`{c}`") for c in self.spark.table(self.name(table)).columns])
        if layout.bucketed:
            df = df.repartition(layout.buckets, layout.bucketed)
        with _setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic" if dynamic else "static"):
            df.write.mode(mode).insertInto(self.name(table))

    @contextmanager
    def staged(self, df: DataFrame, **figures: Column) -> Iterator[tuple[DataFrame, dict]]:
        """df worked out once, and figures observed while it was written: n, its number of rows, and those given, as aggregates without distinct."""
        path, seen = f"{self.root}/_staging-{uuid.uuid4().hex}", Observation()
        try:
            df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in figures.items()]).write.parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path), seen.get
        finally:
            self._delete(path)

    def create(self, table: str, schema: T.StructType) -> None:
        """An empty table of that schema, if there is none."""
        self.schemas[table] = schema
        if not self.exists(table):
            self._define(table, schema, kept=False)

    def append(self, table: str, df: DataFrame) -> int:
        """Add rows; gives their number. Without a table the frame founds one."""
        if not self.exists(table):
            self._define(table, df.schema, kept=False)
        with self.staged(conformed(df, self.schema(table))) as (rows, seen):
            if seen["n"]:
                self._insert(table, rows)
        return seen["n"]

    def replace(self, table: str, df: DataFrame, watch: Watch | None = None) -> int:
        """All rows anew; the table must be there. An empty frame empties it."""
        schema = self.schema(table)
        with self.staged(conformed(df, schema), **(watch.wanted if watch else {})) as (rows, seen):
            if watch:
                watch.found = seen
            if seen["n"]:
                self._insert(table, rows, "overwrite")
            else:
                self._renew(table, schema)
        return seen["n"]

    def _renew(self, table: str, schema: T.StructType) -> None:
        """An empty table of that schema instead of the one that may be there."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
        self._delete(self.path(table))
        self._define(table, schema, kept=False)

    def _forget_parts(self, table: str, gone: list[T.Row]) -> None:
        """Drop partitions, a row with their values each. Files go, too, where the table was registered with its folder."""
        for row in gone:
            values = {c: row[c] for c in self.layout(table).parts}
            if all(v is not None for v in values.values()):
                part = ", ".join(f"`{c}` = '{v}'" for c, v in values.items())
                self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({part})")
            self._delete("/".join([self.path(table), *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in values.items())]))
        self.spark.catalog.refreshTable(self.name(table))

    def dynamic_load(self, table: str, df: DataFrame) -> int:
        """All rows anew, with the frame's own columns."""
        with self.staged(df) as (rows, seen):
            self.schemas.pop(table, None)
            self._renew(table, df.schema)
            if seen["n"]:
                self._insert(table, rows)
        return seen["n"]

    def replace_parts(self, table: str, df: DataFrame) -> int:
        """The partitions that df has rows in hold these rows alone; others are not touched. Run again, it gives the same table."""
        if not self.exists(table):
            self._define(table, df.schema, kept=False)
        with self.staged(conformed(df, self.schema(table))) as (rows, seen):
            if seen["n"]:
                self._insert(table, rows, "overwrite", dynamic=True)
        return seen["n"]

    def replace_range(self, table: str, batch: DataFrame, date: str, watch: Watch | None = None) -> int:
        """Rows in the batch's span of dates, both ends included, make way for the batch. A dated table's other partitions are not touched.

        The span's partitions are shown at once by one commit; those that it leaves without rows are dropped after it, by a run again, too.
        """
        with self.staged(conformed(batch, self.schema(table)), low=F.min(date), high=F.max(date), undated=F.count_if(F.col(date).isNull()), **(watch.wanted if watch else {})) as (rows, seen):
            if watch:
                watch.found = seen
            n, low, high = seen["n"], seen["low"], seen["high"]
            if not n:
                return 0
            if self.dated.get(table) != date or low is None:
                with self.staged(self.read(table).where(outside(date, low, high)).unionByName(rows)) as (fresh, _):
                    self._insert(table, fresh, "overwrite")
                return n
            between = F.col(PART).between(*(self._part(F.lit(x)) for x in (low, high)))
            mine = F.col(date).isNull() & F.lit(seen["undated"] > 0)
            kept = self._rows(table).where(between & outside(date, low, high) | mine).drop(PART)
            with self.staged(kept.unionByName(rows)) as (fresh, _):
                parts = self._dated(table, fresh).select(PART).distinct()
                gone = self._rows(table).where(between).select(PART).distinct().join(parts, PART, "left_anti").collect()  # a row a partition
                self._insert(table, fresh, "overwrite", dynamic=True)
                self._forget_parts(table, gone)
        return n

    def upsert(self, table: str, batch: DataFrame, key: str) -> int:
        """Rows of a key make way for the batch's row of that key; a key twice in the batch is an error. The table is written anew."""
        there = self.exists(table)
        with self.staged(conformed(batch, self.schema(table)) if there else batch) as (rows, seen):
            assert_unique(rows, key)
            if not there:
                self._define(table, rows.schema, kept=False)
                self._insert(table, rows)
            else:
                with self.staged(upsert(self.read(table), rows, key)) as (fresh, _):
                    self._insert(table, fresh, "overwrite")
        return seen["n"]

    def publish_each(self, frames: dict[str, DataFrame]) -> None:
        """Several tables, all rows anew, one after another."""
        for table, df in frames.items():
            self.replace(table, df) if table in self.schemas else self.dynamic_load(table, df)

    def compact(self, table: str) -> int:
        """The table's rows in as few files as Spark makes of them; gives their number."""
        with self.staged(self.read(table)) as (rows, seen):
            if seen["n"]:
                self._insert(table, rows.coalesce(max(1, self.spark.sparkContext.defaultParallelism)), "overwrite")
        return seen["n"]

    def tables(self, names: list[str] | None = None) -> list[tuple[str, int]]:
        """(name, number of columns) of the catalogue's tables of this warehouse, by name; names: of these alone."""
        for table in names or ():
            self.exists(table)
        found = [t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary]
        return sorted((t, sum(c.name != PART for c in self.spark.catalog.listColumns(self.name(t)))) for t in found if names is None or t in names)
