"""The warehouse's steps, classic and adaptive, and the pipeline that runs them.

A step returns a dict with its task, status, figures and duration; a failure inside a step becomes
status `failed`. The pipeline logs each step, retries failed ones, and stops at the first that stays failed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import COLUMN_MAPPING
from ..functions.dates import clean_dates, strict_date
from ..operators import aggregate, clean, quality
from ..operators.archive import to_archive
from ..operators.profile import profile
from ..schema import DATED, DWD, DWS, LAYOUTS, MARKS, ODS, REJECTED, RUN_LOG, RuntimeSchema, merge, typed
from ..sources.files import read_orders, read_unknown
from ..sources.warehouse import PART, Warehouse, Watch
from .alerts import Alerts
from .report import daily_report, data_report, print_report

Result = dict[str, Any]
GOOD = {"success", "passed", "warning", "skipped"}


def step(task: str) -> Callable[[Callable[..., Result]], Callable[..., Result]]:
    """A function whose result gets task and duration, and whose error becomes a failed result."""

    def wrap(f: Callable[..., Result]) -> Callable[..., Result]:
        def run(*args: Any, **kwargs: Any) -> Result:
            began = time.monotonic()
            try:
                out = f(*args, **kwargs)
            except Exception as e:
                out = {"status": "failed", "error": str(e)}
            return {"task": task} | out | {"duration": round(time.monotonic() - began, 2)}

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return wrap


def to_ods(df: DataFrame) -> DataFrame:
    """Source columns under their warehouse names and types; other columns are left out. A text in invoice_date that is no date fails the job."""
    named = df.withColumnsRenamed(COLUMN_MAPPING)
    if dict(named.dtypes)["invoice_date"] == "string":
        named = strict_date(named, "invoice_date")
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ODS])


def since(df: DataFrame, date: str, lower: str | datetime | None) -> DataFrame:
    """Rows from a date on; rows without date are not among them. Parquet scans get the bound as a pushed filter."""
    return df if lower is None else df.where(F.col(date) >= F.lit(lower).cast("timestamp_ntz"))


@step("extract")
def extract(store: Warehouse, path: str, since_date: str | None = None, incremental: bool = False, threshold: float | None = None) -> Result:
    """A fixed file into the raw table. The figures of the quality check that need no distinct values are observed on the way."""
    store.create("ods_orders", ODS)
    rows, watch = since(to_ods(read_orders(store.spark, path)), "invoice_date", since_date), Watch(quality.classic_figures())
    if incremental:
        n = store.replace_range("ods_orders", rows, "invoice_date", watch)
        status = "success" if n or not since_date else "skipped"
    elif since_date and not rows.take(1):
        return {"status": "skipped", "rows": 0}
    else:
        n, status = store.replace("ods_orders", rows, watch), "success"
    return {"status": status, "rows": n, "checks": quality.classic_judged(watch.found, RuntimeSchema(quality_null_threshold=threshold).threshold())}


@step("quality_check")
def quality_check(store: Warehouse, threshold: float | None = None) -> Result:
    row = quality.verdict(quality.classic_check(store.read("ods_orders"), RuntimeSchema(quality_null_threshold=threshold).threshold()).first())
    return {"status": row.pop("status"), "checks": row}


def archive(store: Warehouse, rejected: DataFrame, run_id: str, now: datetime) -> int:
    """Rejected rows in the archive's partition of the run; a run that is repeated replaces its own rows and no other's."""
    store.layouts.setdefault("rejected_orders", LAYOUTS["rejected_orders"])
    store.create("rejected_orders", REJECTED)
    return store.replace_parts("rejected_orders", to_archive(rejected, run_id, now))


@step("transform")
def transform(store: Warehouse, since_date: str | None = None, incremental: bool = False, now: datetime | None = None, run_id: str | None = None) -> Result:
    """Clean detail, and rejected rows in the archive, each from the tagged rows, which are written and counted once; a null where the detail must have none fails the step."""
    now, run_id = now or datetime.now(), run_id or uuid.uuid4().hex
    store.create("dwd_orders", DWD)
    ods = since(store.read("ods_orders"), "invoice_date", since_date)
    outcomes = {x: F.count_if(F.col("outcome") == x) for x in ("clean", "rejected", "lost")}
    with store.staged(clean.first_match(ods), **outcomes) as (tagged, seen):
        if not seen["n"]:
            return {"status": "skipped", "reason": "ODS 表为空", "rows": 0}
        good, bad, _ = clean.split_first(tagged)
        detail = good.withColumn("etl_time", F.lit(now).cast("timestamp_ntz"))
        if incremental:
            store.replace_range("dwd_orders", detail, "invoice_date")
        else:
            store.replace("dwd_orders", detail)
        archive(store, bad, run_id, now)
    return {"status": "success", "run_id": run_id} | {x: seen[x] for x in outcomes}


def mark(store: Warehouse, name: str) -> datetime | None:
    """How far a table has been taken in: the newest etl_time that its last run saw."""
    store.create("etl_marks", MARKS)
    row = store.read("etl_marks").where(F.col("name") == name).select("at").first()
    return row["at"] if row else None


def touched(detail: DataFrame, after: datetime | None) -> DataFrame:
    """Days, with their months, that have rows written after a mark."""
    fresh = detail if after is None else detail.where(F.col("etl_time") > F.lit(after))
    return fresh.where("invoice_date is not null").select(F.col("invoice_date").cast("date").alias("stat_date"), PART).distinct()


def of_days(detail: DataFrame, days: DataFrame) -> DataFrame:
    """All detail of some days. The months that the days lie in are found at run time and prune the scan's partitions."""
    months = days.select(F.col(PART).alias("month")).distinct()
    near = detail.join(months, F.col(PART) == F.col("month"), "left_semi")
    return near.join(days.select("stat_date"), F.col("invoice_date").cast("date") == F.col("stat_date"), "left_semi")


@step("aggregate")
def aggregate_daily(store: Warehouse, now: datetime | None = None, replace: bool = False, changed: bool = False) -> Result:
    """The daily table from the detail; by key unless replace, so that dates that vanished stay.

    changed: only days with rows written since the last such run are summed anew, from all of their rows; the mark is moved when they are in.
    """
    detail = store.parted("dwd_orders")
    newest = detail.agg(F.max("etl_time")).first()[0]
    if newest is None:
        return {"status": "skipped", "rows": 0}
    store.create("dws_sales_daily", DWS)
    if changed:
        days = touched(detail, mark(store, "dws_sales_daily"))
        if not days.take(1):
            return {"status": "skipped", "rows": 0}
        detail = of_days(detail, days)
    daily = aggregate.daily_sales(detail, F.col("invoice_date")).withColumn("etl_time", F.lit(now or datetime.now()).cast("timestamp_ntz"))
    daily = daily.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DWS])
    rows = store.replace("dws_sales_daily", daily) if replace else store.upsert("dws_sales_daily", daily, "stat_date")
    if changed:
        store.upsert("etl_marks", store.spark.createDataFrame([("dws_sales_daily", newest)], MARKS), "name")
    return {"status": "success", "rows": rows}


@step("report")
def report(store: Warehouse, folder: str, now: datetime | None = None, echo: bool = False) -> Result:
    """The daily report as a file; echo: its summary on the console, too."""
    daily = store.read("dws_sales_daily").drop("etl_time")
    summary = aggregate.summary(daily)
    if "message" in summary:
        return {"status": "warning", "summary": summary}
    if echo:
        print_report(summary)
    return {"status": "success", "summary": summary, "path": daily_report(daily, summary, folder, now)}


@step("auto_extract")
def auto_extract(store: Warehouse, path: str, declared: RuntimeSchema | None = None) -> Result:
    """A file of unknown shape into the raw table, under its declared names, with the schema inferred once."""
    declared = declared or RuntimeSchema()
    df = read_unknown(store.spark, path, overrides=declared.dtype_overrides, encodings=declared.csv_encodings)
    df = typed(df.withColumnsRenamed({k: v for k, v in declared.source_mapping.items() if k in df.columns}), declared.dtypes)
    schema = merge(declared, profile(df))
    rows = store.dynamic_load("ods_orders", clean_dates(df, schema.date_columns))
    return {"status": "success", "rows": rows, "schema": schema, "roles": schema.roles()}


@step("auto_quality")
def auto_quality(store: Warehouse, schema: RuntimeSchema) -> Result:
    row = quality.verdict(quality.schema_check(store.read("ods_orders"), schema).first())
    return {"status": row.pop("status"), "checks": row}


@step("auto_transform")
def auto_transform(store: Warehouse, schema: RuntimeSchema, now: datetime | None = None, run_id: str | None = None) -> Result:
    """Rows by all rules; rejected ones keep all their columns in the archive, whatever these are."""
    now, run_id = now or datetime.now(), run_id or uuid.uuid4().hex
    ods = store.read("ods_orders")
    warnings: list[str] = []
    with store.staged(clean.all_matches(ods, clean.compile_rules(schema, ods.schema))) as (tagged, seen):
        if not seen["n"]:
            return {"status": "skipped", "rows": 0}
        good, bad = clean.split_all(tagged, schema, warnings.append)
        kept = store.dynamic_load("dwd_orders", good.withColumn("etl_time", F.lit(now).cast("timestamp_ntz")))
        rejected = archive(store, bad, run_id, now)
    return {"status": "success", "run_id": run_id, "clean": kept, "rejected": rejected, "warnings": warnings}


@step("auto_aggregate")
def auto_aggregate(store: Warehouse, schema: RuntimeSchema, categories: bool = True, **options: Any) -> Result:
    """Sums and means, and distinct counts of the categorical columns that the profile found few values of."""
    options["categories"] = categories
    found = aggregate.adaptive(store.read("dwd_orders").drop("etl_time"), schema, **options)
    if found.note:
        return {"status": "success", "rows": 0, "summary": aggregate.adaptive_summary(found)}
    rows = store.dynamic_load("dws_adaptive", found.result)
    found.result = store.read("dws_adaptive")
    return {"status": "success", "rows": rows, "summary": aggregate.adaptive_summary(found), "figures": aggregate.adaptive_figures(found).first().asDict()}


@step("auto_report")
def auto_report(store: Warehouse, folder: str, summary: dict[str, Any], now: datetime | None = None) -> Result:
    return {"status": "success", "path": data_report(store.read("dws_adaptive"), summary, folder, now)}


class RunLog:
    """Start and end of each run as appended events; the state of a run is its last event. Each event is a file until compact() merges them."""

    def __init__(self, store: Warehouse, table: str = "etl_task_logs"):
        self.store, self.table = store, table
        store.create(table, RUN_LOG)

    def compact(self) -> int:
        return self.store.compact(self.table)

    def _add(self, run_id: str, task: str, status: str, duration: float | None = None, error: str | None = None) -> None:
        row = [(run_id, task, status, datetime.now(), None if duration is None else f"{duration:.2f}", None if error is None else error[:1000])]
        df = self.store.spark.createDataFrame(row, "run_id string, task_name string, status string, at timestamp_ntz, duration string, error_message string")
        self.store.append(self.table, df.withColumn("duration", F.col("duration").cast("decimal(10,2)")))

    def start(self, task: str) -> str:
        run_id = uuid.uuid4().hex
        self._add(run_id, task, "running")
        return run_id

    def end(self, run_id: str, task: str, result: Result) -> None:
        good = result["status"] in GOOD
        self._add(run_id, task, "success" if good else "failed", result.get("duration"), None if good else str(result.get("error", "")))

    def latest(self) -> DataFrame:
        from ..operators.writes import latest_runs

        return latest_runs(self.store.read(self.table))


class StepFailed(RuntimeError):
    """A step stayed failed after its retries."""


@dataclass
class Pipeline:
    """Named steps in order; each is a callable without arguments that returns a step's result."""

    steps: list[tuple[str, Callable[[], Result]]]
    log: RunLog | None = None
    alerts: Alerts = field(default_factory=Alerts)
    retries: int = 3
    wait_seconds: float = 300.0

    def run(self) -> list[Result]:
        out = []
        if self.log:
            self.log.compact()  # the events of earlier runs, a file each
        for name, f in self.steps:
            for attempt in range(self.retries + 1):
                run_id = self.log.start(name) if self.log else ""
                result = f()
                if self.log:
                    self.log.end(run_id, name, result)
                if result["status"] in GOOD:
                    break
                if attempt < self.retries:
                    time.sleep(self.wait_seconds)
            out.append(result)
            if result["status"] not in GOOD:
                self.alerts.send(f"{name} failed", str(result.get("error", "")))
                raise StepFailed(f"{name}: {result.get('error')}")
        return out


def classic_pipeline(spark: SparkSession, root: str, csv_path: str, reports: str, since_date: str | None = None, incremental: bool = False, **options: Any) -> Pipeline:
    """Extract, check, transform, aggregate, report."""
    store = Warehouse(spark, root, DATED, layouts=LAYOUTS)
    lower, run_id = since_date if incremental else None, uuid.uuid4().hex
    return Pipeline(
        [
            ("extract", lambda: extract(store, csv_path, lower, incremental)),
            ("quality_check", lambda: quality_check(store)),
            ("transform", lambda: transform(store, lower, incremental, run_id=run_id)),
            ("aggregate", lambda: aggregate_daily(store, changed=incremental)),
            ("report", lambda: report(store, reports)),
        ],
        RunLog(store),
        **options,
    )


def auto_pipeline(spark: SparkSession, root: str, csv_path: str, reports: str, declared: RuntimeSchema | None = None) -> list[Result]:
    """The adaptive steps over one file; the schema is inferred once and handed on."""
    store = Warehouse(spark, root, layouts={"rejected_orders": LAYOUTS["rejected_orders"]})
    out = [auto_extract(store, csv_path, declared)]
    if out[0]["status"] != "success":
        return out
    schema = out[0]["schema"]
    for f in (auto_quality, auto_transform, auto_aggregate):
        out.append(f(store, schema))
        if out[-1]["status"] not in GOOD:
            return out
    out.append(auto_report(store, reports, out[-1]["summary"]))
    return out
