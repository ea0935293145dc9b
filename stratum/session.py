"""Spark sessions, and the package's own code on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "stratum", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the engine relies on; conf keys use __ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, else the context's checkpoint folder; a local master may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stratum-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()
#: Rows of an Arrow batch to a Python worker where the session leaves Spark's default: rows here are whole texts.
BATCH_ROWS = "1000"


def ship_package(spark: SparkSession, batches: bool = True) -> None:
    """Give Python workers this package, once for each application, whatever their path is; batches: and Arrow batches that fit their memory, for the session."""
    context = spark.sparkContext
    if batches and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="stratum-code-"), "stratum.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
