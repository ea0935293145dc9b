"""Reading tables, durable intermediate tables and small helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts are runs of anything but these bytes.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder where all executors see it: under spark.checkpoint.dir, else under the context's checkpoint folder. Where neither is set a local master gets a local one; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratum-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/stratum-{uuid.uuid4().hex}"


#: Folders written within temporary(), innermost last.
_open: list[list[str]] = []


def written(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder (by: a column whose values have folders of their own) and read it back.

    Results are lazy, so what they read stays until drop_written(), or the end of temporary().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    if _open:
        _open[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stratum_path = path
    return out


#: Tables of the session's catalogue by their folders.
_tables: dict[str, str] = {}


def bucketed(df: DataFrame, buckets: int, *by: str) -> DataFrame:
    """df as a table in the shared folder, in buckets: its joins on these columns need no shuffle of its rows. Dealt once, here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    name = f"bucketed_{path[-32:]}"
    if _open:
        _open[-1].append(path)
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).option("path", path).saveAsTable(name)
    _tables[path] = name
    return spark.table(name)


def drop_written(df: DataFrame, part: str | None = None) -> None:
    """Delete the files of a table made by written(), or one of its folders, once nothing reads them any more."""
    path = getattr(df, "stratum_path", None)
    if path:
        _delete(df.sparkSession, path if part is None else f"{path}/{part}")


def _delete(spark: SparkSession, path: str) -> None:
    if name := _tables.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all that written() made within; a result must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_crc(col: Column | str) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: STRATUM_TOKENIZERS names the folder, else the installed package's."""
    if folder := os.environ.get("STRATUM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
