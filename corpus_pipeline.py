"""A corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs.

Defined cases are those of the operators. Repeated equal rows are one document to the near-duplicate
stage; a document without doc_id stays unless one with a doc_id stands for its class. Null texts
and empty tables pass through all stages, very long texts whole; columns of any further names stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import mixing, near_duplicates, packing, quality, secrets
from stratum.llm.common import drop_written, id_crc, read_table, shared_dir, temporary, unused
from stratum.session import ship_package

#: The near-duplicate stage compares whole texts on shingles of five words at a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labels outside the held-out fold, as the query does."""
    ship_package(spark)
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(F.pmod(id_crc("doc_id"), F.lit(5)) != 0)
    model = quality.learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    names = unused("score", docs), unused("predicted", docs)
    return quality.score(docs, model, keep=tuple(docs.columns), names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest doc_id; rows equal in doc_id and text are one document."""
    ship_package(spark)
    key = F.xxhash64("doc_id", "text")
    classes = near_duplicates.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT, tag=key)
    tag = unused("tag", docs)
    kept = classes.where("kept").select(F.col("tag").alias(tag)).distinct()
    # equal rows meet in each task first, so that they are not one task's
    return docs.withColumn(tag, key).dropDuplicates([tag]).join(kept, tag, "left_semi").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; every document stays."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of equal length."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Learned scores, hashed draws and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):  # what the stage has written for itself
            out = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/{name}"
            out.write.parquet(path)
        drop_written(docs)
        docs = spark.read.schema(out.schema).parquet(path)
        docs.stratum_path = path
    return docs
