"""Operator 9: token ids in ORC files, in ascending id order, and what can be read from them.

Each file holds a range of document ids; ORC keeps the ids with integer run-length encoding, an
index every few rows with the smallest and largest document id, and Bloom filters on the document
id, so that readers take stripes in parallel and skip those that cannot hold a wanted document.

Files are sized by the bytes of their texts, and are at least as many as the session has cores where
there are documents for them. Very long texts are rows like others: a task holds one batch of texts at a time.

Defined cases: a null text is the empty text; a null doc_id sorts first; rows of one doc_id keep
each their own ids and stand in the order of their text's hash (rows equal in both may lie in more
than one file, so that none of them is one task's); an empty table gives no file and no row; columns
other than the two named ones are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, tokenizer_path
from .textops import slices
from .tokens import END_ID, encoder

SCHEMA = "doc_id long, ids array<int>, n int, part int, start_in_part long"
#: Rows between index entries, bytes of a stripe (what one reader takes) and of a file's texts, and rows that are worth a file of their own.
ROW_INDEX_STRIDE, STRIPE_BYTES, BYTES_PER_FILE, FEW_ROWS = 1000, 16 << 20, 128 << 20, 1000


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", bytes_per_file: int = BYTES_PER_FILE, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Write ids of whole texts as ORC under path, documents in ascending order over the files."""
    vocabulary = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count, volume = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    files = max(1, -(-volume // bytes_per_file), min(docs.sparkSession.sparkContext.defaultParallelism, count // FEW_ROWS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = enc.encode(batch.column("text"), end_id)
                column = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(np.diff(at).astype(np.int32)), pa.array(np.full(len(at) - 1, part, np.int32)), pa.array(start + at[:-1])], ["doc_id", "ids", "n", "part", "start_in_part"])
                start += int(at[-1])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    (
        ordered.select("doc_id", "text")
        .mapInArrow(encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.rows.between.memory.checks", ROW_INDEX_STRIDE)  # the stripe's size is looked at that often
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files: doc_id, ids, the file's number and the ids before the row in its file. Filters on doc_id reach the files' indexes."""
    return spark.read.schema(SCHEMA).orc(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("ids")
        at = column.offsets.to_numpy()
        data = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), dtype="<u4")
        crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    The ids before a file are a running sum over one row for each file.
    """
    tokens = read_tokens(spark, path)
    rows = tokens.select("doc_id", "ids", "part", "start_in_part").mapInArrow(_crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    files = tokens.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n")).alias("total"))
    before = files.select("part", F.expr("coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Write the token files in the shared folder and read their digest back; they stay, as the result reads them."""
    path = f"{shared_dir(spark)}/tokens"
    if not docs.select("doc_id").take(1):
        schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
        return spark.createDataFrame([], schema)
    write_tokens(docs, path, tokenizer, **options)
    return digest(spark, path)
