"""Delimited files of unknown shape.

One distributed job looks at a bounded head of every file and settles its encoding, separator, title and header, so the files of a
folder may differ in all of these. Files of one layout are read together by Spark, as lines, cut
into fields and repaired by Column expressions; their columns meet by name, and are typed by one aggregation. Lines are decoded by
Spark where it knows the encoding, and by Python's codecs in Arrow batches otherwise. Paths are those of any file system that Spark reads.

What a file has beyond its head is checked, too: lines that are not UTF-8 in a file that looked like it. Where they are more than the
lines that only UTF-8 explains, the file is read in the encoding that they look like; else their broken bytes become replacement signs.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from statistics import median
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import COLUMN_MAPPING, SEPARATORS, STRING_COLUMNS, TAIL_ROW
from ..functions.numbers import known
from ..session import ship_package
from .encodings import CODECS, detect_encoding

HEAD_LINES, SNIFF_LINES, PROBE_BYTES = 15, 10, 100_000
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")
_INT, _FLOAT, _BOOL = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^(True|False|TRUE|FALSE|true|false)$"


@dataclass(frozen=True)
class Layout:
    """What the head of a file tells: skip is the number of lines with text before the first data line, headed whether one of them names the columns."""

    encoding: str
    separator: str
    columns: tuple[str, ...]
    skip: int
    headed: bool = True
    line_end: str = "\n"


def _lines(head: bytes, encoding: str, whole: bool) -> list[str]:
    lines = head.decode(CODECS.get(encoding, encoding), "replace").lstrip("﻿").splitlines()
    if not whole and len(lines) > 1:
        lines = lines[:-1]
    return [x for x in lines if x.strip()]


def _fields(line: str, separator: str) -> list[str]:
    return next(csv.reader([line], delimiter=separator), [])


def detect_separator(lines: list[str]) -> str:
    """The candidate that cuts all first lines alike into the most fields; else the one that varies least; a comma if none occurs."""
    lines = lines[:SNIFF_LINES]
    counts = {s: [len(_fields(x, s)) - 1 for x in lines] for s in SEPARATORS}
    counts = {s: n for s, n in counts.items() if n and max(n)}
    if not counts:
        return ","
    even = [s for s, n in counts.items() if min(n) == max(n)]
    if even:
        return max(even, key=lambda s: counts[s][0])
    return min(counts, key=lambda s: (max(counts[s]) - min(counts[s]), -median(counts[s])))


def repair_names(names: list[str]) -> list[str]:
    """Blank names become col_<i>; repeated ones get _1, _2 and so on."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        name = name.strip() or f"col_{i}"
        n = seen.get(name, -1) + 1
        seen[name] = n
        out.append(name if not n else f"{name}_{n}")
    return out


def layout_of(head: bytes, whole: bool, encoding: str | None = None, separator: str | None = None, encodings: list[str] | None = None) -> Layout | None:
    """Layout of a file from its head: a title line and a missing header are told from the fields they have. None for a file without text; one without columns is an error."""
    encoding = encoding or detect_encoding(head, not whole, encodings)
    lines = _lines(head, encoding, whole)
    if not lines:
        return None
    end = "\r" if b"\r" in head and b"\n" not in head else "\n"
    separator = separator or detect_separator(lines)
    counts = [len(_fields(x, separator)) for x in lines[:HEAD_LINES]]
    titled = len(counts) > 1 and counts[0] < 0.5 * median(counts[1:11])
    header = _fields(lines[int(titled)], separator)
    if len(header) <= 1:
        raise ValueError("a single column")
    if sum(bool(_NUMBER.fullmatch(x)) for x in header if x.strip()) > 0.5 * len(header):
        return Layout(encoding, separator, tuple(f"col_{i}" for i in range(len(header))), int(titled), False, end)
    return Layout(encoding, separator, tuple(repair_names(header)), int(titled) + 1, True, end)


@contextmanager
def _a_split_each(spark: SparkSession) -> Iterator[None]:
    """Partitions of one piece of a file each."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _text(spark: SparkSession, paths: list[str], line_end: str = "\n") -> DataFrame:
    """Lines as they are, with the file of each; bytes are not decoded."""
    return spark.read.option("lineSep", line_end).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("begin"))


def _heads(early: bool):
    """The first bytes of each file; early: a task ends with the first head it has, so that little more than the heads is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[str, list] = {}
        for batch in batches:
            full = None
            for file, size, begin, line in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "begin", "line"))):
                if begin == 0:
                    held = heads.setdefault(file, [size, bytearray()])
                    if len(held[1]) < PROBE_BYTES:
                        held[1] += line + b"\n"
                    else:
                        full = True
                else:
                    full = True
            if early and full:
                break
        for file, (size, head) in heads.items():
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([bytes(head[: min(size, PROBE_BYTES)])], pa.binary())], ["file", "size", "head"])

    return run


def heads(spark: SparkSession, paths: list[str], early: bool = True) -> DataFrame:
    """file, size and head of each file with bytes. early: for partitions of one piece of a file each, which are left after their first lines."""
    ship_package(spark, batches=False)
    lines = _text(spark, paths).select("file", "size", "begin", F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_heads(early), "file string, size long, head binary")


def layouts(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None, encodings: list[str] | None = None) -> dict[Layout, list[str]]:
    """Layouts, and the files of each. Files without text are left out; the driver gets a row a file, never a head."""
    asked = list(encodings or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, head in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "head"))):
                try:
                    found, error = layout_of(head, size <= PROBE_BYTES, encoding, separator, asked), None
                except ValueError as e:
                    found, error = None, str(e)
                columns = pa.array([list(found.columns) if found else None], pa.list_(pa.string()))
                cells = [found.encoding, found.separator, found.line_end] if found else [None] * 3
                yield pa.RecordBatch.from_arrays([pa.array([file]), *(pa.array([c], pa.string()) for c in cells), columns, pa.array([found.skip if found else None], pa.int32()), pa.array([found.headed if found else None], pa.bool_()), pa.array([error], pa.string())], ["file", "encoding", "separator", "line_end", "columns", "skip", "headed", "error"])

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not list(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []):
        raise FileNotFoundError(path)
    schema = "file string, encoding string, separator string, line_end string, columns array<string>, skip int, headed boolean, error string"
    with _a_split_each(spark):
        rows = heads(spark, [path]).mapInArrow(run, schema).collect()
    # a file that shared a partition with another one, or that is empty
    seen = {_place(r["file"]) for r in rows}
    if missing := [_plain(f) for f in spark.read.text(path).inputFiles() if _place(f) not in seen]:
        rows += heads(spark, missing, early=False).mapInArrow(run, schema).collect()
    out: dict[Layout, list[str]] = {}
    for r in sorted(rows, key=lambda r: r["file"]):
        if r["error"]:
            raise ValueError(f"{unquote(r['file'])} has {r['error']}")
        if r["encoding"]:
            out.setdefault(Layout(r["encoding"], r["separator"], tuple(r["columns"]), r["skip"], r["headed"], r["line_end"]), []).append(_plain(r["file"]))
    if not out:
        raise ValueError(f"{path} has no line with text")
    return _named(out)


def _place(file: str) -> str:
    return re.sub(r"^file:/+", "/", unquote(file))


def _plain(file: str) -> str:
    """A path as Spark's readers take it: without URL escapes, signs of patterns as themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _named(found: dict[Layout, list[str]]) -> dict[Layout, list[str]]:
    """Files without header take the columns of the others where these have one header among them, of as many columns."""
    headers = {x.columns for x in found if x.headed}
    if len(headers) != 1:
        return found
    columns, out = headers.pop(), {}
    for x, files in found.items():
        own = replace(x, columns=columns) if not x.headed and len(x.columns) == len(columns) else x
        out.setdefault(own, []).extend(files)
    return out


def peek(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None, encodings: list[str] | None = None) -> Layout:
    """Layout of a file; of the first one of a folder or pattern."""
    return min(layouts(spark, path, encoding, separator, encodings).items(), key=lambda x: min(x[1]))[0]


#: The signs that windows-1252 has where ISO-8859-1 has control characters.
_UPPER = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _decoded(lines: DataFrame, encoding: str) -> DataFrame:
    """lines with `line`, the value as text."""
    if encoding in ("utf-8", "utf-8-sig", "ascii"):
        return lines.withColumn("line", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.make_valid_utf8("value")))
    if encoding in ("cp1252", "latin-1"):
        text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
        return lines.withColumn("line", F.translate(text, "".join(_UPPER), "".join(_UPPER.values())) if encoding == "cp1252" else text)
    codec = CODECS.get(encoding, encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else x.decode(codec, "replace") for x in batch.column("value").to_pylist()]
            yield batch.append_column("line", pa.array(text, pa.string()))

    schema = ", ".join(f"{c} {k}" for c, k in lines.withColumn("value", F.col("value").cast("binary")).dtypes)
    return lines.withColumn("value", F.col("value").cast("binary")).mapInArrow(run, f"{schema}, line string")


def _parsed(spark: SparkSession, files: list[str], layout: Layout, raw: list[str]) -> DataFrame:
    """_row_id, file, the fields, what is beyond them, the line where it has not just one field more, and whether it is UTF-8 beyond ASCII, or not UTF-8; of lines with text."""
    schema = ", ".join(f"{c} string" for c in [*raw, "__over", "__line"])
    options = {"sep": layout.separator, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__line", "quote": '"', "escape": '"'}
    if layout.encoding.startswith("utf-16"):  # lines of two bytes a sign cannot be split: a file is one task's
        reader = spark.read.schema(schema).options(**options, multiLine="true", encoding=layout.encoding.upper().replace("-LE", "LE").replace("-BE", "BE"))
        rows = reader.csv(files).withColumn("file", F.col("_metadata.file_path"))
        return rows.withColumns({"_row_id": F.monotonically_increasing_id(), "__only_utf8": F.lit(False), "__broken": F.lit(False), "value": F.lit(None).cast("string")})
    lines = _text(spark, files, layout.line_end).select("file", "value").where(F.length(F.trim(F.regexp_replace(F.make_valid_utf8("value"), "[\\r\\uFEFF]", ""))) > 0)
    lines = lines.withColumn("_row_id", F.monotonically_increasing_id())
    valid = F.is_valid_utf8("value")
    lines = lines.withColumns({"__broken": ~valid, "__only_utf8": valid & (F.octet_length("value") > F.length("value"))})
    rows = _decoded(lines, layout.encoding).withColumn("line", F.regexp_replace("line", "\\r$", ""))
    return rows.withColumn("x", F.from_csv("line", schema, options)).select("_row_id", "file", "value", "__broken", "__only_utf8", "x.*")


def _data_rows(spark: SparkSession, files: list[str], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """The rows of files of one layout, and a row for each file: its first row id, that of its last row that is no total, and its lines by what they are as UTF-8."""
    raw = [f"__c{i}" for i in range(len(layout.columns))]
    rows = _parsed(spark, files, layout, raw)
    # n fields or fewer: a corrupt record without the extra column; n + 1: no corrupt record; more: both
    unquoted = F.regexp_replace("__line", r'"(?:[^"]|"")*"', "q")
    fields = F.regexp_count(unquoted, F.lit(re.escape(layout.separator))) + 1
    long_row = F.coalesce(F.col("__line").isNull() | F.col("__over").isNotNull() | (fields > len(raw)), F.lit(False))
    first = F.regexp_replace(F.coalesce(F.col(raw[0]), F.lit("")), "^\\uFEFF", "")
    total = F.col("__c0").rlike(TAIL_ROW) & F.forall(F.array(*raw[1:]), lambda x: x.isNull() | x.rlike(r"^\s*[\d.,]*\s*$"))
    rows = rows.withColumn("__c0", F.when(F.col("__c0").isNotNull(), first)).withColumn("__long", long_row).withColumn("__total", F.coalesce(total, F.lit(False)))
    broken = F.col("__broken")
    found = rows.groupBy("file").agg(
        F.min("_row_id").alias("begin"),
        F.max(F.when(~F.col("__long") & ~F.col("__total"), F.col("_row_id"))).alias("last"),
        F.count_if(broken).alias("broken"),
        F.count_if("__only_utf8").alias("only_utf8"),
        *[f(F.when(broken, F.col("value").cast("binary"))).alias(f"sample{i}") for i, f in enumerate((F.min, F.max))],
    )
    return rows, found


def _without_ends(rows: DataFrame, ends: DataFrame, layout: Layout, one_file: bool) -> DataFrame:
    """Without titles, headers, trailing totals and too long rows; fields under their names, short rows filled with null. What one file has in its first lines and at its end is one row a file."""
    raw = [f"__c{i}" for i in range(len(layout.columns))]
    if one_file:
        row = ends.first()
        rows = rows.withColumns({"begin": F.lit(row["begin"]).cast("long"), "last": F.lit(row["last"]).cast("long")}) if row else rows.withColumns({"begin": F.lit(0), "last": F.lit(0)})
    else:
        rows = rows.join(ends.select("file", "begin", "last"), "file")
    rows = rows.where(~F.col("__long") & (F.col("_row_id") >= F.col("begin") + layout.skip) & (F.col("last").isNull() | ~F.col("__total") | (F.col("_row_id") < F.col("last"))))
    return rows.select("_row_id", *[known(F.trim(F.col(c)) if c == "__c0" else F.col(c)).alias(n) for c, n in zip(raw, layout.columns)])


def read_text_rows(spark: SparkSession, found: dict[Layout, list[str]], encodings: list[str] | None = None, fixed_encoding: bool = False) -> DataFrame:
    """All rows of all files as text, columns by name.

    Files whose head is UTF-8 are checked over all their lines; one that has more broken lines than such as only UTF-8 explains is read
    in the encoding that the broken ones look like.
    """
    frames, todo = [], list(found.items())
    while todo:
        layout, files = todo.pop(0)
        rows, ends = _data_rows(spark, files, layout)
        if layout.encoding in ("utf-8", "ascii") and not fixed_encoding:
            odd = ends.where("broken > only_utf8").select("file", "sample0", "sample1").collect()  # a row a file
            again: dict[Layout, list[str]] = {}
            for r in odd:
                others = [e for e in encodings or [] if e not in ("utf-8", "ascii")]
                other = detect_encoding(bytes(r["sample0"]) + b"\n" + bytes(r["sample1"]), False, others)
                again.setdefault(replace(layout, encoding=other), []).append(_plain(r["file"]))
            if again:
                todo += again.items()
                moved = {f for own in again.values() for f in own}
                files = [f for f in files if f not in moved]
                if not files:
                    continue
                rows, ends = _data_rows(spark, files, layout)
        frames.append(_without_ends(rows, ends, layout, len(files) == 1))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def resolve_types(rows: DataFrame, keep_text: tuple[str, ...] = ()) -> DataFrame:
    """Whole numbers, numbers and booleans get their type where all values of a column have it; columns of nulls only are dropped. One job."""
    names = [c for c in rows.columns if c != "_row_id"]
    figures = rows.agg(*[x for i, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), *[F.count_if(F.col(f"`{c}`").rlike(p)).alias(f"{k}{i}") for k, p in (("i", _INT), ("f", _FLOAT), ("b", _BOOL))])]).first()

    def typed(i: int, c: str) -> Column | None:
        n, col = figures[f"n{i}"], F.col(f"`{c}`")
        if not n:
            return None
        if c not in keep_text:
            if figures[f"i{i}"] == n:
                return F.trim(col).cast("bigint").alias(c)
            if figures[f"f{i}"] == n:
                return F.trim(col).cast("double").alias(c)
            if figures[f"b{i}"] == n:
                return (F.lower(col) == "true").alias(c)
        return col

    return rows.select(*[x for i, c in enumerate(names) if (x := typed(i, c)) is not None])


def read_unknown(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None, overrides: dict[str, str] | None = None, encodings: list[str] | None = None) -> DataFrame:
    """A file, folder or pattern of unknown shape as a typed table; overrides names columns that stay text, encodings the only ones to try."""
    keep = tuple(c for c, t in (overrides or {}).items() if t in ("str", "string", str))
    found = layouts(spark, path, encoding, separator, encodings)
    return resolve_types(read_text_rows(spark, found, encodings, encoding is not None), keep)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """The fixed eight-column file, ids as text."""
    df = read_unknown(spark, path, overrides=dict.fromkeys(STRING_COLUMNS, "str"))
    validate_columns(df)
    return df


def validate_columns(df: DataFrame) -> bool:
    missing = sorted(set(COLUMN_MAPPING) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return True
