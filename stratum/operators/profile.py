"""Column roles, inferred from a sample by a ladder of tests.

A table of more than SAMPLE rows is judged by a sample of that many, chosen by a hash of the rows'
content and read in one job; size=None judges all rows by one aggregation and the first values of
each column. whole=True takes the sample's values and the figures of all rows, in one scan: while the sample is drawn, counts and
distinct sketches are observed; a column whose estimate is too near to a bound of the ladder is counted. The
ladder itself is plain Python over those few figures.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..fixed import BOOL_SETS, CURRENCY, DATE_NAME, DATE_TEXT, ID_NAME
from ..functions.dates import FORMATS, parsed
from ..schema import RuntimeSchema

SAMPLE, HEAD, SEED = 5000, 100, 42
#: Shares of distinct values at which the ladder turns, the sketches' relative deviation, and how many of these decide without counting.
TURNS, DEVIATION, SURE = (0.90, 0.95, 0.98), 0.01, 4
SYSTEM_COLUMNS = ("etl_time", "rejected_at", "rejected_reason")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


@dataclass
class Column:
    """What the ladder looks at: values are the first ones that are not null, distinct their number over the sample, dates the share of the first ten different values that parse."""

    name: str
    kind: str
    count: int
    distinct: int
    values: list[Any]
    dates: float = 0.0

    @property
    def unique(self) -> float:
        return self.distinct / self.count if self.count else 0.0


def progressive(values: list[Any]) -> bool:
    """At least three numbers whose commonest step is positive and makes up over four fifths of the steps."""
    if len(values) < 3:
        return False
    steps = Counter(b - a for a, b in zip(values, values[1:]))
    step, n = max(steps.items(), key=lambda x: (x[1], -x[0]))
    return step > 0 and n / (len(values) - 1) > 0.8


def _different(values: list[Any], most: int) -> list[str]:
    return [str(v) for v in list(dict.fromkeys(values))[:most]]


def numeric_text(values: list[Any]) -> bool:
    """Whether text values are numbers with percent signs, currency signs, separators or exponents."""
    texts = [str(v).strip() for v in values]
    if not texts:
        return False
    number = lambda t: bool(_NUMBER.fullmatch(t.strip()))
    share = lambda test: sum(map(bool, map(test, texts))) / len(texts)
    without = lambda signs: [re.sub(f"[{re.escape(signs)}]", "", t) for t in texts]
    if share(lambda t: t.endswith("%")) > 0.3 and all(map(number, without("%,"))):
        return True
    if share(lambda t: any(c in t for c in CURRENCY)) > 0.3 and all(map(number, without(CURRENCY + ","))):
        return True
    if share(lambda t: re.search(r"\d,\d", t)) > 0.3 and all(map(number, without(","))):
        return True
    return share(lambda t: re.search(r"\d[eE][+-]?\d", t)) > 0.1 and all(map(number, texts))


def role(c: Column) -> str:
    """date, numeric, categorical, id, bool or drop; the first test that holds decides."""
    if not c.count:
        return "drop"
    if c.kind in ("boolean", "date") or c.kind.startswith("timestamp"):
        return "bool" if c.kind == "boolean" else "date"
    if c.kind != "string":
        whole = c.kind in ("tinyint", "smallint", "int", "bigint")
        return "id" if whole and (c.unique > 0.90 and progressive(c.values) or c.unique > 0.95) else "numeric"
    first = _different(c.values, 10)
    if (any(re.search(DATE_TEXT, v) for v in first) or re.search(DATE_NAME, c.name)) and c.dates > 0.8:
        return "date"
    few = {v.strip().lower() for v in _different(c.values[:20], 21)}
    if len(set(map(str, c.values[:20]))) <= 4 and any(few <= s or s <= few for s in BOOL_SETS):
        return "bool"
    if numeric_text(c.values):
        return "numeric"
    if c.unique > 0.90 and re.search(ID_NAME, c.name):
        return "id"
    return "id" if c.unique > 0.98 else "categorical"


def sampled(df: DataFrame, size: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """At most size rows, the same ones whatever the partitions and their order, with _row_id."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c, k in df.dtypes if not k.startswith("map")], F.lit(seed))
    return df.withColumn("_row_id", F.monotonically_increasing_id()).orderBy(content, "_row_id").limit(size)


def _one_scan(rows: DataFrame, kinds: dict[str, str], size: int) -> list[Column]:
    """A sample's values with the figures of all rows, observed while it is drawn."""
    names, seen = rows.columns, Observation()
    figures = [x for i, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.approx_count_distinct(F.col(f"`{c}`"), DEVIATION).alias(f"d{i}"))]
    few = sorted(sampled(rows.observe(seen, *figures), size).collect(), key=lambda r: r["_row_id"])
    found = seen.get
    out = [Column(c, kinds[c], found[f"n{i}"], min(found[f"n{i}"], found[f"d{i}"]), [r[c] for r in few if r[c] is not None][:HEAD]) for i, c in enumerate(names)]
    near = lambda x: x.count and any(abs(x.distinct / x.count - t) <= SURE * DEVIATION * x.distinct / x.count for t in TURNS)
    if close := [x for x in out if near(x)]:
        exact = rows.agg(*[F.countDistinct(F.col(f"`{x.name}`")).alias(f"d{i}") for i, x in enumerate(close)]).first()
        for i, x in enumerate(close):
            x.distinct = exact[f"d{i}"]
    return out


def statistics(df: DataFrame, size: int | None = SAMPLE, whole: bool = False) -> list[Column]:
    """The figures of each column."""
    names = [c for c in df.columns if c not in SYSTEM_COLUMNS]
    rows, kinds = df.select(*[F.col(f"`{c}`") for c in names]), dict(df.dtypes)
    if whole:
        out = _one_scan(rows, kinds, size or SAMPLE)
    elif size is not None:
        few = sorted(sampled(rows, size).collect(), key=lambda r: r["_row_id"])
        values = {c: [r[c] for r in few if r[c] is not None] for c in names}
        out = [Column(c, kinds[c], len(values[c]), len(set(map(repr, values[c]))), values[c][:HEAD]) for c in names]
    else:
        counts = rows.agg(*[x for i, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}"))]).first()
        first = rows.limit(HEAD * 5).collect()
        head = {c: [r[c] for r in first if r[c] is not None][:HEAD] for c in names}
        for i, c in enumerate(names):
            if len(head[c]) < min(HEAD, counts[f"n{i}"]):  # a sparse column: its first values lie further on
                head[c] = [r[c] for r in rows.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`")).limit(HEAD).collect()]
        out = [Column(c, kinds[c], counts[f"n{i}"], counts[f"d{i}"], head[c]) for i, c in enumerate(names)]
    texts = [x for x in out if x.kind == "string" and x.count]
    _date_shares(df, [x for x in texts if any(re.search(DATE_TEXT, v) for v in _different(x.values, 10)) or re.search(DATE_NAME, x.name)])
    return out


def _date_shares(df: DataFrame, columns: list[Column]) -> None:
    """Set the share of the first different values that parse with the format of the first."""
    if not columns:
        return
    values = [(i, j, v) for i, c in enumerate(columns) for j, v in enumerate(_different(c.values, 10))]
    table = df.sparkSession.createDataFrame(values, "c int, j int, v string")
    table = table.withColumns({f"f{k}": parsed(F.col("v"), p).isNotNull() for k, p in enumerate(FORMATS)})
    found: dict[int, list] = {}
    for r in table.collect():
        found.setdefault(r["c"], []).append(r)
    for i, c in enumerate(columns):
        rows = sorted(found[i], key=lambda r: r["j"])
        k = next((k for k in range(len(FORMATS)) if rows[0][f"f{k}"]), None)
        c.dates = sum(r[f"f{k}"] for r in rows) / len(rows) if k is not None else 0.0


def profile(df: DataFrame, size: int | None = SAMPLE, whole: bool = False) -> RuntimeSchema:
    """The runtime schema of a table: roles, an identity mapping of the columns kept, dates as critical columns, and the categories' distinct values."""
    schema = RuntimeSchema()
    for c in statistics(df, size, whole):
        getattr(schema, f"{role(c)}_columns").append(c.name)
        if c.name in schema.categorical_columns:
            schema.cardinality[c.name] = c.distinct
    schema.source_mapping = {c: c for c, r in schema.roles().items() if r != "drop"}
    schema.quality_critical_nulls = list(schema.date_columns)
    return schema


def roles_table(df: DataFrame, size: int | None = SAMPLE, whole: bool = False) -> DataFrame:
    """column_name, role, known (values that are not null) and different (distinct ones) of each column."""
    found = [(c.name, role(c), c.count, c.distinct) for c in statistics(df, size, whole)]
    return df.sparkSession.createDataFrame(sorted(found), "column_name string, role string, known long, different long")
