"""Connected components of an edge table: local forests, joined by large-star and small-star steps over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Edges that one task holds at once, as pairs of numbers.
CHUNK = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, and that smallest one."""
    codes, names = pd.factorize(np.concatenate([u, v]), sort=True)
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(codes[: len(u)].tolist(), codes[len(u) :].tolist()):
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(len(names))], np.int64)
    own = np.flatnonzero(roots != np.arange(len(names)))
    return names[own], names[roots[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars of the same components; a task with more edges than CHUNK gives more than one set."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch.to_pandas())
        if sum(map(len, held)) >= CHUNK:
            both = pd.concat(held)
            held = [pd.DataFrame(dict(zip("uv", stars(both["u"].to_numpy(), both["v"].to_numpy()))))]
            if len(held[0]) >= CHUNK // 2:
                yield pa.RecordBatch.from_pandas(held.pop(), pa.schema([("u", pa.string()), ("v", pa.string())]), preserve_index=False)
    if both := [h for h in held if len(h)]:
        rows = pd.concat(both)
        u, v = stars(rows["u"].to_numpy(), rows["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], ["u", "v"])


def connected_components(edges: DataFrame, chunk: int = CHUNK, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of edges(u, v), texts; root is the smallest node of the component.

    Each round turns the edges of every task into stars, which keeps the components; while there is
    more than one task, a large-star and a small-star step then join them, each by one minimum for
    each node, so no neighbourhood is ever gathered. Rounds end when the edges no longer change.
    """
    now = written(edges.where("u <> v").select("u", "v"), "edges")
    state = None
    for _ in range(most_rounds):
        count = now.count()
        tasks = max(1, -(-count // chunk))
        after = written(now.coalesce(tasks).mapInArrow(_contract, "u string, v string"), "edges")
        drop_written(now)
        now = after
        if count < chunk:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that their joins can be split at a node with many edges
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "edges")
        drop_written(now)
        now, before = after, state
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
