"""Operator 3: exact top-k by inner product, columnar branch and bound.

Vectors are turned to integers floor(scale * x). A task holds its candidates in vertical layout,
dimension block by dimension block. For each query it adds up one block for all candidates, bounds
what the other blocks can still add by the product of the remaining lengths, and compacts the
candidates whose bound reaches the k-th best score met so far; the next block reads survivors only.
Integer scores are exact, and the bound is rounded up, so no true result is lost. A task takes its
longest candidates first, so that thresholds are high early, and dimensions by descending variance, so that little mass
remains after the first blocks; chunks are small, so that each but the first meets a threshold.

Candidates and queries are dealt by a hash into blocks of bounded size; each pair of a candidate and a
query block is met by one task, so nothing passes through the driver and no task's input grows with
either table. A task gives at most k rows a query, which are then ranked by query.

Defined cases: null vectors, and those with null or non-finite components or no component, take no
part, nor do null ids. Rows that share the query's id count as the query's own. Repeated query rows
are answered as one, from the row whose vector comes first. Vectors of other lengths are met over
the dimensions both have. Ties go to the smaller vec_id. Fewer candidates than k: all of them. An
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, divisible, lists, matrix, usable, width

CHUNK, BLOCK_DIMENSIONS, BLOCK_ROWS, BLOCK_QUERIES = 512, 8, 65_536, 65_536


class Shortlist:
    """The k best of each query so far: larger score first, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -(1 << 62), np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def least(self, q: int) -> int:
        return int(self.score[q, -1])

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= cut], scores[scores >= cut]
        ids, scores = np.concatenate([self.id[q], ids]), np.concatenate([self.score[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.id[q], self.score[q] = ids[order], scores[order]


def search_chunk(found: Shortlist, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK_DIMENSIONS) -> int:
    """Meet all queries with the rows of one chunk; both are whole numbers held as doubles. Gives the products of components that were worked out."""
    done = 0
    width = min(queries.shape[1], rows.shape[1])
    queries, columns = queries[:, :width], [np.ascontiguousarray(rows[:, a : min(width, a + block)]) for a in range(0, width, block)]
    rest = lambda x: np.sqrt(np.concatenate([np.cumsum((x**2)[:, ::-1], 1)[:, ::-1], np.zeros((len(x), 1))], 1))
    rows_rest, queries_rest = rest(rows[:, :width])[:, block::block], rest(queries)[:, block::block]
    for q in range(len(queries)):
        alive = None
        for b, part in enumerate(columns):
            dims = queries[q, b * block : b * block + part.shape[1]]
            done += part.shape[1] * (len(part) if alive is None else len(alive))
            if alive is None:
                total = part @ dims
            else:
                total = total + part[alive] @ dims
            if b + 1 < len(columns):
                bound = np.floor((total + (rows_rest[:, b] if alive is None else rows_rest[alive, b]) * queries_rest[q, b]) * (1 + 1e-12)) + 1
                stay = np.flatnonzero(bound >= found.least(q))
                alive = stay if alive is None else alive[stay]
                total = total[stay]
                if not len(alive):
                    break
        else:
            alive = np.arange(len(ids)) if alive is None else alive
            stay = (total >= found.least(q)) & (ids[alive] != query_ids[q])
            if stay.any():
                found.add(q, ids[alive[stay]], total[stay].astype(np.int64))
    return done


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, chunk: int = CHUNK, block: int = BLOCK_DIMENSIONS) -> tuple[Shortlist, float]:
    """The k best rows of each query, and the share of all products that were worked out."""
    found, done = Shortlist(len(query_ids), k), 0
    order = np.argsort(-(rows * rows).sum(1), kind="stable")
    dims = np.argsort(-rows.var(0), kind="stable") if len(rows) else np.arange(queries.shape[1])
    queries = queries[:, dims]
    for a in range(0, len(ids), chunk):
        some = order[a : a + chunk]
        done += search_chunk(found, query_ids, queries, ids[some], rows[some][:, dims], block)
    return found, done / max(1, queries.size * len(rows))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products among the candidates."""
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    rows = usable(candidates, id_col, vector_col).select("vec_id", whole.alias("v"))
    asked = usable(queries, id_col, vector_col).select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    # at least a block for each core; the counts read ids only
    cores = rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(cores, -(-candidates.select(id_col).count() // block_rows))
    query_blocks = max(1, -(-queries.select(id_col).count() // block_queries))
    place = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # rows of one id are dealt by their vectors too, so that a repeated id is not one block's
    own = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(row_blocks))).withColumn("asker", every(query_blocks))
    wanted = asked.withColumn("asker", place(query_blocks)).withColumn("block", every(row_blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, query_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        v, w = lists(left, "v"), lists(right, "v")
        wide = width(w)
        found, _ = search(query_ids, matrix(w, wide), ids, matrix(v, wide), k)
        q, j = np.nonzero(found.id != np.iinfo(np.int64).max)
        return pa.table({"query_id": query_ids[q], "vec_id": found.id[q, j], "score": found.score[q, j]})

    found = own.groupBy("block", "asker").cogroup(wanted.groupBy("block", "asker")).applyInArrow(meet, "query_id long, vec_id long, score long")
    return best(found, k)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The queries are the rows whose vec_id is divisible by every."""
    return top_k(vectors, vectors.where(divisible(every)), k)
