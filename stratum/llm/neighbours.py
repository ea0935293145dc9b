"""Operator 6: approximate nearest neighbours over learned partitions.

A bounded sample gets an exact neighbour graph. The graph is partitioned into parts of equal size so
that few edges are cut; a small classifier learns each sampled vector's part, and then names the part
of every vector and the most probable parts of every query. A query is met with the vectors of its
parts, exactly, in double precision.

The sample has at most sample_rows vectors, the first by a hash of the id; all rows are indexed. The
number of parts grows with the root of the table, up to one for each ROWS_PER_PART sampled vectors. A
tenth of the sample is kept from learning: the number of parts to probe is the smallest with
which the kept vectors' k nearest in the sample, k being that of the search, are found at the rate target_recall. As the
k nearest of a sample lie farther off than those of the table, and the rate is above the one to reach, there is a margin. So clustered
vectors are searched in few parts, and vectors without clusters in as many as it takes.

Parts are packed into blocks of bounded size, a larger part being cut into several by a hash; a
query goes once to each block that holds some of its parts, and the queries of a block are cut likewise.
So no task holds more than a block of either. Each block gives at most k rows a query. Of equal
vectors a block meets the k + 1 of the smallest ids only, which are all that can be found.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do null ids. Rows that share the query's id count as the query's own; repeated query rows are
answered as one, from the row whose vector comes first; repeated candidate rows are found each. Ties go to the
smaller vec_id. Fewer candidates than k: all that lie in the parts searched, which is every part of a table
too small for two. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, divisible, lists, matrix, usable, width

SAMPLE_ROWS, ROWS_PER_PART, DEGREE, TARGET_RECALL, BLOCK_ROWS, BLOCK_QUERIES = 16_384, 64, 10, 0.97, 65_536, 65_536


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest other rows of each row by inner product, in blocks."""
    degree = min(degree, len(x) - 1)
    out = np.zeros((len(x), degree), np.int64)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 512] = np.argpartition(-near, degree - 1, axis=1)[:, :degree] if degree else 0
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for each row of the graph, all parts equally large up to one row in a hundred.

    Parts begin as balanced clusters; then rows move, in rounds, to the part that holds most of their
    neighbours, the largest gains first, while that part has room.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    room = int(np.ceil(n / parts * 1.01))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        near = x @ centres.T
        part[:] = -1
        left = np.full(parts, room)
        order = np.argsort(-(np.partition(near, -2, axis=1)[:, -1] - np.partition(near, -2, axis=1)[:, -2]) if parts > 1 else np.zeros(n))
        choice = np.argsort(-near, axis=1)
        for i in order.tolist():
            for p in choice[i].tolist():
                if left[p]:
                    part[i], left[p] = p, left[p] - 1
                    break
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    back = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (back, part[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), part[back]), 1)
        gain = votes.max(1) - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            p = int(votes[i].argmax())
            if size[p] < room:
                size[part[i]] -= 1
                size[p] += 1
                part[i], moved = p, moved + 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer that gives each vector the log odds of its parts."""

    def __init__(self, width: int, parts: int, hidden: int = 64, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.w
        return np.tanh(x @ w + b) @ v + c

    def fit(self, x: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.01, seed: int = 2) -> Router:
        """target: rows by parts, each row sums to one."""
        rng = np.random.default_rng(seed)
        m, s = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, steps + 1):
            i = rng.integers(0, len(x), min(len(x), 1024))
            h = np.tanh(x[i] @ self.w[0] + self.w[1])
            y = h @ self.w[2] + self.w[3]
            y = np.exp(y - y.max(1, keepdims=True))
            d = (y / y.sum(1, keepdims=True) - target[i]) / len(i)
            dh = d @ self.w[2].T * (1 - h * h)
            for k, g in enumerate((x[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
                self.w[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
        return self


def probes_needed(router: Router, unit: np.ndarray, kept: np.ndarray, x: np.ndarray, target_recall: float, degree: int = DEGREE) -> int:
    """Parts to probe so that kept vectors find their nearest ones of the sample x (unit: x at length one) at that rate."""
    parts, degree = len(router.w[3]), min(degree, len(x))
    near = np.concatenate([np.argpartition(-(kept[a : a + 128] @ x.T), degree - 1, axis=1)[:, :degree] for a in range(0, len(kept), 128)])
    own = router.logits(unit).argmax(1)
    rank = np.argsort(np.argsort(-router.logits(_unit(kept)), axis=1, kind="stable"), axis=1)
    place = np.take_along_axis(rank, own[near], 1).ravel()
    return min(parts, int(np.sort(place)[int(np.ceil(target_recall * len(place))) - 1]) + 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def learn(rows: DataFrame, count: int, sample_rows: int = SAMPLE_ROWS, rows_per_part: int = ROWS_PER_PART, target_recall: float = TARGET_RECALL, k: int = DEGREE) -> tuple[Router | None, int, int]:
    """Fit the router on the sample; the sampled vectors' width, and the parts to probe."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return None, 0, 0
    v = lists(sample, "v")
    wide = width(v)
    x = matrix(v, wide)
    kept, x = x[::10], np.delete(x, np.s_[::10], 0)
    parts = max(1, min(max(16, int(count**0.5 / 2)), len(x) // rows_per_part))
    if parts == 1:
        return Router(wide, 1), wide, 1
    unit = _unit(x)
    graph = neighbour_graph(x)
    part = balanced_parts(graph, unit, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    target[np.arange(len(x)), part] += 1
    target /= target.sum(1, keepdims=True)
    router = Router(wide, parts).fit(unit, target)
    return router, wide, probes_needed(router, unit, kept, x, target_recall, k)


def deal(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first block, blocks) of each part: large parts have blocks of their own, the others share blocks of at most that many rows."""
    out, blocks, load = [(0, 1)] * len(counts), 0, most + 1
    for part in np.argsort(-counts, kind="stable").tolist():
        n = int(counts[part])
        if n > most:
            out[part] = (blocks, -(-n // most))
            blocks += out[part][1]
        else:
            if load + n > most:
                blocks, load = blocks + 1, 0
            out[part], load = (blocks - 1, 1), load + n
    return out


def few_of_equal(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: of equal vectors those of the smallest ids, `most` of them."""
    odd = np.random.default_rng(9).integers(1, 1 << 62, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (np.ascontiguousarray(x).view(np.uint64) * odd).sum(1, dtype=np.uint64)
    order = np.lexsort((ids, key))
    same = np.zeros(len(order), bool)
    same[1:] = (x[order[1:]] == x[order[:-1]]).all(1)
    begin = np.flatnonzero(~same)
    nth = np.arange(len(order)) - begin[np.cumsum(~same) - 1]
    return np.sort(order[nth < most])


def nearest(ids: np.ndarray, x: np.ndarray, asking: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of each query's k best rows of x: larger score first, then smaller id. The query's own id is left out.

    Products of matrices choose candidates, with room for their rounding; the score of a pair is
    then summed in one order, whatever the block's shape.
    """
    lengths = np.linalg.norm(x, axis=1).max(initial=0.0)
    who, what, scores = [], [], []
    for a in range(0, len(q), 64):
        near = q[a : a + 64] @ x.T
        near[asking[a : a + 64, None] == ids[None, :]] = -np.inf
        room = 1e-12 * lengths * np.linalg.norm(q[a : a + 64], axis=1)
        cut = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(near), -np.inf)
        for i in range(len(near)):
            j = np.flatnonzero((near[i] >= cut[i] - room[i]) & (near[i] > -np.inf))
            score = (q[a + i] * x[j]).sum(1)
            first = np.lexsort((ids[j], -score))[:k]
            who.append(np.full(len(first), a + i))
            what.append(ids[j[first]])
            scores.append(score[first])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(who, np.int64), join(what, np.int64), join(scores, float)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, rows_per_part: int = ROWS_PER_PART, target_recall: float = TARGET_RECALL, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. probes: parts to search instead of those that target_recall takes."""
    rows = usable(vectors, id_col, vector_col, zero=False)
    asked = usable(queries, id_col, vector_col, zero=False).groupBy("vec_id").agg(F.min("v").alias("v"))
    router, wide, enough = learn(rows, vectors.select(id_col).count(), sample_rows, rows_per_part, target_recall, k)
    if router is None:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    parts = len(router.w[3])

    def routed(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                top = np.argsort(-router.logits(_unit(matrix(batch.column("v"), wide))), axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(list(top), pa.list_(pa.int64()))], ["vec_id", "v", "parts"])

        return run

    schema = "vec_id long, v array<double>, parts array<long>"
    own = rows.mapInArrow(routed(1), schema).select("vec_id", "v", F.element_at("parts", 1).alias("part"))
    wanted = asked.mapInArrow(routed(min(parts, probes or enough)), schema)

    def number(df: DataFrame) -> np.ndarray:
        """Rows of each part: one row a part comes to the driver, and parts are bounded by the sample."""
        out = np.zeros(parts, np.int64)
        for part, n in df.groupBy("part").count().collect():
            out[part] = n
        return out

    # at least a block for each core
    held = number(own)
    most = max(1, min(block_rows, -(-int(held.sum()) // rows.sparkSession.sparkContext.defaultParallelism)))
    places = deal(held, most)
    asks = number(wanted.select(F.explode("parts").alias("part")))
    askers: dict[int, int] = {}
    for part, (first, n) in enumerate(places):
        for b in range(first, first + n):
            askers[b] = askers.get(b, 0) + int(asks[part])
    askers = {b: max(1, -(-n // block_queries)) for b, n in askers.items()}
    of_part = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(n).alias("blocks"), F.lit(askers[a]).alias("askers")) for a, n in places])
    place = lambda n, *salt: F.pmod(F.xxhash64("vec_id", *salt), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
    own = own.withColumn("at", F.get(of_part, F.col("part").cast("int"))).withColumn("block", F.col("at.first") + place(F.col("at.blocks"), F.monotonically_increasing_id())).select("vec_id", "v", "part", "block", F.explode(upto(F.col("at.askers"))).alias("asker"))
    spots = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.transform(upto(F.get(of_part, p.cast("int"))["blocks"]), lambda b: F.struct((F.get(of_part, p.cast("int"))["first"] + b).alias("block"), F.get(of_part, p.cast("int"))["askers"].alias("askers"))))))
    wanted = wanted.withColumn("spot", F.explode(spots)).select("vec_id", "v", "parts", F.col("spot.block").alias("block"), place(F.col("spot.askers")).alias("asker"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        v, w = lists(left, "v"), lists(right, "v")
        most = width(v, w)
        ids, part, asking = (t.column(c).to_numpy() for t, c in ((left, "vec_id"), (left, "part"), (right, "vec_id")))
        q, probed = matrix(w, most), matrix(lists(right, "parts"), width(lists(right, "parts"))).astype(np.int64)
        x = matrix(v, most)
        keep = few_of_equal(ids, x, k + 1) if len(ids) else np.zeros(0, np.int64)
        ids, part, x = ids[keep], part[keep], x[keep]
        found = []
        for p in np.unique(part).tolist():
            mine, his = np.flatnonzero(part == p), np.flatnonzero((probed == p).any(1))
            if len(his):
                i, vec, score = nearest(ids[mine], x[mine], asking[his], q[his], k)
                found.append(np.rec.fromarrays([his[i], vec, score], names="q,id,score"))
        if not found:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        every = np.concatenate(found)
        every = every[np.lexsort((every["id"], -every["score"], every["q"]))]
        begin = np.searchsorted(every["q"], every["q"])
        every = every[np.arange(len(every)) - begin < k]
        return pa.table({"query_id": asking[every["q"]], "vec_id": every["id"], "score": every["score"]})

    found = own.groupBy("block", "asker").cogroup(wanted.groupBy("block", "asker")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return best(found, k)


def approximate_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, **options) -> DataFrame:
    """The queries are the rows whose vec_id is divisible by every."""
    return search(vectors, vectors.where(divisible(every)), k, **options)
