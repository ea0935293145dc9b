import math

import numpy as np
import pytest

from stratum.llm import exact_top_k, neighbours

from .common import vectors


def rows_of(seed, n, width=24, whole=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width))
    if whole:
        x = np.round(x * 2) / 2  # many ties
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


def brute(rows, every, k, value):
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = sorted((-value(v, w), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def whole_score(v, w):
    return int(sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)))


ODD = [(50, None), (None, [1.0, 2.0]), (100, [float("nan")] * 4), (150, [1.0, None, 0.0]), (250, [float("inf"), 1.0]), (300, [])]


@pytest.mark.parametrize("whole", [False, True])
def test_exact_top_k(spark, whole):
    rows = [*[r for r in rows_of(1, 400, whole=whole) if r[0] not in (50, 100, 150, 250, 300)], *ODD]
    want = brute(rows, 50, 5, whole_score)
    assert grouped(exact_top_k.exact_top_k(vectors(spark, rows).repartition(3))) == want
    assert grouped(exact_top_k.top_k(vectors(spark, rows), vectors(spark, rows).where("vec_id % 50 = 0"), block_rows=30, block_queries=2)) == want


def test_few_and_none(spark):
    few = [(0, [1.0, -1.0]), (1, [0.5]), (2, [0.0, 0.0])]
    assert grouped(exact_top_k.exact_top_k(vectors(spark, few))) == brute(few, 50, 5, whole_score)
    assert exact_top_k.exact_top_k(vectors(spark, [])).collect() == []
    assert neighbours.approximate_neighbours(vectors(spark, [])).collect() == []
    found = grouped(neighbours.approximate_neighbours(vectors(spark, [*few, (20, [0.0, 0.0])])))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {0: [1]}


def test_bounds_leave_out_work(spark):
    """The share of products worked out: on the table, and where few dimensions hold most of the mass."""
    table = np.floor(256 * np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]))
    rng = np.random.default_rng(2)
    decaying = np.floor(256 * rng.normal(0, 1, (4000, 64)) * 0.85 ** np.arange(64))
    for x, most in ((table, 0.95), (decaying, 0.3)):
        ids = np.arange(len(x))
        found, share = exact_top_k.search(ids[::50], x[::50], ids, x, 5)
        assert share < most
        near = (x[::50] @ x.T).astype(np.int64)
        near[np.arange(len(near)), ids[::50]] = -(1 << 62)
        want = [np.lexsort((ids, -row))[:5].tolist() for row in near]
        assert found.id.tolist() == want
        print(share)


def test_repeated_rows(spark):
    rows = rows_of(2, 60) + rows_of(2, 60)[:10]
    assert len(grouped(exact_top_k.exact_top_k(vectors(spark, rows)))) == 2
    found = grouped(neighbours.approximate_neighbours(vectors(spark, rows)))
    assert all(i != q for q, v in found.items() for i, _ in v)


def recall(found, want):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_neighbours(spark):
    rows = [*[r for r in rows_of(3, 1500) if r[0] not in (50, 100, 150, 250, 300)], *ODD]
    want = brute(rows, 20, 20, lambda v, w: float(np.dot(v, w)))
    for blocks in ({}, {"block_rows": 40, "block_queries": 30}):
        found = grouped(neighbours.approximate_neighbours(vectors(spark, rows).repartition(3), **blocks))
        assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
        assert recall(found, want) >= 0.9
    exact = grouped(neighbours.approximate_neighbours(vectors(spark, rows), probes=99, block_rows=100))
    assert recall(exact, want) == 1.0
    assert all(abs(s - t) < 1e-9 for q in want for (_, s), (_, t) in zip(exact[q], want[q]))


def test_parts_are_balanced_and_learned():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (8, 16))
    x = np.repeat(centres, 100, 0) + rng.normal(0, 0.1, (800, 16))
    part = neighbours.balanced_parts(neighbours.neighbour_graph(x), x / np.linalg.norm(x, axis=1, keepdims=True), 8)
    assert np.bincount(part, minlength=8).max() <= 101
    target = np.eye(8)[part]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (neighbours.Router(16, 8).fit(unit, target).logits(unit).argmax(1) == part).mean() > 0.95


def recall_and_share(spark, rows, **options):
    """Recall of the query, and the share of (query, row) pairs that were met."""
    x = np.array([v for _, v in rows])
    ids, asking = np.arange(len(x)), np.arange(0, len(x), 20)
    near = x[asking] @ x.T
    near[asking[:, None] == ids[None, :]] = -np.inf
    want = {int(q): [(int(i), 0.0) for i in np.lexsort((ids, -row))[:20]] for q, row in zip(asking, near)}
    usable = vectors(spark, rows)
    router, wide, probes = neighbours.learn(usable.selectExpr("vec_id", "cast(embedding as array<double>) as v"), len(rows), k=20)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(router.logits(unit).argmax(1), minlength=len(router.w[3]))
    share = sizes[np.argsort(-router.logits(unit[asking]), 1)[:, :probes]].sum() / (len(asking) * len(x))
    return recall(grouped(neighbours.approximate_neighbours(usable, **options)), want), share


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    got, share = recall_and_share(spark, rows)
    assert got >= 0.9 and share < 0.9


def test_clusters_are_searched_in_few_parts(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 32))
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.3, (6000, 32))).astype(np.float32)
    got, share = recall_and_share(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    assert got >= 0.9 and share < 0.3


def test_recall_where_one_cluster_holds_most(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (20, 32))
    which = np.where(rng.random(6000) < 5 / 6, 0, rng.integers(1, 20, 6000))
    x = (centres[which] + rng.normal(0, 0.3, (6000, 32))).astype(np.float32)
    got, _ = recall_and_share(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    assert got >= 0.93


def test_recall_with_uneven_lengths(spark):
    rng = np.random.default_rng(7)
    x = (rng.normal(0, 1, (5000, 32)) * rng.lognormal(0, 1, (5000, 1))).astype(np.float32)
    got, _ = recall_and_share(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    assert got >= 0.93


def test_equal_vectors(spark):
    """A third of all rows are one vector: each query finds the smallest ids, and no block puts out more than k rows a query."""
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else v) for i, v in rows_of(7, 3000, 3)]
    want = brute(rows, 20, 20, lambda v, w: float(sum(a * b for a, b in zip(v, w))))
    for blocks in ({}, {"block_rows": 60, "block_queries": 40}):
        found = grouped(neighbours.approximate_neighbours(vectors(spark, rows), probes=99, **blocks))
        assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_nearest_at_any_length():
    x = np.array([[1e9, 1.0], [1e9, 2.0], [1e9, 2.0], [-1e9, 0.0]])
    who, what, score = neighbours.nearest(np.array([4, 9, 3, 1]), x, np.array([7]), np.array([[1.0, 1.0]]), 2)
    assert what.tolist() == [3, 9] and score.tolist() == [1e9 + 2] * 2


def test_parts_are_dealt_to_blocks():
    counts = np.array([10, 250, 0, 40, 60, 55])
    places = neighbours.deal(counts, 100)
    load = {}
    for n, (first, blocks) in zip(counts.tolist(), places):
        for b in range(first, first + blocks):
            load[b] = load.get(b, 0) + n / blocks
    assert places[1][1] == 3 and max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
