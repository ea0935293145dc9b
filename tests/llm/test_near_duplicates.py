import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from stratum.llm import near_duplicates as near_duplicates_module
from stratum.llm.components import connected_components
from stratum.llm.near_duplicates import linked, near_duplicates

from .common import SF, empty, odd

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, k, percent):
    """Classes by comparing all pairs."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(_LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted((str(r.doc_id), len(sets[i]), str(least.get(find(i)) if sets[i] else r.doc_id)) for i, r in enumerate(rows))


def found(df, **options):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(df, **options).collect())


def family(spark, seed, groups=6, size=14, words=60):
    """Groups of near copies of all degrees, chains, shared passages and exact copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(400)]
    passage = rng.choices(vocabulary, k=25)
    rows, texts = [], []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(size):
            kind = rng.random()
            if kind < 0.2 and texts:
                base = rng.choice(texts).split()
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if kind > 0.8:
                copy = copy + passage
            if kind > 0.95:
                copy = copy[: rng.randrange(1, 8)]
            text = " ".join(copy)
            texts.append(text)
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    for seed in range(3):
        docs = family(spark, seed)
        want = brute(docs.collect(), k, percent)
        assert found(docs, k=k, percent=percent) == want
        assert found(docs, k=k, percent=percent, block_shingles=300, docs_per_bucket=7) == want


def test_pairs_are_verified_once_they_share_enough_prefix_shingles(monkeypatch):
    """A pair that shares fewer than min(l, l') prefix shingles is never verified, and all links are found by pairs that share so many."""
    rng = np.random.default_rng(3)
    sets, prefixes = [], []
    for i in range(120):
        base = rng.integers(0, 1 << 30, 40).astype(np.uint64) if i % 6 == 0 else sets[i - i % 6].copy()
        base[rng.integers(0, 40, i % 3)] = rng.integers(0, 1 << 30, i % 3)
        base[:2] = (5, 7)  # shingles that all sets hold
        sets.append(np.unique(base))
        prefixes.append(sets[-1][: len(sets[-1]) - -(-90 * len(sets[-1]) // 100) + 2])
    matches, verified = np.full(len(sets), 2), []
    plain = near_duplicates_module.linked

    def watched(a, b, percent):
        verified.append((a, b))
        return plain(a, b, percent)

    monkeypatch.setattr(near_duplicates_module, "linked", watched)
    links = near_duplicates_module.forest(sets, prefixes, matches, 90)
    assert all(len(np.intersect1d(prefixes[i], prefixes[j])) >= 2 for i, j in links)
    where = {id(s): i for i, s in enumerate(sets)}
    assert all(len(np.intersect1d(prefixes[where[id(a)]], prefixes[where[id(b)]])) >= 2 for a, b in verified)
    parent = list(range(len(sets)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i, j in links:
        parent[find(i)] = find(j)
    assert all(find(i) == find(j) for i in range(len(sets)) for j in range(i) if plain(sets[i], sets[j], 90))


def test_large_group_of_copies_costs_few_verifications(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 60, 1).astype(np.uint64)])) for _ in range(800)]
    verified = []
    plain = near_duplicates_module.linked
    monkeypatch.setattr(near_duplicates_module, "linked", lambda a, b, p: verified.append(1) or plain(a, b, p))
    prefixes = [np.sort(base)[:9] for _ in sets]
    assert len(near_duplicates_module.forest(sets, prefixes, np.full(800, 3), 90)) == 799 and len(verified) == 799


def test_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs, k=3, percent=90) == brute(docs.collect(), 3, 90)


def test_odd_rows(spark):
    assert found(odd(spark), k=3, percent=90) == brute(odd(spark).collect(), 3, 90)
    assert found(empty(spark)) == []


def test_words_that_defeat_polynomial_hashes(spark):
    """Words of the Thue-Morse kind are different words."""
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    docs = spark.createDataFrame([(1, bits), (2, bits.translate(str.maketrans("ab", "ba"))), (3, bits.upper()), (4, f"{bits} x y"), (5, f"{bits} x y")], "doc_id long, text string")
    assert found(docs, k=3, percent=90) == [("1", 1, "1"), ("2", 1, "2"), ("3", 1, "1"), ("4", 1, "4"), ("5", 1, "4")]


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    """Groups far beyond a block's size: near copies of one text, and texts that share a passage but are not alike."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=5))
    base, passage = [word() for _ in range(80)], [word() for _ in range(30)]
    near = [[*base[:i], word(), *base[i + 1 :]] for i in (rng.randrange(80) for _ in range(150))]
    other = [[*passage, *(word() for _ in range(25))] for _ in range(100)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*near, *other, *near[:40]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(docs.collect(), 3, 90)
    for options in ({"block_shingles": 1000, "parcel": 2000}, {"block_shingles": 1000, "star_rounds": 1}):
        assert found(docs, k=3, percent=90, **options) == want


def test_blocks_of_a_large_component_do_not_multiply_its_sets(spark):
    """A component a hundred times as large sends each set ten times as often, and any two sets meet in one bin, once."""
    copies = lambda total: spark.range(1).select(F.lit("h").alias("home"), F.lit("x").alias("fp"), F.lit(total).cast("long").alias("total")).select(F.size(near_duplicates_module._bins(1000))).first()[0]
    assert copies(1000) == 1 and copies(5_000) == 4 and copies(500_000) == 32
    assert copies(4_000_000_000) >= 4_000_000_000 // near_duplicates_module.BLOCK_MOST
    dealt = spark.range(60).select(F.lit("h").alias("home"), F.col("id").cast("string").alias("fp"), F.lit(9000).cast("long").alias("total"))
    dealt = dealt.select("fp", F.explode(near_duplicates_module._bins(1000)).alias("to")).select("fp", "to.*").toPandas()
    met = [(a.fp, b.fp) for _, own in dealt.groupby("bin") for a in own.itertuples() for b in own.itertuples() if a.fp < b.fp and (a.side != b.side or a.side == 0)]
    assert len(met) == len(set(met)) == 60 * 59 // 2


def test_shingles_are_counted_in_packed_rows(spark, monkeypatch):
    """A row for each bucket of a batch of sets, not for each shingle; the counts are those of all sets together."""
    monkeypatch.setattr(near_duplicates_module, "SHARED_SHINGLES", 2000)
    rng = np.random.default_rng(8)
    sets = {f"{i:032x}"[::-1]: np.unique(rng.integers(0, 3000, rng.integers(1, 90)).astype(np.uint64)) for i in range(1, 120)}
    batch = pa.RecordBatch.from_pydict({"fp": list(sets), "shingles": [x.tobytes() for x in sets.values()]})
    packed = pa.Table.from_batches(list(near_duplicates_module._shared(3)(iter([batch]))))
    assert packed.num_rows <= 3 * (1 + sum(map(len, sets.values())) // 2000)
    own = {}
    for bucket in range(3):
        table = near_duplicates_module._owned(packed.filter(pc.equal(packed["bucket"], bucket)))
        for holder, n in zip(table["holder"].to_pylist(), table["own"].to_pylist()):
            own[holder.hex()] = own.get(holder.hex(), 0) + n
    held = Counter(np.concatenate(list(sets.values())).tolist())
    want = {fp[:24]: sum(held[x] == 1 for x in s.tolist()) for fp, s in sets.items()}
    assert own == {fp: n for fp, n in want.items() if n}


def test_texts_are_found_again_without_a_shuffle(spark):
    """Texts of many sets are read again by a broadcast of few rows, also where a list of their keys is too long for one."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.xxhash64("id").alias("key"))
    rows = near_duplicates_module.written(rows, "rows")
    wanted = near_duplicates_module.written(rows.where("doc_id % 3 = 0").select("doc_id", "key"), "wanted")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30k")
    try:
        found = near_duplicates_module._read_again(rows, wanted)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in found.collect()} == set(range(0, 20_000, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    odd_ids = spark.createDataFrame([(None, "a", 1), (None, "b", 2), (0, "c", 3), (-1, "d", 4), (-64, "e", 5), (63, "f", 6)], "doc_id long, text string, key long")
    assert sorted(r.text for r in near_duplicates_module._read_again(odd_ids, odd_ids.where("key in (2, 4, 6)").select("doc_id", "key")).collect()) == ["b", "d", "f"]


def test_kept_rows(spark):
    """One row of each class is kept, also of classes without doc_id; rows without words stay."""
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text), (3, text), (3, text), (None, text), (None, "x y z"), (None, "x y z"), (8, ""), (8, None)], "doc_id long, text string")
    rows = near_duplicates(docs, k=3, percent=90, tag=F.xxhash64("doc_id", "text")).where("kept").select("doc_id", "component_id", "tag").distinct().collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("3", "3"), ("8", "8"), ("8", "8"), ("None", "None")]


def test_linked():
    s = lambda *x: np.array(x, np.uint64)
    nine, ten = np.arange(9, dtype=np.uint64), np.arange(10, dtype=np.uint64)
    assert linked(nine, ten, 90) and not linked(nine[:8], ten, 90) and linked(s(1), s(1), 100) and not linked(s(1), s(2), 50)


def test_components(spark):
    rng = random.Random(1)
    edges = [(str(a), str(b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220))] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    met = {x for e in edges if e[0] != e[1] for x in e}
    want = {x: find(x) for x in met}
    frame = spark.createDataFrame(edges, "u string, v string").repartition(7)
    for chunk in (500_000, 40):
        assert {r.node: r.root for r in connected_components(frame, chunk).collect()} == want
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
