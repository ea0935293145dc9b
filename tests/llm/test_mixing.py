import re

import pytest
from pyspark.sql import functions as F

from stratum.llm import mixing

from .common import SF, empty, odd


def water(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    limit, total, full = {s: 3 * n for s, n in sizes.items()}, sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] > limit[s] + 1e-9]
        if not over:
            return full | share
        full |= {s: limit[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 5, "c": 1000}, {"b": 10, None: 3, "a": 90, "z": 0}, {"é": 50, "z": 2, "Z": 40, "a": 3}, {"only": 7}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert found == pytest.approx(water(sizes))


def check(docs, rows):
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d.doc_id), words(d.text)) for d in docs)
    sizes, got, most = {}, {}, {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + words(d.text)
    want = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        got[r.source] = got.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    return want, got, most


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "taken")
    rows = mixing.mix(docs).collect()
    want, got, most = check(docs.collect(), rows)
    assert all(abs(want[s] - got[s]) <= most[s] for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_many_documents_hit_the_target(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat(repeat('w ', cast(5 + id % 90 as int)), id) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 4) end as source")
    want, got, most = check(docs.collect(), mixing.mix(docs).collect())
    assert all(abs(want[s] - got[s]) <= 60 for s in want)


def test_expected_copies_stay(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', 10) as text", "case when id < 100 then 'a' else 'b' end as source")
    total = {}
    for seed in range(6):
        for r in mixing.mix(docs, seed=100 + 10 * seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
    assert sum(v for k, v in total.items() if k < 100) / 600 == pytest.approx(400 / 3 / 100, abs=0.01)
    assert len({total[i] for i in range(100)}) > 2


def test_odd_rows(spark):
    docs = odd(spark)
    check(docs.collect(), mixing.mix(docs).collect())
    assert mixing.mix(empty(spark)).collect() == []
    taken = {}
    for r in mixing.copies(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    back = mixing.mix_rows(docs)
    assert back.columns == docs.columns
    number = {}
    for r in back.collect():
        number[r.doc_id] = number.get(r.doc_id, 0) + 1
    assert number == {k: v for k, v in taken.items() if v}
    assert mixing.mix_rows(empty(spark)).collect() == []


def test_a_very_long_document_in_a_small_source(spark):
    """What the long one misses is made up for by all shorter ones, not by the shorter half alone."""
    sizes = [(i, 20 + (i * i) % 37 if i % 2 else 100 + (i * 97) % 301) for i in range(120)] + [(1000, 8000)]
    rows = [(i, "w " * n, "a") for i, n in sizes] + [(2000 + i, "w " * 500, "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (20, 21, 22):
        found = mixing.mix(docs, seed=seed).collect()
        want, got, _ = check(docs.collect(), found)
        assert abs(want["a"] - got["a"]) <= 30
        short = [r.copies for r in found if r.source == "a" and r.size < 100]
        assert 0 < sum(c == min(short) for c in short) < len(short)


def test_many_equal_rows(spark):
    """A third of all rows are equal: they are rounded one by one, in different groups, and reruns agree."""
    docs = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'one two three four', concat(repeat('w ', cast(id % 50 as int)), id)) as text", "if(id % 3 = 0, 'a', concat('s', id % 2)) as source")
    rows = mixing.mix(docs.repartition(5)).collect()
    want, got, _ = check(docs.collect(), rows)
    assert all(abs(want[s] - got[s]) <= 50 for s in want)
    equal = [r.copies for r in rows if r.doc_id == 7 and r.source == "a"]
    assert max(equal) - min(equal) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def test_many_sources(spark):
    """Ranks and levels of as many sources as documents, against sharing again and again."""
    sizes = {f"s{i:04d}": 1 + i * i % 97 for i in range(1200)} | {None: 5}
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(6)).collect()}
    assert found == pytest.approx(water(sizes))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2], i, "x", i) for i in range(60)], "doc_id long, text string, source string, rid long, _RID string, copy int")
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    back = mixing.mix_rows(docs)
    assert back.columns == docs.columns
    rows = back.collect()
    assert all(r.rid == r.doc_id == r.copy for r in rows)
    assert {i: n for i, n in taken.items() if n} == {i: sum(r.doc_id == i for r in rows) for i in {r.doc_id for r in rows}}


def test_a_long_document_is_rounded_to_the_side_that_others_make_up_for(spark):
    """On the table a source's long document may miss on one side only; every source comes near its target."""
    docs = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for r in docs.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.005 * r.target
