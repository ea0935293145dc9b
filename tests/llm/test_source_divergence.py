import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
from stratum.llm.source_divergence import Counted, source_divergence
from stratum.llm.tries import RadixTrie, packed, unpacked

from .common import SF, empty, odd


def test_trie_holds_terms_in_byte_order():
    draw = random.Random(3)
    terms = ["".join(draw.choice("abé漢") for _ in range(draw.randint(0, 7))).encode() for _ in range(3000)]
    trie, numbers = RadixTrie(), {}
    for t in terms:
        assert trie.leaf(t) == numbers.setdefault(t, len(numbers))
    found = list(trie.walk())
    assert [x[:2] for x in found] == sorted(numbers.items())
    whole = [t for t, _, _ in found]
    assert all(t[:n] == before[:n] for before, (t, _, n) in zip(whole, found[1:]))
    assert list(unpacked(*packed(whole, [n for _, _, n in found]))) == whole
    assert list(unpacked(*packed(whole[50:60], [n for _, _, n in found[50:60]]))) == whole[50:60]


def test_subtries_merge_to_the_trie_of_all_terms():
    parts = [["romane", "romanus", "rom", "é"], ["romulus", "romane", "x" * 5000, ""]]
    whole = Counted()
    for n, terms in enumerate(parts):
        one = Counted()
        leaves = np.array([one.trie.leaf(t.encode()) for t in terms])
        one.counts.add(leaves, np.full(4, one.group("en", "ab"[n])), np.arange(4) + 1)
        one.docs.add(leaves, np.full(4, one.group("en", "ab"[n])), np.ones(4, np.int64))
        for row in one.subtries(2):
            whole.take(row)
    assert [t.decode() for t, _, _ in whole.trie.walk()] == sorted({t for terms in parts for t in terms}, key=str.encode)
    at, group, count = whole.counts.by_leaf(whole.trie.size)
    leaf = whole.trie.leaf(b"romane")
    assert dict(zip(group[at[leaf] : at[leaf + 1]].tolist(), count[at[leaf] : at[leaf + 1]].tolist())) == {whole.group("en", "a"): 1, whole.group("en", "b"): 2}


def plain(docs, least=3, top=200):
    """The contract, read literally, on (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        holders[lang or ""].update(set(found))
    rows = []
    for lang in holders:
        kept = [t for t, n in holders[lang].items() if n >= least]
        v, groups = len(kept), [s for k, s in counts if k == lang]
        share = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + v)
        by = {s: {t: counts[lang, s][t] for t in kept} for s in groups}
        p = {s: {t: share(c, sum(by[s].values())) for t, c in by[s].items()} for s in groups}
        whole = {t: sum(by[s][t] for s in groups) for t in kept}
        q = {t: share(c, sum(whole.values())) for t, c in whole.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                rows += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(rows)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_documents(spark):
    docs = odd(spark)
    assert result(source_divergence(docs)) == plain([(r.text, r.lang, r.source) for r in docs.collect()])


@pytest.mark.parametrize("bounds", [{}, {"trie_leaves": 20, "range_entries": 15, "block": 7, "cells": 9}])
def test_random_documents_equal_plain_counting(spark, bounds):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcé漢Z") for _ in range(draw.randint(1, 5))) for _ in range(120)] + ["deep" * 40 + "x", "deep" * 40 + "y"]
    rows = []
    for i in range(400):
        text = " ".join(draw.choice(words[: 30 + 9 * (i % 10)]) for _ in range(draw.randint(0, 40)))
        rows.append((text, draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "é", None])))
    rows += [("only here", "fr", "a"), (None, "fr", "b"), ("", "it", "x")] + [("tie gate", "nl", s) for s in "ab" for _ in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(source_divergence(docs, top=12, **bounds)) == plain(rows, top=12)


def test_frequent_word_is_one_leaf_a_task(spark):
    rows = [("same " * 50 + f"word{i % 7}", "en", f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert result(source_divergence(docs)) == plain(rows)


def test_empty_table(spark):
    assert source_divergence(empty(spark)).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = __spark_entry__.queries()["op12_source_divergence"](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()["op12_source_divergence"])
    assert got.columns == want.columns
    assert result(got) == sorted(want.fetchall())
