import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
from stratum.llm.repeated_passages import LENGTH, PIECE, anchors, repeated_passages, repeated_passages_digest
from stratum.llm.run_length_index import RunLengthIndex, suffix_order

from .common import SF, empty, odd


def strings_of(draw):
    base = bytes(draw.choice(b"ab\x00\xff") for _ in range(12))
    for _ in range(draw.randint(1, 6)):
        s = bytearray(base * draw.randint(1, 3))
        for _ in range(draw.randint(0, 2)):
            s[draw.randrange(len(s))] = draw.choice(b"ab\x00c")
        yield bytes(s[draw.randint(0, 3) : draw.randint(4, len(s))])


def longest(strings, classes):
    """Matching statistics by comparing all pairs of places."""
    places = [(x, i) for x, s in enumerate(strings) for i in range(len(s))]
    for x, i in places:
        best = 0
        for y, j in places:
            if classes[x] == classes[y] and (x, i) != (y, j):
                k = 0
                while i + k < len(strings[x]) and j + k < len(strings[y]) and strings[x][i + k] == strings[y][j + k]:
                    k += 1
                best = max(best, k)
        yield best


def test_index_gives_order_and_matching_statistics():
    draw = random.Random(2)
    for _ in range(150):
        strings = list(strings_of(draw))
        classes = np.array(sorted(draw.randint(0, 2) for _ in strings))
        data, at = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        own = np.repeat(np.arange(len(strings)), np.diff(at))
        want = sorted(range(len(data)), key=lambda i: (classes[own[i]], strings[own[i]][i - at[own[i]] :], own[i]))
        assert suffix_order(data, at, classes).tolist() == want
        assert RunLengthIndex(data, at, classes).matching_statistics().tolist() == list(longest(strings, classes))


def test_repetitive_strings_have_few_runs():
    base = np.random.default_rng(1).integers(97, 123, 600).astype(np.uint8)
    strings = []
    for i in range(50):
        s = base.copy()
        s[i * 7] = 65
        strings.append(s)
    index = RunLengthIndex(np.concatenate(strings), np.arange(51) * 600, np.zeros(50, np.int64))
    assert index.runs < 30000 / 10
    assert RunLengthIndex(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)).matching_statistics().tolist() == []


def test_each_window_has_one_anchor_that_its_bytes_decide():
    draw = np.random.default_rng(4)
    texts = [draw.integers(97, 100, n).astype(np.uint8) for n in (10, 400, 0, 1500, 399)] + [np.full(900, 120, np.uint8)]
    buf, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen = {}
    for doc, a, b, p in anchors(buf, offsets, 400, 344):
        for d, i, j, k in zip(doc.tolist(), a.tolist(), b.tolist(), p.tolist()):
            for s in range(i, j + 1):
                assert s not in seen and offsets[d] <= s <= offsets[d + 1] - 400 and s <= k < s + 344
                seen[s] = k - s
    assert len(seen) == sum(max(0, len(t) - 399) for t in texts)
    again = np.concatenate([buf[1000:1400], buf])
    moved = {s: k - s for _, a, b, p in anchors(again[:400], np.array([0, 400]), 400, 344) for s, k in zip(a.tolist(), p.tolist())}
    if 1000 in seen:
        assert moved[0] == seen[1000]


def plain(docs, length):
    """The contract, read literally."""
    bodies = [(i, (t or "").encode()) for i, t in docs]
    windows = Counter(b[s : s + length] for _, b in bodies for s in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if windows[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def digest(rows):
    """Rows of the operator in the query's form, and whether spans and kept bytes agree."""
    return sorted(((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


def test_odd_documents(spark):
    docs = odd(spark)
    assert sorted((tuple(r) for r in repeated_passages_digest(docs).collect()), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()], LENGTH)


def corpus(draw, n):
    """Texts with near copies, shared passages at any place, periods and copies."""
    word = lambda: "".join(draw.choice("abcé漢 ") for _ in range(draw.randint(1, 6)))
    passages = [" ".join(word() for _ in range(draw.randint(5, 40))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(draw.randint(0, 25))) for _ in range(3)]
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            parts.insert(draw.randint(0, 3), p[draw.randint(0, 10) : draw.randint(20, len(p))])
        text = "".join(parts)
        if i % 7 == 3:
            text = "ab" * draw.randint(10, 60)
        if i % 5 == 4 and out:
            text = list(draw.choice(out)[1] or "")
            for _ in range(draw.randint(0, 2)):
                if text:
                    text[draw.randrange(len(text))] = draw.choice("xyz")
            text = "".join(text)
        out.append((i if i % 11 else None, text))
    return out


@pytest.mark.parametrize("bounds", [{}, {"key_contexts": 2, "ranges": (6, 1)}, {"key_contexts": 1, "ranges": (1,)}, {"bin_bytes": 500}])
def test_passages_equal_comparing_all_windows(spark, bounds):
    rows = corpus(random.Random(8), 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(repeated_passages(docs, length=40, span=24, **bounds).collect()) == plain(rows, 40)


def test_passage_within_very_many_texts_is_split(spark):
    draw = random.Random(9)
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage, short = noise(450), noise(300)
    rows = [(i, noise(200) + (passage if i % 2 else short) + noise(200)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(repeated_passages(docs, key_contexts=20).collect()) == plain(rows, LENGTH)


def test_text_longer_than_a_piece(spark):
    draw = np.random.default_rng(3)
    long = draw.integers(97, 123, PIECE + 5000).astype(np.uint8).tobytes().decode()
    rows = [(1, long), (2, long[PIECE - 700 : PIECE + 900]), (3, long[10:409]), (4, long[-500:] + "z" * 300)]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].spans] == [(PIECE - 700, PIECE + 900), (PIECE + 4500, PIECE + 5000)]
    assert [tuple(x) for x in got[2].spans] == [(0, 1600)] and not got[3].spans and [tuple(x) for x in got[4].spans] == [(0, 500)]


def test_empty_table_and_bounds(spark):
    assert repeated_passages_digest(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeated_passages(empty(spark), length=40, span=40)


def test_query_equals_comparing_all_windows(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in __spark_entry__.queries()["op13_repeated_passages"](spark, SF).collect()), key=str)
    assert got == plain(docs, LENGTH)
