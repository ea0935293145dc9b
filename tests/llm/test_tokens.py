import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratum.llm import packing, token_files
from stratum.llm.common import shared_dir, tokenizer_path
from stratum.llm.textops import Words, WordTable, buffers
from stratum.llm.tokens import encoder

from .common import SF, empty, odd

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def own(texts):
    ids, at = encoder(PATH).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


ODD_TEXTS = ["İstanbul ΣΑΣ Σ a\xa0b c", "it's we'LL 'tis ''s don't", "Ǆ 12³ é é ≠ x", "<|endoftext|> \x85\x1c\x00q", "ÀÉÎ×÷ĀŽ ß»,«", "", None, "a.b,c--d 1a2b !?", "日本語 テキスト", "\U0001f600x \U0001f600"]


def test_ids_are_the_library_s(library):
    assert own(ODD_TEXTS) == [library(t) for t in ODD_TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("aAéÉ '.,!19ßİ×́\n\t|", max_size=20), max_size=6))
def test_ids_of_any_text(texts):
    t = Tokenizer.from_file(PATH)
    assert own(texts) == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_ids_of_all_code_points():
    """Also of those newer than any library's tables."""
    t = Tokenizer.from_file(PATH)
    points = [c for c in [*range(0x32000), *range(0x32000, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 20_000):
        texts = [f":{chr(c)}a 1{chr(c)}" for c in points[a : a + 20_000]]
        assert own(texts) == [x.ids + [2] for x in t.encode_batch(texts, add_special_tokens=False)]


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 16, 32, 64, 2048, 1 << 21])
def test_words_that_defeat_polynomial_hashes(n, library):
    a, b = thue_morse(n)
    h = Words(*buffers(pa.array([a, b, a.upper()]))).hashes(lower=True)
    assert h[0] != h[1] and h[0] == h[2]
    if n <= 2048:
        assert own([a, b, f"{b} {a}"]) == [library(x) for x in (a, b, f"{b} {a}")]


def test_word_tables_compare_bytes(monkeypatch):
    """Words are told apart where all hashes collide."""
    monkeypatch.setattr(Words, "hashes", lambda self, lower=False: (self.ends - self.starts).astype(np.uint64) % np.uint64(2))
    texts = ["ab cd ab abcd", "cd abcdefghi abcdefghj", "x" * 40 + " " + "x" * 39 + "y " + "x" * 40, "", "ab cd ef"]
    kept = []
    table = WordTable(kept.extend, kept.clear, most=7)
    for _ in range(3):
        words = Words(*buffers(pa.array(texts)))
        got = [kept[i].decode() for i in table.records(words)]
        assert got == " ".join(texts).split()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text("ab \t\n\x0b\x0cé", max_size=12), max_size=6))
def test_words(texts):
    words = Words(*buffers(pa.array(texts, pa.string())))
    got = [words.buf[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
    assert got == [w for t in texts for w in (t or "").encode().split()]
    assert np.diff(words.first).tolist() == [len((t or "").encode().split()) for t in texts]
    h = words.hashes()
    assert all((h[i] == h[j]) == (got[i] == got[j]) for i in range(len(h)) for j in range(i))


def check_digest(rows, docs, library):
    rows = sorted(rows, key=lambda r: (r.start, r.doc_id is not None))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert [r.doc_id for r in rows] == sorted((d.doc_id for d in docs), key=lambda i: (i is not None, i or 0))
    crc = lambda t: zlib.crc32(np.array(library(t), "<u4"))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(d.doc_id), len(library(d.text)), crc(d.text)) for d in docs)


@pytest.mark.parametrize("per_file", [20_000, 1 << 27])
def test_token_files(spark, library, per_file):
    same = spark.createDataFrame([(5, "equal rows")] * 40 + [(6, "others")], "doc_id long, text string")
    for docs in (odd(spark), same, spark.read.parquet(f"{SF}/documents.parquet")):
        check_digest(token_files.tokens_round_trip(spark, docs, bytes_per_file=per_file).collect(), docs.collect(), library)
    assert token_files.tokens_round_trip(spark, empty(spark)).collect() == []


def rows_scanned(df):
    """Rows that the scan of an executed query put out."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_token_files_prune_and_round_trip(spark, library):
    """Files, stripes and row groups without the wanted document are not read; Bloom filters tell where the range of ids does not."""
    docs = spark.range(6000).selectExpr("2 * id as doc_id", "concat('word ', id, repeat(' more', cast(id % 40 as int))) as text").repartition(3)
    path = f"{shared_dir(spark)}/t"
    token_files.write_tokens(docs, path, bytes_per_file=250_000, stripe_bytes=20_000)
    tokens = token_files.read_tokens(spark, path)
    files = tokens.select("part").distinct().count()
    assert files > 1
    stripes = [pyarrow.orc.ORCFile(f).nstripes for f in glob.glob(f"{path.removeprefix('file:')}/*.orc")]
    assert len(stripes) == files and sum(stripes) > files
    for wanted, found in ((3000, 1), (3001, 0)):
        one = tokens.where(f"doc_id = {wanted}")
        assert "EqualTo(doc_id,3000)".replace("3000", str(wanted)) in one._jdf.queryExecution().executedPlan().toString()
        one = tokens.where(f"doc_id = {wanted}").select("doc_id", "ids")
        rows = one.collect()
        assert len(rows) == found and rows_scanned(one) <= found * token_files.ROW_INDEX_STRIDE
        assert all(list(r.ids) == library(docs.where(f"doc_id = {wanted}").first().text) for r in rows)


def check_pack(pieces, docs, library, capacity=4096):
    want = sorted((str(d.doc_id), library(d.text)) for d in docs)
    texts = {}
    for k, ids in want:
        texts.setdefault(k, []).append(np.array(ids, "<u4"))
    for p in pieces:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length]) == p.ids_crc32 for x in texts[str(p.doc_id)])
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in want)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by


def padding(by, capacity=4096):
    """Tokens added to the sequences, which have the capacity's length unless theirs is a power of two."""
    lengths = [sum(p.length for p in own) for own in by.values()]
    return sum(capacity - n for n in lengths if n & (n - 1))


def test_short_documents_leave_no_padding(spark, library):
    rng = np.random.default_rng(2)
    for texts in (["word"] * 3000, ["a few words " * int(n) for n in rng.integers(1, 6, 3000)], ["one", "a longer text " * 300, ""] * 200):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        pieces = packing.pack(docs).collect()
        by = {}
        for p in pieces:
            by.setdefault(p.sequence_id, []).append(p)
        assert padding(by) == 0
        assert sum(p.length for p in pieces) == sum(len(x) for x in map(library, texts))
        lengths = [sum(p.length for p in own) for own in by.values()]
        assert sum(n < 4096 for n in lengths) <= 12


def test_packing(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = check_pack(packing.pack(docs).collect(), docs.collect(), library)
    assert padding(by) == 0
    check_pack(packing.pack(odd(spark), capacity=64, docs_per_group=3).collect(), odd(spark).collect(), library, 64)
    assert packing.pack(empty(spark)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=60))
def test_balance(sizes):
    found = packing.balance(np.array(sizes, np.int64), 100)
    covered = [set() for _ in sizes]
    full = {}
    for i, start, n, s, offset in found:
        assert covered[i].isdisjoint(range(start, start + n))
        covered[i].update(range(start, start + n))
        assert offset == full.get(s, 0)
        full[s] = offset + n
    assert [len(c) for c in covered] == sizes
    short = [n for n in full.values() if n != 100]
    assert all(n < 100 and n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


def test_balance_takes_the_cheapest():
    first = {i: s for i, start, n, s, offset in packing.balance(np.array([50, 40, 10, 10, 10, 80]), 100) if start == 0}
    assert first[5] != first[0] and first[1] == first[0]


def test_added_tokens_are_the_library_s():
    plain = Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> y", None, "a b", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|> <|StartOfText|>", "", "<|endoftext|>\u0338 é", "<|endoftext| >", "<|endoftext|>"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own(texts) == [ids + [2] for ids in want]
    ids, at = encoder(PATH).encode(pa.array(texts, pa.string()), None)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_balance_cuts_only_what_fits_nowhere():
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(1500, 4000, 400), rng.integers(1, 900, 900)])
    found = packing.balance(sizes, 4096)
    total = int(sizes.sum())
    room = np.array([4096] * (total // 4096) + [1 << k for k in range(11, -1, -1) if total >> k & 1])
    for i, start, n, s, _ in found:
        assert start + n == sizes[i] or room.max() < sizes[i] - start
        room[s] -= n
