"""Operator 13: bytes of passages that occur more than once, found with run-length indexes over routed windows.

A byte goes if a window of `length` bytes that covers it also begins anywhere else, in the same text or another. Every window
has one anchor: of the places in its first `span` bytes that whose eight bytes have the smallest hash, the
leftmost of equals. The anchor depends on the window's bytes alone, so equal windows have equal anchors at equal
distances, and are found with the key of their anchor: a hash of the length - span + 1 bytes from there, which every
window of the anchor holds.

1. One pass over the texts gives a row for each anchor: its place, the range of windows that have it, its key and a hash of all
   bytes that these windows cover (the context). Keys that occur once are done: none of their windows repeats.
2. Equal contexts are counted as one string; where it occurs more than once, all its windows do. Where a key has but one
   context that is all there is to know, so exact copies, however many, cost an entry in a partial sum.
3. Keys with several contexts: the distinct contexts are read from one text each and go to bins, each key with all its contexts in
   one. A bin builds the run-compressed Burrows-Wheeler transform of its contexts, with samples at the ends of the runs, and streams
   matching statistics over them; a window repeats if its statistic reaches `length`.
4. Keys with more contexts than a bin takes (a passage within very many texts) are split: windows by their distance from the anchor,
   in ranges, with a key of the longer string that all windows of a range hold, and at last window by window, where the
   string is the window itself and counting settles it. So no key is ever gathered beyond a bin's bound, and none is dropped.

The texts are dealt once, into a bucketed table of the session's catalogue; the reading of contexts and the last step find
them there without another shuffle. Like other intermediate tables it lies in the shared folder and is read by the lazy result.

Windows are in one context each, so a context never meets itself at the same place. Hashes route and count; equal
contexts are taken as equal by 128 bits of hash (that of the key and its own).

Defined cases: null and empty texts and those shorter than a window lose nothing; texts are UTF-8 bytes, and what is kept may
end within a character; a null doc_id is a document like others; repeated rows are copies of each other; very long
texts are worked through in pieces; an empty table gives no row; columns that are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, written
from .run_length_index import RunLengthIndex, _eights
from .textops import buffers, slices

#: Bytes of a window, and its first bytes among which the anchor is chosen.
LENGTH, SPAN = 400, 344
#: Contexts of a key that a bin takes; bytes of a bin; distances of a range when a key is split, from coarse to single ones; windows worked through at once; bytes of texts in a bucket.
KEY_CONTEXTS, BIN_BYTES, RANGES, PIECE, BUCKET_BYTES = 1000, 1_000_000, (32, 1), 1 << 20, 32 << 20
#: width: windows of a context; p: bytes from its first to its anchor; several: whether it stands for more than one string of the corpus.
_CONTEXTS = "key long, ctx long, several boolean, k long, width int, p int, body binary"
_PICKS = "struct<key: bigint, ctx: bigint, several: boolean, k: bigint, width: int, p: int, a: int>"


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, first window, last window and anchor, as places in buf; each window within a text belongs to one row."""
    lasts = offsets[1:] - length
    for x in range(0, len(buf), PIECE):
        y = min(len(buf), x + PIECE)
        piece = buf[x : min(len(buf), y + length)]
        eight = _eights(piece)[: len(piece)]
        h = eight * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(piece), dtype=np.uint64)
        blocks = -(-len(h) // span) + 1
        h = np.concatenate([h, np.full(blocks * span - len(h), 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(blocks, span)
        before = np.minimum.accumulate(h, 1).ravel()
        after = np.minimum.accumulate(h[:, ::-1], 1)[:, ::-1].ravel()
        places = y - x
        least = np.minimum(after[:places], before[span - 1 : span - 1 + places])
        p = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + x
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, x, y)))
        starts = np.flatnonzero(np.arange(x, y) <= lasts[doc]) + x
        if not len(starts):
            continue
        p, doc = p[starts - x], doc[starts - x]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])]))
        yield doc[first], starts[first], starts[np.append(first[1:], len(starts)) - 1], p[first]


_ANCHORS = "did long, th long, a int, width int, p int, key long, ctx long"


def _anchors(length: int, span: int):
    """Stage 1."""
    held = length - span + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                buf, offsets = buffers(batch.column("text"))
                data = memoryview(buf.tobytes())
                for doc, a, b, p in anchors(buf, offsets, length, span):
                    key, ctx = [], []
                    for i, j, k in zip(a.tolist(), b.tolist(), p.tolist()):
                        key.append(xxhash.xxh3_64_intdigest(data[k : k + held]))
                        ctx.append(xxhash.xxh3_64_intdigest(data[i : j + length], k - i))
                    at = offsets[doc]
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([batch.column("did").take(rows), batch.column("th").take(rows), *(pa.array(x.astype(np.int32)) for x in (a - at, b - a + 1, p - a)), _signed(key), _signed(ctx)], ["did", "th", "a", "width", "p", "key", "ctx"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], memoryview, list[dict]]]:
    """Identity, bytes and picks of each text; equal rows that follow each other are one."""
    before = None
    for whole in batches:
        for i in range(whole.num_rows):
            own = whole.column("did")[i].as_py(), whole.column("th")[i].as_py()
            if own != before:
                yield own, memoryview(whole.column("text")[i].as_buffer()), whole.column("picks")[i].as_py()
            before = own


def _contexts(length: int):
    """Stage 3: the bytes of the picked contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, picks in _texts(batches):
            for at in range(0, len(picks), 5000):
                some = picks[at : at + 5000]
                body = [text[x["a"] : x["a"] + x["width"] - 1 + length].tobytes() for x in some]
                cells = [pa.array([x[c] for x in some], k) for c, k in (("key", pa.int64()), ("ctx", pa.int64()), ("several", pa.bool_()), ("k", pa.int64()), ("width", pa.int32()), ("p", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(body, pa.binary())], ["key", "ctx", "several", "k", "width", "p", "body"])

    return run


_PARTS = "pkey long, pctx long, off int, key long, ctx long, several boolean, width int, p int, body binary"


def _parts(length: int, size: int):
    """Stage 4: contexts cut by the windows' distance from the anchor. Single windows need no bytes: they are settled by counting."""
    names = [x.split()[0] for x in _PARTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), None, None, pa.bool_(), pa.int32(), pa.int32(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for x in batch.to_pylist():
                body, last, p = memoryview(x["body"]), x["width"] - 1, x["p"]
                for q in range((p - last) // size, p // size + 1):
                    low, high = max(0, p - q * size - size + 1), min(last, p - q * size)
                    key = xxhash.xxh3_64_intdigest(body[p - q * size : p - q * size - size + 1 + length], size << 16 | q)
                    part = body[low : high + length]
                    yield x["key"], x["ctx"], low, key, xxhash.xxh3_64_intdigest(part, p - low), x["several"], high - low + 1, p - low, part.tobytes() if size > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while some := list(islice(found, 5_000)):
            yield pa.RecordBatch.from_arrays([_signed(c) if k is None else pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return run


def _solve(length: int):
    """Stage 3, for one bin: the windows of its contexts that begin elsewhere, too, as ranges from the context's first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("ctx", "ascending")]).combine_chunks()
        key, ctx = (table.column(c).to_numpy() for c in ("key", "ctx"))
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])[: len(key)]
        table = table.filter(pa.array(once))  # a context of a row that occurs more than once
        key, bodies = key[once], table.column("body").to_pylist()
        out = {"key": [], "ctx": [], "lo": [], "hi": []}
        if len(key):
            at = np.concatenate([[0], np.cumsum([len(x) for x in bodies])])
            classes = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            hit = RunLengthIndex(np.frombuffer(b"".join(bodies), np.uint8), at, classes).matching_statistics() >= length
            edges = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            lo, hi = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1  # a context's last places are no windows, so no range leaves it
            own = np.searchsorted(at, lo, "right") - 1
            ctx, several = table.column("ctx").to_numpy(), table.column("several").to_numpy(zero_copy_only=False)
            alone = ~several[own]  # the others are marked whole already
            own, lo, hi = own[alone], lo[alone], hi[alone]
            out = {"key": key[own], "ctx": ctx[own], "lo": (lo - at[own]).astype(np.int32), "hi": (hi - at[own]).astype(np.int32)}
        return pa.table({c: pa.array(x, pa.int32() if c in ("lo", "hi") else pa.int64()) for c, x in out.items()})

    return run


def _found(items: DataFrame, length: int, level: int, ranges: tuple[int, ...], key_contexts: int, bin_bytes: int) -> DataFrame:
    """key, ctx, lo, hi: ranges of the repeated windows of contexts, which are distinct, of keys with k > 1 of them."""
    few, many = items.where(F.col("k") <= key_contexts), items.where(F.col("k") > key_contexts)
    out = items.where("several").select("key", "ctx", F.lit(0).alias("lo"), (F.col("width") - 1).alias("hi"))
    volume = few.agg(F.coalesce(F.sum(F.col("width") + length), F.lit(0))).first()[0]
    if volume:
        dealt = few.select("key", "ctx", "several", "body", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-volume // bin_bytes)))).alias("bin"))
        out = out.unionByName(dealt.groupBy("bin").applyInArrow(_solve(length), "key long, ctx long, lo int, hi int"))
    if level < len(ranges) and many.take(1):
        parts = written(many.mapInArrow(_parts(length, ranges[level]), _PARTS), "parts")
        weight = F.sum(F.when(F.col("several"), 2).otherwise(1))
        keys = parts.groupBy("key").agg(weight.alias("c"), F.min("ctx").alias("low"), F.max("ctx").alias("high")).where("c > 1")
        live = written(parts.join(written(keys, "keys"), "key"), "live")
        of_parent = lambda lo, hi: [F.col("pkey").alias("key"), F.col("pctx").alias("ctx"), (F.col("off") + lo).alias("lo"), (F.col("off") + hi).alias("hi")]
        out = out.unionByName(live.where("low = high").select(*of_parent(F.lit(0), F.col("width") - 1)))
        open_ = live.where("low <> high")
        inner = open_.groupBy("key", "ctx").agg(weight.alias("m"), F.any_value(F.struct("width", "p", "body")).alias("x"))
        inner = written(inner.select("key", "ctx", (F.col("m") > 1).alias("several"), "x.*"), "inner")
        inner = written(inner.join(written(inner.groupBy("key").agg(F.count("*").alias("k")), "sizes"), "key"), "contexts")
        found = written(_found(inner, length, level + 1, ranges, key_contexts, bin_bytes), "found")
        out = out.unionByName(open_.drop("low", "high").join(found, ["key", "ctx"]).select(*of_parent(F.col("lo"), F.col("hi"))))
    return out


def _repeated(cands: DataFrame, texts: DataFrame, length: int, ranges: tuple[int, ...], key_contexts: int, bin_bytes: int) -> DataFrame:
    """did, th, lo, hi: ranges of repeated windows, of cands(did, th, a, width, p, key, ctx)."""
    keys = cands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = written(cands.join(written(keys, "keys"), "key", "left_semi"), "live")
    items = live.groupBy("key", "ctx").agg(F.count("*").alias("m"), F.min(F.struct("did", "th", "a", "width", "p")).alias("place"))
    items = written(items.select("key", "ctx", (F.col("m") > 1).alias("several"), "place.*"), "items")
    items = written(items.join(written(items.groupBy("key").agg(F.count("*").alias("k")), "sizes"), "key"), "sized")
    alone = items.where("k = 1").select("key", "ctx", F.lit(0).alias("lo"), (F.col("width") - 1).alias("hi"))
    picks = items.where("k > 1").groupBy("did", "th").agg(F.collect_list(F.struct("key", "ctx", "several", "k", "width", "p", "a").cast(_PICKS)).alias("picks"))
    contexts = written(texts.join(picks, ["did", "th"]).select("did", "th", "text", "picks").mapInArrow(_contexts(length), _CONTEXTS), "contexts")
    found = written(alone.unionByName(_found(contexts, length, 0, ranges, key_contexts, bin_bytes)), "found")
    return live.join(found, ["key", "ctx"]).select("did", "th", (F.col("a") + F.col("lo")).alias("lo"), (F.col("a") + F.col("hi")).alias("hi"))


def _spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows of the ranges cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _cut(length: int):
    """The text without the bytes that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                spans, kept, sizes = [], [], []
                for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                    body = text.as_buffer().to_pybytes() if text.is_valid else b""
                    sizes.append(len(body))
                    found = _spans(ranges or [], length)
                    spans.append([{"start": a, "end": b} for a, b in found])
                    ends = [0, *(b for _, b in found)]
                    kept.append(b"".join(body[a:b] for a, b in zip(ends, [*(a for a, _ in found), len(body)])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def _dealt(rows: DataFrame, bucket_bytes: int) -> DataFrame:
    """rows in buckets by did and th."""
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return bucketed(rows, min(100_000, max(4, -(-volume // bucket_bytes))), "did", "th")


def repeated_passages(docs: DataFrame, length: int = LENGTH, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", key_contexts: int = KEY_CONTEXTS, bin_bytes: int = BIN_BYTES, ranges: tuple[int, ...] = RANGES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the removed runs, in bytes) and kept (the remaining bytes) of each document."""
    if not 8 <= length - span + 1 <= length or ranges[-1] != 1:
        raise ValueError("a window must hold eight bytes from its anchor on, and keys must be split down to single windows")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a row is known by its id and a hash of id and text; rows equal in both have equal results
    rows = _dealt(rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("did"), F.xxhash64("doc_id", "text").alias("th"), "text"), bucket_bytes)
    cands = written(rows.select("did", "th", "text").mapInArrow(_anchors(length, span), _ANCHORS), "anchors")
    hits = _repeated(cands, rows.where(F.octet_length("text") >= length).select("did", "th", "text"), length, ranges, key_contexts, bin_bytes)
    by_row = written(hits.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    return rows.join(by_row, ["did", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")


def repeated_passages_digest(docs: DataFrame) -> DataFrame:
    """Counts of the removed bytes and runs, and a digest of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return repeated_passages(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
