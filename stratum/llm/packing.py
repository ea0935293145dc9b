"""Operator 8: cost-balanced packing of token sequences.

A document costs linear * n + quadratic * n^2 for n tokens. A document longer than a sequence is
cut into full sequences and a rest; the rests are dealt into groups of bounded size, and in each
group documents go, the dearest first, to the cheapest sequence that has room for them. What fits
nowhere is cut at the cheapest sequence's room, so all sequences of a group are full. What a group has beyond
full sequences makes shorter ones, each as long as a power of two, which need no padding.

Defined cases: a null text is the empty text and gives one piece, the end id; equal documents are
packed apart; an empty table gives no row; columns other than the two named ones are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .textops import slices
from .tokens import END_ID, encoder

CAPACITY = 4096
#: Bytes of text and documents of a group, whose rests are in one task: many sequences, so that only few are short ones.
GROUP_BYTES, DOCS_PER_GROUP = 4 << 20, 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CUT = "bucket long, place long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def balance(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. All sequences are full; behind those of full capacity come one for each power of two in what is left.

    Documents come by descending cost, ties by position; the cheapest sequence with room for the whole document takes it.
    """
    total = int(sizes.sum())
    if not total:
        return []
    left = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1], np.int64)
    count = len(room)
    used, costs, out = np.zeros(count, np.int64), np.zeros(count), []
    waiting = [(-(linear * n + quadratic * n * n), i, 0, n) for i, n in enumerate(sizes.tolist()) if n]
    heapq.heapify(waiting)
    while waiting:
        _, i, start, n = heapq.heappop(waiting)
        s = int(np.where(room >= n, costs, np.inf).argmin())
        if room[s] < n:  # no sequence has room for the whole: the cheapest takes what it has room for
            s = int(np.where(room > 0, costs, np.inf).argmin())
        fits = min(n, int(room[s]))
        out.append((i, start, fits, s, int(used[s])))
        used[s] += fits
        room[s] -= fits
        costs[s] += linear * fits + quadratic * fits * fits
        if n > fits:
            left = n - fits
            heapq.heappush(waiting, (-(linear * left + quadratic * left * left), i, start + fits, left))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, docs_per_group: int = DOCS_PER_GROUP, group_bytes: int = GROUP_BYTES, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    count, volume = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-count // docs_per_group), -(-volume // group_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full sequences with their digest, and the rest of each document with its ids; bucket deals by the row's place, so equal rows spread."""
        part, row, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = enc.encode(batch.column("text"), end_id)
                ids = np.ascontiguousarray(ids, "<u4")
                columns: list[list] = [[] for _ in range(8)]
                for k, (doc, a, b) in enumerate(zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist())):
                    place = part << 33 | row + k
                    bucket = zlib.crc32(place.to_bytes(8, "little")) % groups
                    for start in range(a, b, capacity):
                        end = min(b, start + capacity)
                        rest = end - start < capacity
                        for column, x in zip(columns, (bucket, place, doc, start - a, end - start, None if rest else zlib.crc32(ids[start:end]), b - a, ids[start:end].tobytes() if rest and narrow is None else ids[start:end].astype(narrow).tobytes() if rest else None)):
                            column.append(x)
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == 7 else pa.int64()) for n, c in enumerate(columns)], ["bucket", "place", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    narrow = "<u2" if _fits_two_bytes(vocabulary) else None

    def balanced(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "start"], kind="stable").reset_index(drop=True)
        base = int(group["bucket"].iloc[0]) << 32
        full = group[group["ids"].isna()]
        done = full[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=base + np.arange(len(full)), offset=0)
        rests = group[group["ids"].notna()]
        ids, docs_, starts, totals = (rests[c].tolist() for c in ("ids", "doc_id", "start", "doc_tokens"))
        found = balance(rests["length"].to_numpy(np.int64), capacity, linear, quadratic)
        rows_ = []
        for i, start, n, s, offset in found:
            own = np.frombuffer(ids[i], narrow or "<u4")[start : start + n].astype("<u4")
            rows_.append((docs_[i], starts[i] + start, n, zlib.crc32(own), totals[i], base + len(full) + s, offset))
        more = pd.DataFrame(rows_, columns=done.columns)
        return pd.concat([x for x in (done, more) if len(x)] or [done]).astype({"doc_id": "Int64"}).astype({c: "int64" for c in done.columns if c != "doc_id"})

    return rows.mapInArrow(cut, _CUT).groupBy("bucket").applyInPandas(balanced, PIECES)


def _fits_two_bytes(vocabulary: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16
