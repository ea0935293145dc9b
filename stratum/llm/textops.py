"""Words of whole texts by numpy over Arrow's string buffers, inside one task.

A batch of texts is one byte buffer with offsets. Words are cut at the bytes 0x20 and 0x09-0x0D and
hashed to 64 bits, eight bytes at a time over all words, without a Python object for each word; they
are looked up once for each distinct word of a batch, and words of equal hash are compared by
their bytes. So the cost of a text is a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

#: Bytes of a word that are hashed with all words at once; longer words are hashed one by one.
LONG = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest n of eight bytes.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most that many text bytes (a longer text stays whole), to bound memory."""
    texts = batch.column(column)
    if batch.num_rows == 0:
        return
    _, at = buffers(texts)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of a batch: byte ranges [starts, ends), the number of each text, and first[i]:first[i+1] as those of text i. breaks: the bytes between words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            space = breaks[buf]
            edge = offsets[:-1][np.diff(offsets) > 0]
            before, after = np.empty(n, bool), np.empty(n, bool)
            before[0], after[-1] = True, True
            before[1:], after[:-1] = space[:-1], space[1:]
            before[edge] = True
            after[edge[1:] - 1] = True
            self.starts = np.flatnonzero(before & ~space)
            self.ends = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.first[-1] = len(self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def parts(self, which: np.ndarray | None = None, lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The first LONG bytes of words (all, or those of that number), eight at a time: the words that have so many, and the bytes as one number."""
        starts, ends = (self.starts, self.ends) if which is None else (self.starts[which], self.ends[which])
        buf = np.concatenate([_LOWER[self.buf] if lower else self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.buf) + 1,), "<u8", buf, 0, (1,))
        left, rows = ends - starts, np.arange(len(starts))
        for at in range(0, LONG, 8):
            if at:
                rows = rows[left[rows] > at]
            if not len(rows):
                return
            yield rows, eight[starts[rows] + at] & _LOWEST[np.minimum(left[rows] - at, 8)]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64 bits for each word; lower: A-Z count as a-z."""
        lengths = self.ends - self.starts
        out = mix(lengths.astype(np.uint64) * _ODD)
        for rows, part in self.parts(lower=lower):
            out[rows] = mix((out[rows] * _ODD) ^ part)
        for i in np.flatnonzero(lengths > LONG).tolist():
            word = self.buf[self.starts[i] : self.ends[i]]
            out[i] = xxhash.xxh3_64_intdigest((_LOWER[word] if lower else word).tobytes())
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each word's text among the distinct ones, and of those the first word and the hash. Words of equal hash are compared."""
        codes, found = pd.factorize(self.hashes())
        first = np.empty(len(found), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        like, sizes = first[codes], self.ends - self.starts
        same = sizes == sizes[like]
        for (rows, mine), (_, other) in zip(self.parts(), self.parts(np.where(same, like, np.arange(len(self))))):
            same[rows] &= mine == other
        for i in np.flatnonzero(sizes > LONG).tolist():
            same[i] = same[i] and (like[i] == i or self.bytes_of(i) == self.bytes_of(like[i]))
        if same.all():
            return codes, first, found
        odd = np.flatnonzero(~same)  # two texts of one hash: those that differ from the first are put apart, each by itself
        shared = found[codes[odd]]
        codes = codes.copy()
        codes[odd] = len(first) + np.arange(len(odd))
        return codes, np.append(first, odd), np.append(found, shared)


class Grown:
    """An array that is added to at its end, in amortised constant time for each row."""

    def __init__(self, kind: type, *width: int):
        self.data, self.size = np.zeros((1024, *width), kind), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.size + len(rows)
        if need > len(self.data):
            wider = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            wider[: self.size] = self.data[: self.size]
            self.data = wider
        self.data[self.size : need] = rows
        self.size = need

    @property
    def rows(self) -> np.ndarray:
        return self.data[: self.size]


class WordTable:
    """A record number for each word, made once for each distinct word: fill(words) gets the new words and adds their records.

    A word is met again by its hash, and then compared by its bytes. Memory is bounded: past `most`
    words the table is emptied with reset() and filled anew; words of more than LONG bytes are
    known within their batch only.
    """

    def __init__(self, fill: Callable[[list[bytes]], None], reset: Callable[[], None], most: int = 400_000):
        self.fill, self.reset, self.most = fill, reset, most
        self._empty()

    def _empty(self) -> None:
        self.size, self.volume = 0, 0
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lengths, self.texts = Grown(np.int32), Grown(np.uint64, LONG // 8)

    def records(self, words: Words) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int64)
        if self.size > self.most or self.volume > 64 * self.most:
            self._empty()
            self.reset()
        codes, first, hashes = words.distinct()
        texts = np.zeros((len(first), LONG // 8), np.uint64)
        for k, (rows, part) in enumerate(words.parts(first)):
            texts[rows, k] = part
        lengths = (words.ends - words.starts)[first]
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.keys, hashes[order])
        seen = np.flatnonzero(at < len(self.keys))
        seen = seen[self.keys[at[seen]] == hashes[order[seen]]]
        number, mine = self.numbers[at[seen]], order[seen]
        equal = (self.lengths.rows[number] == lengths[mine]) & (lengths[mine] <= LONG) & (self.texts.rows[number] == texts[mine]).all(1)
        found = np.full(len(first), -1, np.int64)
        found[mine[equal]] = number[equal]
        new = np.flatnonzero(found < 0)
        if len(new):
            data, begin, end = words.buf.tobytes(), words.starts[first[new]].tolist(), words.ends[first[new]].tolist()
            self.fill([data[a:b] for a, b in zip(begin, end)])
            found[new] = np.arange(self.size, self.size + len(new))
            self.size += len(new)
            self.volume += int(lengths[new].sum())
            self.lengths.add(lengths[new])
            self.texts.add(texts[new])
            fresh = found[order] >= self.size - len(new)
            fresh[seen] = False  # another word has this hash
            fresh &= lengths[order] <= LONG
            self.keys = np.insert(self.keys, at[fresh], hashes[order[fresh]])
            self.numbers = np.insert(self.numbers, at[fresh], found[order[fresh]])
        return found[codes]
