"""Whole texts to token ids of a public vocabulary, one batch of texts at a time, inside one task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textops import _LOWER, Grown, Words, WordTable, buffers

END_ID = 2


def byte_letters() -> list[str]:
    """A printable letter for each byte, as byte-level vocabularies spell them: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[33:128], _KIND[128:], _KIND[:32] = _MARK, _OTHER, _OTHER
_KIND[127] = _OTHER
_KIND[48:58], _KIND[65:91], _KIND[97:123] = _DIGIT, _LETTER, _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[ord("'")] = _OTHER
#: Lead bytes of U+00C0 to U+017F: letters that are one letter in lower case too, all but three.
_KIND[0xC3:0xC6] = _LETTER


class Pieces(Words):
    """What a pre-tokeniser would cut from each word, where plain classes of bytes tell: runs of Latin letters, single digits, runs of ASCII marks.

    Words with an apostrophe or any other character stay whole. Letters from A to Z and from U+00C0 to U+00DE are put in lower case.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        super().__init__(buf, offsets)
        if not len(buf):
            return
        kind = _KIND[buf]
        lead = np.flatnonzero((buf >= 0xC3) & (buf <= 0xC5))
        lead = lead[lead + 1 < len(buf)]
        tail = buf[lead + 1]
        sign = (buf[lead] == 0xC3) & ((tail == 0x97) | (tail == 0xB7)) | (buf[lead] == 0xC4) & (tail == 0xB0)
        kind[lead + 1] = np.where(sign, _OTHER, _LETTER)
        odd = np.concatenate([[0], np.cumsum(kind == _OTHER, dtype=np.int32)])
        whole = odd[self.ends] > odd[self.starts]
        self.buf = buf = _LOWER[buf]
        upper = lead[(buf[lead] == 0xC3) & (tail <= 0x9E) & ~sign] + 1
        buf[upper] += 0x20
        cut = np.zeros(len(buf), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for s, e in zip(self.starts[whole].tolist(), self.ends[whole].tolist()):
            cut[s + 1 : e] = False
        cut[self.starts] = True
        cut &= kind != 0
        starts = np.flatnonzero(cut)
        after = np.searchsorted(self.ends, starts, "right")
        ends = self.ends[after]
        ends[:-1] = np.minimum(ends[:-1], starts[1:])
        self.first = np.searchsorted(starts, offsets)
        self.first[-1] = len(starts)
        self.starts, self.ends = starts, ends


class Encoder:
    """Token ids of texts with the tokenizers library, the library being asked once for each distinct piece of a word.

    White space never joins two words in these vocabularies, so a text's ids are its words' ids in order.
    Words that are not plain Latin letters, digits or ASCII marks are given to the library whole, which alone knows
    the classes of all letters. So are the rare texts that may hold one of the vocabulary's added tokens, in any case of letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(map(re.escape, added))
        self.model = self.tokenizer.model
        self.unplain = re.compile(rb"[^!-&(-~\x80-\xc3]|\xc3[\x97\xb7]|(?:^|[^\xc3])[\x80-\xc2]").search
        self.letters = byte_letters()
        self.table = WordTable(self._fill, self._reset)
        self._reset()

    def _reset(self) -> None:
        self.flat, self.at = Grown(np.uint32), Grown(np.int64)
        self.at.add(np.zeros(1, np.int64))

    def _spelt(self, piece: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, piece)))]

    def _fill(self, words: list[bytes]) -> None:
        tokenize, ids = self.model.tokenize, []
        for w in words:
            if w.isalpha():
                ids.append([t.id for t in tokenize(w.decode())])
            elif self.unplain(w):
                ids.append(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids)
            else:
                ids.append(self._spelt(w))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat.add(np.fromiter((x for some in ids for x in some), np.uint32, int(sizes.sum())))
        self.at.add(self.at.rows[-1] + np.cumsum(sizes))

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text's."""
        if not self.added:
            return self._plain(texts, end_id)
        held = pc.fill_null(pc.match_substring_regex(texts, self.added, ignore_case=True), False)
        rows = np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist()
        if not rows:
            return self._plain(texts, end_id)
        ids, at = self._plain(pc.if_else(held, pa.scalar("", texts.type), texts), end_id)
        parts, sizes, before = [], np.zeros(len(texts) + 1, np.int64), 0
        for i in rows:
            own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            parts += [ids[before : at[i]], own]
            sizes[i + 1], before = len(own), at[i]
        return np.concatenate([*parts, ids[before:]]), at + np.cumsum(sizes)

    def _plain(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts without added tokens."""
        words = Pieces(*buffers(texts))
        record = self.table.records(words)
        upto = self.at.rows
        begin, size = upto[record], upto[record + 1] - upto[record]
        upto = np.concatenate([[0], np.cumsum(size)])
        extra = 0 if end_id is None else 1
        at = upto[words.first] + extra * np.arange(len(texts) + 1)
        ids = self.flat.rows[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        if end_id is None:
            return ids, at
        out = np.full(at[-1], end_id, np.uint32)
        keep = np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        out[keep] = ids
        return out, at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process; its table outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(ids: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(len(at) - 1):
        yield ids[at[i] : at[i + 1]]
