"""The encoding of bytes, by marks, by strict decoding, and by how likely an encoding's text has such bytes.

Beyond ASCII an encoding is a model of the bytes that text in it has: of the pairs of a double-byte
one, by the rows of its standard (the common characters, signs, the rare ones), of the single bytes of
another, by its letters and by whether such a byte follows another one. Among the encodings that decode all
bytes the likeliest is taken. The models are shares of running text, rounded; they need tell encodings apart, not measure them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..fixed import BOMS, TRIAL_ENCODINGS

_HIGH = ((0xA1, 0xFE),)
_RARE = -16.0  # for bytes that the model does not know


@dataclass(frozen=True)
class Pairs:
    """rows: (first lead byte, last, trail ranges, share of the pairs); single: upper bytes that stand alone."""

    codec: str
    rows: tuple[tuple[int, int, tuple[tuple[int, int], ...], float], ...]
    single: tuple[int, int] = (1, 0)

    def likelihood(self, data: bytes) -> float:
        table: dict[int, list] = {}
        for low, high, trails, share in self.rows:
            cells = (high - low + 1) * sum(b - a + 1 for a, b in trails)
            for lead in range(low, high + 1):
                table.setdefault(lead, []).append((trails, math.log(share / cells)))
        total, i, n = 0.0, 0, len(data)
        while i < n:
            lead = data[i]
            i += 1
            if lead < 0x80:
                continue
            trail = data[i] if i < n else -1
            for trails, gain in table.get(lead, ()):
                if any(a <= trail <= b for a, b in trails):
                    total += gain
                    i += 1
                    break
            else:
                total += math.log(0.002 / 63) if self.single[0] <= lead <= self.single[1] else _RARE
        return total


@dataclass(frozen=True)
class Singles:
    """shares: (first byte, last, share of the upper bytes); together: how often an upper byte follows another."""

    codec: str
    shares: tuple[tuple[int, int, float], ...]
    together: float

    def likelihood(self, data: bytes) -> float:
        gain = [_RARE] * 256
        for low, high, share in self.shares:
            for b in range(low, high + 1):
                gain[b] = math.log(share / (high - low + 1))
        after, alone = math.log(self.together), math.log(1 - self.together)
        total, before = 0.0, 0
        for b in data:
            if b >= 0x80:
                total += gain[b] + (after if before >= 0x80 else alone)
            before = b
        return total


_BIG5 = ((0x40, 0x7E), (0xA1, 0xFE))
_KANJI = ((0x40, 0x7E), (0x80, 0xFC))
MODELS = {
    "gbk": Pairs("gbk", ((0xB0, 0xD7, _HIGH, 0.90), (0xA1, 0xA3, _HIGH, 0.07), (0xD8, 0xF7, _HIGH, 0.025), (0x81, 0xFE, ((0x40, 0x7E), (0x80, 0xFE)), 0.005))),
    "big5": Pairs("big5", ((0xA4, 0xC6, _BIG5, 0.88), (0xA1, 0xA3, _BIG5, 0.08), (0xC9, 0xF9, _BIG5, 0.04))),
    "shift_jis": Pairs("cp932", ((0x82, 0x82, ((0x9F, 0xF1),), 0.50), (0x83, 0x83, ((0x40, 0x7E), (0x80, 0x96)), 0.20), (0x88, 0x97, _KANJI, 0.23), (0x81, 0x81, _KANJI, 0.05), (0x82, 0x82, ((0x4F, 0x9A),), 0.005), (0x98, 0x9F, _KANJI, 0.01), (0xE0, 0xEA, _KANJI, 0.005)), (0xA1, 0xDF)),
    "euc_jp": Pairs("euc_jp", ((0xA4, 0xA4, ((0xA1, 0xF3),), 0.50), (0xA5, 0xA5, ((0xA1, 0xF6),), 0.20), (0xB0, 0xCF, _HIGH, 0.23), (0xA1, 0xA3, _HIGH, 0.05), (0xD0, 0xF4, _HIGH, 0.02))),
    "euc_kr": Pairs("cp949", ((0xB0, 0xC8, _HIGH, 0.93), (0xA1, 0xA3, _HIGH, 0.05), (0xCA, 0xFD, _HIGH, 0.01), (0x81, 0xC6, ((0x41, 0x5A), (0x61, 0x7A), (0x81, 0xFE)), 0.01))),
    "cp1251": Singles("cp1251", ((0xE0, 0xFF, 0.86), (0xC0, 0xDF, 0.10), (0x80, 0xBF, 0.04)), 0.85),
    "koi8_r": Singles("koi8_r", ((0xC0, 0xDF, 0.86), (0xE0, 0xFF, 0.10), (0x80, 0xBF, 0.04)), 0.85),
    "cp1252": Singles("cp1252", ((0xE0, 0xFF, 0.70), (0xC0, 0xDF, 0.12), (0x80, 0x9F, 0.10), (0xA0, 0xBF, 0.08)), 0.04),
}
#: The codecs that Python reads these encodings with.
CODECS = {name: model.codec for name, model in MODELS.items()}


def decodes(head: bytes, encoding: str, cut_off: bool) -> bool:
    """cut_off: whether the head may end inside a character."""
    for cut in range(4 if cut_off else 1):
        try:
            head[: len(head) - cut].decode(CODECS.get(encoding, encoding))
            return True
        except UnicodeDecodeError:
            continue
    return False


def likeliest(head: bytes, cut_off: bool = False) -> str | None:
    """The likeliest encoding of bytes that are not UTF-8, among those that decode them; ties go to the first."""
    found = {name: model.likelihood(head) for name, model in MODELS.items() if decodes(head, name, cut_off)}
    return max(found, key=found.__getitem__) if found else None


def detect_encoding(head: bytes, cut_off: bool = False, encodings: list[str] | None = None) -> str:
    """The encoding that the byte order mark names; else the first of encodings that decodes the head; without those, what the bytes look like."""
    for mark, encoding in BOMS.items():
        if head.startswith(mark):
            return encoding
    if not encodings:
        zeros = [head[k::2].count(0) for k in (0, 1)]
        if sum(zeros) > len(head) // 8:
            return "utf-16-le" if zeros[1] > zeros[0] else "utf-16-be"
        if not decodes(head, "utf-8", cut_off) and (found := likeliest(head, cut_off)):
            return found
    return next((e for e in encodings or TRIAL_ENCODINGS if decodes(head, e, cut_off)), "latin-1")
