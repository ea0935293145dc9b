"""Operator 11: fill-in-the-middle rearrangement by one event scan of each text.

One Aho-Corasick automaton holds the ASCII characters that change the class of a text (white space
against text, or what `Units` names) and the sentinels. A scan gives the places where a run of one class begins;
between two of them the class stays, so the units of a gap are its length by the units' width, and a
running sum over these sparse events is all that finding the r-th unit needs: a binary search, then
arithmetic within the gap. The same scan finds texts that hold a sentinel, which stay plain, and tells whether a cut
lies within a word.

A document's draws come from the sha256 of `salt` and its decimal id, so reruns and other partitionings
agree. Texts are rows, whatever their length: a task holds one batch of texts and their events.

Defined cases: a null text is the empty text, which stays plain; a null doc_id counts as the empty id in the
draws; repeated rows stay, each with the same result; a text that holds a sentinel stays plain, so that the output
can always be read back; an empty table gives no row; columns that are not asked for are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import slices

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
TEXT = 0


@dataclass(frozen=True)
class Units:
    """What is counted: ASCII characters of classes other than text, and the code points that a unit of each class holds.

    classes[i] are the characters of class i + 1; widths[i] belongs to class i, class 0 being text. A width of 0 makes a whole
    run of the class one unit.
    """

    classes: tuple[str, ...] = (" \t\n\v\f\r",)
    widths: tuple[int, ...] = (1, 1)


#: Each code point is a unit; white space is told from text.
CODE_POINTS = Units()
#: Words, with single white-space characters between them.
WORDS = Units(widths=(0, 1))
#: Lines, and line ends.
LINES = Units(classes=("\n",), widths=(0, 1))


class Scanner:
    """The automaton of one choice of units and sentinels."""

    def __init__(self, units: Units = CODE_POINTS, sentinels: tuple[str, ...] = SENTINELS):
        self.units, self.automaton = units, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, characters in enumerate(units.classes, 1):
            for c in characters:
                if not c.isascii():
                    raise ValueError(f"not an ASCII character: {c!r}")
                self.automaton.add_word(c, number)
        for s in sentinels:
            self.automaton.add_word(s, -1)
        self.automaton.make_automaton()

    def scan(self, text: str) -> Events:
        begins, kinds, marked = [], [], False
        kind, after = -1, 0  # the class of the run so far, and the place after it
        for at, value in self.automaton.iter(text):
            if value < 0:
                marked = True
            elif at > after or value != kind:
                if at > after or kind < 0 and at:
                    begins.append(after)
                    kinds.append(TEXT)
                begins.append(at)
                kinds.append(value)
                kind, after = value, at + 1
            else:
                after = at + 1
        if after < len(text):
            begins.append(after)
            kinds.append(TEXT)
        return Events(self.units, len(text), begins, kinds, marked)


class Events:
    """Begins and classes of the runs of a text; before[i] units lie before run i, `units` in all."""

    def __init__(self, units: Units, length: int, begins: list[int], kinds: list[int], marked: bool):
        self.widths, self.length, self.begins, self.kinds, self.marked = units.widths, length, begins, kinds, marked
        gaps = [b - a for a, b in zip(begins, [*begins[1:], length])]
        counts = [-(-n // w) if (w := units.widths[k]) else 1 for n, k in zip(gaps, kinds)]
        self.before = [0, *accumulate(counts)]
        self.units = self.before[-1]

    def place(self, rank: int) -> int:
        """The code point where unit number `rank` begins; the text's length for the number of units."""
        if rank >= self.units:
            return self.length
        run = bisect_right(self.before, rank) - 1
        return self.begins[run] + (rank - self.before[run]) * self.widths[self.kinds[run]]

    def within_text(self, at: int) -> bool:
        """Whether the code points on both sides of a place belong to one run of text."""
        run = bisect_right(self.begins, at) - 1
        return 0 < at < self.length and self.kinds[run] == TEXT and self.begins[run] < at


@lru_cache(maxsize=8)
def scanner(units: Units, sentinels: tuple[str, ...]) -> Scanner:
    return Scanner(units, sentinels)


def draws(doc_id: int | None, salt: str) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(text: str, doc_id: int | None, scan: Scanner, salt: str, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple:
    """(units, form, units of the prefix, units of the middle, cuts within words, output) of one text."""
    events = scan.scan(text)
    h1, h2, h3, h4 = draws(doc_id, salt)
    if not text or events.marked or h3 % 100 >= rate:
        return events.units, "plain", None, None, None, text
    low, high = sorted((h1 % (events.units + 1), h2 % (events.units + 1)))
    a, b = events.place(low), events.place(high)
    cuts = events.within_text(a) + events.within_text(b)
    p, s, m = sentinels
    if h4 % 100 < spm:
        return events.units, "spm", low, high - low, cuts, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return events.units, "psm", low, high - low, cuts, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, units: Units = CODE_POINTS, sentinels: tuple[str, str, str] = SENTINELS, salt: str = "1:", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, cut_words and the output text of each document.

    rate percent of the documents are rearranged, spm percent of these with the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(units, sentinels)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
                rows = [arrange(t or "", i, scan, salt, rate, spm, sentinels) for i, t in zip(ids.to_pylist(), texts)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.large_string()))]
                yield pa.RecordBatch.from_arrays([ids, *columns[:-1], columns[-1].cast(pa.string())], ["doc_id", "n", "form", "prefix_units", "middle_units", "cut_words", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, cut_words int, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output: its parts lie between the sentinels, which no rearranged text holds."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels))
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the outputs and of the texts read back from them."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
