"""Operator 12: how far the sources of a language differ in their words, by mergeable radix tries.

1. One pass over the texts: each task counts terms in a byte radix trie whose leaves carry counters
   for each (lang, source) and the number of documents for each lang. A trie of bounded size is cut into
   its prefixes' subtries, which are sent as front-coded terms with their counters; so a frequent word is one leaf a
   trie, however often it occurs.
2. Subtries meet by prefix range and are merged. Prefixes whose subtries hold more entries than a task takes are first
   cut by longer prefixes, as often as that is needed. Terms of enough documents of a lang are kept, in blocks.
3. Totals of groups and langs are sums over these blocks. Then each block is read once more in UTF-8 order: dense
   chunks of (term, source) shares give the sums of all pairs of sources, and the best terms of each source are
   kept as a running list, in which the earlier term wins a tie. Partial sums are added and lists ranked by Spark.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)), with V kept terms of the lang and N occurrences of them in the group; a term's
figure is f = floor((p - q)^2 / q). All arithmetic is in whole numbers, exact for counts below 9 * 10^9.

The pairs of sources are the result, so a lang's sources squared bound what a task holds; a lang's totals are one row.

Defined cases: null text, lang and source are empty texts; a row is a document, so repeated rows count as often as they
occur; groups without terms have shares of the count 0; in a lang without kept terms all pairs have the value 0; terms of any
length are whole terms; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textops import _LOWER, Words, WordTable, buffers, slices
from .tries import U4, RadixTrie, packed, unpacked

SCALE, LEAST_DOCUMENTS, TOP = 1_000_000_000, 3, 200
#: Leaves of a task's trie before it is sent; bytes of the first prefixes; entries of a prefix that one task merges; terms of a kept block; cells of a dense chunk.
TRIE_LEAVES, PREFIX_BYTES, RANGE_ENTRIES, BLOCK_TERMS, CELLS = 150_000, 2, 400_000, 20_000, 1 << 20
_BREAKS = np.ones(256, bool)
_BREAKS[0x80:] = _BREAKS[0x41:0x5B] = _BREAKS[0x61:0x7B] = False
_I8 = "<i8"
#: counters: for each term of the subtrie at[i]:at[i + 1] are its entries; group numbers point to langs and sources, those of documents to the langs of these.
_SUBTRIES = "prefix binary, depth int, n int, shared binary, lengths binary, rest binary, langs array<string>, sources array<string>, at binary, grp binary, cnt binary, dat binary, dgrp binary, docs binary"
_NAMES = [x.split()[0] for x in _SUBTRIES.split(", ")]
_KINDS = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 6]
_KEPT = "lang string, n int, terms array<string>, sources array<string>, sums array<long>, at binary, grp binary, cnt binary"
_SCORED = "part string, lang string, source string, item string, value long"


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    if not len(keys):
        return keys, values
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


class Counters:
    """Sums by (leaf, number): rows are gathered and added up now and then."""

    def __init__(self) -> None:
        self.keys, self.values, self.rows = [], [], 0

    def add(self, leaf: np.ndarray, number: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(leaf.astype(np.int64) << 32 | number)
        self.values.append(value.astype(np.int64))
        self.rows += len(leaf)
        if self.rows > 2_000_000:
            k, v = self.sums()
            self.keys, self.values, self.rows = [k], [v], 0

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate(self.keys or [np.zeros(0, np.int64)]), np.concatenate(self.values or [np.zeros(0, np.int64)]))

    def by_leaf(self, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the entries of each leaf begin, and numbers and sums of these."""
        keys, values = self.sums()
        return np.searchsorted(keys, np.arange(leaves + 1, dtype=np.int64) << 32), keys & 0xFFFFFFFF, values


def _picked(at: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the leaves in that order, and where those of each begin."""
    sizes = (at[1:] - at[:-1])[leaves]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(begin[-1]) - np.repeat(begin[:-1], sizes) + np.repeat(at[leaves], sizes), begin


def _prefixes(terms: list[bytes], depth: int) -> Iterator[tuple[int, int]]:
    """Ranges of sorted terms that have the same first bytes."""
    a = 0
    while a < len(terms):
        prefix, b = terms[a][:depth], a + 1
        while b < len(terms) and terms[b].startswith(prefix) and len(prefix) == depth:
            b += 1
        yield a, b
        a = b


def _subtrie(terms: list[bytes], shared: list[int], depth: int, names: list[tuple[str, str]], at: np.ndarray, grp: np.ndarray, cnt: np.ndarray, dat: np.ndarray, dgrp: np.ndarray, docs: np.ndarray) -> dict:
    """A row of sorted terms with their counters, and the names of the groups that these have."""
    used, local = np.unique(np.concatenate([grp, dgrp]), return_inverse=True)
    ints, longs = (lambda x: x.astype(U4).tobytes()), (lambda x: x.astype(_I8).tobytes())
    cells = (terms[0][:depth], depth, len(terms), *packed(terms, shared), [names[g][0] for g in used], [names[g][1] for g in used], ints(at), ints(local[: len(grp)]), longs(cnt), ints(dat), ints(local[len(grp) :]), longs(docs))
    return dict(zip(_NAMES, cells))


class Counted:
    """A trie with the counters of its leaves and the names of their groups."""

    def __init__(self) -> None:
        self.trie, self.groups, self.counts, self.docs = RadixTrie(), {}, Counters(), Counters()
        #: Leaves of merged terms, so that one met again is not looked for byte by byte.
        self.known: dict[bytes, int] = {}

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def subtries(self, depth: int) -> Iterator[dict]:
        """A row for each prefix of that many bytes."""
        if not self.trie.size:
            return
        terms, leaves, shared = map(list, zip(*self.trie.walk()))
        leaves, names = np.array(leaves, np.int64), list(self.groups)
        counts, docs = self.counts.by_leaf(self.trie.size), self.docs.by_leaf(self.trie.size)
        for a, b in _prefixes(terms, depth):
            (row, begin), (drow, dbegin) = _picked(counts[0], leaves[a:b]), _picked(docs[0], leaves[a:b])
            yield _subtrie(terms[a:b], shared[a:b], depth, names, begin, counts[1][row], counts[2][row], dbegin, docs[1][drow], docs[2][drow])

    def take(self, row: dict) -> None:
        """Merge a subtrie."""
        known, leaf, leaves = self.known, self.trie.leaf, []
        for term in unpacked(row["shared"], row["lengths"], row["rest"]):
            at = known.get(term)
            if at is None:
                at = known[term] = leaf(term)
            leaves.append(at)
        leaves = np.array(leaves, np.int64)
        number = np.array([self.group(*g) for g in zip(row["langs"], row["sources"])], np.int64)
        for at, grp, cnt, counters in ((row["at"], row["grp"], row["cnt"], self.counts), (row["dat"], row["dgrp"], row["docs"], self.docs)):
            sizes = np.diff(np.frombuffer(at, U4).astype(np.int64))
            counters.add(np.repeat(leaves, sizes), number[np.frombuffer(grp, U4)], np.frombuffer(cnt, _I8))


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, volume = [], 0
    for row in rows:
        held.append(row)
        volume += len(row["rest"]) + len(row["cnt"]) * 2
        if volume > 1 << 22 or len(held) >= 1000:
            yield _batch(held)
            held, volume = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(_NAMES, _KINDS)], _NAMES)


def _count(trie_leaves: int, depth: int):
    """Stage 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, leaf_of = Counted(), []

        def fill(words: list[bytes]) -> None:
            # in order of their bytes, so that neighbours take the same path
            order = sorted(range(len(words)), key=words.__getitem__)
            new = np.empty(len(words), np.int64)
            new[order] = [found.trie.leaf(words[i]) for i in order]
            leaf_of.extend(new.tolist())

        table = WordTable(fill, leaf_of.clear, most=1 << 40)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 22):
                buf, offsets = buffers(batch.column("text"))
                words = Words(_LOWER[buf], offsets, _BREAKS)
                groups = np.array([found.group(*g) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
                langs: dict[str, int] = {}
                for (lang, _), g in found.groups.items():
                    langs.setdefault(lang, g)
                first_of = np.array([langs[lang] for lang, _ in found.groups], np.int64)  # the first group of a lang stands for it
                if len(words):
                    records = table.records(words)
                    leaf = np.array(leaf_of, np.int64)[records]
                    doc = np.repeat(np.arange(len(groups)), np.diff(words.first))
                    pair, n = np.unique(doc << 32 | leaf, return_counts=True)
                    doc, leaf = pair >> 32, pair & 0xFFFFFFFF
                    for counters, number, value in ((found.counts, groups[doc], n), (found.docs, first_of[groups[doc]], np.ones(len(n), np.int64))):
                        keys, sums = _summed(leaf << 32 | number, value)
                        counters.add(keys >> 32, keys & 0xFFFFFFFF, sums)
                if found.trie.size >= trie_leaves:
                    yield from _batches(found.subtries(depth))
                    found, leaf_of = Counted(), []
                    table = WordTable(fill, leaf_of.clear, most=1 << 40)
        yield from _batches(found.subtries(depth))

    return run


def _deeper(depth: int):
    """Subtries cut by longer prefixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                terms, shared = list(unpacked(row["shared"], row["lengths"], row["rest"])), np.frombuffer(row["shared"], U4).tolist()
                names = list(zip(row["langs"], row["sources"]))
                (at, dat, grp, dgrp), (cnt, docs) = ([np.frombuffer(row[c], k).astype(np.int64) for c in own] for own, k in ((("at", "dat", "grp", "dgrp"), U4), (("cnt", "docs"), _I8)))
                for a, b in _prefixes(terms, depth):
                    own, down = slice(at[a], at[b]), slice(dat[a], dat[b])
                    yield _subtrie(terms[a:b], shared[a:b], depth, names, at[a : b + 1] - at[a], grp[own], cnt[own], dat[a : b + 1] - dat[a], dgrp[down], docs[down])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches))

    return run


def _merge(least: int, block: int):
    """Stage 2, for one prefix: blocks of each lang's kept terms, in byte order."""

    def run(table: pa.Table) -> pa.Table:
        found = Counted()
        for batch in table.to_batches(max_chunksize=64):
            for row in batch.to_pylist():
                found.take(row)
        terms, leaves, _ = zip(*found.trie.walk()) if found.trie.size else ((), (), ())
        leaves, names = np.array(leaves, np.int64), list(found.groups)
        langs = sorted({lang for lang, _ in names})
        lang_of = np.array([langs.index(lang) for lang, _ in names], np.int64)
        (at, grp, cnt), (dat, dgrp, docs) = found.counts.by_leaf(found.trie.size), found.docs.by_leaf(found.trie.size)
        drow, dbegin = _picked(dat, leaves)
        term_of = np.repeat(np.arange(len(leaves)), np.diff(dbegin))
        keys, many = _summed(lang_of[dgrp[drow]] << 32 | term_of, docs[drow])
        out = {c.split()[0]: [] for c in _KEPT.split(", ")}
        for k, lang in enumerate(langs):
            mine = np.flatnonzero((keys >> 32 == k) & (many >= least))
            kept = (keys[mine] & 0xFFFFFFFF).astype(np.int64)
            for a in range(0, len(kept), block):
                some = kept[a : a + block]
                row, begin = _picked(at, leaves[some])
                own = lang_of[grp[row]] == k
                sizes = np.bincount(np.repeat(np.arange(len(some)), np.diff(begin))[own], minlength=len(some))
                used, local = np.unique(grp[row[own]], return_inverse=True)
                values = cnt[row[own]]
                sums = np.zeros(len(used), np.int64)
                np.add.at(sums, local, values)
                cells = (lang, len(some), [terms[i].decode() for i in some.tolist()], [names[g][1] for g in used], sums.tolist(), np.concatenate([[0], np.cumsum(sizes)]).astype(U4).tobytes(), local.astype(U4).tobytes(), values.astype(_I8).tobytes())
                for c, x in zip(out, cells):
                    out[c].append(x)
        kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds)})

    return run


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    return 1 + SCALE * (counts + 1) // (total + terms)


def figures(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _score(top: int, cells: int):
    """Stage 3: partial sums of a task for each pair of sources, and the task's best terms of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                lang, names, v = row["lang"], row["all_sources"], row["v"]
                totals = np.array(row["totals"], np.int64)
                number = {s: i for i, s in enumerate(names)}
                here = np.array([number[s] for s in row["sources"]], np.int64)
                at, source, count = np.frombuffer(row["at"], U4).astype(np.int64), here[np.frombuffer(row["grp"], U4)], np.frombuffer(row["cnt"], _I8)
                sums = pairs.setdefault(lang, (names, np.zeros((len(names), len(names)), np.int64)))[1]
                step = max(1, cells // len(names))
                terms = row["terms"]
                for a in range(0, len(terms), step):
                    b = min(len(terms), a + step)
                    c = np.zeros((b - a, len(names)), np.int64)
                    cut = slice(at[a], at[b])
                    c[np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), source[cut]] = count[cut]
                    p, q = shares(c, totals, v), shares(c.sum(1), totals.sum(), v)
                    for g in range(len(names)):
                        sums[g] += figures(p[:, g : g + 1], p).sum(0)
                        held = np.flatnonzero((c[:, g] > 0) & (p[:, g] > q))
                        if not len(held):
                            continue
                        f = figures(p[held, g], q[held])
                        first = np.argsort(-f, kind="stable")[:top]
                        new = [(-int(f[i]), terms[a + held[i]].encode()) for i in first.tolist()]
                        list_ = best.get((lang, names[g]))
                        best[lang, names[g]] = sorted(list_ + new)[:top] if list_ else new
        rows = [("pair", lang, names[g], names[h], int(sums[g, h])) for lang, (names, sums) in pairs.items() for g in range(len(names)) for h in range(len(names)) if g != h]
        rows += [("term", lang, source, term.decode(), -f) for (lang, source), found in best.items() for f, term in found]
        for a in range(0, len(rows), 10_000):
            columns = zip(*rows[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(columns)], ["part", "lang", "source", "item", "value"])

    return run


def merged_tries(rows: DataFrame, trie_leaves: int = TRIE_LEAVES, range_entries: int = RANGE_ENTRIES, least: int = LEAST_DOCUMENTS, block: int = BLOCK_TERMS) -> DataFrame:
    """Blocks of the terms that at least so many documents of a lang hold, with their counts by source, of rows(text, lang, source)."""
    sent = written(rows.mapInArrow(_count(trie_leaves, PREFIX_BYTES), _SUBTRIES), "subtries")
    ready, depth = None, PREFIX_BYTES
    while True:
        # a prefix shorter than the depth is a whole term: it cannot be cut further
        heavy = written(sent.groupBy("prefix").agg(F.sum("n").alias("entries")).where((F.col("entries") > range_entries) & (F.length("prefix") >= depth)).select("prefix"), "heavy")
        if not heavy.take(1):
            break
        light = sent.join(heavy, "prefix", "left_anti").select(*_NAMES)
        ready = light if ready is None else ready.unionByName(light)
        depth *= 2
        sent = written(sent.join(heavy, "prefix", "left_semi").select(*_NAMES).mapInArrow(_deeper(depth), _SUBTRIES), "subtries")
    ready = sent if ready is None else ready.unionByName(sent)
    return ready.groupBy("prefix", "depth").applyInArrow(_merge(least, block), _KEPT)


def source_divergence(docs: DataFrame, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cells: int = CELLS, **bounds) -> DataFrame:
    """lang, source, part, item, value and rank: each source's distance to every other source of its lang (part pair), and the terms it has more of than its lang (part term)."""
    own = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(own(text_col, "text"), own(lang_col, "lang"), own(source_col, "source"))
    kept = written(merged_tries(rows, **bounds), "kept")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("g"))
    terms = kept.groupBy("lang").agg(F.sum("n").alias("v"))
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list("g")).alias("g")).join(terms, "lang", "left")
    by_lang = written(by_lang.select("lang", F.col("g.source").alias("all_sources"), F.col("g.total").alias("totals"), F.coalesce("v", F.lit(0)).alias("v")), "totals")
    scored = kept.join(by_lang, "lang").mapInArrow(_score(top, cells), _SCORED)
    scored = written(scored, "scored")
    still = by_lang.where("v = 0").select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item"), F.lit(0).cast("decimal(38,0)").alias("value")).where("source <> item")
    pairs = scored.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).unionByName(still)
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long")).unionByName(scored.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
