"""Operator 2: Jaccard self-join of documents on word shingles, by adaptive multi-match prefixes.

Two documents link when 100 * intersection >= percent * union of their shingle sets. In a global
order of shingles a document's l-prefix has n - ceil(percent * n / 100) + l shingles, and two
linked documents share l shingles of their l-prefixes. The order takes first the shingles below a
hash bound (a fixed share of all), the rarest first, then the rest by hash; so frequencies are
counted for that share alone, and the prefix still holds the rarest shingles there are.

1. One pass over the texts: the distinct sets of a task are gathered in parcels of bounded size. A parcel
   sends each of its first shingles once, with the number of its sets that hold it and the smallest and
   largest of them, so the commonest shingle has one entry a parcel, not one a set.
2. Entries meet by shingle. A shingle of one set only cannot match; the others go back to their parcels
   with their total. Shingles without match lead the prefix, so a set with more of them than its prefix is
   long has no partner and is done; this settles all unique texts exactly.
3. Each remaining set chooses l by estimated candidate cost. Sets that share a 1-prefix shingle are
   joined to that shingle's first set; connected components of these edges hold all links.
4. Components of small size share tasks, dealt by their weight. Of larger ones all shingles are counted: a set
   with more shingles that no other of them has than a partner may lack is done, so texts that share
   but a passage leave, and what stays is joined to components again. In those that are still large each set is
   first counted against the first sets of its prefix shingles, by joins, and verified where they share min(l, l') of them;
   what is then connected over all sets of a shingle needs no more, so a large group of near copies is settled
   there. What is left open is joined to components a last time; of these, large ones are cut in blocks, as many as
   the root of their size, each pair of blocks being a task. In a task a pair is verified exactly once it shares min(l, l') prefix shingles and
   is not yet connected. Links form the classes.

No pairs of a group are emitted: each task gives a spanning forest of its links.

Defined cases: null or empty text: no shingles, linked with nothing, its own class. Fewer words
than the shingle's length: the whole sequence is the one shingle. Very long texts are whole sets like
others. Equal sets are one class, with the smallest doc_id. A null doc_id is a document too; a class of
such alone has a null component_id. Repeated rows stay. An empty table gives no row. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, drop_written, written
from .components import connected_components
from .textops import Words, buffers, mix, slices

#: Longest extension of a prefix, shingles, and the verification cost of a set's shingle against a prefix hit.
MOST_MATCHES, VERIFY_COST = 4, 0.05
#: Shingles of a parcel; documents for each bucket of shingles; shingles of whole sets in a component that one task solves, and in a bin of small ones; rounds of verification by joins.
PARCEL, DOCS_PER_BUCKET, BLOCK_SHINGLES, BIN_SHINGLES, STAR_ROUNDS = 300_000, 4096, 100_000, 200_000, 2
#: Shingles that a task counts at once where sets are counted whole.
SHARED_SHINGLES = 250_000
#: Shingles of whole sets in a bucket of the table that they are joined from, and most shingles of a block where a large component is cut.
BUCKET_SHINGLES, BLOCK_MOST = 2_000_000, 2_000_000
_ODD = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SENT = "kind int, bucket long, parcel long, doc_id long, tag long, key long, n int, fa long, fb long, fas binary, fbs binary, ns binary, ss binary, sizes binary, tokens binary, counts binary, lows binary, highs binary"
_LONGS, _INTS = {"bucket", "parcel", "doc_id", "tag", "key", "fa", "fb"}, {"kind", "n"}
_BACK = "parcel long, tokens binary, counts binary"
_U8, _I8, _U4 = "<u8", "<i8", "<u4"


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h = words.hashes(lower=True)
    rows = np.zeros(0, np.uint64)
    if len(h) >= k:
        rows = h[: len(h) - k + 1] * _ODD[0]
        for j in range(1, k):
            rows = rows + h[j : len(h) - k + 1 + j] * _ODD[j]
        rows = mix(rows)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            own = np.sort(rows[a : b - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield mix(np.add.reduce(h[a:b] * _ODD[: b - a], keepdims=True) + _ODD[-b + a - 1])
        else:
            yield rows[:0]


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Shared shingles without which a set of n has no partner."""
    return -(-percent * n // 100)


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    a = np.add.reduce(mix(own + _ODD[40]), dtype=np.uint64)
    b = np.add.reduce(mix(own ^ _ODD[41]) * _ODD[42], dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def name(a: int, b: int) -> str:
    return f"{a & (1 << 64) - 1:016x}{b & (1 << 64) - 1:016x}"


def _emit(columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    names = [x.split()[0] for x in _SENT.split(", ")]
    kind = lambda c: pa.int64() if c in _LONGS else pa.int32() if c in _INTS else pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kind(c)) for c in names], names)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """The first place of each run of equal keys."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _send(k: int, percent: int, share: float, buckets: int, parcel_size: int):
    """Stage 1: a row for each document (kind 0); for each parcel its sets with their first shingles (kind 2), and its shingles by bucket (kind 1)."""
    bound = np.uint64(int(share * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[int, int, int, int, np.ndarray]] = []
        size, parcel = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            fa, fb, n, s = (np.array([x[i] for x in held], np.int64) for i in range(4))
            sizes = np.array([len(x[4]) for x in held], np.int64)
            tokens = np.concatenate([x[4] for x in held])
            packed = {"fas": fa.astype(_I8), "fbs": fb.astype(_I8), "ns": n.astype(_U4), "ss": s.astype(_U4), "sizes": sizes.astype(_U4), "tokens": tokens.astype(_U8)}
            yield _emit({"kind": [2], "parcel": [parcel]} | {c: [x.tobytes()] for c, x in packed.items()})
            holder = np.repeat(fa, sizes)
            bucket = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((tokens, bucket))
            tokens, holder, bucket = tokens[order], holder[order], bucket[order]
            first = _runs(tokens)
            counts, lows, highs = np.diff(np.append(first, len(tokens))), np.minimum.reduceat(holder, first), np.maximum.reduceat(holder, first)
            # in each bucket those of one set come first; counts and largest sets are sent of the others alone
            order = np.lexsort((counts > 1, bucket[first]))
            token, of, counts, lows, highs = tokens[first][order].astype(_U8), bucket[first][order], counts[order], lows[order].astype(_I8), highs[order].astype(_I8)
            cuts = np.append(_runs(of), len(of)).tolist()
            rows = {c: [] for c in ("bucket", "tokens", "lows", "counts", "highs")}
            for a, b in zip(cuts[:-1], cuts[1:]):
                more = a + int(np.searchsorted(counts[a:b] > 1, True))
                for c, x in zip(rows, (int(of[a]), token[a:b].tobytes(), lows[a:b].tobytes(), counts[more:b].astype(_U4).tobytes(), highs[more:b].tobytes())):
                    rows[c].append(x)
            yield _emit(rows | {"kind": [1] * len(cuts[1:]), "parcel": [parcel] * len(cuts[1:])})

        for whole in batches:
            for batch in slices(whole, "text"):
                out = {c: [] for c in ("n", "fa", "fb")}
                for own in shingle_sets(Words(*buffers(batch.column("text"))), k):
                    n = len(own)
                    key = fingerprint(own) if n else (0, 0)
                    for c, x in zip(out, (n, *key)):
                        out[c].append(x)
                    if n and key not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(key)
                        s = int(np.searchsorted(own, bound))
                        first = own[: max(s, n - needed(n, percent) + MOST_MATCHES)].copy()
                        held.append((*key, n, s, first))
                        size += len(first)
                yield _emit(out | {"kind": [0] * batch.num_rows, "doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "key": batch.column("key")})
                if size > parcel_size:
                    yield from flush()
                    held.clear()
                    size, parcel = 0, parcel + 1
        if held:
            yield from flush()

    return run


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(column).to_pylist())])


def _count(table: pa.Table) -> pa.Table:
    """Stage 2, for one bucket of shingles: those that more than one set holds go back to their parcels, with the number of sets of all parcels."""
    tokens, lows = _joined(table, "tokens", _U8), _joined(table, "lows", _I8)
    counts, highs = np.ones(len(tokens), _U4), lows.copy()
    sizes, more = ([len(x) // 8 for x in table.column(c).to_pylist()] for c in ("tokens", "highs"))
    several = np.concatenate([np.zeros(0, np.int64), *(np.arange(end - m, end) for end, m in zip(np.cumsum(sizes).tolist(), more))])
    counts[several], highs[several] = _joined(table, "counts", _U4), _joined(table, "highs", _I8)
    parcel = np.repeat(np.array(table.column("parcel").to_pylist(), np.int64), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, parcel = tokens[order], parcel[order]
    first = _runs(tokens)
    out = {"parcel": [], "tokens": [], "counts": []}
    if len(first):
        length = np.diff(np.append(first, len(tokens)))
        live = np.repeat(np.minimum.reduceat(lows[order], first) != np.maximum.reduceat(highs[order], first), length)
        total = np.repeat(np.minimum(np.add.reduceat(counts[order].astype(np.int64), first), 0xFFFFFFFF), length).astype(_U4)
        tokens, parcel, total = tokens[live], parcel[live], total[live]
        order = np.argsort(parcel, kind="stable")
        tokens, parcel, total = tokens[order], parcel[order], total[order]
        cuts = np.append(_runs(parcel), len(parcel)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            for c, x in zip(out, (int(parcel[a]), tokens[a:b].tobytes(), total[a:b].tobytes())):
                out[c].append(x)
    return pa.table({"parcel": pa.array(out["parcel"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})


_PREFIXES = "fp string, n int, matches int, one int, prefix array<long>"


def _prefixes(percent: int, share: float):
    """Stage 3, for one parcel: its sets that may have a partner, with l and the l-prefix."""
    bound = np.uint64(int(share * 2**64))

    def run(parcels: pa.Table, back: pa.Table) -> pa.Table:
        out = {c: [] for c in ("fp", "n", "matches", "one", "prefix")}
        known, totals = _joined(back, "tokens", _U8), _joined(back, "counts", _U4)
        order = np.argsort(known)
        known, totals = known[order], totals[order]
        for row in parcels.to_pylist() if len(known) else ():
            fa, fb, n, s, sizes, tokens = (np.frombuffer(row[c], k) for c, k in (("fas", _I8), ("fbs", _I8), ("ns", _U4), ("ss", _U4), ("sizes", _U4), ("tokens", _U8)))
            n, s = n.astype(np.int64), s.astype(np.int64)
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            live = known[at] == tokens
            tokens, doc, counts = tokens[live], np.repeat(np.arange(len(n)), sizes)[live], totals[at[live]].astype(np.int64)
            late = tokens >= bound
            dead = s - np.bincount(doc[~late], minlength=len(n))
            one = n - needed(n, percent) + 1
            order = np.lexsort((tokens, np.where(late, 0, counts), late, doc))
            doc, tokens, counts, late = doc[order], tokens[order], counts[order], late[order]
            begin = np.searchsorted(doc, np.arange(len(n) + 1))
            for i in np.flatnonzero((dead < one) & (begin[1:] > begin[:-1])).tolist():
                x, y = begin[i], begin[i + 1]
                # before the late shingles all positions are known; of those, all that live are taken
                early = int(np.searchsorted(late[x:y], True))
                reach = [x + min(int(one[i] - dead[i]) + extra, early) if one[i] + extra <= s[i] else y for extra in range(MOST_MATCHES)]
                hits = np.concatenate([[0], np.cumsum(counts[x:y] - 1)])
                extra = int(np.argmin([hits[r - x] * (1 + VERIFY_COST * n[i] / (extra + 1)) for extra, r in enumerate(reach)]))
                for c, v in zip(out, (name(int(fa[i]), int(fb[i])), int(n[i]), extra + 1, int(reach[0] - x), tokens[x : reach[extra]].view(np.int64))):
                    out[c].append(v)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link, by the exact integer test."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < needed(len(b), percent):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], prefixes: list[np.ndarray], matches: np.ndarray, percent: int, known: list[str] | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets, a spanning forest of them; sets of one known class count as connected. Where side is given, links within a side are left to other calls.

    The sets are taken in order, and the shingles of each are counted for the later sets that hold them, too. A pair with
    min(l, l') of these is verified unless connected by then; no other pair is. A shingle whose sets are all connected
    is not looked at again, so a large group of copies costs its first sets' counts. Every link of two sets not
    connected otherwise is found.
    """
    head: dict[str, int] = {}
    roots = np.array([i if known is None else head.setdefault(known[i], i) for i in range(len(sets))], np.int64)
    out: list[tuple[int, int]] = []
    size = np.array([len(x) for x in prefixes], np.int64)
    if not size.sum():
        return out
    token, doc = np.concatenate(prefixes), np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((doc, token))
    token, doc = token[order], doc[order]
    begin = _runs(token)
    end = np.append(begin[1:], len(token))
    group = np.repeat(np.arange(len(begin)), end - begin)
    by_doc = np.argsort(doc, kind="stable")
    own = np.searchsorted(doc[by_doc], np.arange(len(sets) + 1))
    done = end - begin < 2
    for i in range(len(sets)):
        mine = group[by_doc[own[i] : own[i + 1]]]
        mine = mine[~done[mine]]
        if not len(mine):
            continue
        held = [doc[begin[g] : end[g]] for g in mine.tolist()]
        others = np.concatenate(held)
        others = others[(others > i) & (roots[others] != roots[i])]
        if side is not None:
            others = others[side[others] != side[i]]
        partners, count = np.unique(others, return_counts=True)
        met = False
        for j in partners[count >= np.minimum(matches[i], matches[partners])].tolist():
            if roots[i] != roots[j] and linked(sets[i], sets[j], percent):
                low, high = sorted((roots[i], roots[j]))
                roots[roots == high] = low
                out.append((i, j))
                met = True
        if met or not len(others):
            done[mine] = [(roots[x] == roots[i]).all() for x in held]
    return out


def _solve(percent: int):
    """Stage 4, for one bin: links of each of its components."""

    def run(table: pa.Table) -> pa.Table:
        fp, home, known = table.column("fp").to_pylist(), np.array(table.column("home").to_pylist()), table.column("known").to_pylist()
        sets = [np.frombuffer(x, _U8) for x in table.column("shingles").to_pylist()]
        prefixes = [np.array(x, np.int64).view(np.uint64) for x in table.column("prefix").to_pylist()]
        matches = np.array(table.column("matches").to_pylist(), np.int64)
        side = np.array(table.column("side").to_pylist(), np.int64)
        us, vs = [], []
        order = np.argsort(home, kind="stable")
        cuts = np.append(_runs(home[order]), len(order)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = sorted(order[a:b].tolist(), key=lambda i: (len(sets[i]), fp[i]))
            for i, j in forest([sets[i] for i in own], [prefixes[i] for i in own], matches[own], percent, [known[i] for i in own], side[own] if side[own].any() else None):
                us.append(fp[own[i]])
                vs.append(fp[own[j]])
        return pa.table({"u": pa.array(us, pa.string()), "v": pa.array(vs, pa.string())})

    return run


def _verify(percent: int):
    """The pairs that link, of rows with both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [linked(np.frombuffer(a, _U8), np.frombuffer(b, _U8), percent) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(yes, pa.bool_()))

    return run


def _whole(k: int):
    """fp and the whole set of each text; equal rows that follow each other are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for whole in batches:
            for batch in slices(whole, "text"):
                fps, sets = [], []
                for key, own in zip(batch.column("key").to_pylist(), shingle_sets(Words(*buffers(batch.column("text"))), k)):
                    if len(own) and key != before:
                        fps.append(name(*fingerprint(own)))
                        sets.append(own.astype(_U8).tobytes())
                    before = key
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.string()), pa.array(sets, pa.binary())], ["fp", "shingles"])

    return run


def _text(name: Column | str) -> Column:
    """A set's name from its bytes."""
    return F.lower(F.hex(name))


def _homes(token: DataFrame) -> DataFrame:
    """node and root of the components of sets that share a token, of token(fp, token), fp as bytes: each joins the token's first set."""
    heads = written(token.groupBy("token").agg(F.min("fp").alias("head"), F.count("*").alias("c")).where("c > 1").drop("c"), "heads")
    return connected_components(token.join(heads, "token").where("fp <> head").select(_text("fp").alias("u"), _text("head").alias("v")))


def _sized(member: DataFrame) -> DataFrame:
    """member(home, n, ...) with the shingles of each component. The sums are written, so that the join may be broadcast or split where a component is large."""
    return written(member.join(written(member.groupBy("home").agg(F.sum("n").alias("total")), "sizes"), "home"), "members")


_SHARED = "bucket int, tokens binary, holders binary, sizes binary"


def _shared(buckets: int):
    """The distinct shingles of many sets at once by bucket: those that one of these sets holds, together for each holder (12 bytes of its name), before the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        names: list[bytes] = []

        def flush() -> pa.RecordBatch:
            tokens, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
            # of shingles that several sets hold no holder is needed
            holder = np.where(n > 1, len(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])[first])
            bucket = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((holder, bucket))
            tokens, holder, bucket = tokens[order].astype(_U8), holder[order], bucket[order]
            rows = {c: [] for c in ("bucket", "tokens", "holders", "sizes")}
            cuts = np.append(_runs(bucket), len(bucket)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                one = int(np.searchsorted(holder[a:b], len(sets)))
                starts = _runs(holder[a : a + one])
                who, size = holder[a : a + one][starts].tolist(), np.diff(np.append(starts, one))
                for c, x in zip(rows, (int(bucket[a]), tokens[a:b].tobytes(), b"".join(names[i] for i in who), size.astype(_U4).tobytes())):
                    rows[c].append(x)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows.values(), kinds)], list(rows))

        size = 0
        for batch in batches:
            for fp, shingles in zip(batch.column("fp").to_pylist(), batch.column("shingles").to_pylist()):
                sets.append(np.frombuffer(shingles, _U8))
                names.append(bytes.fromhex(fp[:24]))
                size += len(sets[-1])
                if size > SHARED_SHINGLES:
                    yield flush()
                    sets.clear()
                    names.clear()
                    size = 0
        if sets:
            yield flush()

    return run


def _owned(table: pa.Table) -> pa.Table:
    """For one bucket: how many shingles each set holds that no other set does."""
    tokens, names, owner = [np.zeros(0, _U8)], [], [np.zeros(0, np.int64)]
    for row, held, sizes in zip(*(table.column(c).to_pylist() for c in ("tokens", "holders", "sizes"))):
        tokens.append(np.frombuffer(row, _U8))
        own = np.repeat(np.arange(len(sizes) // 4) + len(names), np.frombuffer(sizes, _U4))
        names += [held[i : i + 12] for i in range(0, len(held), 12)]
        owner += [own, np.full(len(tokens[-1]) - len(own), -1)]
    token, owner = np.concatenate(tokens), np.concatenate(owner)
    order = np.argsort(token)
    first = _runs(token[order])
    alone = owner[order[first[np.diff(np.append(first, len(token))) == 1]]]
    own = np.bincount(alone[alone >= 0], minlength=len(names))
    some = np.flatnonzero(own)
    return pa.table({"holder": pa.array([names[i] for i in some.tolist()], pa.binary()), "own": pa.array(own[some], pa.int64())})


def _partnered(member: DataFrame, sets: DataFrame, percent: int, volume: int) -> DataFrame:
    """Without the sets that have more shingles of their own than a partner may lack; volume: shingles of all sets."""
    buckets = max(1, -(-volume // BUCKET_SHINGLES))
    counted = member.select("fp").join(sets, "fp").select("fp", "shingles").mapInArrow(_shared(buckets), _SHARED)
    own = counted.groupBy("bucket").applyInArrow(_owned, "holder binary, own long").groupBy("holder").agg(F.sum("own").alias("own"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100)
    return member.withColumn("holder", F.unhex(F.substring("fp", 1, 24))).join(own, "holder", "left").where(F.coalesce("own", F.lit(0)) <= most).drop("holder", "own")


def _relabelled(member: DataFrame, edges: DataFrame) -> DataFrame:
    """member(fp, known, ...) with the classes that links between its sets join, and the links as they are."""
    found = connected_components(edges).select(F.col("node").alias("fp"), F.col("root"))
    return member.drop("known").join(found, "fp", "left").withColumn("known", F.coalesce("root", "fp")).drop("root")


def _bins(block_shingles: int) -> Column:
    """(bin, side) of each bin that a set of a component goes to, of its home, total and fp: the component, or each pair of its blocks.

    A set is sent as often as there are blocks, so these grow in number with the root of the component's size, and in size
    up to BLOCK_MOST. In a pair of blocks the sets of one are compared to those of the other, in a block with itself all are.
    """
    blocks = f"greatest(ceil(sqrt(2 * total / {block_shingles})), ceil(total / {BLOCK_MOST}))"
    block = f"pmod(xxhash64(fp), {blocks})"
    pair = f"struct(concat_ws(':', home, least({block}, j), greatest({block}, j)) AS bin, CASE WHEN j = {block} THEN 0 WHEN j < {block} THEN 1 ELSE 2 END AS side)"
    return F.expr(f"if(total <= {block_shingles}, array(struct(home AS bin, 0 AS side)), transform(sequence(0L, {blocks} - 1), j -> {pair}))")


def _read_again(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted(doc_id, key), found by a bitmap of their ids, which is small enough to be broadcast where a list of keys is not; so texts of other rows are not shuffled."""
    number = F.coalesce("doc_id", F.lit(0))
    word, bit = F.shiftright(number, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))
    words = written(wanted.groupBy(word).agg(F.bit_or(bit).alias("bits")), "words")
    found = rows.withColumn("word", word).join(words, "word").where(F.col("bits").bitwiseAND(bit) != 0)
    if found.count() > wanted.count():  # ids that several rows have
        found = found.join(wanted.select("key").distinct(), "key", "left_semi")
    return found


def _stars(member: DataFrame, sets: DataFrame, percent: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Links found by verifying each set against the first ones of its prefix shingles, where the two share min(l, l') of these; and the (fp, known, token) that are left open.

    First is what comes first by a hash of the set, another one in each round, so near copies mostly have the same first set for all their
    shingles. A shingle whose sets are all in one class is closed. Pairs are at most one for each shingle of a set.
    """
    links, now = None, member.withColumn("known", F.col("fp"))
    for turn in range(rounds + 1):
        token = now.select(F.unhex("fp").alias("fp"), F.unhex("known").alias("known"), "matches", F.explode("prefix").alias("token"))
        first = F.min_by(F.struct("fp", "known", "matches"), F.xxhash64("fp", F.lit(turn)))
        heads = token.groupBy("token").agg(F.min("known").alias("low"), F.max("known").alias("high"), first.alias("head")).where("low <> high").drop("low", "high")
        open_ = token.join(written(heads, "heads"), "token")
        if turn == rounds:
            return links, open_.select("fp", _text("known").alias("known"), "token")
        shared = open_.where("known <> head.known").groupBy(F.col("fp").alias("u"), F.col("head.fp").alias("v")).agg(F.count("*").alias("c"), F.min(F.least("matches", "head.matches")).alias("least"))
        pairs = shared.where("c >= least").select(_text("u").alias("u"), _text("v").alias("v"))
        # few sets are first ones, of many pairs each: written apart, so that this join can be split
        pairs = written(pairs, "pairs")
        firsts = written(sets.join(pairs.select(F.col("v").alias("fp")).distinct(), "fp", "left_semi"), "firsts")
        both = pairs.join(firsts.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
        found = both.select("u", "v", "a", "b").mapInArrow(_verify(percent), "u string, v string")
        links = written(found if links is None else links.unionByName(found), "links")
        now = written(_relabelled(member.withColumn("known", F.col("fp")), links), "known")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", docs_per_bucket: int = DOCS_PER_BUCKET, block_shingles: int = BLOCK_SHINGLES, parcel: int = PARCEL, star_rounds: int = STAR_ROUNDS, tag: Column | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs, whole texts compared on k-word shingles at percent/100 Jaccard.

    tag: a long worked out for each row, to be returned with it and with `kept`, which is true for one tag of each class:
    that of the smallest doc_id (of one without doc_id where there is no other), and of its rows the smallest.
    """
    more = [] if tag is None else ["tag", "kept"]
    # key finds a row's text again; rows of one doc_id, or without, differ in it by their texts
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(None).cast("long") if tag is None else tag).alias("tag")).withColumn("key", F.xxhash64("doc_id", "text"))
    share = min(0.9, 1.5 * (100 - percent) / 100)
    buckets = max(4, -(-docs.select(id_col).count() // docs_per_bucket))
    # one pass over the texts writes all kinds of rows, each to its own folder
    sent = written(rows.mapInArrow(_send(k, percent, share, buckets, parcel), _SENT), "sent", by="kind")
    documents = sent.where("kind = 0")
    back = sent.where("kind = 1").groupBy("bucket").applyInArrow(_count, _BACK)
    parcels = sent.where("kind = 2").select("parcel", "fas", "fbs", "ns", "ss", "sizes", "tokens")
    prefixes = written(parcels.groupBy("parcel").cogroup(back.groupBy("parcel")).applyInArrow(_prefixes(percent, share), _PREFIXES).dropDuplicates(["fp"]), "prefixes")
    for kind in (1, 2):
        drop_written(sent, f"kind={kind}")

    docs_ = documents.select("doc_id", "tag", "key", F.col("n").alias("n_shingles"), F.concat(F.lower(F.lpad(F.hex("fa"), 16, "0")), F.lower(F.lpad(F.hex("fb"), 16, "0"))).alias("fp"))
    least = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tag", "key")
    held = docs_.where("n_shingles > 0").groupBy("fp").agg(F.min(least).alias("least"))

    ones = lambda df: df.select(F.unhex("fp").alias("fp"), F.explode(F.expr("slice(prefix, 1, one)")).alias("token"))
    homes = lambda token: _homes(token).select(F.col("node").alias("fp"), F.col("root").alias("home"))
    member = _sized(homes(ones(prefixes)).join(prefixes, "fp"))
    wanted = written(member.select("fp").join(held, "fp").select("least.doc_id", "least.key").distinct(), "wanted")
    whole = _read_again(rows, wanted).select("key", "text")
    sets = whole.mapInArrow(_whole(k), "fp string, shingles binary")
    heaviest, volume = member.agg(F.coalesce(F.max("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if heaviest > block_shingles:  # they are joined by fp several times, and dealt once
        sets = bucketed(sets, min(100_000, max(8, -(-volume // BUCKET_SHINGLES))), "fp")
    columns = ["bin", "side", "home", "fp", "known", "matches", "prefix", "shingles"]

    def solved(some: DataFrame, sets: DataFrame) -> DataFrame:
        """Links of components that fit into a task: the smallest are dealt to bins by a hash, the others are bins of their own."""
        few = F.col("total") <= block_shingles // 2
        weight = some.agg(F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0))).first()[0]
        bins = max(1, -(-weight // BIN_SHINGLES))
        place = F.when(few, F.pmod(F.xxhash64("home"), F.lit(bins)).cast("string")).otherwise(F.col("home"))
        dealt = some.withColumn("bin", place).withColumn("side", F.lit(0)).withColumn("known", F.col("fp")).join(sets, "fp")
        return dealt.select(*columns).groupBy("bin").applyInArrow(_solve(percent), "u string, v string")

    fits = F.col("total") <= block_shingles
    edges = solved(member.where(fits), sets)
    if heaviest > block_shingles:
        large = written(_partnered(member.where(~fits).drop("home", "total"), sets, percent, volume), "partnered")
        large = _sized(homes(ones(large)).join(large, "fp"))
        edges = edges.unionByName(solved(large.where(fits), sets))
        large = large.where(~fits).drop("home", "total")
        if large.take(1):
            links, open_ = _stars(large, sets, percent, star_rounds)
            open_ = written(open_, "open")
            left = homes(open_.select("fp", "token")).join(open_.select(_text("fp").alias("fp"), "known").distinct(), "fp").join(large, "fp")
            left = _sized(left).withColumn("to", F.explode(_bins(block_shingles)))
            rest = left.select("to.bin", "to.side", "home", "fp", "known", "matches", "prefix").join(sets, "fp").select(*columns)
            edges = edges.unionByName(links).unionByName(rest.groupBy("bin").applyInArrow(_solve(percent), "u string, v string"))
    found = connected_components(edges)
    # classes and sets are written before they are joined to what may be many rows of one of them
    classes = written(found.join(held, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("first")), "classes")
    of_set = held.join(found.join(classes, "root").select(F.col("node").alias("fp"), "first"), "fp", "left").select("fp", F.coalesce("first", "least").alias("first"))
    of_set = written(of_set, "set_classes")
    some = docs_.where("n_shingles > 0").join(of_set, "fp").select("doc_id", F.col("n_shingles").cast("long"), F.col("first.doc_id").alias("component_id"), "tag", F.col("tag").eqNullSafe(F.col("first.tag")).alias("kept"))
    none = docs_.where("n_shingles = 0").select("doc_id", F.col("n_shingles").cast("long"), F.col("doc_id").alias("component_id"), "tag", F.lit(True).alias("kept"))
    return some.unionByName(none).select("doc_id", "n_shingles", "component_id", *more)
