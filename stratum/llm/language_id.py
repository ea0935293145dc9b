"""Operator 1: language of whole texts, by unigram models that sum over all segmentations.

The pieces are those of a fixed public vocabulary. A language gives each piece a probability; a
word's probability is the sum over all its segmentations into pieces, by a forward algorithm, and
a text's is the product over its words. Probabilities come from labelled texts by expectation
maximisation over the same lattice.

Learning reads a bounded sample: about docs_per_language labelled documents of each language, chosen
by a hash of the doc_id, and all their words; those of more than learn_letters letters, as scripts without blanks have them,
are learned window by window, so that no letter is left out. There is no bound on the
number of languages: the table of probabilities takes 256 KB a language in each worker, and all else is
sized so that it does not grow with it. Prediction covers every text, whatever the length of its
words, and reads nothing but the text.

Defined cases: null text or text without letters: `und`, score 0. Ties go to the language first by
code point. No labelled text at all: `und` everywhere. A letter without piece is the unknown piece.
Repeated rows and ids are predicted each, and learned once; a null doc_id counts as empty text in the
fold's crc32. An empty table gives no row. Columns other than those named are not read.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, tokenizer_path
from .textops import Grown, WordTable, buffers, mix, slices
from .tokens import Pieces

#: Rounds end earlier once the likelihood gains less than SETTLED of itself.
DOCS_PER_LANGUAGE, LEARN_LETTERS, ROUNDS, SETTLED = 300, 32, 4, 0.002
START = 0x2581
#: Numbers in the arrays of a step over many words at once, and of the scores that a worker keeps.
CELLS = 4_000_000
_SMOOTH, _RESCALE = 0.01, 8
_letters: np.ndarray | None = None


def letter_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of the words that have some: code points (a start sign before each word), their offsets, each one's word, and the letters of each word."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    joined = "\n".join(words) + "\n"
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined)
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = codes == 10
    word = np.cumsum(stop) - stop
    keep = _letters[codes]
    codes, word = codes[keep], word[keep]
    count = np.bincount(word, minlength=len(words))
    some = np.flatnonzero(count)
    opens = np.cumsum(count[some]) - count[some]
    out = np.insert(codes, opens, START)
    return out, np.append(opens + np.arange(len(some)), len(out)), some, count


def windows(begin: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut into windows of at most that many letters: their offsets, and the run of each."""
    length = np.diff(begin)
    count = -(-length // most)
    run = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return np.append(begin[:-1][run] + nth * most, begin[-1]), run


class Lattice:
    """The pieces of a vocabulary, found in runs of code points by hash."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        rng = np.random.default_rng(5)
        self.base = np.uint64(rng.integers(1, 1 << 62) * 2 + 1)
        self.power = np.full(self.longest + 1, self.base, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        bits = max(12, int(np.ceil(np.log2(len(pieces) + 1))) + 4)
        self.shift = np.uint64(64 - bits)
        self.slots = [(np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.size, np.int32)) for _ in range(4)]
        left = np.arange(len(pieces))
        for level, (keys, ids) in enumerate(self.slots):
            slot = self._slot(hashes[left], level)
            _, chosen = np.unique(slot, return_index=True)
            keys[slot[chosen]], ids[slot[chosen]] = hashes[left[chosen]], left[chosen]
            left = np.delete(left, chosen)
        self.levels = next((n for n in range(1, 5) if not len(left) and all((i == self.size).all() for _, i in self.slots[n:])), 4)

    def _hash(self, piece: str) -> int:
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                total = total * self.base + np.uint64(ord(c) + 1)
            return int(mix(np.array([total + np.uint64(len(piece) << 40)], np.uint64))[0])

    def _slot(self, hashes: np.ndarray, level: int) -> np.ndarray:
        return ((hashes << np.uint64(13 * level)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
        """Piece of that length at each place, or size where there is none."""
        total = np.zeros(len(at), np.uint64)
        for j in range(length):
            total = total * self.base + (codes[at + j] + np.uint32(1))
        hashes = mix(total + np.uint64(length << 40))
        out = np.full(len(at), self.size, np.int32)
        for level in range(self.levels):
            keys, ids = self.slots[level]
            slot = self._slot(hashes, level)
            hit = keys[slot] == hashes
            out[hit] = ids[slot[hit]]
        return out

    def pieces(self, codes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, the piece of that length at each place; size + 1 where there is none, size for a letter that is none."""
        left = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(codes))
        out = []
        for k in range(1, self.longest + 1):
            at = np.flatnonzero(left >= k)
            if not len(at):
                break
            ids = np.full(len(codes), self.size if k == 1 else self.size + 1, np.int32)
            own = self.find(codes, k, at)
            ids[at] = own if k == 1 else np.where(own == self.size, self.size + 1, own)
            out.append(ids)
        return out

    def parts(self, begin: np.ndarray, cells: int, whole: bool = False) -> Iterator[np.ndarray]:
        """Runs, the longest first, so many at once that `cells` numbers for each run (each letter and run, if whole) stay within CELLS, and letters too."""
        length = np.diff(begin)
        order = np.argsort(-length, kind="stable")
        a = 0
        while a < len(order):
            longest = int(length[order[a]]) + 1
            n = max(1, CELLS // (cells * (longest if whole else self.longest + 1)))
            b = min(len(order), a + n)
            b = max(a + 1, min(b, int(np.searchsorted(np.cumsum(length[order[a:b]]), CELLS // self.longest, "right")) + a))
            yield order[a:b]
            a = b

    def forward(self, codes: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Log probability of each run in each language, over all segmentations; table: pieces and the unknown one by languages.

        All runs of a part go forward letter by letter together; only the last places that a piece can
        reach back to are held, and are brought back to size every few letters. So runs of any length will do.
        """
        out = np.zeros((len(begin) - 1, table.shape[1]))
        wide = np.vstack([table, np.zeros(table.shape[1])])
        for part in self.parts(begin, table.shape[1]):
            own = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in part.tolist()])
            first = np.append(0, np.cumsum(begin[part + 1] - begin[part]))
            length = np.diff(first)
            pieces = self.pieces(codes[own], first)
            ring, scale, size = np.zeros((self.longest + 1, len(part), table.shape[1])), np.zeros((len(part), table.shape[1])), self.longest + 1
            ring[0] = 1
            reach = np.searchsorted(-length, -np.arange(length[0] + 2), "right")  # runs of at least that many letters
            for i in range(int(length[0]) + 1):
                now, m = ring[i % size], int(reach[i + 1])
                done = slice(m, int(reach[i]))
                out[part[done]] = np.log(np.maximum(now[done], 1e-300)) + scale[done]
                for k, ids in enumerate(pieces, 1):
                    n = int(reach[min(i + k, len(reach) - 1)])
                    if not n:
                        break
                    ids = ids[first[:n] + i]
                    if k == 1:
                        ring[(i + 1) % size][:n] += now[:n] * wide[ids]
                    elif len(hit := np.flatnonzero(ids <= self.size)):
                        ring[(i + k) % size][hit] += now[hit] * wide[ids[hit]]
                now[:] = 0
                if i % _RESCALE == _RESCALE - 1 and m:
                    most = ring[:, :m].max(0)
                    most[most == 0] = 1
                    ring[:, :m] /= most
                    scale[:m] += np.log(most)
        return out

    def expected(self, codes: np.ndarray, begin: np.ndarray, weight: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected number of each piece in each language, over all segmentations, and the log likelihood; weight: runs by languages. For short runs."""
        out, likelihood = np.zeros((table.shape[0], table.shape[1])), 0.0
        wide = np.vstack([table, np.zeros(table.shape[1])])
        for part in self.parts(begin, 2 * table.shape[1], True):
            own = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in part.tolist()])
            first = np.append(0, np.cumsum(begin[part + 1] - begin[part]))
            length = np.diff(first)
            alpha, beta = np.zeros((length[0] + 1, len(part), table.shape[1])), np.zeros((length[0] + 1, len(part), table.shape[1]))
            alpha[0] = 1
            beta[length, np.arange(len(part))] = 1
            steps = []
            for k, ids in enumerate(self.pieces(codes[own], first), 1):
                for i in range(int(length[0]) - k + 1):
                    n = int(np.searchsorted(-length, -(i + k), "right"))
                    near = ids[first[:n] + i]
                    if len(hit := np.flatnonzero(near <= self.size)):
                        steps.append((i, k, hit, near[hit]))
            steps.sort(key=lambda x: (x[0], x[1]))
            for i, k, hit, ids in steps:
                alpha[i + k, hit] += alpha[i, hit] * wide[ids]
            for i, k, hit, ids in reversed(steps):
                beta[i, hit] += beta[i + k, hit] * wide[ids]
            total = np.maximum(alpha[length, np.arange(len(part))], 1e-300)
            scale = weight[part] / total
            likelihood += float((weight[part] * np.log(total)).sum())
            for i, k, hit, ids in steps:
                share = alpha[i, hit] * wide[ids] * beta[i + k, hit] * scale[hit]
                for language in range(table.shape[1]):
                    out[:, language] += np.bincount(ids, share[:, language], minlength=len(out))
        return out, likelihood


def public_pieces(path: str) -> list[str]:
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
    return [vocabulary.id_to_piece(i) for i in range(vocabulary.get_piece_size()) if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i))]


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One lattice for each worker process."""
    if path not in _lattices:
        _lattices[path] = Lattice(public_pieces(path))
    return _lattices[path]


class Scorer:
    """Log probabilities of texts; each distinct word is scored once in a worker process."""

    def __init__(self, path: str, table: np.ndarray):
        self.lattice, self.table, self.wide = lattice(path), table, table.shape[1]
        self.known = WordTable(self._fill, self._reset, max(1000, min(400_000, CELLS // self.wide)))
        self._reset()

    def _reset(self) -> None:
        self.scores, self.letters = Grown(np.float64, self.wide), Grown(np.int32)

    def _fill(self, words: list[bytes]) -> None:
        codes, begin, word, count = letter_words([w.decode("utf-8", "replace") for w in words])
        own = np.zeros((len(words), self.wide))
        own[word] = self.lattice.forward(codes, begin, self.table)
        self.scores.add(own)
        self.letters.add(count)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Pieces(*buffers(texts))
        record = self.known.records(words)
        total, letters = np.zeros((len(texts), self.wide)), np.zeros(len(texts), np.int64)
        some = np.flatnonzero(np.diff(words.first) > 0)
        if len(some):
            for a in range(0, self.wide, 8):
                total[some, a : a + 8] = np.add.reduceat(self.scores.rows[:, a : a + 8][record], words.first[some])
            letters[some] = np.add.reduceat(self.letters.rows[record], words.first[some], dtype=np.int64)
        return total, letters


_scorers: dict[str, Scorer] = {}


def _scorer(key: str, path: str, table: np.ndarray) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(path, table)
    return _scorers[key]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word and number of the words of texts, cut as for scoring."""
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Pieces(*buffers(batch.column("text")))
            codes, first, _ = words.distinct()
            of, languages = pd.factorize(np.array(batch.column("lang").to_pylist(), object))
            key, n = np.unique(np.repeat(of, np.diff(words.first)) * max(1, len(first)) + codes, return_counts=True)
            language, code = np.divmod(key, max(1, len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(languages[language], pa.string()), pa.array([words.bytes_of(i).decode("utf-8", "replace") for i in first[code].tolist()], pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def learn(labelled: DataFrame, path: str, docs_per_language: int = DOCS_PER_LANGUAGE, learn_letters: int = LEARN_LETTERS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities from labelled(doc_id, text, lang)."""
    context = labelled.sparkSession.sparkContext
    counts = labelled.where("lang is not null").groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_language / r["count"]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_000
    sample = labelled.where(drawn).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    words = sample.mapInArrow(_words, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
    words = words.select("word", F.array(*[F.coalesce(F.try_element_at("n", F.lit(x)), F.lit(0)) for x in languages]).alias("n"))
    words = words.repartition(max(1, context.defaultParallelism), F.xxhash64("word")).persist()
    size = lattice(path).size + 1
    table = np.full((size, len(languages)), 1.0 / size)

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, likelihood = None, 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                weight = batch.column("n").flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                codes, begin, word, count = letter_words(batch.column("word").to_pylist())
                begin, run = windows(begin, learn_letters + 1)
                own, gained = lattice(path).expected(codes, begin, weight[word[run]], shared.value)
                total, likelihood = own if total is None else total + own, likelihood + gained
            if total is not None:
                piece, language = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(piece, -1)), pa.array(np.append(language, 0)), pa.array(np.append(total[piece, language], likelihood))], ["piece", "language", "n"])

        return run

    before = None
    for _ in range(rounds):
        shared = context.broadcast(table)  # pieces by languages
        found = words.mapInArrow(step(shared), "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        likelihood = float(found["n"][found["piece"] < 0].sum())
        found = found[found["piece"] >= 0]
        total = np.zeros_like(table)
        total[found["piece"], found["language"]] = found["n"]
        table = (total + _SMOOTH) / (total.sum(0) + _SMOOTH * size)
        shared.unpersist()
        if before is not None and likelihood - before < SETTLED * abs(before):
            break
        before = likelihood
    words.unpersist()
    return languages, table


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row, from its text alone."""
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(table)  # pieces by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                if not languages:
                    names, score = ["und"] * n, np.zeros(n)
                else:
                    total, letters = _scorer(key, path, shared.value).score(batch.column("text"))
                    best = total.argmax(1)
                    score = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
                    score[letters == 0] = 0
                    names = [languages[i] if some else "und" for i, some in zip(best.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Learn from the documents whose fold is not 1 and predict all: doc_id, held_out, lang_pred, score."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages, table = learn(rows.where((F.pmod(id_crc("doc_id"), F.lit(3)) != 1) & F.col("text").isNotNull()), path, **options)
    found = identify(rows, languages, table, path)
    return found.select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(3)) == 1).alias("held_out"), "lang_pred", "score")
