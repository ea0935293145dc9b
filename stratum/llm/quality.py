"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage is encoded: its words by signed
feature hashing into WORD_FEATURES numbers, and its form (shares of letters, marks, digits and
capitals, word lengths, repetition). A small layer embeds it, gated attention weighs the passages, and
the weighted mean is scored. Embedding, attention and score are learned together from document labels.

Fitting reads at most train_docs labelled documents, in the order of a hash of the doc_id, each of them
whole, and of these the ones that fit into train_passages passages in all; so what the driver
holds is bounded. Scoring reads every passage of every document, however long.

Defined cases: a null or empty text is one empty passage and is scored like any other. Conflicting
or repeated labels of a doc_id count as their mean; null labels do not count. Without labels of
both kinds every score is the share of label 1, or 0.5 without any. A null doc_id is empty text in the
fold's crc32. Repeated rows are scored each; an empty table gives no row; other columns, whatever
their names, are kept where asked for, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, unused, written
from .textops import Words, buffers, slices

PASSAGE_WORDS, WORD_FEATURES, TRAIN_DOCS, TRAIN_PASSAGES, THRESHOLD = 64, 64, 6000, 60_000, 0.3
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|", b"#$%&*@~^_=+<>/\\{}[]`", b"\"'()-", bytes(range(0xC3, 0xF5)), b"\xc3"]
FORM = len(_KINDS) + 9
FEATURES = FORM + WORD_FEATURES


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all texts, and the first passage of each text."""
    buf, offsets = buffers(texts)
    words = Words(buf, offsets)
    number = np.diff(words.first)
    count = np.maximum(1, -(-number // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((first[-1], FEATURES), np.float32)
    if not len(words):
        return out, first
    doc = np.repeat(np.arange(len(number)), number)
    passage = first[doc] + (np.arange(len(words)) - words.first[doc]) // PASSAGE_WORDS
    used, begin = np.unique(passage, return_index=True)
    size = np.diff(np.append(begin, len(words)))
    lo, hi = words.starts[begin], words.ends[begin + size - 1]
    length = (words.ends - words.starts).astype(np.float32)
    mass = np.add.reduceat(length, begin)
    for k, bytes_ in enumerate(_KINDS):
        table = np.zeros(256, bool)
        table[list(bytes_)] = True
        upto = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int32)])
        out[used, k] = (upto[hi] - upto[lo]) / mass
    k = len(_KINDS)
    h = words.hashes(lower=True)
    again = np.zeros(len(words), np.float32)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    key = np.sort((passage.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    distinct = np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(36)).astype(np.int64), minlength=first[-1])[used]
    mean = mass / size
    tail = buf[words.ends - 1]
    out[used, k] = np.add.reduceat(again, begin) / size
    out[used, k + 1] = distinct / size
    out[used, k + 2] = mean / 10
    out[used, k + 3] = np.sqrt(np.maximum(np.add.reduceat(length * length, begin) / size - mean * mean, 0)) / 10
    out[used, k + 4] = np.add.reduceat((length <= 1).astype(np.float32), begin) / size
    out[used, k + 5] = np.add.reduceat(((tail < 128) & ~(((tail | 32) >= 97) & ((tail | 32) <= 122))).astype(np.float32), begin) / size
    out[used, k + 6] = np.log1p(size) / 4
    out[used, k + 7] = np.maximum.reduceat(length, begin) / 40
    out[used, k + 8] = 1
    # the lowest bits of a word's hash name its feature, the next one its sign
    place, sign = (h & np.uint64(WORD_FEATURES - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> np.uint64(16)) & np.uint64(1))
    hashed = np.bincount(passage * WORD_FEATURES + place, sign, len(out) * WORD_FEATURES).reshape(len(out), WORD_FEATURES)
    out[used, FORM:] = hashed[used] / np.sqrt(size)[:, None]
    return out, first


class AttentionPool:
    """Gated attention over the instances of a bag, trained from bag labels by Adam on the cross entropy."""

    def __init__(self, inputs: int, hidden: int = 16, gate: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(inputs, hidden), "b": np.zeros(hidden), "V": g(hidden, gate), "bv": np.zeros(gate), "U": g(hidden, gate), "bu": np.zeros(gate), "w": g(gate, 1)[:, 0], "c": g(hidden, 1)[:, 0], "b0": np.zeros(1)}
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, start, size = self.p, first[:-1], np.diff(first)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"] + p["bv"]), 1 / (1 + np.exp(-(h @ p["U"] + p["bu"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
        a = e / np.repeat(np.add.reduceat(e, start), size)
        z = np.add.reduceat(a[:, None] * h, start)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b0"], -40, 40)))}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self._forward((x - self.mean) / self.scale, first)["y"]

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-3, batch: int = 256, seed: int = 12) -> AttentionPool:
        if len(label) == 0 or label.min() == label.max():
            self.constant = float(label.mean()) if len(label) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x, rng, step = (x - self.mean) / self.scale, np.random.default_rng(seed), 0
        m, v, p = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, self.p
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                begin = np.append(0, np.cumsum(first[own + 1] - first[own]))
                rows = np.repeat(first[own] - begin[:-1], np.diff(begin)) + np.arange(begin[-1])
                step += 1
                for k, g in self.gradient(x[rows], begin, label[own]).items():
                    g = g + decay * p[k] if p[k].ndim > 1 else g
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, for scaled passages x."""
        p, f, start, size = self.p, self._forward(x, first), first[:-1], np.diff(first)
        dy = (f["y"] - label) / len(label)
        dz = np.repeat(dy[:, None] * p["c"], size, 0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start), size))
        dts = de[:, None] * p["w"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = (dz * f["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "bv": dt.sum(0), "U": f["h"].T @ ds, "bu": ds.sum(0), "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "b0": np.array([dy.sum()])}


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> AttentionPool:
    """Fit on docs(doc_id, text) and labels(doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # at most train_docs rows of 16 bytes, so it may be broadcast

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x, first = passages(batch.column("text"))
                rows = [x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(np.diff(first)), pa.array(rows, pa.binary())], ["doc_id", "label", "n", "x"])

    sample = docs.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text").mapInArrow(encode, "doc_id long, label double, n long, x binary")
    # repeated documents of a sampled doc_id: one of them is enough
    sample = written(sample.groupBy("doc_id").agg(F.min_by(F.struct("label", "n", "x"), F.xxhash64("x")).alias("d")).select("doc_id", "d.*"), "bags")
    chosen, total = [], 0
    for doc, n in sample.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "n").collect():  # at most train_docs rows
        if total + n <= train_passages:
            chosen.append(doc)
            total += n
    model = AttentionPool(FEATURES)
    if not chosen:
        return model.fit(np.zeros((0, FEATURES)), np.zeros(1, np.int64), np.zeros(0))
    found = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in chosen], "doc_id long")), "doc_id").select("doc_id", "label", "x").toPandas().sort_values("doc_id")
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in found["x"]]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return model.fit(np.concatenate(bags).astype(np.float64), first, found["label"].to_numpy())


def score(docs: DataFrame, model: AttentionPool, threshold: float = THRESHOLD, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns named in keep, and score and predicted (or as names has it), of each row."""
    text = unused("text", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                y = np.clip(model.score(*passages(batch.column(text))), 0, 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(y, pa.float64()), pa.array((y >= threshold).astype(np.int32), pa.int32())], [*keep, *names])

    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    return rows.mapInArrow(run, T.StructType([*rows.schema[:-1], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def quality(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labels whose fold is not 0 and score all documents: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(F.pmod(id_crc("doc_id"), F.lit(5)) != 0)
    found = score(rows, learn(rows, known, train_docs, train_passages), threshold)
    return found.select("doc_id", (F.pmod(id_crc("doc_id"), F.lit(5)) == 0).alias("held_out"), "score", "predicted")
