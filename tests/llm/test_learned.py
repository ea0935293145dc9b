import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import language_id, quality
from stratum.llm.common import tokenizer_path
from stratum.llm.textops import Words, buffers
from stratum.llm.tokens import Pieces

from .common import DOCS, empty, odd

SF = "/root/testdata/sf0.01"
PIECES = tokenizer_path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice(["a", "b", "ab", "ba", "aba", "▁", "▁a"])
    table = np.array([[0.2, 0.1], [0.15, 0.3], [0.1, 0.05], [0.05, 0.1], [0.1, 0.1], [0.2, 0.2], [0.1, 0.05], [0.1, 0.1]])
    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4, "▁": 5, "▁a": 6}
    words = ["abab", "ba", "xab", "a", "b" * 5]

    def total(w, language):
        if not w:
            return 1.0
        out = 0.0
        for k in range(1, len(w) + 1):
            p = pieces.get(w[:k], 7 if k == 1 else None)
            if p is not None:
                out += table[p, language] * total(w[k:], language)
        return out

    codes, begin, word, count = language_id.letter_words(words)
    got = lattice.forward(codes, begin, table)
    assert word.tolist() == list(range(5)) and count.tolist() == [4, 2, 3, 1, 5]
    assert np.allclose(np.exp(got), [[total("▁" + w, i) for i in (0, 1)] for w in words])
    expected, likelihood = lattice.expected(codes, begin, np.ones((5, 2)), table)
    assert np.isclose(likelihood, got.sum())
    assert np.allclose((expected[:7].T @ np.array([1, 1, 2, 2, 3, 1, 2]) + expected[7]), sum(len(w) + 1 for w in words))


def test_letter_words():
    codes, begin, word, count = language_id.letter_words(["Ab-c1", "12", "", "x" * 70, "É"])
    runs = ["".join(map(chr, codes[a:b])) for a, b in zip(begin[:-1], begin[1:])]
    assert runs == ["▁abc", "▁" + "x" * 70, "▁é"]
    assert word.tolist() == [0, 3, 4] and count.tolist() == [3, 0, 0, 70, 1]


def test_long_words_and_many_languages():
    """Segmentations of words of any length are all summed, in logarithms by hand."""
    lattice = language_id.Lattice(["a", "ab", "b", "aba", "▁"])
    rng = np.random.default_rng(3)
    table = rng.dirichlet(np.ones(6), 300).T
    pieces = {"a": 0, "ab": 1, "b": 2, "aba": 3, "▁": 4}
    words = ["ab" * 900 + "a", "b", "x" * 3, "aba" * 40]
    codes, begin, word, _ = language_id.letter_words(words)
    got = lattice.forward(codes, begin, table)
    for w, row in zip(words, got):
        text, logs = "▁" + w, np.log(table)
        alpha = [np.full(300, -np.inf) for _ in range(len(text) + 1)]
        alpha[0] = np.zeros(300)
        for i in range(len(text)):
            for k in range(1, 4):
                piece = pieces.get(text[i : i + k], 5 if k == 1 else None)
                if piece is not None and i + k <= len(text):
                    alpha[i + k] = np.logaddexp(alpha[i + k], alpha[i] + logs[piece])
        assert np.allclose(row, alpha[-1])


def test_language_of_each_text_by_hand(spark):
    """The query's predictions, from its learned table, by a plain forward sum over each word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    rows = docs.selectExpr("doc_id", "text", "lang")
    languages, table = language_id.learn(rows.where("text is not null"), PIECES, rounds=2)
    found = {r.doc_id: r for r in language_id.identify(rows, languages, table, PIECES).collect()}
    number = {p: i for i, p in enumerate(language_id.public_pieces(PIECES))}
    longest, known = max(map(len, number)), {}

    def word_score(w):
        if w not in known:
            alpha = np.zeros((len(w) + 2, len(languages)))
            alpha[0], text = 1, "▁" + w
            for i in range(len(text)):
                for k in range(1, min(longest, len(text) - i) + 1):
                    piece = number.get(text[i : i + k], len(number) if k == 1 else None)
                    if piece is not None:
                        alpha[i + k] += alpha[i] * table[piece]
            known[w] = np.log(alpha[-1])
        return known[w]

    for r in rows.collect():
        cut = Pieces(*buffers(pa.array([r.text or ""])))
        words = [unicodedata.normalize("NFC", cut.bytes_of(i).decode()).lower() for i in range(len(cut))]
        words = [w for w in ("".join(c for c in w if c.isalpha()) for w in words) if w]
        total, got = sum(map(word_score, words), np.zeros(len(languages))), found[r.doc_id]
        if not words:
            assert got.lang_pred == "und"
        else:
            assert got.lang_pred == languages[int(total.argmax())]
            assert got.score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-6)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in found.values() if r.held_out]
    assert len(found) == len(truth) and len(held) > 250
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())


def test_languages_written_without_blanks(spark):
    """Runs of 40 letters are learned like others: two languages of one script, told apart by their letters' frequencies."""
    rng = np.random.default_rng(3)
    letters = {"xa": "アイウエオカキ", "xb": "ラリルレロワン"}
    run = lambda lang: "".join(rng.choice(list(letters[lang] + "ーノ"), 40))
    rows = [(i, "。".join(run(lang) for _ in range(5)).replace("。", " "), lang) for i in range(400) for lang in [("xa", "xb")[i % 2]]]
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_windows_hold_every_letter():
    begin, run = language_id.windows(np.array([0, 3, 3, 40, 41]), 16)
    assert begin.tolist() == [0, 3, 19, 35, 40, 41] and run.tolist() == [0, 2, 2, 2, 3]


def test_language_of_odd_rows(spark):
    rows = language_id.language_id(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 8)} == {"und"} and {r.score for r in rows if r.doc_id in (3, 4, 5, 8)} == {0.0}
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert language_id.language_id(empty(spark)).collect() == []
    nothing = language_id.language_id(spark.createDataFrame([(1, "some words", None, None, None, None, None)], DOCS)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r, truth[i]) for i, r in found.items() if r.held_out and i in truth]
    assert len(found) == docs.count() and np.mean([r.predicted == t for r, t in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, None), (None, 1.0), (6, 0.0), (9, 1.0), (77, 1.0)], "doc_id long, quality double")
    assert len(quality.quality(odd(spark), labels).collect()) == odd(spark).count()
    assert {r.score for r in quality.quality(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.quality(empty(spark), labels).collect() == []


def test_attention_finds_the_one_bad_passage():
    rng = np.random.default_rng(0)
    x, first, y = [], [0], []
    for i in range(600):
        n = rng.integers(1, 12)
        bag = rng.normal(0, 1, (n, 4))
        bag[:, 0] = 0
        if i % 2:
            bag[rng.integers(n), 0] = 3
        x.append(bag)
        first.append(first[-1] + n)
        y.append(float(i % 2))
    x, first, y = np.concatenate(x), np.array(first), np.array(y)
    model = quality.AttentionPool(4).fit(x[: first[400]], first[:401], y[:400])
    assert ((model.score(x[first[400] :], first[400:] - first[400]) > 0.5) == y[400:]).mean() > 0.95


def plain_scores(model, bags):
    """Scores by one passage and one number at a time."""
    p, out = model.p, []
    for bag in bags:
        embedded, energy = [], []
        for row in bag:
            x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
            h = [math.tanh(sum(v * p["W"][i, j] for i, v in enumerate(x)) + p["b"][j]) for j in range(len(p["b"]))]
            gate = 0.0
            for g in range(len(p["w"])):
                t = math.tanh(sum(h[j] * p["V"][j, g] for j in range(len(h))) + p["bv"][g])
                s = 1 / (1 + math.exp(-(sum(h[j] * p["U"][j, g] for j in range(len(h))) + p["bu"][g])))
                gate += p["w"][g] * t * s
            embedded.append(h)
            energy.append(math.exp(gate))
        z = [sum(e * h[j] for e, h in zip(energy, embedded)) / sum(energy) for j in range(len(p["b"]))]
        out.append(1 / (1 + math.exp(-(sum(c * v for c, v in zip(p["c"], z)) + p["b0"][0]))))
    return out


def plain_passages(text):
    """The words of a text by passages, and their hashed features."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = []
    for a in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
        own = words[a : a + quality.PASSAGE_WORDS]
        row = np.zeros(quality.WORD_FEATURES)
        for w in own:
            h = int(Words(*buffers(pa.array([w]))).hashes(lower=True)[0])
            row[h % quality.WORD_FEATURES] += -1.0 if h >> 16 & 1 else 1.0
        out.append(row / math.sqrt(max(1, len(own))))
    return np.array(out)


def test_scores_by_hand(spark):
    """The query's scores are those of gated attention over all passages of each whole text."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(1 + i * 29 % 400))) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as double) as quality")
    model = quality.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, model).collect()[:12]:
        x, first = quality.passages(pa.array([texts[r.doc_id]]))
        assert np.allclose(x[:, quality.FORM :], plain_passages(texts[r.doc_id]), atol=1e-6)
        assert r.score == pytest.approx(plain_scores(model, [x])[0], abs=1e-6)


def test_training_is_bounded_in_passages(spark):
    docs = spark.createDataFrame([(i, "a b c " * (500 if i == 3 else 10)) for i in range(30)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as double) as quality")
    seen = []
    original = quality.AttentionPool.fit
    try:
        quality.AttentionPool.fit = lambda self, x, first, label, **o: seen.append((len(x), len(label))) or original(self, x, first, label, **o)
        quality.learn(docs, labels, train_passages=20)
        quality.learn(docs, labels)
    finally:
        quality.AttentionPool.fit = original
    assert seen[0][0] <= 20 and seen[1] == (29 + 24, 30)


def test_gradient_by_differences():
    rng = np.random.default_rng(6)
    x, first, y = rng.normal(0, 1, (9, 3)), np.array([0, 4, 9]), np.array([1.0, 0.0])
    model = quality.AttentionPool(3, 4, 2)
    loss = lambda: -float(np.mean(y * np.log(f := model._forward(x, first)["y"]) + (1 - y) * np.log(1 - f)))
    for k, g in model.gradient(x, first, y).items():
        for i in np.ndindex(g.shape):
            kept = model.p[k][i]
            model.p[k][i] = kept + 1e-6
            up = loss()
            model.p[k][i] = kept - 1e-6
            assert g[i] == pytest.approx((up - loss()) / 2e-6, abs=1e-6)
            model.p[k][i] = kept


def test_gradient():
    rng = np.random.default_rng(1)
    x, first, y = rng.normal(0, 1, (9, 3)), np.array([0, 4, 9]), np.array([1.0, 0.0])
    model = quality.AttentionPool(3, 4, 2)
    before = model._forward((x - x.mean(0)) / (x.std(0) + 1e-6), first)["y"]
    model.fit(x, first, y, epochs=60, decay=0)
    after = model.score(x, first)
    assert after[0] > before[0] and after[1] < before[1] and (after > 0.5).tolist() == [True, False]


@pytest.mark.parametrize("text, feature", [("ABC DEF GHI", 0), ("12 34 56", 1), ("hi hi hi hi", len(quality._KINDS))])
def test_passage_features(text, feature):
    x, first = quality.passages(pa.array([text, "plain words here", None]))
    assert first.tolist() == [0, 1, 2, 3] and x[0, feature] > x[1, feature] and not x[2].any()
