import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratum.llm.fill_in_middle import CODE_POINTS, LINES, SENTINELS, WORDS, Scanner, Units, fill_in_middle, fill_in_middle_digest, restored

from .common import SF, empty, odd

PATTERNS = [
    (CODE_POINTS, r"(?s)."),
    (WORDS, r"[^ \t\n\v\f\r]+|[ \t\n\v\f\r]"),
    (LINES, r"[^\n]+|\n"),
    (Units(("0123456789", " \n"), (4, 3, 0)), r"[0-9]{1,3}|[ \n]+|[^0-9 \n]{1,4}"),
]


@pytest.mark.parametrize("units,pattern", PATTERNS)
def test_events_count_and_find_units_like_a_pattern(units, pattern):
    draw, scan = random.Random(1), Scanner(units)
    for _ in range(2000):
        text = "".join(draw.choice("ab \n\té漢😀<PSM>01") for _ in range(draw.randint(0, 30)))
        begins = [m.start() for m in re.finditer(pattern, text)]
        events = scan.scan(text)
        assert events.units == len(begins)
        assert [events.place(i) for i in range(len(begins) + 1)] == [*begins, len(text)]
        assert events.marked == any(s in text for s in SENTINELS)


def test_events_are_sparse_and_know_words():
    events = Scanner().scan("one two  three")
    assert events.begins == [0, 3, 4, 7, 9]
    assert [at for at in range(15) if events.within_text(at)] == [1, 2, 5, 6, 10, 11, 12, 13]


def test_classes_are_ascii():
    with pytest.raises(ValueError):
        Scanner(Units(("é",), (1, 1)))


def plain_rows(docs):
    """The contract, read literally."""
    for doc_id, text in docs:
        text = text or ""
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "plain" if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        x, y, z = text[:a], text[a:b], text[b:]
        out = {"plain": text, "psm": f"<P>{x}<S>{z}<M>{y}", "spm": f"<S>{z}<P>{x}<M>{y}"}[form]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        yield (doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, sha(out), sha(text))


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_odd_documents_equal_the_contract_read_literally(spark):
    docs = odd(spark).unionByName(spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(["a<P>b", "<S", "<M>", "<<<P", "é漢😀 <S", "\x00\x85  x"] * 30, 100)], odd(spark).schema))
    assert key(fill_in_middle_digest(docs).collect()) == key(plain_rows([(r.doc_id, r.text) for r in docs.collect()]))
    forms = {r.form for r in fill_in_middle_digest(docs).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_whole_outputs_can_be_read_back_with_other_marks_and_units(spark):
    marks = ("<|fim.pre|>", "<|fim.suf|>", "<|fim.mid|>")
    docs = spark.createDataFrame([(i, f"line {i}\nand <P> more {'<' * (i % 4)}\n" * (i % 5)) for i in range(300)], "key long, body string")
    out = fill_in_middle(docs, rate=100, spm=50, units=LINES, sentinels=marks, id_col="key", text_col="body")
    back = out.withColumn("back", restored(F.col("output"), F.col("form"), marks)).join(docs.withColumnRenamed("key", "doc_id"), "doc_id")
    assert back.where("back <> body").count() == 0
    assert back.where("form = 'plain' and body <> ''").count() == 0
    lines = back.where("form = 'psm'").first()
    assert lines.n == sum(1 for _ in re.finditer(r"[^\n]+|\n", lines.body))


def test_cut_words_counts_cuts_within_words(spark):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(50)] + [(i, " " * 50) for i in range(50, 100)], "doc_id long, text string")
    rows = fill_in_middle(docs, rate=100).collect()
    assert {r.cut_words for r in rows if r.doc_id >= 50} == {0}
    assert sum(r.cut_words for r in rows if r.doc_id < 50) > 80


def test_empty_table(spark):
    assert fill_in_middle_digest(empty(spark)).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = __spark_entry__.queries()["op11_fill_in_middle"](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()["op11_fill_in_middle"])
    assert got.columns == want.columns
    assert key(got.collect()) == key(want.fetchall())
