import pytest

from stratum.llm import preferences

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def rows(*convs):
    return [(c, t, role, text, "x") for c, turns in convs for t, (role, text) in enumerate(turns)]


A = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "good")]
B = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "bad <|end|>"), ("user", "why")]


def run(spark, data):
    return preferences.preferences(spark.createDataFrame(data, SCHEMA))


def test_prefix_once_and_masked_completions(spark):
    out = run(spark, rows((1, A), (65, B)))
    got = {(r.part, r.turn): (r.rendered, r.loss) for r in out.collect()}
    assert got == {
        ("prompt", 0): ("<|user|>\nhi<|end|>\n", 0),
        ("prompt", 1): ("<|assistant|>\nhello<|end|>\n", 0),
        ("prompt", 2): ("<|user|>\nmore<|end|>\n", 0),
        ("chosen", 3): ("<|assistant|>\ngood<|end|>\n", 1),
        ("rejected", 3): ("<|assistant|>\nbad < |end|><|end|>\n", 1),
        ("rejected", 4): ("<|user|>\nwhy<|end|>\n", 0),
    }
    one = preferences.render(out).first()
    assert one.prompt.count("<|user|>") == 2 and one.chosen == got["chosen", 3][0]
    assert [tuple(s) for s in one.chosen_loss] == [(0, len(one.chosen))] and [tuple(s) for s in one.rejected_loss] == [(0, len(got["rejected", 3][0]))]


def test_pairs_of_a_large_opening(spark):
    data = rows(*[(i, [("user", "hi"), ("assistant", f"a{i}")]) for i in range(301)])
    out = run(spark, data).collect()
    ids = [r.chosen_id for r in out if r.part == "chosen"] + [r.rejected_id for r in out if r.part == "rejected"]
    assert sorted(ids) == list(range(301))
    assert sum(r.rejected_id is None for r in out if r.part == "chosen") == 1


def test_alone_equal_and_prefix(spark):
    """One left alone: its last answer against the one before, at the prompt of that one."""
    alone = {(r.chosen_id, r.rejected_id, r.part, r.turn, r.rendered, r.loss) for r in run(spark, rows((1, A))).collect()}
    assert alone == {(1, 1, "prompt", 0, "<|user|>\nhi<|end|>\n", 0), (1, 1, "chosen", 1, "<|assistant|>\ngood<|end|>\n", 1), (1, 1, "rejected", 1, "<|assistant|>\nhello<|end|>\n", 1)}
    single = {(r.rejected_id, r.part, r.turn, r.loss) for r in run(spark, rows((1, A[:3]))).collect()}
    assert single == {(None, "prompt", 0, 0), (None, "chosen", 1, 1), (None, "chosen", 2, 0)}
    assert {r.part for r in run(spark, rows((1, [*A[:3], A[1]]))).collect()} == {"prompt"}  # the same answer twice
    equal = run(spark, rows((1, A), (65, A))).collect()
    assert {r.part for r in equal} == {"prompt"} and len(equal) == 4
    prefix = run(spark, rows((1, A[:2]), (65, A))).collect()
    assert {(r.part, r.turn) for r in prefix} == {("prompt", 0), ("prompt", 1), ("rejected", 2), ("rejected", 3)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pairs_on_the_table(spark, sf):
    """Each conversation of the table is in one pair, whose prefix is the longest common one; most have a rejected side."""
    table = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    convs = {}
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    out = preferences.render(preferences.preferences(table)).collect()
    assert sorted(i for r in out for i in {r.chosen_id, r.rejected_id} - {None}) == sorted(convs)
    assert sum(r.rejected is not None for r in out) > 0.5 * len(out)
    show = lambda turns: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)
    for r in out:
        chosen = convs[r.chosen_id]
        spoken = [i for i, (role, _) in enumerate(chosen) if role == "assistant"]
        if r.rejected_id is None:
            assert len(spoken) < 2 and r.prompt == show(chosen[: spoken[0]] if spoken else chosen)
            continue
        rejected = convs[r.rejected_id]
        if r.chosen_id == r.rejected_id:
            rejected, chosen = chosen[: spoken[-2] + 1], [*chosen[: spoken[-2]], chosen[spoken[-1]]]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        assert (r.prompt, r.chosen or "", r.rejected or "") == (show(chosen[:n]), show(chosen[n:]), show(rejected[n:]))
        for text, spans, turns in ((r.chosen, r.chosen_loss, chosen[n:]), (r.rejected, r.rejected_loss, rejected[n:])):
            assert [text[a:b] for a, b in spans or []] == [show([t]) for t in turns if t[0] == "assistant"]


def test_a_very_long_conversation(spark):
    long = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)]
    out = run(spark, rows((1, long), (9, [*long[:2999], ("assistant", "end")])))
    assert {(r.part, n) for r, n in ((r, r["n"]) for r in out.groupBy("part").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect())} == {("prompt", 2999), ("chosen", 1), ("rejected", 1)}


def test_odd_rows(spark):
    data = [(None, 0, "user", "x", "x"), (1, None, None, None, None), (1, 0, "user", "u", "x"), (1, 0, "user", "u", "x"), (1, 0, "assistant", "v", "x"), (1, 1, "assistant", "", "x")]
    out = [(r.part, r.turn, r.role, r.rendered, r.loss) for r in run(spark, data).orderBy("turn", "part", "role").collect()]
    first = -(1 << 63)
    assert out == [
        ("prompt", first, "unknown", "<|unknown|>\n<|end|>\n", 0),
        ("chosen", 0, "assistant", "<|assistant|>\n<|end|>\n", 1),
        ("chosen", 0, "user", "<|user|>\nu<|end|>\n", 0),
        ("rejected", 0, "assistant", "<|assistant|>\nv<|end|>\n", 1),
        ("rejected", 0, "user", "<|user|>\nu<|end|>\n", 0),
    ]
    assert run(spark, []).collect() == []
