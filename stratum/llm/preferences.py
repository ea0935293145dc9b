"""Operator 7: preference formatting of chat conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered
once, as the prompt; what follows in each is its completion, in which only assistant turns carry
loss. Turns are compared by joins and counted by aggregates, and the result has a row for each
rendered turn, so no conversation is ever gathered; render() puts a pair into one row for those
who want that. All of it is DataFrame functions.

Pairs of the query: conversations that open with the same turn are alternatives to each other. They are
paired in the order of conv_id, the first being the chosen one: first among ids that share all but their
last 8 bits, then the ones left over among ids that share all but 20, then all of them. A conversation left
alone is paired with itself: the last assistant turn, put in place of the assistant turn before it, is chosen
over that one, so that the conversation up to there is the prompt. One with a single
assistant turn has no rejected side; that turn is the completion.

Defined cases: rows without conv_id belong to no conversation and are left out; a null turn comes before
all; a null role is `unknown`, a null text empty; rows of one conv_id and turn stand in the order of
role and text, equal ones once; equal conversations are all prompt; the marker `<|` inside a
text is broken up; very long texts and conversations are rows like others; an empty table gives no
row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of conv_id within which conversations of one opening are paired first, and then the ones left over.
LEVELS = (8, 20)
_FIRST = -(1 << 63)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of each turn, without nulls and repeats."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.where("conv_id is not null").distinct()


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def opening_pairs(turns: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """chosen_id and rejected_id (null for one left alone) of conversations that open alike.

    Only ids and hashes of openings are dealt; the windows of a level hold what one block of ids leaves over.
    """
    first = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("o"))
    left, pairs = first.select("conv_id", F.sha2(F.concat_ws("\x01", "o.role", "o.text"), 256).alias("opening")), None
    for bits in (*levels, None):
        block = F.lit(0).cast("long") if bits is None else F.shiftright("conv_id", bits)
        numbered = left.withColumn("block", block).withColumn("n", F.expr("row_number() over (partition by opening, block order by conv_id)"))
        found = written(numbered.groupBy("opening", "block", F.floor((F.col("n") - 1) / 2).alias("pair")).agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("last"), F.count("*").alias("c")), "pairs")
        two = found.where("c = 2").select("chosen_id", F.col("last").alias("rejected_id"))
        pairs = two if pairs is None else pairs.unionByName(two)
        left = found.where("c = 1").select("opening", F.col("chosen_id").alias("conv_id"))
    return pairs.unionByName(left.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id")))


def sides_of(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """The turns of both sides of each pair: chosen_id, rejected_id, side, turn, role, text; a conversation left alone is paired with itself."""
    two = pairs.where("rejected_id is not null")
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}_id").alias("conv_id"))
    of_two = two.select("chosen_id", "rejected_id", F.explode(F.array(side("chosen"), side("rejected"))).alias("s")).select("chosen_id", "rejected_id", "s.*")
    of_two = of_two.join(turns, "conv_id").select("chosen_id", "rejected_id", "side", "turn", "role", "text")
    own = turns.join(pairs.where("rejected_id is null").select(F.col("chosen_id").alias("conv_id")), "conv_id")
    spoken = own.where("role = 'assistant'").select("conv_id", "turn")
    last = spoken.groupBy("conv_id").agg(F.max("turn").alias("later"))
    both = spoken.join(last, "conv_id").where("turn < later").groupBy("conv_id").agg(F.max("turn").alias("earlier"), F.max("later").alias("later"))
    own = own.join(both, "conv_id", "left")
    assistant, at = F.col("role") == "assistant", F.col("turn")
    kept = F.col("earlier").isNull() | (at < F.col("earlier")) | (at == F.col("earlier")) & ~assistant
    chosen = F.when(kept, at).when((at == F.col("later")) & assistant, F.col("earlier"))
    rejected = F.when(at <= F.col("earlier"), at)
    spots = F.filter(F.array(F.struct(F.lit("chosen").alias("side"), chosen.alias("turn")), F.struct(F.lit("rejected").alias("side"), rejected.alias("turn"))), lambda x: x["turn"].isNotNull())
    alone = own.select(F.col("conv_id").alias("chosen_id"), F.when(F.col("earlier").isNotNull(), F.col("conv_id")).alias("rejected_id"), F.explode(spots).alias("s"), "role", "text")
    return of_two.unionByName(alone.select("chosen_id", "rejected_id", "s.side", "s.turn", "role", "text"))


def format_pairs(of: DataFrame) -> DataFrame:
    """From the sides of pairs, a row for each rendered turn of each pair: chosen_id, rejected_id, part (prompt, chosen, rejected), turn, role, rendered, loss."""
    # what a pair has at each turn: a turn is common if both sides have the same rows there
    at = of.groupBy("chosen_id", "rejected_id", "turn").agg(*[F.sum(F.when(F.col("side") == side, F.xxhash64("role", "text", F.lit(seed)).cast("decimal(38,0)"))).alias(f"{side}{seed}") for side in ("chosen", "rejected") for seed in (1, 2)], F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("spoken"))
    same = F.col("chosen1").eqNullSafe(F.col("rejected1")) & F.col("chosen2").eqNullSafe(F.col("rejected2"))
    parting = at.groupBy("chosen_id", "rejected_id").agg(F.min(F.when(~same, F.col("turn"))).alias("differs"), F.max("spoken").alias("spoken"))
    parting = parting.select(F.col("chosen_id").alias("c"), F.col("rejected_id").alias("r"), F.when(F.col("rejected_id").isNull(), F.col("spoken")).otherwise(F.col("differs")).alias("parts"))
    joined = of.join(parting, (F.col("chosen_id") == F.col("c")) & F.col("rejected_id").eqNullSafe(F.col("r")))
    common = F.col("parts").isNull() | (F.col("turn") < F.col("parts"))
    out = joined.where(~common | (F.col("side") == "chosen"))
    loss = ~common & (F.col("role") == "assistant")
    return out.select("chosen_id", "rejected_id", F.when(common, "prompt").otherwise(F.col("side")).alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), loss.cast("int").alias("loss"))


def render(rows: DataFrame) -> DataFrame:
    """One row a pair from format_pairs(): prompt, chosen and rejected texts, and the (start, end) character spans with loss of both completions."""
    ordered = rows.groupBy("chosen_id", "rejected_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "rendered", "loss"))).alias("t"))
    ordered = ordered.withColumn("ends", F.aggregate("t", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["rendered"])))))
    spans = F.filter(F.transform("t", lambda x, i: F.struct(x["loss"].alias("loss"), F.get("ends", i).alias("start"), F.get("ends", i + 1).alias("end"))), lambda x: x["loss"] == 1)
    one = ordered.select("chosen_id", "rejected_id", "part", F.array_join("t.rendered", "").alias("text"), F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return one.groupBy("chosen_id", "rejected_id").agg(F.coalesce(pick("prompt", "text"), F.lit("")).alias("prompt"), pick("chosen", "text").alias("chosen"), pick("rejected", "text").alias("rejected"), pick("chosen", "spans").alias("chosen_loss"), pick("rejected", "spans").alias("rejected_loss"))


def preferences(conversations: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    turns = turns_of(conversations)
    return format_pairs(sides_of(turns, opening_pairs(turns, levels)))
