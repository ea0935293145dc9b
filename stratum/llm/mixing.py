"""Operator 4: mixing sources to target weights, by pivotal dependent rounding of copy numbers.

A source's target share of all words, over its own words, is the number of copies each of its
documents ought to have. The whole part is taken as it is. The fractions are rounded together:
two documents with fractions p, q and sizes a, b exchange word mass, so that p*a + q*b stays, until
one of them has no copy or a whole one; which of the two ways is drawn so that each document's
expected fraction stays. A source's longest documents come first, one by one from the longest on: each
exchanges mass with all shorter ones together, whose common fraction takes up what it misses. Then the
others over the median size are rounded, whose last one exchanges with those below in the same way.
So a source's words hit the target up to half a small document: the last one of all is rounded to
the nearer side, as is one that is longer than all shorter ones together can make up for.

Below the longest, the rounding is a reduction tree: documents are dealt by a hash into groups of at most a few dozen; a
group is folded by `aggregate` and leaves one document undecided; the undecided ones form the next
level, until each source has one, which is drawn on its own. Every draw is a hash of the documents
met, so reruns agree. All of it is DataFrame and SQL functions.

Rows equal in id, text and source are items of their own, told apart by a number, so they fall into different
groups and none of the work gathers them. Ranks of sources and the level up to which targets are
filled come from aggregates, so sources may be as many as documents.

Defined cases: a null text has size 0 and takes no words; null sources are one source, last in order;
a source without words has target 0; an empty table gives no row; very long texts are counted whole; other
columns, whatever their names, are kept by mix_rows().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, unused, written

GROUP, MOST_COPIES = 32, 3
#: Documents of a source that are settled one by one; they are one row of an array.
LONGEST = 512
_TINY = 1e-9


def targets(sizes: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """source, source_size and target of each source of sizes(source, size).

    Sources weigh 1, 2, 3, repeating, by code point with null last. Shares of the whole are filled up like
    water: a source gets the level times its weight, up to most_copies times its size. The level
    rises, by one aggregate a round, until no further source is full.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = written(by.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "sources")
    # the rank is that in the part, which the lower 33 bits of `at` hold, and the rows of the parts before: one row a part
    part = F.shiftright("at", 33)
    ahead = ordered.groupBy(part.alias("part")).count().select("part", F.expr("coalesce(sum(count) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("ahead"))
    rank = F.col("ahead") + F.col("at") - F.shiftleft("part", 33)
    limit = F.lit(most_copies) * F.col("source_size")
    ranked = ordered.withColumn("part", part).join(F.broadcast(ahead), "part").select("source", "source_size", (F.pmod(rank, F.lit(3)) + 1).alias("weight"), limit.alias("limit"))
    ranked = written(ranked, "weights")
    total, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, left, before = 0.0, total, None
    while weights and weights != before:
        level, before = left / weights, weights
        full = F.col("limit") < F.lit(level) * F.col("weight")
        filled, weights = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        left = total - filled
    return ranked.select("source", "source_size", F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _snapped(p: Column) -> Column:
    return F.when(F.abs(p) < _TINY, 0.0).when(F.abs(p - 1) < _TINY, 1.0).otherwise(p)


def _item(p: Column, like: Column) -> Column:
    return F.struct(like["key"].alias("key"), like["rid"].alias("rid"), _snapped(p).alias("p"), like["size"].alias("size"))


def _draw(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _is_whole(item: Column) -> Column:
    return (item["p"] == 0.0) | (item["p"] == 1.0)


def _exchange(state: Column, x: Column, seed: int) -> Column:
    """One step of the fold: the held item and x exchange word mass; a whole one is put out, the other is held."""
    held = state["held"]
    give = F.least((1.0 - held["p"]) * held["size"], x["p"] * x["size"])
    take = F.least(held["p"] * held["size"], (1.0 - x["p"]) * x["size"])
    moved = _let(F.struct(give.alias("give"), take.alias("take")), lambda m: F.when(_draw(held["key"], x["key"], F.lit(seed)) * (m["give"] + m["take"]) < m["take"], m["give"]).otherwise(-m["take"]))
    pair = _let(moved, lambda d: F.struct(_item(held["p"] + d / held["size"], held).alias("a"), _item(x["p"] - d / x["size"], x).alias("b")))
    return _let(pair, lambda w: F.when(_is_whole(w["a"]), F.struct(w["b"].alias("held"), F.concat(state["out"], F.array(w["a"])).alias("out"))).otherwise(F.struct(w["a"].alias("held"), F.concat(state["out"], F.array(w["b"])).alias("out"))))


def _settled(p: Column, size: Column, q: Column, mass: Column, draw: Column) -> Column:
    """bit of an item with fraction p and q of all items below it, mass words with the common fraction q, after their exchange.

    Where the items below run out on the drawn side, the item is rounded to the side that they can make up for, or else to the one that misses less.
    """
    amounts = F.struct(F.least((1.0 - p) * size, q * mass).alias("give"), F.least(p * size, (1.0 - q) * mass).alias("take"))
    moved = _let(amounts, lambda m: F.when(draw * (m["give"] + m["take"]) < m["take"], m["give"]).otherwise(-m["take"]))
    bit = F.when(p + moved / size > 0.5, 1.0).otherwise(0.0)
    words = lambda b: q * mass + (p - b) * size  # noqa: E731  what the items below then have to give
    miss = lambda b: F.greatest(F.lit(0.0), -words(b), words(b) - mass)
    bit = _let(bit, lambda b: F.when(miss(b) <= miss(1.0 - b) + _TINY, b).otherwise(1.0 - b))
    left = lambda b: F.when(mass > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), q + (p - b) * size / mass))).otherwise(0.0)
    return _let(bit, lambda b: F.struct(b.alias("bit"), _snapped(left(b)).alias("q")))


def _longest(open_: DataFrame, seed: int, most: int = LONGEST) -> DataFrame:
    """source, out (rid and bit of its longest documents) and p, the fraction of its other ones, of open_(source, key, rid, p, size), p being one for a source.

    The window keeps `most` rows of each source in each task before anything is dealt.
    """
    nth = F.expr("row_number() over (partition by source order by size desc, key)")
    first = open_.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("nth", "key", "rid", "size"))).alias("items"))
    whole = open_.groupBy("source").agg(F.sum(F.col("size").cast("long")).cast("double").alias("mass"), F.max("p").alias("p")).withColumnRenamed("source", "of")

    def step(state: Column, x: Column) -> Column:
        rest = state["mass"] - x["size"]
        done = _settled(state["p"], x["size"], state["p"], rest, _draw(x["key"], x["nth"], F.lit(seed)))
        return _let(done, lambda d: F.struct(d["q"].alias("p"), rest.alias("mass"), F.concat(state["out"], F.array(F.struct(x["rid"].alias("rid"), d["bit"].cast("int").alias("bit")))).alias("out")))

    start = F.struct(F.col("p"), F.col("mass"), F.array().cast("array<struct<rid:bigint,bit:int>>").alias("out"))
    both = first.join(whole, F.col("source").eqNullSafe(F.col("of")))
    return written(both.select("source", F.aggregate("items", start, step).alias("s")).select("source", "s.out", "s.p"), "longest")


def _round(items: DataFrame, seed: int, nearest: bool, group: int = GROUP) -> tuple[DataFrame, DataFrame | None]:
    """rid and bit of each item of items(source, key, rid, p, size) with size > 0, and the undecided one of each source unless it is rounded to the nearer side.

    Items of a source are dealt to leaves by hash; leaf i of a level belongs to leaf i / group of the next.
    """
    counts = items.groupBy("source").agg(F.count("*").alias("n"))
    leaves = items.join(counts, items["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    level = leaves.select("source", F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col("n") / group)).alias("leaf"), F.struct("key", "rid", "p", "size").alias("item"))
    leaf_count = counts.agg(F.ceil(F.max("n") / group)).first()[0] or 0
    decided = undecided = None
    while leaf_count:
        items_ = F.array_sort(F.collect_list("item"))
        empty = F.array().cast("array<struct<key:bigint,rid:bigint,p:double,size:double>>")
        folded = level.groupBy("source", "leaf").agg(items_.alias("items"))
        folded = folded.select("source", "leaf", F.aggregate(F.slice("items", 2, F.size("items")), F.struct(F.element_at("items", 1).alias("held"), empty.alias("out")), lambda state, x: _exchange(state, x, seed)).alias("s"))
        last = leaf_count == 1
        held = F.col("s.held")
        if last and nearest:  # the root: what is left undecided is rounded
            held = _let(held, lambda h: F.struct(h["key"].alias("key"), h["rid"].alias("rid"), F.when(h["p"] > 0.5, 1.0).otherwise(0.0).alias("p"), h["size"].alias("size")))
        folded = written(folded.select("source", "leaf", held.alias("held"), F.col("s.out").alias("out")), "level")
        done = F.concat("out", F.filter(F.array("held"), _is_whole))
        bits = folded.select(F.explode(done).alias("d")).select(F.col("d.rid").alias("rid"), F.col("d.p").cast("int").alias("bit"))
        decided = bits if decided is None else decided.unionByName(bits)
        if last:
            undecided = folded.where(~_is_whole(F.col("held"))).select("source", "held.*")
            break
        level = folded.where(~_is_whole(F.col("held"))).select("source", F.floor(F.col("leaf") / group).alias("leaf"), F.col("held").alias("item"))
        leaf_count = -(-leaf_count // group)
    return (decided if decided is not None else items.select("rid", F.lit(0).alias("bit")).where("false")), undecided


def _spread(rows: DataFrame) -> DataFrame:
    """rows(key, rid) with the number of a row among those of its key, from the second on, hashed into the key, so that equal rows are different items.

    Rows are numbered within the key and the input's part (the upper bits of rid), and the parts of a key
    are then put one after another, so a key of any number of rows is no single task's.
    """
    parted = rows.withColumn("part", F.shiftright("rid", 33))
    numbered = parted.withColumn("n", F.expr("row_number() over (partition by key, part order by rid)"))
    ahead = parted.groupBy("key", "part").count().withColumn("ahead", F.expr("sum(count) over (partition by key order by part rows between unbounded preceding and 1 preceding)"))
    both = numbered.join(ahead.where("ahead > 0").drop("count"), ["key", "part"], "left")
    nth = F.col("n") + F.coalesce("ahead", F.lit(0))
    return both.withColumn("key", F.when(nth == 1, F.col("key")).otherwise(F.xxhash64("key", nth))).select(*rows.columns)


def copies(docs: DataFrame, most_copies: int = MOST_COPIES, seed: int = 20, rid: str | None = None) -> DataFrame:
    """rid, doc_id, source, size, source_size, target and copies of each row of docs(doc_id, text, source); rid: a column that numbers its rows as monotonically_increasing_id does."""
    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = docs.select(number.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text", "source").alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    rows = written(_spread(written(rows, "counted")), "sizes")
    shares = written(targets(rows, most_copies), "targets")
    known = rows.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most_copies)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    known = known.withColumn("whole", F.floor(rate + _TINY)).withColumn("p", F.greatest(F.lit(0.0), rate - F.col("whole")))
    open_ = known.where((F.col("p") > _TINY) & (F.col("size") > 0)).select("source", "key", "rid", "p", F.col("size").cast("double").alias("size"))
    open_ = written(open_, "open")
    longest = _longest(open_, seed + 4)
    bits = longest.select(F.explode("out").alias("d")).select("d.*")
    share = longest.select(F.col("source").alias("of"), F.col("p").alias("left"))
    others = open_.join(bits, "rid", "left_anti").join(share, F.col("source").eqNullSafe(F.col("of"))).select("source", "key", "rid", F.col("left").alias("p"), "size")
    middle = others.groupBy("source").agg(F.expr("percentile(size, 0.5)").alias("middle")).withColumnRenamed("source", "of")
    others = written(others.join(middle, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "others")
    large, small = others.where("size > middle").drop("middle"), others.where("size <= middle").drop("middle")
    more, undecided = _round(large, seed, False)
    bits = bits.unionByName(more)
    if undecided is not None:
        below = small.groupBy("source").agg(F.sum(F.col("size").cast("long")).cast("double").alias("mass"), F.max("p").alias("q")).withColumnRenamed("source", "of")
        last = undecided.join(below, F.col("source").eqNullSafe(F.col("of")))
        last = written(last.select("of", "rid", _settled(F.col("p"), F.col("size"), F.col("q"), F.col("mass"), _draw(F.col("key"), F.lit(seed + 1))).alias("s")).select("of", "rid", "s.*"), "last")
        bits = bits.unionByName(last.select("rid", F.col("bit").cast("int").alias("bit")))
        small = small.join(last.select("of", "q"), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "key", "rid", F.coalesce("q", "p").alias("p"), "size")
        small = written(small, "small")
    bits = bits.unionByName(_round(small, seed + 2, True)[0])
    return known.join(bits, "rid", "left").select("rid", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("bit", F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and copies of each row."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as in docs.

    The rows are written with a number first, so that copies join them row by row.
    """
    rid = unused("rid", docs)
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    taken = copies(rows, rid=rid, **options).where("copies > 0").select(F.col("rid").alias(rid), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(unused("copy", docs)))
    return rows.join(taken, rid).select(*docs.columns)
