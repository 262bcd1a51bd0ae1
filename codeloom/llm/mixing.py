"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A unit (the rows of one doc_id within a source) shall be taken target / source size times; the whole part is certain, the
fraction is its probability of one copy more. Pivotal rounding lets units meet and transfers words between them at random until
one has a whole number of copies, such that each keeps its expected share and their sum of words stays what it was. Here a unit
meets the pool of all units that are smaller: the largest first, it gets its whole part and perhaps one more, and what it took
too much or too little is spread over the pool by size. So the large units, which weigh most, are decided while many can make
up for them, and the deviation at the end is that of the smallest.

The units of a source are dealt into blocks by a hash, blocks into blocks of blocks, and so on: a tree with FAN_IN children a
node. A unit belongs to the lowest node that holds about ROOM times its words, so a node has a bounded number of units of its
own. From the root down, each node folds over its own units, whose pool is all that lies below; the deviation goes down as a
shift of the copies wanted. A leaf's fold leaves its smallest unit with a fraction, in which the leaf's deviation has gathered;
these residuals meet up the tree to one a source, and their decisions go down again. A source of any size spreads over all
tasks. The chance is a hash of the unit's key, so that every run decides alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words, written

#: Units or residuals that meet in one node of the tree, on average at its leaves and at most above.
FAN_IN = 64
#: Words of a node, on average, for each word of the largest unit below it.
ROOM = 8
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Per source: source, source_size, n_units, target. sized has source and size.

    Sources weigh by their place in code point order, null last. A source whose share exceeds most times its size stops there
    and its excess is shared among the others by weight. That level is where the sources, in order of capacity by weight, stop
    being full. The table has one row a source: its windows run over totals, not over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    full = F.lit(most) * F.col("source_size")
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    out = totals.withColumn("weight", weight).withColumn("level", level)
    out = out.withColumn("level", F.max("level").over(everywhere))  # it rises up to the first source that isn't full, then falls
    return out.select("source", "source_size", "n_units", F.least(full, F.col("level") * F.col("weight")).alias("target"))


def _held(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(MOST_COPIES))


def _rounded(v: Column) -> Column:
    """Nearly whole numbers are whole, so that rounding errors of sums decide nothing."""
    return F.when(F.abs(v - F.round(v)) < 1e-9, F.round(v)).otherwise(v)


def _fold(kids: Column, pool: Column, shift: Column, every: bool) -> Column:
    """Lets the units of a sorted array<struct<a: words, v: copies wanted, u: chance in [0, 1)>> meet the pool of those after them.

    pool: words that come after all of them; shift: more copies wanted of each. Gives struct<off: words that are left to get
    from the pool or, if not every, by the last unit besides its own, got: copies of all, or all but the last>.
    """
    words = F.aggregate(kids, pool, lambda s, x: s + x["a"])
    over = F.aggregate(kids, F.lit(0.0), lambda s, x: s + (x["v"] + shift - _held(x["v"] + shift)) * x["a"])
    start = F.struct(over.alias("off"), words.alias("left"), F.array().cast("array<int>").alias("got"))

    def meet(acc: Column, x: Column) -> Column:
        own = _held(x["v"] + shift)
        v = _rounded(_held(own + F.when(acc["left"] > 0, acc["off"] / acc["left"]).otherwise(F.lit(0.0))))
        copies = F.floor(v).cast("int") + (x["u"] < v - F.floor(v)).cast("int")
        return F.struct((acc["off"] + (own - copies) * x["a"]).alias("off"), (acc["left"] - x["a"]).alias("left"), F.concat(acc["got"], F.array(copies)).alias("got"))

    some = kids if every else F.slice(kids, F.lit(1), F.size(kids) - 1)
    return F.aggregate(some, start, meet, lambda acc: F.struct(acc["off"].alias("off"), acc["got"].alias("got")))


def _last(level: DataFrame) -> DataFrame:
    """source, block, a, v: the residual of each node."""
    last = F.element_at("kids", -1)
    v = _held(last["v"] + F.col("shift")) + F.when(last["a"] > 0, F.col("r.off") / last["a"]).otherwise(F.lit(0.0))
    return level.select("source", "block", last["a"].alias("a"), v.alias("v"))


def _chance(*key: Column | str, seed: int) -> Column:
    """In [0, 1): 52 bits of the MD5 of seed and key, joined by bars; a null is a tilde."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("~")) for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def _order(words: Column, *more: Column) -> list[Column]:
    """Fields to sort units by: those without words, which no deviation can go to, then the largest first."""
    return [(words > 0).alias("some"), (-words).alias("less"), *more]


def copies_of(units: DataFrame, seed: int = 7) -> DataFrame:
    """units has source, doc_id, size (one row each), n_units and source_size of the source and share, the times it shall be taken.

    Returns source, doc_id, copies. share is from 0 to 2. Null sources and doc_ids are values like others.
    """
    a = F.col("size").cast("double")
    unit = F.struct(*_order(a, _chance("doc_id", seed=seed + 1).alias("tie"), F.col("doc_id")), a.alias("a"), F.col("share").alias("v"), _chance("source", "doc_id", seed=seed + 2).alias("u"))
    # So many units have ROOM times the words of this one, on average; a node of level k holds FAN_IN ** (k + 1).
    room = F.least(F.lit(float(ROOM)) * a * F.col("n_units") / F.col("source_size"), F.col("n_units").cast("double"))
    level = F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.ceil(F.log(F.greatest(room, F.lit(1.0))) / math.log(FAN_IN) - 1e-9) - 1)).otherwise(F.lit(0.0)).cast("int")
    block = F.floor(_chance("doc_id", seed=seed) * F.ceil(F.col("n_units") / FAN_IN).cast("double"))
    dealt = written(units.select("source", block.alias("block"), level.alias("level"), unit.alias("unit")), "mixing-units")
    most = dealt.agg(F.max("block")).first()[0]
    depth = 0
    while most and FAN_IN**depth <= most:
        depth += 1
    same = lambda x, y, k: F.col(f"{x}.source").eqNullSafe(F.col(f"{y}.source")) & (k == F.col(f"{y}.block"))
    # Down: the units of each node, from the root; what they deviate by shifts those below.
    decided, shifts = [], None
    for k in range(depth, -1, -1):
        own = F.sort_array(F.collect_list(F.when(F.col("level") == k, F.col("unit")))).alias("kids")
        pool = F.sum(F.when(F.col("level") < k, F.col("unit.a")).otherwise(0.0)).alias("pool")
        nodes = dealt.filter(F.col("level") <= k).withColumn("block", F.floor(F.col("block") / FAN_IN**k)).groupBy("source", "block").agg(own, pool)
        if shifts is None:
            nodes = nodes.withColumn("shift", F.lit(0.0))
        else:
            nodes = nodes.alias("n").join(shifts.alias("s"), same("n", "s", F.floor(F.col("n.block") / FAN_IN)), "left").select("n.*", F.coalesce("s.shift", F.lit(0.0)).alias("shift"))
        if k:
            nodes = written(nodes.withColumn("r", _fold(F.col("kids"), F.col("pool"), F.col("shift"), every=True)), f"mixing-node-{k}")
            decided.append(nodes.filter(F.size("kids") > 0).select("source", F.explode(F.arrays_zip(F.col("kids").alias("kid"), F.col("r.got").alias("copies"))).alias("x")))
            shifts = nodes.select("source", "block", (F.col("shift") + F.when(F.col("pool") > 0, F.col("r.off") / F.col("pool")).otherwise(F.lit(0.0))).alias("shift"))
    leaf = nodes.filter(F.size("kids") > 0)
    levels = [written(leaf.withColumn("r", _fold(F.col("kids"), F.lit(0.0), F.col("shift"), every=False)), "mixing-0")]
    # Up: the residuals, to one a source.
    for k in range(1, depth + 1):
        kid = F.struct(*_order(F.col("a"), F.col("block")), "a", "v", _chance("source", "block", seed=seed + 2 + k).alias("u"))
        up = _last(levels[-1]).withColumn("over", F.floor(F.col("block") / FAN_IN)).groupBy("source", "over").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        up = up.withColumnRenamed("over", "block").withColumn("shift", F.lit(0.0))
        levels.append(written(up.withColumn("r", _fold(F.col("kids"), F.lit(0.0), F.lit(0.0), every=False)), f"mixing-{k}"))
    # Down again: the root's residual by its own chance, then each node's residual as its parent decided.
    v = _rounded(_held(F.col("v")))
    fate = _last(levels[-1]).select("source", "block", (F.floor(v).cast("int") + (_chance("source", seed=seed + 99) < v - F.floor(v)).cast("int")).alias("copies"))
    for level in reversed(levels):
        joined = level.alias("l").join(fate.alias("d"), same("l", "d", F.col("l.block")))
        flat = joined.select("l.source", F.explode(F.arrays_zip(F.col("l.kids").alias("kid"), F.concat("l.r.got", F.array("d.copies")).alias("copies"))).alias("x"))
        fate = flat.select("source", F.col("x.kid.block").alias("block"), F.col("x.copies").alias("copies")) if level is not levels[0] else flat
    for more in decided:
        fate = fate.unionByName(more)
    return fate.select("source", F.col("x.kid.doc_id").alias("doc_id"), F.col("x.copies").alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **targets) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words (null and empty: 0), counted over whole texts of any length. Rows that repeat a doc_id within a
    source, equal or not, are one unit and share their number of copies. Ties of size go by a hash. Null sources form a source
    that comes last; null doc_ids form one unit a source. An empty table gives no rows. No row is taken more than twice, as no
    target exceeds twice its source's size. Other columns don't matter. The table of sources is ordered in one task: it holds a
    row a source, so millions of sources are fine, one for each document isn't what a mix is for.
    """
    sized = written(docs.select(docs[key].alias("doc_id"), docs[source].alias("source"), n_words(text).alias("size")), "mixing-sizes")
    units = sized.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    goals = written(source_targets(units, **targets), "mixing-targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = units.alias("u").join(goals.alias("g"), F.col("u.source").eqNullSafe(F.col("g.source")))
    taken = copies_of(joined.select("u.source", "u.doc_id", "u.size", "g.n_units", "g.source_size", share.alias("share")))
    out = sized.alias("s").join(taken.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")) & F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")))
    out = out.select("s.*", "t.copies").alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
    return out.select("o.doc_id", "o.source", "o.size", "g.source_size", "g.target", "o.copies", (F.col("o.copies") * F.col("o.size")).alias("taken"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with every row as many times as the mix takes it, columns unchanged, whatever their names."""
    taken = mix(docs, text, key, source).select("doc_id", "source", "copies").distinct()
    taken = taken.filter("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    joined = docs.join(taken, docs[key].eqNullSafe(taken["doc_id"]) & docs[source].eqNullSafe(taken["source"]))
    return joined.select(*(docs[c] for c in docs.columns))
