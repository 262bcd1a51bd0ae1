"""Communities of a graph by modularity, their cohesion and labels."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.runtime import cut

#: Gains, in units of weight, that are no more than rounding.
NOTHING = 1e-9
#: Pairs up to which the turns of a level run in one task, some 200 bytes each; beyond, as joins. Both take the same turns.
ONE_TASK_PAIRS = 2_000_000


def cluster_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w of the undirected multigraph of CALLS and IMPORTS between known nodes, with a <= b and weights summed."""
    known = nodes.select("uid").distinct()
    used = edges.filter(F.col("type").isin("CALLS", "IMPORTS"))
    used = used.join(known.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").join(known.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi")
    return used.groupBy(F.least("from_uid", "to_uid").alias("a"), F.greatest("from_uid", "to_uid").alias("b")).agg(F.sum("confidence").alias("w"))


def weighted_degrees(pairs: DataFrame) -> DataFrame:
    """uid, degree; an edge counts at both its ends."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("uid"), "w")
    return ends.groupBy("uid").agg(F.sum("w").alias("degree"))


#: Checksums of names of one length differ in the same bits each turn; the carries of a product make them differ.
_SPREAD = 0x45D9F3B


def _coin(name: str, tail: str):
    """Bits that depend on a name and a tail."""
    return F.shiftright(F.crc32(F.concat(F.col(name), F.lit(tail)).cast("binary")) * F.lit(_SPREAD), 20)


def _turns(pairs: pd.DataFrame, home: pd.DataFrame, resolution: float) -> pd.DataFrame:
    """_settle() for a level that fits a task: a, c. Both follow the same rules, so they give the same."""
    names, ends = np.unique(np.concatenate([home["a"].to_numpy(str), home["c"].to_numpy(str)]), return_inverse=True)
    nodes, c = ends[: len(home)], ends[len(home) :].copy()
    place = np.full(len(names), -1)
    place[nodes] = np.arange(len(nodes))
    a, b = (place[np.searchsorted(names, pairs[k].to_numpy(str))] for k in ("a", "b"))
    w = pairs["w"].to_numpy(float)
    d = np.round(np.bincount(a, w, len(nodes)) + np.bincount(b, w, len(nodes)), 9)
    weight, real = d.sum() / 2, a != b
    x, y, w = np.concatenate([a[real], b[real]]), np.concatenate([b[real], a[real]]), np.concatenate([w[real]] * 2)
    coin = lambda of, tail: np.array([zlib.crc32(f"{n}{tail}".encode()) * _SPREAD >> 20 for n in names[of]], np.int64)
    turn, thin = 0, 0
    while weight > 0:
        mass = np.round(np.bincount(c, d, len(names)), 9)
        key, where = np.unique(x * np.int64(len(names)) + c[y], return_inverse=True)
        k = np.round(np.bincount(where, w, len(key)), 9)
        node, to = key // len(names), key % len(names)
        own = to == c[node]
        fit = np.round(resolution * k - (mass[to] - np.where(own, d[node], 0.0)) * d[node] / (2 * weight), 9)
        stay = np.round(-(mass[c] - d) * d / (2 * weight), 9)
        stay[node[own]] = fit[own]
        gains = ~own & (fit - stay[node] > NOTHING)
        left = len(np.unique(node[gains]))
        if not left:
            break
        takes_part = (coin(np.arange(len(names)), f"|{turn}") & 1).astype(bool)  # a community that receives
        asks = gains & takes_part[to] & ~takes_part[c[node]]
        asks[asks] = (coin(nodes[node[asks]], f"#{turn}") & ((1 << thin) - 1)) == 0
        node, to, fit = node[asks], to[asks], fit[asks]
        order = np.lexsort((to, -fit, node))
        node, to, fit = node[order], to[order], fit[order]
        node, first = np.unique(node, return_index=True)
        to, gain = to[first], fit[first] - stay[node]
        others = np.bincount(c[node], d[node], len(names))[c[node]] + np.bincount(to, d[node], len(names))[to] - 2 * d[node]
        good = gain > resolution * d[node] * others / (4 * weight) + NOTHING
        c[node[good]] = to[good]
        turn += 1
        thin = 0 if good.any() else (thin + 1) % (2 + math.ceil(math.log2(left + 1)))
    return pd.DataFrame({"a": names[nodes], "c": names[c]})


def _settle(pairs: DataFrame, home: DataFrame, resolution: float, one_task: int) -> tuple[DataFrame, bool]:
    """Moves nodes until no single move gains: node, community and whether any moved. home: a, c for every node in pairs.

    Moving a node of degree d to a community of weight k with it and mass M gains, but for a factor, resolution * k - M * d / (2 W);
    of several moves at once, those between other communities don't matter to each other. So each turn, a coin makes each
    community give or receive, a node of a giving one proposes the best receiving one, and of the proposals those stand that gain
    more than all others with the same source or target may take from them: two nodes of degrees d and e that go from or to the
    same community lose d * e / (2 W) at most. Proposals are thinned, by half from turn to turn, so that some always stand. Every
    turn with moves thus raises modularity, and the end is reached when no node has a move that gains, whichever coins fall.
    Sums are rounded, so that results don't depend on their order, nor on whether one task takes the turns.
    """
    if pairs.count() > one_task:
        return _settle_by_joins(pairs, home, resolution)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(frames)
        if every:
            rows = pd.concat(every)
            own = rows["c"].notna()
            yield _turns(rows[~own], rows[own], resolution)

    every = pairs.select("a", "b", "w", F.lit(None).cast("string").alias("c")).unionByName(home.select("a", F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"), "c"))
    new = cut(every.coalesce(1).mapInPandas(run, "a string, c string"))
    return new, not new.join(home.withColumnRenamed("c", "old"), "a").filter("c <> old").isEmpty()


def _settle_by_joins(pairs: DataFrame, home: DataFrame, resolution: float) -> tuple[DataFrame, bool]:
    """_settle() by joins, a turn at a time."""
    both = cut(pairs.filter("a <> b").select("a", "b", "w").unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    degree = cut(weighted_degrees(pairs).select(F.col("uid").alias("a"), F.round("degree", 9).alias("d")))
    weight = (degree.agg(F.sum("d")).first()[0] or 0.0) / 2
    moved, turn, thin = False, 0, 0
    if weight <= 0:
        return home, False
    while True:
        own = home.join(degree, "a")
        mass = own.groupBy("c").agg(F.round(F.sum("d"), 9).alias("mass"))
        links = both.join(home.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.round(F.sum("w"), 9).alias("k"))
        worth = links.join(mass, "c").join(own.select("a", "d", F.col("c").alias("from")), "a")
        fit = F.round(F.lit(resolution) * F.col("k") - (F.col("mass") - F.when(F.col("c") == F.col("from"), F.col("d")).otherwise(F.lit(0.0))) * F.col("d") / (2 * weight), 9)
        worth = worth.withColumn("fit", fit)
        other = F.col("c") != F.col("from")
        best = worth.groupBy("a", "from", "d").agg(
            F.max(F.when(~other, F.col("fit"))).alias("stay"), F.max(F.when(other, F.col("fit"))).alias("top"), F.min(F.when(other & (_coin("c", f"|{turn}") % 2 == 1), F.struct((-F.col("fit")).alias("less"), F.col("c").alias("to")))).alias("ask")
        )
        # A node without a link to its own community loses the mass of the others there only.
        best = best.join(mass.withColumnRenamed("c", "from"), "from").withColumn("stay", F.coalesce("stay", F.round(-(F.col("mass") - F.col("d")) * F.col("d") / (2 * weight), 9)))
        chosen = _coin("a", f"#{turn}") % (1 << thin) == 0
        asks = (_coin("from", f"|{turn}") % 2 == 0) & (-F.col("ask.less") - F.col("stay") > NOTHING) & chosen
        best = best.select("a", "from", "d", (F.col("top") - F.col("stay") > NOTHING).alias("open"), F.when(asks, F.col("ask.to")).alias("to"), (-F.col("ask.less") - F.col("stay")).alias("gain"))
        best = cut(best.filter("open"))
        left = best.count()
        if not left:
            return home, moved
        give = best.filter("to IS NOT NULL").groupBy("from").agg(F.sum("d").alias("gives"))
        take = best.filter("to IS NOT NULL").groupBy("to").agg(F.sum("d").alias("takes"))
        stands = best.filter("to IS NOT NULL").join(give, "from").join(take, "to").filter(F.col("gain") > F.lit(resolution) * F.col("d") * (F.col("gives") + F.col("takes") - 2 * F.col("d")) / (4 * weight) + NOTHING)
        new = cut(home.join(stands.select("a", "to"), "a", "left").select("a", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("went")))
        went = not new.filter("went").isEmpty()
        home, moved, turn = new.select("a", "c"), moved or went, turn + 1
        thin = 0 if went else (thin + 1) % (2 + math.ceil(math.log2(left + 1)))


def _named(home: DataFrame) -> DataFrame:
    """home with communities named by their least nodes."""
    return cut(home.join(home.groupBy("c").agg(F.min("a").alias("least")), "c").select("a", F.col("least").alias("c")))


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, one_task: int = ONE_TASK_PAIRS) -> DataFrame:
    """uid, community (its least uid) of every node; nodes without edges are alone.

    Nodes move until none gains by it, then communities as wholes, and again, until neither does: at the end no move of a node
    and no move of a community into another gains modularity. The same at any size and partitioning.
    """
    pairs = cut(cluster_graph(nodes, edges))
    home = cut(weighted_degrees(pairs).select(F.col("uid").alias("a"), F.col("uid").alias("c")))
    while True:
        home, _ = _settle(pairs, home, resolution, one_task)
        home = _named(home)
        ends = [home.select(F.col("a").alias(k), F.col("c").alias(f"c{k}")) for k in ("a", "b")]
        up = pairs.join(ends[0], "a").join(ends[1], "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        up = cut(up)
        over, joined = _settle(up, cut(home.select(F.col("c").alias("a")).distinct().withColumn("c", F.col("a"))), resolution, one_task)
        if not joined:
            break
        home = _named(home.join(over.select(F.col("a").alias("c"), F.col("c").alias("to")), "c").select("a", F.col("to").alias("c")))
    found = home.select(F.col("a").alias("uid"), F.col("c").alias("community"))
    return nodes.select("uid").distinct().join(found, "uid", "left").select("uid", F.coalesce("community", "uid").alias("community"))


def invariants(nodes: DataFrame, edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row about a partition: nodes, placed (nodes with one community), least (communities named by their least node),
    improving (moves of a node to a neighbour's community that gain), above (has it at least the modularity of singletons?)."""
    pairs = cluster_graph(nodes, edges)
    degree = weighted_degrees(pairs)
    whole = degree.agg(F.sum("degree") / 2).scalar()
    both = pairs.filter("a <> b").select("a", "b", "w").unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    mass = members.join(degree, "uid").groupBy("community").agg(F.sum("degree").alias("mass"))
    links = both.join(members.select(F.col("uid").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("k"))
    own = members.join(degree, "uid").select(F.col("uid").alias("a"), F.col("community").alias("home"), "degree")
    here = own.join(mass.withColumnRenamed("community", "home"), "home").join(links.withColumnRenamed("community", "home").withColumnRenamed("k", "k0"), ["a", "home"], "left")
    stay = F.lit(resolution) * F.coalesce("k0", F.lit(0.0)) - (F.col("mass") - F.col("degree")) * F.col("degree") / (2 * whole)
    there = links.join(mass.withColumnRenamed("mass", "m"), "community").join(here.withColumn("stay", stay), "a").filter("community <> home")
    gains = F.lit(resolution) * F.col("k") - F.col("m") * F.col("degree") / (2 * whole) - F.col("stay")
    better = there.agg(F.count_if(gains > 1e-6).alias("improving"))
    alone = nodes.select("uid", F.col("uid").alias("community"))
    q, q0 = (modularity(pairs, m, resolution) for m in (members, alone))
    least = members.groupBy("community").agg(F.min("uid").alias("first")).agg(F.count_if(F.col("first") != F.col("community"))).scalar()
    one = nodes.select("uid").join(members, "uid", "left").agg(F.countDistinct("uid").alias("nodes"), F.count("community").alias("placed"))
    one = one.withColumns({"least": least == 0, "improving": better.scalar(), "q": q.scalar(), "q0": q0.scalar()})
    return one.select("nodes", "placed", "least", "improving", (F.coalesce("q", F.lit(0.0)) >= F.coalesce("q0", F.lit(0.0)) - 1e-9).alias("above"))


def modularity(pairs: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a partition (uid, community)."""
    degree = weighted_degrees(pairs)
    total = degree.agg(F.sum("degree") / 2).scalar()
    square = members.join(degree, "uid").groupBy("community").agg(F.sum("degree").alias("mass")).agg(F.sum(F.col("mass") * F.col("mass"))).scalar()
    inner = pairs.join(members.select(F.col("uid").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("uid").alias("b"), F.col("community").alias("cb")), "b")
    inner = inner.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    return inner.select((F.col("inner") / total - F.lit(resolution) * square / (4 * total * total)).alias("modularity"))


def cohesion(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """community, cohesion: the share of the weight at its members' ends that stays inside; 0 without edges."""
    a = members.select(F.col("uid").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("uid").alias("b"), F.col("community").alias("cb"))
    placed = pairs.join(a, "a").join(b, "b")
    ends = placed.select(F.col("ca").alias("community"), "w", (F.col("ca") == F.col("cb")).alias("same")).unionByName(placed.select(F.col("cb").alias("community"), "w", (F.col("ca") == F.col("cb")).alias("same")))
    share = ends.groupBy("community").agg(F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    every = members.select("community").distinct().join(share, "community", "left")
    return every.select("community", F.when(F.coalesce("all", F.lit(0.0)) > 0, F.col("inside") / F.col("all")).otherwise(F.lit(0.0)).alias("cohesion"))


def labels(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, label: the commonest last two directory parts of its members' files; ties to the lesser label."""
    named = members.join(nodes.select("uid", T.area_label("file_path").alias("label")), "uid")
    each = named.groupBy("community", "label").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("community").orderBy(F.col("n").desc(), "label")
    return each.withColumn("place", F.row_number().over(first)).filter("place = 1").select("community", "label")


def clusters(members: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """community, label, cohesion, members (sorted uids)."""
    listed = members.groupBy("community").agg(F.array_sort(F.collect_list("uid")).alias("members"))
    return listed.join(labels(members, nodes), "community", "left").join(cohesion(members, pairs), "community").select("community", "label", "cohesion", "members")


def assigned(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """nodes with cluster_id from members; empty without one."""
    return nodes.drop("cluster_id").join(members.select("uid", F.col("community").alias("cluster_id")), "uid", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(""))).select(*nodes.columns)
