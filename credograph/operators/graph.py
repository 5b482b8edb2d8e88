"""Chain prediction, traversal, coverage and bridges over belief edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.session import cut

#: Up to so many bytes, as rows in memory, of the edges of one number of hops left are broadcast; beyond, they are joined by shuffles.
BROADCAST_BYTES = 100_000_000

#: A node's edges are shared by one more task for each so many.
SHARE_EDGES = 10


def chain_probabilities(edges: DataFrame, key: str = "chain_id") -> DataFrame:
    """Plug-in prediction of each chain: softmin of its edges' means, the bottleneck and the edge count.

    ``edges`` has the chain, ``edge_type``, ``alpha`` and ``beta``; edges without
    evidence are left out, and of equal bottlenecks the smaller edge type is named.
    """
    a, b = F.col("alpha"), F.col("beta")
    p = a / (a + b)
    x = edges.where("alpha + beta > 2").withColumns({"p": p, "weak": F.round((1 - p) * B.trust(a + b - 2), 6)})
    top = F.min_by("edge_type", F.struct(-F.col("weak"), F.round("p", 6), "edge_type"))
    return x.groupBy(key).agg(F.round(B.softmin(F.col("p")), 6).alias("efficacy"), F.max("weak").alias("bottleneck"), top.alias("bottleneck_edge"), F.count("*").alias("n_edges"))


def two_hop_counts(edges: DataFrame, first: str, second: str) -> DataFrame:
    """``via, sources, sinks, paths`` of the simple paths over two edge types, counted for each middle node and never paired.

    Paths that lead back to where they began are taken off: nodes that are source and sink of the same middle node.
    """
    a = edges.where(F.col("edge_type") == first).select(F.col("dst").alias("via"), F.col("src").alias("node")).distinct()
    b = edges.where(F.col("edge_type") == second).select(F.col("src").alias("via"), F.col("dst").alias("node")).distinct()
    ins, outs = a.groupBy("via").agg(F.count("*").alias("i")), b.groupBy("via").agg(F.count("*").alias("o"))
    back = a.intersect(b).groupBy("via").agg(F.count("*").alias("k"))
    x = ins.join(outs, "via").join(back, "via", "left")
    k = F.coalesce("k", F.lit(0))
    paths = F.col("i") * F.col("o") - k
    # a node that is both has no path if it is the only one of the other side
    sources = F.col("i") - F.when(F.col("o") == 1, k).otherwise(0)
    sinks = F.col("o") - F.when(F.col("i") == 1, k).otherwise(0)
    return x.where(paths > 0).select("via", sources.alias("sources"), sinks.alias("sinks"), paths.alias("paths"))


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 6, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``src, tgt, hops, nodes, edge_types``: every path of at most ``max_hops`` edges of any type between the pairs.

    ``edges`` has ``src, dst, edge_type``, ``pairs`` has ``src, tgt``; no path visits a node
    twice, parallel edges of several types give a path each, and a node has no path to
    itself. Only steps from which the goal can still be reached in exactly the hops left are
    taken, which leaves out no path. Repeated edges and pairs count once.

    Only edges are written and shuffled, with the goals that they still lead to; paths are
    grown from them row by row while the result is read, and never stored on the way. That
    holds while the edges of each number of hops left are at most ``broadcast_bytes``
    (added up first); beyond, they are joined by shuffles. Nodes are numbers on the way, goals
    bits of a mask for each block of 64.
    """
    asked = pairs.select("src", "tgt").where("src <> tgt").distinct()
    goals = cut(_numbered(asked.select("tgt").distinct(), "goal"))
    asked = cut(asked.join(goals, "tgt"))
    e = cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "edge_type").where("node is not null and next is not null").distinct())
    near = layer = asked.select(F.col("src").alias("node"), F.lit(0).alias("far")).distinct()
    for far in range(1, max_hops):
        found = layer.join(e, "node").select(F.col("next").alias("node")).distinct()
        layer = cut(found.join(near, "node", "left_anti").select("node", F.lit(far).alias("far")))
        if layer.isEmpty():
            break
        near = near.unionByName(layer)
    e = e.join(near, "node")
    ids = cut(_numbered(e.select("node").union(e.select("next")).distinct(), "at"))
    e = cut(e.join(ids, "node").join(ids.toDF("next", "to"), "next").select("at", "to", "next", "edge_type", "far"))
    goals = goals.join(ids, goals["tgt"] == ids["node"]).select("at", F.expr("goal div 64").cast("int").alias("block"), F.expr("shiftleft(1L, goal % 64)").alias("mask"), "goal")
    asked = cut(asked.join(ids, asked["src"] == ids["node"]).select("src", "tgt", "goal", F.expr("goal div 64").cast("int").alias("block"), F.expr("shiftleft(1L, goal % 64)").alias("bit"), F.col("at").alias("a0")))
    own = goals.select("at", "block", F.col("mask").alias("own"))
    back, steps = goals.select(F.col("at").alias("to"), "block", "mask", F.lit(0).alias("fan")), {}
    weight = F.sum(F.octet_length("name") + F.coalesce(F.octet_length("edge_type"), F.lit(0)) + 100)
    for left in range(1, max_hops + 1):
        step = e.where(F.col("far") <= max_hops - left).join(back, "to").join(own, ["at", "block"], "left")
        step = cut(step.select("at", "block", "to", F.col("next").alias("name"), "edge_type", F.expr("mask & ~coalesce(own, 0L)").alias("mask"), "fan").where("mask <> 0"))
        size = step.agg(weight).first()[0]
        if size is None:
            break
        # the tables are far smaller as files than in memory, so the planner isn't left to guess
        steps[left] = step, "broadcast" if size <= broadcast_bytes else "merge"
        back = step.groupBy(F.col("at").alias("to"), "block").agg(F.bit_or("mask").alias("mask"), F.count("*").cast("int").alias("fan"))
    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    out = asked.where("false").select("src", "tgt", F.lit(0).alias("hops"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("edge_types"))
    for hops in steps:
        front = asked.withColumn("n0", F.col("src"))
        for hop in range(1, hops + 1):
            step, how = steps[hops - hop + 1]
            # the first steps are from few rows, and would be broadcast once more for them
            step = step.toDF("at", "to_block", f"a{hop}", f"n{hop}", f"e{hop}", "mask", "fan").hint("merge" if hop == 1 else how)
            front = front.join(step, _goes_on(hop, hops))
            if hop == 1 < hops:  # few rows still, each the start of many paths
                front = _dealt(front, tasks) if hops > 2 else front.repartition(tasks)
            front = front.drop("at", "to_block", "mask", "fan")
        out = out.unionByName(front.select("src", "tgt", F.lit(hops).alias("hops"), F.array(*[f"n{i}" for i in range(hops + 1)]).alias("nodes"), F.array(*[f"e{i}" for i in range(1, hops + 1)]).alias("edge_types")))
    return out


def _numbered(names: DataFrame, number: str) -> DataFrame:
    return names.coalesce(1).withColumn(number, F.monotonically_increasing_id().cast("int"))


def _dealt(front: DataFrame, tasks: int) -> DataFrame:
    """Paths of one hop, dealt out to tasks: ``share`` of ``shares`` goes on to the next nodes of that remainder.

    A node with many edges has shares in up to all tasks, one after another, so that hubs are
    spread evenly and each task's result has few different names; paths to nodes with few
    edges are dealt out by their pair.
    """
    front = front.withColumn("shares", F.least(F.lit(tasks), 1 + F.expr(f"fan div {SHARE_EDGES}")).cast("int"))
    front = front.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    of = lambda *c: F.pmod(F.hash(*c), F.lit(tasks))
    return front.repartitionById(tasks, of("a1") + F.col("share") + F.col("shares") * of("a0", "goal"))


def _goes_on(hop: int, hops: int) -> Column:
    """Whether a step is the next one of a path: it leads to the goal, and comes to a new node or, as the last one, to the goal itself."""
    here = (F.col(f"a{hop - 1}") == F.col("at")) & (F.col("block") == F.col("to_block")) & (F.col("mask").bitwiseAND(F.col("bit")) != 0)
    if hop == 2 < hops:
        here &= F.pmod(f"a{hop}", "shares") == F.col("share")
    return here if hop == hops else here & ~F.col(f"a{hop}").isin(*[F.col(f"a{i}") for i in range(hop)])


def ancestors(nodes: DataFrame, parents: DataFrame, max_depth: int = 5) -> DataFrame:
    """``node, level, ancestor`` of each node: itself at level 0, then its parent's parents, nearest first.

    ``parents`` has ``node, parent``; of several the smallest counts. A walk ends at the root, at
    ``max_depth``, or where it would come to a node again.
    """
    first = cut(parents.where("node is not null and parent is not null and node <> parent").groupBy(F.col("node").alias("at")).agg(F.min("parent").alias("parent")))
    walk = nodes.select("node", F.lit(0).alias("level"), F.col("node").alias("ancestor"), F.array("node").alias("seen")).distinct()
    out = [walk]
    for level in range(1, max_depth + 1):
        walk = walk.join(first, walk["ancestor"] == first["at"]).where(~F.array_contains("seen", F.col("parent")))
        walk = cut(walk.select("node", F.lit(level).alias("level"), F.col("parent").alias("ancestor"), F.array_append("seen", F.col("parent")).alias("seen")))
        if walk.isEmpty():
            break
        out.append(walk)
    return reduce(DataFrame.unionByName, out).drop("seen")


def running_total(df: DataFrame, by: str, order: str, value: str, out: str, prefix: int = 8) -> DataFrame:
    """``out``: the sum of ``value`` up to each row in the order of a text column, ties summed together, per ``by``.

    Rows fall into ranges by the order's first characters; the ranges' sums are added up
    first, then each range on its own, so that no window holds all rows of a group.
    """
    x = df.withColumn("__r", F.substring(order, 1, prefix))
    sums = x.groupBy(by, "__r").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    sums = sums.select(by, "__r", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    own = Window.partitionBy(by, "__r").orderBy(order)
    return x.withColumn("__o", F.sum(value).over(own)).join(sums, [by, "__r"]).withColumn(out, F.col("__o") + F.col("__b")).drop("__r", "__o", "__b")


def best_of(edges: DataFrame, by: str, pick: str) -> DataFrame:
    """For each node the neighbour with the greatest p·(1+strength); ties go to the larger name."""
    a, b = F.col("alpha"), F.col("beta")
    score = F.round(a / (a + b) * (a + b - 1), 6)
    return edges.withColumn("score", score).groupBy(by).agg(F.max_by(pick, F.struct("score", pick)).alias(pick), F.max("score").alias("score"))


def bridges(uses: DataFrame, node: str, side: str, value: str) -> DataFrame:
    """Nodes used on at least two sides, and how far the sides' means lie apart."""
    per = uses.groupBy(node, side).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    x = per.groupBy(node).agg(F.count("*").alias("sides"), F.sum("n").alias("uses"), F.round(F.max("m") - F.min("m"), 6).alias("spread"), F.max_by(side, F.struct(F.round("m", 9), side)).alias("high"), F.min_by(side, F.struct(F.round("m", 9), side)).alias("low"))
    return x.where("sides >= 2")


def leave_one_out_rate(rows: DataFrame, key: str, value: str, prior: float = 0.5, weight: float = 2.0) -> DataFrame:
    """Each row's group mean without itself, shrunk towards ``prior``; sums are joined back, so a hot group is split."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    rate = (F.col("__sum") - F.col(value) + prior * weight) / (F.col("__n") - 1 + weight)
    return rows.join(sums, key).withColumn("rate", F.round(rate, 6)).drop("__sum", "__n")


def subsets(features: str) -> Column:
    """All non-empty subsets of a sorted array column, each joined by ``__``; twice as many with each feature."""
    f = features
    return F.expr(f"transform(sequence(1L, shiftleft(1L, size({f})) - 1), m -> array_join(filter({f}, (x, i) -> (shiftright(m, i) & 1) = 1), '__'))")
