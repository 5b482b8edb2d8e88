"""Entity merge: equivalence by shared keys, redirected edges, replayed beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credograph.session import cut


def classes(nodes: DataFrame, node: str, keys: list[Column]) -> DataFrame:
    """``node, class_id``: nodes that share any key, directly or through others; the class is its smallest node.

    Labels pass from nodes to keys and back, by the smallest, until nothing changes; a
    key of many nodes is one partial aggregation. Null keys join nothing.
    """
    shared = F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), k) for i, k in enumerate(keys)]))
    return linked(nodes.select(F.col(node).alias("node"), F.explode_outer(shared).alias("key")), "node", "key")


def linked(rows: DataFrame, node: str, key: str) -> DataFrame:
    """As ``classes``, of rows of a node and a key; a node without keys has a row with a null one."""
    n = cut(rows.select(F.col(node).alias("node"), F.col(key).alias("key")).where("key is not null").distinct())
    label = cut(rows.select(F.col(node).alias("node")).distinct().withColumn("class_id", F.col("node")))
    while True:
        by_key = n.join(label, "node").groupBy("key").agg(F.min("class_id").alias("c"))
        least = n.join(by_key, "key").groupBy("node").agg(F.min("c").alias("c"))
        # a node also takes over the label of its label: chains halve each round
        moved = label.join(least, "node", "left").withColumn("c", F.least("class_id", F.coalesce("c", "class_id")))
        jump = moved.select(F.col("node").alias("m"), F.col("c").alias("j"))
        new = cut(moved.join(jump, F.col("c") == F.col("m"), "left").select("node", F.least("c", F.coalesce("j", "c")).alias("class_id"), (F.col("class_id") != F.least("c", F.coalesce("j", "c"))).alias("changed")))
        done = new.where("changed").isEmpty()
        label = new.drop("changed")
        if done:
            return label


def winners(classed: DataFrame, score: Column, listed: Column) -> DataFrame:
    """``node, winner`` of ``node, class_id`` and what ``score`` and ``listed`` are made of.

    The node of the highest score wins, of equal ones a listed one, then the smallest.
    """
    best = F.min(F.struct((-F.coalesce(score, F.lit(0.0))).alias("s"), F.when(F.coalesce(listed, F.lit(False)), 0).otherwise(1).alias("l"), F.col("node")))
    return classed.join(classed.groupBy("class_id").agg(best["node"].alias("winner")), "class_id").select("node", "winner")


def folded(nodes: DataFrame, won: DataFrame, node: str, lists: list[str], texts: list[str]) -> DataFrame:
    """One row for each winner: lists united, texts its own or the first of its losers', and ``merged_from``."""
    x = nodes.join(won.withColumnRenamed("node", node), node)
    own = F.col(node) == F.col("winner")
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in lists]
    first = [F.min_by(F.nullif(F.trim(c), F.lit("")), F.struct(F.nullif(F.trim(c), F.lit("")).isNull(), ~own, F.col(node))).alias(c) for c in texts]
    return x.groupBy(F.col("winner").alias(node)).agg(*united, *first, F.array_sort(F.collect_list(F.when(~own, F.col(node)))).alias("merged_from"))


def rewritten(chains: DataFrame, won: DataFrame, roles: list[str]) -> DataFrame:
    """Chains with each role's node replaced by the one it was merged into."""
    out = chains
    for role in roles:
        m = won.select(F.col("node").alias(role), F.col("winner").alias("__w"))
        out = out.join(m, role, "left").withColumn(role, F.coalesce("__w", role)).drop("__w")
    return out.select(*chains.columns)


def replayed(log: DataFrame, arm: str = "arm") -> DataFrame:
    """Beliefs of merged edges: records alike in source, support and arm count once, the earliest, at the weight they applied."""
    kept = log.groupBy("src", "dst", "edge_type", "source_id", "bucket", arm).agg(F.min_by(F.struct("up", "down"), F.struct("ts", "seq")).alias("v"))
    return kept.groupBy("src", "dst", "edge_type").agg((1 + F.sum("v.up").cast("double")).alias("alpha"), (1 + F.sum("v.down").cast("double")).alias("beta"), F.count("*").alias("n_records"))


def redirect(log: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """The log with one end replaced by its class; records alike in source, bucket and edge count once, the first."""
    x = log.join(mapping.select(F.col("node").alias(column), "class_id"), column, "left").withColumn(column, F.coalesce("class_id", column)).drop("class_id")
    w = Window.partitionBy("src", "dst", "edge_type", "source_id", "bucket").orderBy("seq")
    return x.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prune(edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Edges of type ``kinds[k]`` need an edge of type ``k`` into their source; repeated until nothing goes."""
    live = cut(edges)
    while True:
        out = live
        for before, after in kinds.items():
            fed = out.where(F.col("edge_type") == before).select(F.col("dst").alias("src")).distinct()
            kept = out.where(F.col("edge_type") == after).join(fed, "src", "left_semi")
            out = out.where(F.col("edge_type") != after).unionByName(kept.select(*out.columns))
        new = cut(out)
        if new.count() == live.count():
            return new
        live = new
