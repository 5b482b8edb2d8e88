"""Groups from pairwise links by randomised contraction.

In each round every vertex hooks to whichever of itself and its neighbours comes first
in a fresh hash order; links are relabelled and deduplicated, those inside a vertex
vanish, and the rest go on. The expected number of vertices falls by a constant factor a
round whatever the graph's shape, chains and stars included. At the end the rounds'
mappings are expanded one into the next, the last first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credograph.session import cut, release

MAX_ROUNDS = 100


def contract(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, root`` of every vertex of ``links``; vertices of one group share a root.

    Nulls and self-links link nothing and name no vertex; repeated and reversed links
    count once; no links give no rows. The choice of a neighbour is a partial
    aggregation, so a vertex with a third of all links is reduced before the shuffle;
    relabelling joins are left to adaptive skew splitting. Mappings and links are
    written each round: a lost executor costs at most one round. Tables of a round are
    deleted as soon as the next has been written, the mappings once they are expanded.
    """
    plain = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(plain.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        n = len(rounds)
        if n >= MAX_ROUNDS:
            raise RuntimeError(f"links left after {n} rounds")
        both = edges.union(edges.select("v", "u"))
        key = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("w"))  # noqa: B023, E731
        hooks = both.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least(F.col("m"), key("u"))["w"].alias("to"))
        hooks = cut(hooks)
        rounds.append(hooks)
        to = hooks.withColumnRenamed("to", "r")
        half = edges.join(to, "u").select(F.col("r").alias("p"), "v")
        full = half.join(to.withColumnRenamed("u", "v"), "v").select("p", F.col("r").alias("q")).where("p <> q")
        before, edges = edges, cut(full.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        release(before)
    if not rounds:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    out = rounds[-1].select(F.col("u").alias("x"), F.col("to").alias("root"))
    for hooks in reversed(rounds[:-1]):  # where its representative went on, a vertex follows
        out = hooks.join(out, hooks["to"] == out["x"], "left").select(hooks["u"].alias("x"), F.coalesce(out["root"], hooks["to"]).alias("root"))
    out = cut(out.select(F.col("x").alias("vertex"), "root"))
    release(edges, *rounds)
    return out


def groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, group``: the group's name is its smallest vertex."""
    found = contract(links, a, b)
    least = found.groupBy("root").agg(F.min("vertex").alias("group"))
    return found.join(least, "root").select("vertex", "group")


def accepted(verdicts: DataFrame) -> DataFrame:
    """``a, b`` of match verdicts that hold: for a pair and field the latest counts, whichever way round.

    Of equally late verdicts the one loaded last counts, then the one with the larger
    ``pair_id``; a verdict without a date is older than any other. A pair is linked if the verdict is
    ``merge`` in at least one field.
    """
    last = (
        verdicts.where("left_id is not null and right_id is not null and left_id <> right_id")
        .groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"), "field_name")
        .agg(F.max(F.struct("decided_at", "loaded_at", "pair_id", "label"))["label"].alias("label"))
    )
    return last.where(F.lower(F.trim("label")) == "merge").select("a", "b").distinct()
