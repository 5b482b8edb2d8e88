from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from credograph.operators import graph


def brute(edges, src, tgt, hops):
    found, stack = set(), [((src,), ())]
    while stack:
        nodes, types = stack.pop()
        for a, b, t in edges:
            if a == nodes[-1] and b not in nodes and len(types) < hops:
                if b == tgt:
                    found.add((src, tgt, nodes + (b,), types + (t,)))
                else:
                    stack.append((nodes + (b,), types + (t,)))
    return found


def test_all_simple_paths_of_up_to_six_hops(spark):
    r = random.Random(5)
    edges = {(f"n{r.randrange(12)}", f"n{r.randrange(12)}", r.choice("xyz")) for _ in range(26)} | {(f"c{i}", f"c{i + 1}", "x") for i in range(7)} | {("c3", "c0", "y")}
    pairs = [(f"n{i}", f"n{11 - i}") for i in range(12)] + [("c0", "c6"), ("c0", "c3"), ("c0", "c7"), ("c0", "c1"), ("c0", "c0"), ("c0", "gone")]
    got = graph.simple_paths(spark.createDataFrame([*edges, *edges, (None, "n1", "x")], "src string, dst string, edge_type string"), spark.createDataFrame(pairs + pairs, "src string, tgt string")).collect()
    want = {p for a, b in pairs if a != b for p in brute(edges, a, b, 6)}
    assert {(x["src"], x["tgt"], tuple(x["nodes"]), tuple(x["edge_types"])) for x in got} == want and len(got) == len(want)
    assert all(x["hops"] == len(x["edge_types"]) for x in got) and {x["hops"] for x in got} >= {1, 3, 6}


def test_paths_are_not_stored_on_the_way(spark, monkeypatch):
    """12^4 paths over 456 edges: no table written holds more rows than the edges, and after the first hop of each length none is joined by a shuffle."""
    layers = [["s"], *[[f"{k}{i}" for i in range(12)] for k in "abcd"], ["t"]]
    edges = [(a, b, "x") for here, there in zip(layers, layers[1:]) for a in here for b in there]
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (written.append(cut(df)), written[-1])[1])
    got = graph.simple_paths(spark.createDataFrame(edges, "src string, dst string, edge_type string"), spark.createDataFrame([("s", "t")], "src string, tgt string"))
    assert got.count() == got.distinct().count() == 12**4
    assert max(df.count() for df in written) <= len(edges)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == sum(range(5)) and plan.count("SortMergeJoin") == 5


def test_paths_of_edges_too_many_to_broadcast(spark):
    r = random.Random(6)
    edges = {(f"n{r.randrange(9)}", f"n{r.randrange(9)}", r.choice("xy")) for _ in range(22)}
    pairs = [(f"n{i}", f"n{j}") for i in range(9) for j in range(9)]
    args = spark.createDataFrame([*edges], "src string, dst string, edge_type string"), spark.createDataFrame(pairs, "src string, tgt string")
    got = graph.simple_paths(*args, broadcast_bytes=0).collect()
    want = {p for a, b in pairs if a != b for p in brute([*edges], a, b, 6)}
    assert {(x["src"], x["tgt"], tuple(x["nodes"]), tuple(x["edge_types"])) for x in got} == want and len(got) == len(want)
    assert sorted(got) == sorted(graph.simple_paths(*args).collect())


def test_paths_through_a_hub_are_shared_by_all_tasks(spark):
    """One pair whose target has 240 mechanisms: 480 paths, a sixteenth in each task, and those of a mechanism all in one."""
    mids = [f"m{i}" for i in range(240)]
    edges = [("s", "h", "x"), *[("h", m, "x") for m in mids], *[(m, f"b{i % 2}", "x") for m in mids for i in range(2)], *[(f"b{i}", "t", "x") for i in range(2)]]
    got = graph.simple_paths(spark.createDataFrame(edges, "src string, dst string, edge_type string"), spark.createDataFrame([("s", "t")], "src string, tgt string"))
    tasks = got.select(F.get("nodes", F.lit(2)).alias("mid"), F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 480 and len({(x["mid"], x["task"]) for x in tasks}) == 240
    each = Counter(x["task"] for x in tasks)
    assert len(each) == 4 * spark.sparkContext.defaultParallelism and max(each.values()) == 30


def test_paths_to_more_goals_than_a_mask_has_bits(spark):
    r = random.Random(7)
    edges = [*{(f"n{r.randrange(150)}", f"n{r.randrange(150)}", r.choice("xy")) for _ in range(260)}]
    pairs = [(f"n{r.randrange(150)}", f"n{i}") for i in range(150) for _ in range(3)]
    args = spark.createDataFrame(edges, "src string, dst string, edge_type string"), spark.createDataFrame(pairs, "src string, tgt string")
    want = {p for a, b in {*pairs} if a != b for p in brute(edges, a, b, 6)}
    assert len({x[1] for x in want}) > 64
    for how in ({}, {"broadcast_bytes": 0}):
        got = graph.simple_paths(*args, **how).collect()
        assert {(x["src"], x["tgt"], tuple(x["nodes"]), tuple(x["edge_types"])) for x in got} == want and len(got) == len(want)
