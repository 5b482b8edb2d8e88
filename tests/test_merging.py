from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from credograph.operators import field, merge, vectors

random.seed(11)
BASE = [[random.gauss(0, 1) for _ in range(8)] for _ in range(12)]
VECTORS = [(i, [x + random.gauss(0, 0.25) for x in random.choice(BASE)]) for i in range(150)] + [(200, BASE[0]), (201, [2 * x for x in BASE[0]]), (202, None), (203, [0.0] * 8), (None, BASE[1])]


def cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5


@pytest.mark.parametrize("least,pivots", [(0.9, 5), (0.6, 40), (0.97, 1)])
def test_similar_pairs_are_all_there_are(spark, least, pivots):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    usable = [(i, v) for i, v in VECTORS if i is not None and v and any(v) and i != 201]
    want = {(a, b) for a, u in usable for b, v in usable if a < b and cosine(u, v) >= least}
    got = vectors.similar_pairs(df, least, pivots).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 5
    new = spark.createDataFrame([(3,), (200,)], "vec_id long")
    assert {(r["a"], r["b"]) for r in vectors.similar_pairs(df, least, pivots, new=new).collect()} == {p for p in want if {3, 200} & set(p)}
    assert {r["first"] for r in vectors.copies(df).where("vec_id in (200, 201)").collect()} == {200}
    assert vectors.similar_pairs(df.limit(0), least).count() == 0


def test_winner_fold_and_rewrite(spark):
    nodes = spark.createDataFrame([("a", 1.0, False, ["x"], ""), ("b", 1.0, True, ["y", "x"], "told"), ("c", 0.5, True, None, "late"), ("d", None, None, [], None), ("e", None, None, ["z"], None)], "node string, score double, listed boolean, names array<string>, note string")
    classed = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "3")], "node string, class_id string").join(nodes, "node")
    won = merge.winners(classed, F.col("score"), F.col("listed"))
    assert {tuple(r) for r in won.collect()} == {("a", "b"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "e")}
    out = {r["node"]: r for r in merge.folded(nodes, won, "node", ["names"], ["note"]).collect()}
    assert set(out) == {"b", "d", "e"} and out["b"]["names"] == ["x", "y"] and out["b"]["merged_from"] == ["a", "c"] and out["b"]["note"] == "told" and out["d"]["note"] is None
    chains = spark.createDataFrame([(1, "a", "q"), (2, "c", "a"), (3, None, "zz")], "id int, compound string, target string")
    assert sorted(map(tuple, merge.rewritten(chains, won, ["compound", "target"]).collect()), key=str) == [(1, "b", "q"), (2, "b", "b"), (3, None, "zz")]


def test_replay_counts_alike_records_once(spark):
    log = spark.createDataFrame([("s", "t", "k", "n1", "strong", "a1", 1, 2, 3.0, 1.0), ("s", "t", "k", "n1", "strong", "a1", 2, 1, 9.0, 9.0), ("s", "t", "k", "n1", "strong", "a2", 1, 3, 1.0, 0.0), ("s", "t", "k", "n1", "weak", "a1", 1, 4, 0.0, 1.0)], "src string, dst string, edge_type string, source_id string, bucket string, arm string, ts int, seq int, up double, down double")
    assert tuple(merge.replayed(log).first())[3:] == (5.0, 3.0, 3)


def test_hierarchy_takes_the_narrowest_and_makes_no_circle(spark):
    shares = spark.createDataFrame([("in", "mid", 1.0), ("in", "out", 1.0), ("mid", "out", 0.95), ("out", "mid", 0.2), ("same", "twin", 0.99), ("twin", "same", 0.93), ("far", "out", 0.4)], "inner string, outer string, share double")
    widths = spark.createDataFrame([("in", 1.0), ("mid", 2.0), ("out", 5.0), ("same", 1.0), ("twin", 1.0)], "key string, width double")
    assert {tuple(r) for r in vectors.nearest_parents(shares, widths).collect()} == {("in", "mid"), ("mid", "out")}


def test_field(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    edge = ("a", "b", "t")
    records = spark.createDataFrame([(*edge, "n1", 4.0, 1.0), (*edge, "n2", 1.0, 3.0), (*edge, "n3", 1.0, 1.0)], "src string, dst string, edge_type string, trial string, up double, down double")
    at = spark.createDataFrame([(*edge, "n1", 1, 1), (*edge, "n1", 1, 2), (*edge, "n1", 1, 2), (*edge, "n2", 3, 3), (*edge, "n3", None, 1)], "src string, dst string, edge_type string, trial string, s long, t long")
    placed = field.anchors(records, at)
    assert {(r["trial"], r["t"], r["up"], r["down"]) for r in placed.collect()} == {("n1", 1, 2.0, 0.5), ("n1", 2, 2.0, 0.5), ("n2", 3, 1.0, 3.0)}
    marginal = spark.createDataFrame([(*edge, 6.0, 2.0)], "src string, dst string, edge_type string, alpha double, beta double")
    e = 2.718281828459045
    points = spark.createDataFrame([(1, *edge, 1, 1, None), (2, *edge, 1, 1, "n1"), (3, "q", "b", "t", 1, 1, None), (4, *edge, 4, 4, None)], "point long, src string, dst string, edge_type string, s long, t long, without string")
    got = {r["point"]: (r["alpha"], r["beta"]) for r in field.query(points, placed, vec, marginal).collect()}
    w2, w3, w4 = e ** (-1 / 0.25), e ** (-4 / 0.25), e ** (-2 / 0.25)
    assert got[1] == pytest.approx((1.5 + 2 + 2 * w2 + w3, 0.5 + 0.5 + 0.5 * w2 + 3 * w3))
    assert got[2] == pytest.approx((1.5 + w3, 0.5 + 3 * w3)) and got[3] == (1.0, 1.0)
    assert got[4] == pytest.approx((1.5 + w4 * 5, 0.5 + w4 * 4))
    assert spark.range(1).select(field.chain_mean(F.lit(0.25)).alias("p")).first()["p"] == pytest.approx(0.25)
    assert field.interned(vec.unionByName(vec), "embedding").count() == 4
