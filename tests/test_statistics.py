from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from credograph.operators import merge, statistics, vectors


@pytest.fixture(scope="module")
def scored(spark):
    random.seed(1)
    rows = [(i, round(random.random(), 2), round(random.random(), 1), float(random.random() < 0.4)) for i in range(300)]
    return spark.createDataFrame(rows, "i long, p double, q double, y double").persist(), rows


def brute(rows, k):
    pos, neg = [r[k] for r in rows if r[3]], [r[k] for r in rows if not r[3]]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)


def test_auroc_is_brute_force(scored):
    df, rows = scored
    assert statistics.auroc(df, "p", "y").first()["auroc"] == pytest.approx(brute(rows, 1), abs=1e-6)
    d = statistics.delong(df, "p", "q", "y").first()
    assert (d["auc_a"], d["auc_b"]) == pytest.approx((brute(rows, 1), brute(rows, 2)), abs=1e-6)
    assert statistics.auroc(df.where("y = 1"), "p", "y").first()["auroc"] is None
    assert statistics.auroc(df.limit(0), "p", "y").first()["auroc"] is None


def test_average_precision(scored):
    df, rows = scored
    total, want = sum(r[3] for r in rows), 0.0
    for s in {r[1] for r in rows}:
        above = [r for r in rows if r[1] >= s]
        want += sum(r[3] for r in rows if r[1] == s) * sum(r[3] for r in above) / len(above)
    assert statistics.pr_auc(df, "p", "y").first()["pr_auc"] == pytest.approx(want / total, abs=1e-6)


def test_reliability_counts_all(scored):
    assert sum(r["n"] for r in statistics.reliability(scored[0], "p", "y").collect()) == 300


def test_fold(spark):
    df = spark.createDataFrame([("a",), ("NCT1",), ("é",)], "k string").select("k", statistics.fold(F.col("k"), 7).alias("f"))
    assert {r["k"]: r["f"] for r in df.collect()} == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % 7 for k in ("a", "NCT1", "é")}


def test_mcnemar(spark):
    df = spark.createDataFrame([(0, 0), (1, 9), (5, 5)], "b long, c long").select(statistics.mcnemar_p("b", "c").alias("p"))
    assert [r["p"] for r in df.collect()] == pytest.approx([1.0, 22 / 1024, 1.0])


def test_search_is_brute_force(spark):
    import numpy as np

    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(200)] + [(500, None), (501, [0.0] * 6), (502, [1.0] * 6), (503, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = vectors.search(df, df.where("vec_id % 50 = 0 or vec_id >= 500"), 3, block=2).collect()
    held = {i: np.array(v, dtype="float32").astype(float) for i, v in rows if v and any(v)}
    for q in (0, 50, 502):
        best = sorted(((-round(float(held[q] @ v / np.linalg.norm(v) / np.linalg.norm(held[q])), 12), i) for i, v in held.items() if i != q))[:3]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in best]
    assert {r["query_id"] for r in got}.isdisjoint({500, 501})
    assert vectors.search(df.limit(0), df.limit(0), 3).count() == 0


def test_classes_follow_chains(spark):
    rows = [(f"n{i:03d}", f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(120)] + [("alone", None, None)]
    df = spark.createDataFrame(rows, "node string, a string, b string")
    got = {r["node"]: r["class_id"] for r in merge.classes(df, "node", [F.col("a"), F.col("b")]).collect()}
    assert {got[f"n{i:03d}"] for i in range(120)} == {"n000"} and got["alone"] == "alone"


def test_box_relation(spark):
    df = spark.createDataFrame([(1, 0.95, 0.95), (2, 0.95, 0.1), (3, 0.1, 0.95), (4, 0.4, 0.1), (5, 0.1, 0.2)], "i int, a double, b double")
    assert [r[0] for r in df.orderBy("i").select(vectors.relation(F.col("a"), F.col("b"))).collect()] == ["merge", "child", "parent", "sibling", "unrelated"]
