from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from credograph.llm import components, splits


def union_find(links, nodes=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n in nodes:
        find(n)
    for a, b in links:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for x in list(parent):
        groups[find(x)].append(x)
    return {x: min(g) for g in groups.values() for x in g}


def shapes():
    random.seed(3)
    yield "chain", [(i, i + 1) for i in range(300)]
    yield "star", [(0, i) for i in range(1, 400)] + [(1000, 1001)]
    yield "random", [(random.randrange(500), random.randrange(500)) for _ in range(350)]
    yield "dirty", [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None), (5, 6), (6, 7)]
    yield "none", [(1, 1), (None, None)]


@pytest.mark.parametrize("name,links", list(shapes()))
def test_components(spark, name, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["vertex"]: r["group"] for r in components.groups(df).collect()} == union_find(links)


def test_empty(spark):
    assert components.groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_verdicts(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [
        (1, 1, 2, "m", "merge", t(1), t(1)), (2, 2, 1, "m", "unrelated", t(2), t(2)),  # revised the other way round
        (3, 1, 3, "m", "unrelated", t(2), t(2)), (4, 1, 3, "b", "Merge ", t(1), t(1)),  # one field is enough
        (5, 4, 5, "m", "merge", None, t(9)), (6, 4, 5, "m", "sibling", t(1), t(1)),  # undated is oldest
        (7, 6, 7, "m", "merge", t(1), t(3)), (8, 6, 7, "m", "sibling", t(1), t(2)),  # a tie: loaded last
        (9, 8, 8, "m", "merge", t(1), t(1)), (10, None, 8, "m", "merge", t(1), t(1)), (11, 9, 10, "m", None, t(1), t(1)),
    ]
    df = spark.createDataFrame(rows, "pair_id long, left_id long, right_id long, field_name string, label string, decided_at timestamp, loaded_at timestamp")
    assert {tuple(r) for r in components.accepted(df).collect()} == {(1, 3), (6, 7)}


ROWS = [(1, "NCT00000001", "A"), (2, "nct-00000001 ", "b"), (3, None, " a "), (4, "NCT00000002", "unclear"), (5, "00000002.json", None), (6, "x", "B\t"), (7, None, "n/a"), (8, "", "-"), (9, "NCT00000009", "a  c"), (9, "NCT00000009", "a  c")]


def grouped(spark, rows):
    df = spark.createDataFrame(rows, "extraction_id long, nct_id string, target string")
    return splits.grouped(df, "extraction_id", {"trial": splits.trial_key(F.col("nct_id")), "target": splits.named(F.col("target"))}, ["target"])


def test_grouped(spark):
    got = sorted((r["extraction_id"], r["group_id"], r["group_rows"]) for r in grouped(spark, ROWS).collect())
    assert got == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 2), (5, 4, 2), (6, 1, 4), (7, 7, 1), (8, 8, 1), (9, 9, 2), (9, 9, 2)]
    assert grouped(spark, []).count() == 0
    assert splits.assign(grouped(spark, []), "extraction_id", "target").count() == 0


@pytest.mark.parametrize("bounds", [{}, {"group_rows": 7}, {"vectors": 38}, {"labels": 1}])
def test_splits_keep_groups_and_proportions(spark, bounds):
    random.seed(4)
    rows = [(i, f"NCT{random.randrange(900):08d}", None) for i in range(3000)]
    df = grouped(spark, rows).drop("target").withColumn("label", F.when(F.col("extraction_id") % 10 == 0, "rare").when(F.col("extraction_id") % 3 == 0, None).otherwise("usual"))
    out = splits.assign(df, "extraction_id", "label", **bounds).join(df.select("extraction_id", "label"), "extraction_id").collect()
    assert len(out) == 3000
    assert all(len({r["split"] for r in out if r["group_id"] == g}) == 1 for g in {r["group_id"] for r in out})
    for label in ("rare", None, "usual"):
        n = Counter(r["split"] for r in out if r["label"] == label)
        total, near = sum(n.values()), {"labels": 0.08, "vectors": 0.12}.get(next(iter(bounds), ""), 0.03)  # labels counted as one fall as they may, nine bundles a label are coarse
        assert n["train"] / total == pytest.approx(0.8, abs=near) and n["test"] / total == pytest.approx(0.1, abs=near)


def one_by_one(classes, shares):
    """Every component in turn: label with fewest rows outstanding, largest first, greatest need."""
    items = [(k, v) for k, (v, c) in enumerate(classes) for _ in range(c)]
    n = len(classes[0][0])
    outstanding = [sum(v[i] for _, v in items) for i in range(n)]
    need, out = [[s * t for t in outstanding] for s in shares], [[0] * len(shares) for _ in classes]
    while items:
        live = [i for i in range(n) if outstanding[i] > 0]
        if not live:
            for k, _ in items:
                out[k][0] += 1
            break
        label = min(live, key=lambda i: (outstanding[i], i))
        for k, v in sorted((x for x in items if x[1][label]), key=lambda x: (-sum(x[1]), x[1])):
            best = max(range(len(shares)), key=lambda s: (need[s][label], sum(need[s]), -s))
            out[k][best] += 1
            for i in range(n):
                need[best][i] -= v[i]
                outstanding[i] -= v[i]
        items = [x for x in items if not x[1][label]]
    return out


def test_classes_are_placed_as_their_components_would_be():
    random.seed(8)
    for _ in range(60):
        classes = list({tuple(random.choice([0, 0, 1, 2, 5]) for _ in range(3)): random.choice([1, 3, 40, 200]) for _ in range(random.randrange(1, 9))}.items())
        shares = [Fraction(8, 10), Fraction(1, 10), Fraction(1, 10)]
        assert splits.place(classes, shares) == one_by_one(classes, shares), classes


def test_place_prefers_the_greatest_need():
    classes = [((1, 9), 8), ((4, 0), 2)]
    for got in zip(*splits.place(classes, [0.5, 0.5])):
        assert sum(v[0] * n for (v, _), n in zip(classes, got)) == 8
    assert sum(map(sum, splits.place([((2, 1), 10**12)], [0.8, 0.1, 0.1]))) == 10**12
