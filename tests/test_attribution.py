from __future__ import annotations

import random
from collections import defaultdict

import pytest

from credograph.operators import attribution as A
from credograph.operators import statistics as S


def one_by_one(rows):
    """Epochs in turn: successes first, then failures against what stands."""
    up, down, n = defaultdict(float), defaultdict(float), defaultdict(int)

    def add(edge, w, p):
        up[edge] += round(w * p, 6)
        down[edge] += round(w * (1 - p), 6)
        n[edge] += 1

    for epoch in sorted({r["epoch"] for r in rows}):
        now = [r for r in rows if r["epoch"] == epoch]
        for r in now:
            if r["outcome"] == "success":
                add(r["edge"], r["w"], 0.8)
        mean = {e: (1 + up[e]) / (2 + up[e] + down[e]) for e in up}
        chains = defaultdict(list)
        for r in now:
            if r["outcome"] in ("failure", "partial"):
                chains[r["chain_id"]].append((r, mean.get(r["edge"], 0.5)))
        for held in chains.values():
            lack, product = sum(1 - b for _, b in held), 1.0
            for _, b in held:
                product *= b
            for r, b in held:
                if r["branch"] == "unknown":
                    add(r["edge"], r["w"] * ((1 - b) / lack if lack > 0 else 1 / len(held)), 0.2 if r["outcome"] == "failure" else 0.35)
                elif r["branch"] in ("efficacy", "measurement") and 1 - product >= 1e-6:
                    add(r["edge"], r["w"], min(max((b - product) / (1 - product), 0.0), 1.0))
    return {e: (1 + up[e], 1 + down[e], n[e]) for e in n}


def test_epochs(spark):
    r = random.Random(2)
    rows = []
    for c in range(60):
        epoch, outcome, branch, w = r.randrange(4), r.choice(["success", "failure", "partial", "unknown"]), r.choice(["unknown", "efficacy", "safety", "operational", "measurement"]), r.choice([0.2, 2.0, 6.0])
        rows += [{"chain_id": c, "edge": (f"s{r.randrange(3)}", f"t{k}", "x"), "outcome": outcome, "branch": branch, "w": w, "epoch": epoch} for k in range(3)]
    df = spark.createDataFrame([(x["chain_id"], *x["edge"], x["outcome"], x["branch"], x["w"], x["epoch"]) for x in rows], "chain_id long, src string, dst string, edge_type string, outcome string, branch string, w double, epoch int")
    want = one_by_one(rows)
    got = {(x["src"], x["dst"], x["edge_type"]): (x["alpha"], x["beta"], x["n_records"]) for x in A.attribute_epochs(df).collect()}
    assert got.keys() == want.keys()
    for e, (a, b, n) in want.items():
        assert got[e] == (pytest.approx(a, abs=1e-4), pytest.approx(b, abs=1e-4), n)
    assert A.attribute_epochs(df.limit(0)).count() == 0


def test_branches(spark):
    modes = {"no_target_engagement": "efficacy", "wrong_timeframe": "measurement", "dose_limiting_toxicity": "safety", "underpowered": "operational", "multiple_factors": "unknown", "wrong_target": "unknown", None: "unknown"}
    df = spark.createDataFrame([(m,) for m in modes], "mode string")
    assert {r["mode"]: r["b"] for r in df.select("mode", A.branch_of(df["mode"]).alias("b")).collect()} == modes
    assert df.where("mode = 'wrong_target'").select(A.branch_of(df["mode"], {"wrong_target": "efficacy"}).alias("b")).first()["b"] == "efficacy"


def test_stop_reasons(spark):
    df = spark.createDataFrame([("TERMINATED", "slow accrual"), ("terminated", "Futility and slow accrual"), ("COMPLETED", "slow accrual"), ("WITHDRAWN", "unacceptable toxicity"), ("SUSPENDED", None), (None, "funding")], "s string, r string")
    assert [x["o"] for x in df.select(A.stop_override(df["s"], df["r"]).alias("o")).collect()] == ["operational", None, None, "safety", None, None]


def test_arms(spark):
    arms = spark.createDataFrame([("t", 1, ["a"], 0), ("t", 2, ["a", "b"], 2), ("t", 3, ["c"], 1), ("u", 4, ["a", "b", "c"], 2)], "trial_id string, arm_id int, compounds array<string>, grade int")
    assert [(r["trial_id"], r["base_arm"], r["combo_arm"], r["added"], r["bucket"]) for r in A.subset_pairs(arms).collect()] == [("t", 1, 2, "b", "strong_support")]


def test_delong(spark):
    r = random.Random(3)
    rows = [(y, y + r.gauss(0, 0.8), y + r.gauss(0, 3.0)) for y in (r.randrange(2) for _ in range(300))]
    scaled = [(float(y), min(max((a + 6) / 14, 0.0), 1.0), min(max((b + 12) / 26, 0.0), 1.0)) for y, a, b in rows]
    df = spark.createDataFrame(scaled, "y double, p double, q double")
    x = S.delong_test(df, "p", "q", "y").first()
    assert x["auc_a"] > x["auc_b"] and x["p_value"] < 0.001 and 0 < x["low"] < x["auc_a"] - x["auc_b"] < x["high"]
    same = S.delong_test(df, "p", "p", "y").first()
    assert same["z"] is None and same["p_value"] is None and same["low"] is None
