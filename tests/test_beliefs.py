"""Laws of the belief algebra, and published vectors."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from credograph.functions import belief as B


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def softmin(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "p double").agg(B.softmin(F.col("p"))).first()[0]


def test_softmin(spark):
    assert softmin(spark, [0.9, 0.5]) == pytest.approx(0.5674997252642137)
    assert softmin(spark, [0.9, 0.9, 0.2]) == pytest.approx(0.30967901857751845)
    for ps in ([0.1, 0.2, 0.9], [0.5], [0.0, 1.0]):
        assert min(ps) - 1e-9 <= softmin(spark, ps) <= sum(ps) / len(ps) + 1e-9


def test_pooling(spark):
    lit = lambda a, b: (F.lit(a).cast("double"), F.lit(b).cast("double"))
    assert one(spark, *B.pooled([lit(60, 40), lit(3, 1)])) == pytest.approx((14, 8))
    assert one(spark, *B.pooled([lit(3, 1)])) == (3, 1)
    assert one(spark, *B.pooled([lit(None, None), lit(3, 1)])) == (3, 1)
    assert one(spark, *B.pooled([lit(None, None)])) == (1, 1)


def test_precision_and_trust(spark):
    got = one(spark, *[B.precision(F.lit(n)) for n in (50, 350, 1400, 5000, 0)], B.precision(F.lit(None).cast("long")))
    assert got == pytest.approx((0.5, 1.0, 2.0, 2.5, 1.0, 1.0))
    assert one(spark, *[B.trust(F.lit(float(s))) for s in (0, 1, 10, 49, 500)]) == pytest.approx((0, 0.1771838206, 0.6129553097, 1, 1))


def test_buckets(spark):
    names = list(B.P_OBS)
    twice = one(spark, *[B.flipped(B.flipped(F.lit(n))) for n in names])
    assert list(twice) == names
    assert one(spark, B.flipped(F.lit("weak_support")), B.flipped(F.lit("ambiguous"))) == ("weak_contradict", "ambiguous")
    assert one(spark, B.modulation_bucket(F.lit("amplifies"), F.lit(0.7)), B.modulation_bucket(F.lit("suppresses"), F.lit(0.9)), B.modulation_bucket(F.lit("neutral"), F.lit(0.9)), B.modulation_bucket(F.lit("amplifies"), F.lit(0.2))) == ("moderate_support", "strong_contradict", "ambiguous", "ambiguous")


def test_cap_keeps_the_mean(spark):
    a, b = one(spark, B.capped(F.lit(60.0), F.lit(60.0), F.lit(40.0)), B.capped(F.lit(40.0), F.lit(60.0), F.lit(40.0)))
    assert (a + b, a / (a + b)) == pytest.approx((20, 0.6))


def test_responsibility(spark):
    from credograph.operators.attribution import explain_away, responsibility

    rows = [("c", e, r, "failure", b, 1.0, e) for b in ("efficacy", "unknown") for e, r in (("x", 0.9), ("y", 0.6), ("z", 0.5))]
    df = spark.createDataFrame([(f"{c}{b}", e, r, o, b, w, s) for c, e, r, o, b, w, s in rows], "chain_id string, edge_type string, r double, outcome string, branch string, w double, src string")
    got = {r["edge_type"]: r["p"] for r in responsibility(df).collect()}
    assert [got[k] for k in "xyz"] == pytest.approx([0.8630136986, 0.4520547945, 0.3150684932])
    got = {r["edge_type"]: r["share"] for r in explain_away(df).collect()}
    assert [got[k] for k in "xyz"] == pytest.approx([0.1, 0.4, 0.5])


def test_interval(spark):
    from credograph.operators.statistics import credible_interval

    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (30.0, 10.0), (10.0, 30.0)], "a double, b double").withColumn("ci", credible_interval("a", "b"))
    got = {(r["a"], r["b"]): r["ci"] for r in df.collect()}
    assert tuple(got[1.0, 1.0]) == pytest.approx((0.025, 0.975), abs=1e-6)
    assert tuple(got[2.0, 1.0]) == pytest.approx((math.sqrt(0.025), math.sqrt(0.975)), abs=1e-6)
    assert got[30.0, 10.0]["low"] == pytest.approx(1 - got[10.0, 30.0]["high"], abs=1e-6)
