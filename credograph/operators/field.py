"""Beliefs localised in vector space: evidence as anchors at pairs of vectors, queried by a kernel.

An anchor is evidence of an edge placed at a pair (s, t) of vectors, named by their ids. The
kernel's sum is additive over anchors, so leaving a trial out is exact and needs no replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credograph.operators.vectors import dot, unit

EDGE = ["src", "dst", "edge_type"]
BANDWIDTH, FALLBACK = 0.25, 2.0


def anchors(records: DataFrame, coordinates: DataFrame) -> DataFrame:
    """``src, dst, edge_type, trial, s, t, up, down``: each record's mass split evenly over its trial's distinct pairs on the edge.

    ``records`` has the edge, ``trial, up, down``; ``coordinates`` the edge, ``trial, s, t``. The
    split keeps an edge's sums what they are; records of trials without coordinates place nothing.
    """
    pairs = coordinates.select(*EDGE, "trial", "s", "t").where("s is not null and t is not null").distinct()
    n = pairs.groupBy(*EDGE, "trial").agg(F.count("*").alias("__k"))
    mass = records.groupBy(*EDGE, "trial").agg(F.sum("up").cast("double").alias("u"), F.sum("down").cast("double").alias("d"))
    x = mass.join(n, [*EDGE, "trial"]).join(pairs, [*EDGE, "trial"])
    return x.select(*EDGE, "trial", "s", "t", (F.col("u") / F.col("__k")).alias("up"), (F.col("d") / F.col("__k")).alias("down"))


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``a, b, cos`` of distinct pairs of vector ids; zero and unknown vectors have cosine 0."""
    u = vectors.select(F.col("vec_id").alias("i"), unit(F.col("embedding")).alias("u"))
    x = pairs.distinct().join(u.select(F.col("i").alias("a"), F.col("u").alias("ua")), "a", "left").join(u.select(F.col("i").alias("b"), F.col("u").alias("ub")), "b", "left")
    return x.select("a", "b", F.coalesce(dot(F.col("ua"), F.col("ub")), F.lit(0.0)).alias("cos"))


def fallback(alpha: Column, beta: Column, strength: float = FALLBACK) -> tuple[Column, Column]:
    """The prior of a query: ``strength`` at the edge's scalar mean."""
    p = F.when(alpha + beta > 0, alpha / (alpha + beta)).otherwise(0.5)
    return strength * p, strength * (1 - p)


def query(points: DataFrame, placed: DataFrame, vectors: DataFrame, marginal: DataFrame, bandwidth: float = BANDWIDTH) -> DataFrame:
    """``points`` with ``alpha, beta``: the kernel-weighted belief of their edge at (s, t).

    ``points`` has ``point`` (an id), the edge, ``s, t`` and, if a trial is to be left out,
    ``without``. An anchor at the point itself counts whole, others exp((cos s + cos t - 2) / h);
    ``marginal`` has the edges' scalar ``alpha, beta``, to which far queries fall back. Each
    distinct pair of vectors is compared once.
    """
    asked = points if "without" in points.columns else points.withColumn("without", F.lit(None).cast("string"))
    near = asked.select("point", *EDGE, "without", F.col("s").alias("s0"), F.col("t").alias("t0")).join(placed, EDGE).where(~F.coalesce(F.col("trial") == F.col("without"), F.lit(False)))
    cos = cosines(near.select(F.col("s0").alias("a"), F.col("s").alias("b")).unionByName(near.select(F.col("t0").alias("a"), F.col("t").alias("b"))), vectors)
    side = lambda at, by, name: cos.select(F.col("a").alias(at), F.col("b").alias(by), F.col("cos").alias(name))
    x = near.join(side("s0", "s", "cs"), ["s0", "s"]).join(side("t0", "t", "ct"), ["t0", "t"]).withColumn("w", F.exp((F.col("cs") + F.col("ct") - 2) / bandwidth))
    sums = x.groupBy("point").agg(F.sum(F.col("w") * F.col("up")).alias("ka"), F.sum(F.col("w") * F.col("down")).alias("kb"))
    a, b = fallback(F.coalesce("ma", F.lit(1.0)), F.coalesce("mb", F.lit(1.0)))
    scalar = marginal.select(*EDGE, F.col("alpha").alias("ma"), F.col("beta").alias("mb"))
    out = points.join(sums, "point", "left").join(scalar, EDGE, "left")
    return out.withColumns({"alpha": a + F.coalesce("ka", F.lit(0.0)), "beta": b + F.coalesce("kb", F.lit(0.0))}).drop("ka", "kb", "ma", "mb")


def chain_mean(p: Column) -> Column:
    """Aggregate: the geometric mean of local means along a chain."""
    return F.exp(F.avg(F.log(F.greatest(p, F.lit(1e-9)))))


def interned(rows: DataFrame, vector: str) -> DataFrame:
    """``key, vector``: each distinct vector at six decimals, once."""
    v = F.transform(vector, lambda x: F.round(x.cast("double"), 6))
    return rows.where(F.col(vector).isNotNull()).select(v.alias("vector")).distinct().select(F.xxhash64("vector").alias("key"), "vector")
