"""Calibration, discrimination and paired tests over scored labels, as aggregates and windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credograph.session import cut


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed: count, mean score, observed rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))


def score_levels(df: DataFrame, p: str, y: str) -> DataFrame:
    """Distinct scores with their positives and negatives: all that rank statistics need."""
    return df.groupBy(F.col(p).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def running(levels: DataFrame, descending: bool = False, parts: int = 1024) -> DataFrame:
    """Positives and negatives on smaller scores (or larger ones), without a window over all rows.

    Scores fall into ``parts`` ranges; ranges are summed up first, then each on its own.
    """
    part = F.least(F.floor(F.col("s") * parts), F.lit(parts - 1)).cast("int")
    x = levels.withColumn("part", -part if descending else part)
    order = F.desc("s") if descending else F.asc("s")
    w = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("part").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    totals = totals.select("part", F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("bn"))
    x = x.withColumns({"rp": F.coalesce(F.sum("pos").over(w), F.lit(0)), "rn": F.coalesce(F.sum("neg").over(w), F.lit(0))})
    return x.join(F.broadcast(totals), "part").select("s", "pos", "neg", (F.col("rp") + F.col("bp")).alias("pos_before"), (F.col("rn") + F.col("bn")).alias("neg_before"))


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row aggregate, computed in the same plan."""
    return df.join(F.broadcast(totals), F.lit(True))


def auroc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Probability that a positive scores above a negative, ties as half; null without both kinds."""
    x = running(score_levels(df, p, y))
    return x.agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).select(F.round(F.expr("try_divide(u, n_pos * n_neg)"), 6).alias("auroc"), F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def pr_auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Average precision; equal scores count as one step."""
    x = running(score_levels(df, p, y), descending=True)
    tp, n = F.col("pos_before") + F.col("pos"), F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg")
    return x.agg(F.sum(F.col("pos") * tp / n).alias("a"), F.sum("pos").alias("n")).select(F.round(F.expr("try_divide(a, n)"), 6).alias("pr_auc"))


def delong(df: DataFrame, p1: str, p2: str, y: str) -> DataFrame:
    """AUROC of two scores on the same rows and the z of their difference, from structural components."""
    def placements(p: str, name: str) -> DataFrame:
        r = running(score_levels(df, p, y))
        r = with_totals(r, df.agg(F.sum(y).alias("P"), F.sum(1 - F.col(y)).alias("N")))
        return r.select(F.col("s").alias(f"s_{name}"), ((F.col("neg_before") + F.col("neg") / 2) / F.col("N")).alias(f"v_{name}"), ((F.col("P") - F.col("pos_before") - F.col("pos") / 2) / F.col("P")).alias(f"w_{name}"))

    x = df.join(placements(p1, "a"), F.col(p1) == F.col("s_a")).join(placements(p2, "b"), F.col(p2) == F.col("s_b"))
    pos, neg = F.col(y) == 1, F.col(y) == 0
    m = x.agg(
        F.avg(F.when(pos, F.col("v_a"))).alias("auc_a"), F.avg(F.when(pos, F.col("v_b"))).alias("auc_b"),
        F.var_samp(F.when(pos, F.col("v_a") - F.col("v_b"))).alias("s10"), F.var_samp(F.when(neg, F.col("w_a") - F.col("w_b"))).alias("s01"),
        F.sum(y).alias("m"), F.sum(1 - F.col(y)).alias("n"),
    )
    var = F.col("s10") / F.col("m") + F.col("s01") / F.col("n")
    return m.select(F.round("auc_a", 6).alias("auc_a"), F.round("auc_b", 6).alias("auc_b"), F.when(var > 0, F.round((F.col("auc_a") - F.col("auc_b")) / F.sqrt(var), 4)).alias("z"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal deviate; null for null."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def delong_test(df: DataFrame, p1: str, p2: str, y: str) -> DataFrame:
    """``delong`` with the difference's p and its 95 % interval; null where the variance is nothing."""
    d = F.col("auc_a") - F.col("auc_b")
    half = F.abs(d / F.col("z")) * 1.959964
    x = delong(df, p1, p2, y).withColumn("p_value", F.round(two_sided_p("z"), 6))
    return x.withColumns({"low": F.when(F.col("z") != 0, F.round(d - half, 6)), "high": F.when(F.col("z") != 0, F.round(d + half, 6))})


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided p of b against c discordant pairs."""
    def one(x: int, y: int) -> float:
        n, k = x + y, min(x, y)
        if not n:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    return pd.Series([one(int(x), int(y)) for x, y in zip(b, c)])


def fold(key: Column, k: int) -> Column:
    """md5 of the key modulo k, over its hexadecimal digits."""
    return F.aggregate(F.split(F.md5(key), ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1) % k)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def credible_interval(alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
    """Central 95 % interval of Beta beliefs: bisection on a continued fraction, all rows at once."""
    import numpy as np

    a, b = alpha.to_numpy(float), beta.to_numpy(float)
    lgamma = np.vectorize(math.lgamma)
    front = lgamma(a + b) - lgamma(a) - lgamma(b)

    def cdf(x: np.ndarray) -> np.ndarray:
        turn = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-30, 1e-30, d)
        h = d.copy()
        for m in range(1, 200):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < 1e-30, 1e-30, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < 1e-30, 1e-30, c)
                h = h * c * d
        with np.errstate(divide="ignore"):
            v = np.exp(front + p * np.log(z) + q * np.log1p(-z)) * h / p
        v = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, v))
        return np.where(turn, 1 - v, v)

    def quantile(t: float) -> np.ndarray:
        lo, hi = np.zeros_like(a), np.ones_like(a)
        for _ in range(50):
            mid = (lo + hi) / 2
            below = cdf(mid) < t
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return (lo + hi) / 2

    return pd.DataFrame({"low": quantile(0.025), "high": quantile(0.975)})


def isotonic(df: DataFrame, p: str, y: str) -> DataFrame:
    """Recalibrated score by monotone regression."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    x = VectorAssembler(inputCols=[p], outputCol="__f", handleInvalid="skip").transform(df)
    return IsotonicRegression(featuresCol="__f", labelCol=y, predictionCol="calibrated").fit(x).transform(x).drop("__f")


def platt(df: DataFrame, p: str, y: str, fold_column: str, k: int) -> DataFrame:
    """Recalibrated score by a logistic fit on the other folds."""
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = cut(VectorAssembler(inputCols=[p], outputCol="__f", handleInvalid="skip").transform(df))
    parts = []
    for i in range(k):
        model = LogisticRegression(featuresCol="__f", labelCol=y, probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r").fit(x.where(F.col(fold_column) != i))
        parts.append(model.transform(x.where(F.col(fold_column) == i)).withColumn("calibrated", vector_to_array("__p")[1]).drop("__f", "__p", "__c", "__r"))
    return reduce(DataFrame.unionByName, parts)
