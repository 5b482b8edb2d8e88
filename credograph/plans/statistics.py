"""Queries of evaluation: scores are predicted chain probabilities, labels the chains' outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.operators import statistics as S
from credograph.plans.attribution import labels
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, chains, evidence_log
from credograph.plans.graph import AT_SQL, chain_prediction, group_rate_baseline
from credograph.session import cut

FOLDS = 5


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = labels(spark, sf_dir).where("label in ('success', 'failure')").select("chain_id", F.when(F.col("label") == "success", 1.0).otherwise(0.0).alias("y"))
    return chain_prediction(spark, sf_dir).select("chain_id", F.col("efficacy").alias("p")).join(y, "chain_id")


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"), F.count("*").alias("n"))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reliability(_scored(spark, sf_dir), "p", "y")


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.reliability(_scored(spark, sf_dir), "p", "y").withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))
    return r.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.auroc(_scored(spark, sf_dir), "p", "y")


def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pr_auc(_scored(spark, sf_dir), "p", "y")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("hit", F.col("p") >= 0.5)
    return x.groupBy("hit", F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n"))


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = group_rate_baseline(spark, sf_dir).groupBy("chain_id").agg(F.round(F.avg("rate"), 6).alias("q"))
    return cut(_scored(spark, sf_dir).join(base, "chain_id"))


def delong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.delong(_two(spark, sf_dir), "p", "q", "y")


def delong_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.delong_test(_two(spark, sf_dir), "p", "q", "y")


def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = lambda c: (F.col(c) >= 0.5) == (F.col("y") == 1)
    x = _two(spark, sf_dir).agg(F.count_if(right("p") & ~right("q")).alias("b"), F.count_if(~right("p") & right("q")).alias("c"))
    return x.withColumn("p_value", F.round(S.mcnemar_p("b", "c"), 6))


def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains(spark, sf_dir).select("trial_id").distinct().withColumn("fold", S.fold(F.col("trial_id"), FOLDS))


def kfold_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs of each edge as each fold's predictions would see them: all evidence but the fold's own, in one pass."""
    log = evidence_log(spark, sf_dir).withColumn("fold", S.fold(F.coalesce("source_id", F.lit("")), FOLDS))
    key = ["src", "dst", "edge_type"]
    sums = [F.sum(F.when(F.col("fold") != i, F.col(c)).otherwise(0)).cast("double").alias(f"{c}{i}") for i in range(FOLDS) for c in ("up", "down")]
    rows = [F.struct(F.lit(i).cast("long").alias("fold"), (1 + F.col(f"up{i}")).alias("alpha"), (1 + F.col(f"down{i}")).alias("beta")) for i in range(FOLDS)]
    return log.groupBy(*key).agg(*sums).select(*key, F.inline(F.array(*rows)))


def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = chain_prediction(spark, sf_dir).join(labels(spark, sf_dir), "chain_id").where("label is not null")
    return x.groupBy("label").agg(F.round(F.avg("efficacy"), 6).alias("mean_p"), F.count("*").alias("n"))


def credible_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beliefs(evidence_log(spark, sf_dir))
    ci = S.credible_interval("alpha", "beta")
    return b.withColumn("ci", ci).select("src", "dst", "edge_type", "ci.low", "ci.high")


def isotonic_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.isotonic(_scored(spark, sf_dir), "p", "y")


def platt_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("fold", S.fold(F.col("chain_id").cast("string"), FOLDS))
    return S.platt(x, "p", "y", "fold", FOLDS).select("chain_id", "p", "y", "calibrated")


QUERIES = {f.__name__: f for f in (brier, reliability, calibration_error, auroc, pr_auc, confusion, delong, delong_test, mcnemar, kfold_assign, kfold_holdout, calibration_bands, credible_intervals, isotonic_recalibration, platt_recalibration)}

_LB = """, lb0 AS (SELECT *, CASE WHEN mode IN ('insufficient_information', 'dose_limiting_toxicity', 'commercial_not_scientific', 'underpowered') THEN 'ambiguous' ELSE 'failure' END AS bad FROM ch
), lb AS (SELECT chain_id, CASE WHEN met THEN 'success' WHEN NOT met THEN bad WHEN trial_outcome = 'success' THEN 'success' WHEN trial_outcome = 'failure' THEN bad WHEN trial_outcome = 'partial' THEN 'ambiguous' END AS label FROM lb0)"""
_SC = f"WITH {AT_SQL}{_LB}, sc AS (SELECT chain_id, efficacy AS p, CASE label WHEN 'success' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM cp JOIN lb USING (chain_id) WHERE label IN ('success', 'failure'))"
_REL = ", rl AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM sc GROUP BY 1)"
_MD5 = "list_reduce(list_transform(string_split(md5({}), ''), lambda d: (instr('0123456789abcdef', d) - 1)::BIGINT), lambda acc, d: (acc * 16 + d) % {})"
_GR = ", gy AS (SELECT chain_id, indication, CASE outcome WHEN 'success' THEN 1.0::DOUBLE ELSE 0 END AS gy FROM ci WHERE outcome IN ('success', 'failure')), gr0 AS (SELECT chain_id, round((sum(gy) OVER w - gy + 1.0) / (count(*) OVER w - 1 + 2.0), 6) AS r FROM gy WINDOW w AS (PARTITION BY indication)), gr AS (SELECT chain_id, round(avg(r), 6) AS q FROM gr0 GROUP BY 1), tw AS (SELECT sc.*, q FROM sc JOIN gr USING (chain_id))"
_AUC = "(SELECT sum(CASE WHEN a.{0} > b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END) / count(*) FROM tw a, tw b WHERE a.y = 1 AND b.y = 0)"
SQL = {
    "brier": f"{_SC} SELECT round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM sc",
    "reliability": f"{_SC}{_REL} SELECT * FROM rl",
    "calibration_error": f"{_SC}{_REL} SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece, round(max(abs(mean_p - rate)), 6) AS mce FROM rl",
    "auroc": f"{_SC} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auroc, count(DISTINCT a.chain_id) AS n_pos, count(DISTINCT b.chain_id) AS n_neg FROM sc a, sc b WHERE a.y = 1 AND b.y = 0",
    "pr_auc": f"{_SC}, l AS (SELECT p, sum(y) AS pos, count(*) AS n FROM sc GROUP BY 1), r AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM l WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos * tp / n) / sum(pos), 6) AS pr_auc FROM r",
    "confusion": f"{_SC} SELECT p >= 0.5 AS hit, y::INTEGER AS y, count(*) AS n FROM sc GROUP BY 1, 2",
    "delong": f"{_SC}{_GR}, va AS (SELECT a.chain_id, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) AS v1, avg(CASE WHEN a.q > b.q THEN 1.0::DOUBLE WHEN a.q = b.q THEN 0.5::DOUBLE ELSE 0 END) AS v2 FROM tw a, tw b WHERE a.y = 1 AND b.y = 0 GROUP BY 1), wa AS (SELECT b.chain_id, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) AS w1, avg(CASE WHEN a.q > b.q THEN 1.0::DOUBLE WHEN a.q = b.q THEN 0.5::DOUBLE ELSE 0 END) AS w2 FROM tw a, tw b WHERE a.y = 1 AND b.y = 0 GROUP BY 1), st AS (SELECT (SELECT avg(v1) FROM va) AS a1, (SELECT avg(v2) FROM va) AS a2, (SELECT var_samp(v1 - v2) / count(*) FROM va) + (SELECT var_samp(w1 - w2) / count(*) FROM wa) AS var) SELECT round(a1, 6) AS auc_a, round(a2, 6) AS auc_b, CASE WHEN var > 0 THEN round((a1 - a2) / sqrt(var), 4) END AS z FROM st",
    "mcnemar": f"{_SC}{_GR}, m AS (SELECT count(*) FILTER (WHERE (p >= 0.5) = (y = 1) AND (q >= 0.5) <> (y = 1)) AS b, count(*) FILTER (WHERE (p >= 0.5) <> (y = 1) AND (q >= 0.5) = (y = 1)) AS c FROM tw) SELECT b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE (SELECT round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))), 6) FROM (SELECT unnest(range(least(b, c) + 1)) AS i)) END AS p_value FROM m",
    "kfold_assign": f"WITH {CH_SQL} SELECT DISTINCT trial_id, {_MD5.format('trial_id', FOLDS)} AS fold FROM ch",
    "kfold_holdout": f"WITH {EV_SQL}, f AS (SELECT *, {_MD5.format(chr(99) + 'oalesce(source_id, ' + chr(39) * 2 + ')', FOLDS)} AS own FROM ev), k AS (SELECT unnest(range({FOLDS})) AS fold) SELECT src, dst, edge_type, fold, 1 + coalesce(sum(up) FILTER (WHERE own <> fold), 0)::DOUBLE AS alpha, 1 + coalesce(sum(down) FILTER (WHERE own <> fold), 0)::DOUBLE AS beta FROM f, k GROUP BY 1, 2, 3, 4",
    "calibration_bands": f"WITH {AT_SQL}{_LB} SELECT label, round(avg(efficacy), 6) AS mean_p, count(*) AS n FROM cp JOIN lb USING (chain_id) WHERE label IS NOT NULL GROUP BY 1",
}
