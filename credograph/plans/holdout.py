"""Honest hold-outs: beliefs attributed anew without a fold's trials, then predictions of that fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.operators import attribution as A
from credograph.operators import graph as G
from credograph.operators import statistics as S
from credograph.plans.attribution import RT_SQL, _routed, labels
from credograph.plans.base import by_indication, chains, unpivot
from credograph.session import cut

KEY, FOLDS = ["src", "dst", "edge_type"], 5


def _sums(updates: DataFrame, *by: str) -> DataFrame:
    x = updates.withColumns({"up": B.exact(F.col("n") * F.col("p")), "down": B.exact(F.col("n") * (1 - F.col("p")))})
    return x.groupBy(*KEY, *by).agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def kfold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain's chance from beliefs attributed without the trials of its fold, all folds in one pass.

    Successes are additive: an edge's sums without a fold are its sums less the fold's own. The
    failures of all other folds are then attributed against those, once for each fold they train.
    """
    e = cut(unpivot(_routed(spark, sf_dir), "chain_id", "trial_id", "outcome", "branch", "w").withColumn("own", S.fold(F.col("trial_id"), FOLDS)))
    done = e.where("outcome = 'success'").select(*KEY, "own", F.col("w").alias("n"), F.lit(A.P_OUTCOME["success"]).alias("p"))
    trained = F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda f: f != F.col("own"))).alias("fold")
    good = _sums(done.select(*KEY, "n", "p", trained), "fold")
    b = good.select(*KEY, "fold", ((1 + F.col("up").cast("double")) / (2 + (F.col("up") + F.col("down")).cast("double"))).alias("b"))
    bad = e.where("outcome <> 'success'").select("*", trained).join(b, [*KEY, "fold"], "left").withColumn("r", F.coalesce("b", F.lit(0.5)))
    bad = cut(bad)
    keys = ("chain_id", "fold")
    blame = A.explain_away(bad, keys).select(*KEY, "fold", (F.col("w") * F.col("share")).alias("n"), "p")
    own = A.responsibility(bad, keys).select(*KEY, "fold", F.col("w").alias("n"), "p")
    sums = good.unionByName(_sums(blame.unionByName(own), "fold")).groupBy(*KEY, "fold").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    beliefs = sums.select(*KEY, F.col("fold").alias("own"), (1 + F.col("up").cast("double")).alias("alpha"), (1 + F.col("down").cast("double")).alias("beta"))
    p = G.chain_probabilities(e.select("chain_id", *KEY, "own").join(beliefs, [*KEY, "own"]))
    return p.join(e.select("chain_id", F.col("own").alias("fold")).distinct(), "chain_id").select("chain_id", "fold", "efficacy", "bottleneck_edge", "n_edges")


def holdout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well held-out chances tell successes from failures: AUROC and Brier score."""
    y = labels(spark, sf_dir).where("label in ('success', 'failure')").select("chain_id", F.when(F.col("label") == "success", 1.0).otherwise(0.0).alias("y"))
    x = cut(kfold_predictions(spark, sf_dir).select("chain_id", F.col("efficacy").alias("p")).join(y, "chain_id"))
    return S.with_totals(S.auroc(x, "p", "y"), x.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier")))


def transfer_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's belief as an indication that it is used for would inherit it: successes of chains without that indication.

    A chain of several indications is left out for each of them; sums of one indication are
    taken off the edge's own, so no pair of indications meets.
    """
    c = chains(spark, sf_dir)
    e = unpivot(c, "chain_id", "indications", "outcome", "w").select(*KEY, "chain_id", "indications", F.when(F.col("outcome") == "success", B.exact(F.col("w") * 0.8)).otherwise(F.lit(0).cast("decimal(18,6)")).alias("up"), F.when(F.col("outcome") == "success", B.exact(F.col("w") * 0.2)).otherwise(F.lit(0).cast("decimal(18,6)")).alias("down"))
    e = e.groupBy(*KEY, "chain_id").agg(F.first("indications").alias("indications"), F.first("up").alias("up"), F.first("down").alias("down"))
    whole = e.groupBy(*KEY).agg(F.sum("up").alias("u"), F.sum("down").alias("d"), F.count("*").alias("n"))
    own = by_indication(e).groupBy(*KEY, "indication").agg(F.sum("up").alias("ou"), F.sum("down").alias("od"), F.count("*").alias("on"))
    x = own.join(whole, KEY).where("n > on")
    return x.select(*KEY, "indication", (1 + (F.col("u") - F.col("ou")).cast("double")).alias("alpha"), (1 + (F.col("d") - F.col("od")).cast("double")).alias("beta"), (F.col("n") - F.col("on")).alias("chains"))


def baseline_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate of the other chains of the same biology and phase, else of the biology, else of the phase, else of all."""
    c = chains(spark, sf_dir).where("outcome in ('success', 'failure')").select("chain_id", "biology", "phase", F.when(F.col("outcome") == "success", 1).otherwise(0).alias("y"))
    x = c
    for i, cols in enumerate((["biology", "phase"], ["biology"], ["phase"])):
        sums = c.where(" and ".join(f"{k} is not null" for k in cols)).groupBy(*cols).agg(F.sum("y").alias(f"s{i}"), F.count("*").alias(f"n{i}"))
        x = x.join(sums, cols, "left")
    x = S.with_totals(x, c.agg(F.sum("y").alias("s3"), F.count("*").alias("n3")))
    rung = lambda i: F.when(F.col(f"n{i}") >= 3, F.struct(F.lit(i).alias("rung"), F.round((F.col(f"s{i}") - F.col("y")) / (F.col(f"n{i}") - 1), 6).alias("rate")))
    return x.select("chain_id", F.coalesce(*map(rung, range(4))).alias("r")).select("chain_id", "r.rung", "r.rate")


QUERIES = {f.__name__: f for f in (kfold_predictions, holdout_scores, transfer_beliefs, baseline_ladder)}

_FOLD = "list_reduce(list_transform(string_split(md5(trial_id), ''), lambda d: (instr('0123456789abcdef', d) - 1)::BIGINT), lambda acc, d: (acc * 16 + d) % 5)"
_K = f"""WITH {RT_SQL}, ow AS (SELECT *, {_FOLD} AS own FROM re), tf AS (SELECT ow.*, fold FROM ow, (SELECT unnest(range(5)) AS fold) WHERE fold <> own
), s1 AS (SELECT src, dst, edge_type, fold, w AS n, 0.8::DOUBLE AS p FROM tf WHERE outcome = 'success'
), s2 AS (SELECT src, dst, edge_type, fold, 1 + sum(round(n * p, 6)::DECIMAL(18,6))::DOUBLE AS a, 1 + sum(round(n * (1 - p), 6)::DECIMAL(18,6))::DOUBLE AS b FROM s1 GROUP BY ALL
), t1 AS (SELECT tf.*, coalesce(a / (a + b), 0.5) AS r FROM tf LEFT JOIN s2 USING (src, dst, edge_type, fold) WHERE outcome <> 'success'
), x1 AS (SELECT *, CASE WHEN sum(1 - r) OVER c > 0 THEN (1 - r) / sum(1 - r) OVER c ELSE 1.0 / count(*) OVER c END AS share, CASE outcome WHEN 'failure' THEN 0.2 ELSE 0.35 END::DOUBLE AS p FROM t1 WHERE branch = 'unknown' AND outcome IN ('failure', 'partial') WINDOW c AS (PARTITION BY chain_id, fold)
), r0 AS (SELECT *, exp(sum(ln(greatest(r, 1e-12))) OVER (PARTITION BY chain_id, fold)) AS m FROM t1 WHERE branch IN ('efficacy', 'measurement') AND outcome IN ('failure', 'partial')
), r1 AS (SELECT *, least(greatest((r - m) / (1 - m), 0.0), 1.0) AS p FROM r0 WHERE 1 - m >= 1e-6
), al AS (SELECT * FROM s1 UNION ALL SELECT src, dst, edge_type, fold, w * share, p FROM x1 UNION ALL SELECT src, dst, edge_type, fold, w, p FROM r1
), fb AS (SELECT src, dst, edge_type, fold, 1 + sum(round(n * p, 6)::DECIMAL(18,6))::DOUBLE AS alpha, 1 + sum(round(n * (1 - p), 6)::DECIMAL(18,6))::DOUBLE AS beta FROM al GROUP BY ALL
), fc AS (SELECT chain_id, own AS fold, ow.edge_type, alpha / (alpha + beta) AS p, round((1 - alpha / (alpha + beta)) * least(1.0, ln(greatest(alpha + beta - 2, 0) + 1) / ln(50)), 6) AS weak FROM ow JOIN fb ON ow.src = fb.src AND ow.dst = fb.dst AND ow.edge_type = fb.edge_type AND ow.own = fb.fold WHERE alpha + beta > 2
), fr AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY weak DESC, round(p, 6), edge_type) AS k FROM fc
), fp AS (SELECT chain_id, any_value(fold) AS fold, round(-0.1 * ln(avg(exp(-greatest(p, 1e-12) / 0.1))), 6) AS efficacy, max(CASE WHEN k = 1 THEN edge_type END) AS bottleneck_edge, count(*) AS n_edges FROM fr GROUP BY 1)"""
_LABEL = "CASE WHEN met THEN 1 WHEN NOT met THEN CASE WHEN mode IN ('insufficient_information', 'dose_limiting_toxicity', 'commercial_not_scientific', 'underpowered') THEN NULL ELSE 0 END WHEN trial_outcome = 'success' THEN 1 WHEN trial_outcome = 'failure' AND coalesce(mode NOT IN ('insufficient_information', 'dose_limiting_toxicity', 'commercial_not_scientific', 'underpowered'), true) THEN 0 END"
SQL = {
    "kfold_predictions": f"{_K} SELECT * FROM fp",
    "holdout_scores": f"{_K}, sc AS (SELECT chain_id, efficacy AS p, {_LABEL} AS y FROM fp JOIN ch USING (chain_id)), u AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS auroc FROM sc a, sc b WHERE a.y = 1 AND b.y = 0) SELECT (SELECT round(auroc, 6) FROM u) AS auroc, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, round(avg(pow(p - y, 2)) FILTER (WHERE y IS NOT NULL), 6) AS brier FROM sc",
    "transfer_beliefs": f"WITH {RT_SQL}, d AS (SELECT DISTINCT src, dst, edge_type, chain_id, inds, CASE WHEN outcome = 'success' THEN round(w * 0.8, 6) ELSE 0 END::DECIMAL(18,6) AS up, CASE WHEN outcome = 'success' THEN round(w * 0.2, 6) ELSE 0 END::DECIMAL(18,6) AS down FROM ce), i AS (SELECT DISTINCT src, dst, edge_type, unnest(inds) AS indication FROM d) SELECT i.src, i.dst, i.edge_type, i.indication, 1 + sum(up)::DOUBLE AS alpha, 1 + sum(down)::DOUBLE AS beta, count(*) AS chains FROM i JOIN d ON i.src = d.src AND i.dst = d.dst AND i.edge_type = d.edge_type AND NOT coalesce(list_contains(d.inds, i.indication), false) GROUP BY ALL",
    "baseline_ladder": f"WITH {RT_SQL}, c AS (SELECT chain_id, biology, phase, CASE outcome WHEN 'success' THEN 1 ELSE 0 END AS y FROM ch WHERE outcome IN ('success', 'failure')), w AS (SELECT *, CASE WHEN biology IS NOT NULL AND phase IS NOT NULL THEN count(*) OVER a END AS n0, sum(y) OVER a AS s0, CASE WHEN biology IS NOT NULL THEN count(*) OVER b END AS n1, sum(y) OVER b AS s1, CASE WHEN phase IS NOT NULL THEN count(*) OVER p END AS n2, sum(y) OVER p AS s2, count(*) OVER () AS n3, sum(y) OVER () AS s3 FROM c WINDOW a AS (PARTITION BY biology, phase), b AS (PARTITION BY biology), p AS (PARTITION BY phase)) SELECT chain_id, CASE WHEN n0 >= 3 THEN 0 WHEN n1 >= 3 THEN 1 WHEN n2 >= 3 THEN 2 WHEN n3 >= 3 THEN 3 END AS rung, round(CASE WHEN n0 >= 3 THEN (s0 - y)::DOUBLE / (n0 - 1) WHEN n1 >= 3 THEN (s1 - y)::DOUBLE / (n1 - 1) WHEN n2 >= 3 THEN (s2 - y)::DOUBLE / (n2 - 1) WHEN n3 >= 3 THEN (s3 - y)::DOUBLE / (n3 - 1) END, 6) AS rate FROM w",
}
