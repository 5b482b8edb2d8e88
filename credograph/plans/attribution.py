"""Queries of attribution and adverse events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.operators import attribution as A
from credograph.operators import graph as G
from credograph.operators.statistics import with_totals
from credograph.plans.base import CH_SQL, chains, unpivot
from credograph.session import cut
from credograph.sources.tables import table

KEY = ["src", "dst", "edge_type"]
#: Branches of the modes that these tables have besides the fixed ones.
OWN_MODES = {"wrong_target": "efficacy", "inadequate_exposure": "efficacy", "endpoint_mismatch": "measurement"}
#: Severity class of each adverse event term; the number is the grade it counts as.
GRADES = {"second malignancies": 5, "QT prolongation": 4, "pneumonitis": 4, "neutropenia": 4, "thrombocytopenia": 4, "infections": 3, "elevated transaminases": 3, "infusion reaction": 3, "hypertension": 3, "diarrhea": 2, "rash": 2, "fatigue": 2, "nausea": 1, "headache": 1}
# Organ class of each term.
ORGANS = {"second malignancies": "neoplasms", "QT prolongation": "cardiac", "pneumonitis": "respiratory", "neutropenia": "blood", "thrombocytopenia": "blood", "infections": "infections", "elevated transaminases": "investigations", "infusion reaction": "injury", "hypertension": "vascular", "diarrhea": "gastrointestinal", "rash": "skin", "fatigue": "general", "nausea": "gastrointestinal", "headache": "nervous"}
# Weight of each grade.
GRADE_WEIGHT = {1: 0.05, 2: 0.05, 3: 0.15, 4: 0.30, 5: 0.50}
CAP = 0.60


def _map(values: dict, key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chains(spark, sf_dir)
    return c.withColumn("branch", F.coalesce(A.stop_override(F.col("overall_status"), F.col("why_stopped")), A.branch_of(F.col("mode"), OWN_MODES)))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivot(_routed(spark, sf_dir), "chain_id", "trial_id", "outcome", "branch", "w")


def _beliefs(updates: DataFrame) -> DataFrame:
    x = updates.withColumns({"up": B.exact(F.col("n") * F.col("p")), "down": B.exact(F.col("n") * (1 - F.col("p")))})
    return x.groupBy(*KEY).agg((1 + F.sum("up").cast("double")).alias("alpha"), (1 + F.sum("down").cast("double")).alias("beta"), F.count("*").alias("n_records"))


def _with_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain edges with their belief at the epoch's start: the successes so far."""
    e = _edges(spark, sf_dir)
    b = _beliefs(A.success_updates(e)).select(*KEY, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("b"))
    return e.join(b, KEY, "left").withColumn("r", F.coalesce("b", F.lit(0.5))).drop("b")


def annotation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions with the classification of their trial, inner."""
    c = chains(spark, sf_dir).where("confidence is not null or mode is not null or trial_outcome is not null")
    return c.select("chain_id", "trial_id", "trial_outcome", "mode", F.round("confidence", 6).alias("confidence"), "operational")


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = unpivot(chains(spark, sf_dir), "chain_id", "trial_id")
    return e.groupBy("edge_type").agg(F.count("*").alias("uses"), F.countDistinct("src", "dst").alias("edges"), F.countDistinct("trial_id").alias("trials"))


def failure_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).groupBy("outcome", "branch").agg(F.count("*").alias("n"), F.sum(B.exact(F.col("w"))).cast("double").alias("weight"))


def stop_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "trials", "nct_id", "overall_status", "why_stopped")
    return t.select("nct_id", A.stop_override(F.col("overall_status"), F.col("why_stopped")).alias("branch")).where("branch is not null")


def attribute_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beliefs(A.success_updates(_edges(spark, sf_dir)))


def explain_away_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.explain_away(_with_belief(spark, sf_dir)).select("chain_id", *KEY, F.round("share", 6).alias("share"), F.round(F.col("w") * F.col("share"), 6).alias("n"), "p")


def responsibility_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.responsibility(_with_belief(spark, sf_dir)).select("chain_id", *KEY, F.col("w").alias("n"), F.round("p", 6).alias("p"))


def censored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains whose failure says nothing about their edges."""
    return _routed(spark, sf_dir).where("outcome in ('failure', 'partial') and branch in ('safety', 'operational')").select("chain_id", "trial_id", "branch")


def attributed_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes and routed failures of one epoch as one belief aggregate."""
    e = cut(_with_belief(spark, sf_dir))
    blame = A.explain_away(e).select(*KEY, (F.col("w") * F.col("share")).alias("n"), "p")
    own = A.responsibility(e).select(*KEY, F.col("w").alias("n"), "p")
    x = _beliefs(A.success_updates(e).unionByName(blame).unionByName(own))
    return x.select(*KEY, "alpha", "beta", "n_records")


def _arm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of each trial, one for each set of compounds, with their outcome and where it is told.

    The first result told for the arm counts, those of the whole population before those of a
    subgroup; an arm without any has the trial's outcome.
    """
    c = chains(spark, sf_dir).where("compound is not null").withColumn("compounds", F.array_sort(F.array_distinct(F.split("compound", r" \+ | and | plus | with "))))
    told = F.when(F.col("met").isNotNull(), F.struct(F.col("population").isNotNull().alias("s"), F.col("chain_id").alias("c"), F.when(F.col("met"), "success").otherwise("failure").alias("o")))
    x = c.groupBy("trial_id", "compounds").agg(F.min("chain_id").alias("arm_id"), F.min(told)["o"].alias("own"), F.min("trial_outcome").alias("of_trial"))
    fallback = F.when(F.col("of_trial").isin("success", "partial", "failure"), F.col("of_trial"))
    return x.select("trial_id", "arm_id", "compounds", F.coalesce("own", fallback, F.lit("unknown")).alias("outcome"), F.when(F.col("own").isNotNull(), "arm").when(fallback.isNotNull(), "trial").otherwise("none").alias("told_by"))


def arm_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arm_table(spark, sf_dir).withColumn("compounds", F.array_join("compounds", "+"))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arm_table(spark, sf_dir).where("outcome <> 'unknown'").withColumn("grade", _map({"failure": 0, "partial": 1, "success": 2}, F.col("outcome")))


def arm_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.subset_pairs(_arms(spark, sf_dir))


def single_arm_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within combinations that have no strictly smaller arm to compare with."""
    arms = _arms(spark, sf_dir)
    alone = arms.where(F.size("compounds") > 1).join(A.subset_pairs(arms).select(F.col("combo_arm").alias("arm_id")).distinct(), "arm_id", "left_anti")
    x = alone.select("arm_id", "outcome", "compounds", F.posexplode("compounds").alias("i", "a")).select("arm_id", "outcome", "a", F.explode(F.expr("slice(compounds, i + 2, size(compounds))")).alias("b"))
    bucket = _map({"success": "weak_support", "partial": "ambiguous", "failure": "weak_contradict"}, F.col("outcome"))
    return x.select("arm_id", "a", "b", bucket.alias("bucket"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chains(spark, sf_dir).where("compound is not null and target is not null")
    return c.select("chain_id", "trial_id", "compound", "target", "outcome", "branch" if "branch" in c.columns else F.lit(None).cast("string").alias("branch"), "w", F.explode("signals").alias("ae"))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each compound's reports the share with an event, against all other compounds' reports."""
    c = chains(spark, sf_dir).where("compound is not null")
    n = with_totals(c.groupBy("compound").agg(F.count("*").alias("n")), c.agg(F.count("*").alias("every")))
    s = c.select("chain_id", "compound", F.explode(F.array_distinct("signals")).alias("ae")).where("ae is not null")
    k = s.groupBy("compound", "ae").agg(F.count("*").alias("k"))
    all_k = s.groupBy("ae").agg(F.count("*").alias("all_k"))
    x = k.join(n, "compound").join(all_k, "ae")
    control = F.when(F.col("every") > F.col("n"), 100.0 * (F.col("all_k") - F.col("k")) / (F.col("every") - F.col("n")))
    return x.withColumns({"treated": 100.0 * F.col("k") / F.col("n"), "control": control})


def ae_incidence_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _rates(spark, sf_dir)
    return x.select("compound", "ae", "n", "k", A.ae_bucket(F.round("treated", 6), F.round("control", 6), F.col("n")).alias("bucket"))


def _ae_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ae_incidence_bucket(spark, sf_dir).withColumn("p_obs", B.lookup(B.P_OBS, F.col("bucket")))
    return x.select("compound", "ae", (1 + F.col("n") * F.col("p_obs")).alias("alpha"), (1 + F.col("n") * (1 - F.col("p_obs"))).alias("beta"))


def ae_target_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events shared by at least two compounds of a target, as votes of weight four."""
    b = _ae_beliefs(spark, sf_dir).where("alpha + beta - 2 >= 1")
    binds = chains(spark, sf_dir).where("compound is not null and target is not null").select("compound", "target").distinct()
    v = b.join(binds, "compound").withColumn("vote", A.class_votes(B.expected(F.col("alpha"), F.col("beta")))).withColumn("p_vote", B.lookup(B.P_OBS, F.col("vote")))
    x = v.groupBy("target", "ae").agg(F.count("*").alias("siblings"), F.sum(B.exact(4 * F.col("p_vote"))).alias("u")).where("siblings >= 2")
    return x.select("target", "ae", "siblings", (1 + F.col("u").cast("double")).alias("alpha"), (1 + 4 * F.col("siblings") - F.col("u").cast("double")).alias("beta"))


def ae_soc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by organ class and term, with the totals of each level."""
    s = _signals(spark, sf_dir).where("ae is not null").withColumn("organ", _map(ORGANS, F.col("ae")))
    return s.rollup("organ", "ae").agg(F.count("*").alias("reports"), F.countDistinct("compound").alias("compounds")).select(F.coalesce("organ", F.lit("all")).alias("organ"), F.coalesce("ae", F.lit("all")).alias("ae"), "reports", "compounds")


def safety_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest event of each compound: severity, belief and trust; capped."""
    b = _ae_beliefs(spark, sf_dir)
    a, c = F.col("alpha"), F.col("beta")
    p = a / (a + c)
    risk = F.round(_map(GRADE_WEIGHT, _map(GRADES, F.col("ae"))) * F.least(F.greatest((p - 0.5) / 0.5, F.lit(0.0)), F.lit(1.0)) * B.trust(a + c - 2), 6)
    x = b.withColumns({"p": B.expected(a, c), "risk": risk}).where("p >= 0.55 and alpha + beta - 2 >= 1")
    return x.groupBy("compound").agg(F.least(F.lit(CAP), F.max("risk")).alias("penalty"), F.max_by("ae", F.struct("risk", "ae")).alias("worst_ae"), F.count("*").alias("risks"))


def survival_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass against each known event of a compound from later trials that succeeded or failed on efficacy.

    What comes later is all of a compound less its running total, so no event meets the chains one by one.
    """
    c = _routed(spark, sf_dir).where("compound is not null")
    counts = F.coalesce(F.expr("outcome = 'success' or branch in ('efficacy', 'measurement')"), F.lit(False))
    c = c.select("compound", "chain_id", "signals", F.lpad(F.col("chain_id").cast("string"), 12, "0").alias("o"), F.when(counts, B.exact(F.col("w"))).otherwise(F.lit(0).cast("decimal(18,6)")).alias("v"), F.when(counts, 1).otherwise(0).alias("k"))
    first = c.select("compound", "o", F.explode("signals").alias("ae")).where("ae is not null").groupBy("compound", "ae").agg(F.min("o").alias("o"))
    run = G.running_total(G.running_total(c.select("compound", "o", "v", "k"), "compound", "o", "v", "rv", 9), "compound", "o", "k", "rk", 9)
    whole = c.groupBy("compound").agg(F.sum("v").alias("av"), F.sum("k").alias("ak"))
    x = first.join(run.select("compound", "o", "rv", "rk"), ["compound", "o"]).join(whole, "compound")
    return x.where("ak > rk").select("compound", "ae", (F.col("av") - F.col("rv")).cast("double").alias("credit"), (F.col("ak") - F.col("rk")).alias("chains"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success, failure, ambiguous or null of each chain; a failure for other than scientific reasons is ambiguous."""
    other = F.coalesce(F.col("mode").isin("insufficient_information", "dose_limiting_toxicity", "commercial_not_scientific", "underpowered"), F.lit(False))
    failed = F.when(other, "ambiguous").otherwise("failure")
    o = F.col("trial_outcome")
    return chains(spark, sf_dir).select("chain_id", F.when(F.col("met"), "success").when(~F.col("met"), failed).when(o == "success", "success").when(o == "failure", failed).when(o == "partial", "ambiguous").alias("label"))


QUERIES = {f.__name__: f for f in (arm_outcomes, annotation_pairs, chain_edges, failure_branches, stop_overrides, attribute_success, explain_away_epoch, responsibility_epoch, censored, attributed_beliefs, arm_differential, single_arm_combo, ae_incidence_bucket, ae_target_class, ae_soc_rollup, safety_penalty, survival_credit, labels)}


def _case(values: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" if isinstance(v, str) else f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_R = "lower(why_stopped)"
STOP_SQL = """CASE WHEN upper(overall_status) IN ('TERMINATED', 'WITHDRAWN', 'SUSPENDED')
  AND NOT regexp_matches(lower(why_stopped), 'futility|futile|efficac|did not meet|lack of response|no benefit|ineffective|primary endpoint|interim analysis|insufficient response|negative result') THEN
  CASE WHEN regexp_matches(lower(why_stopped), 'accrual|enroll|enrol|recruit|fund|financ|budget|sponsor|business|commercial|strateg|portfolio|prioriti|supply|manufactur|administrativ|merger|reorganiz|company|discontinu|logistic|feasib|covid|pandemic') THEN 'operational'
  WHEN regexp_matches(lower(why_stopped), 'toxic|adverse event|tolerab|unacceptable risk|safety signal|serious adverse') THEN 'safety' END END"""
_BRANCH = """CASE WHEN mode IN ('no_target_engagement', 'target_engaged_biology_not_moved', 'wrong_target', 'inadequate_exposure') THEN 'efficacy'
  WHEN mode IN ('biology_moved_endpoint_flat', 'wrong_timeframe', 'high_placebo_response', 'wrong_population', 'efficacy_in_subgroup_only', 'endpoint_mismatch') THEN 'measurement'
  WHEN mode = 'dose_limiting_toxicity' THEN 'safety' WHEN mode IN ('underpowered', 'manufacturing_or_delivery', 'commercial_not_scientific', 'insufficient_information') THEN 'operational' ELSE 'unknown' END"""
RT_SQL = f"""{CH_SQL}, rt AS (SELECT *, coalesce({STOP_SQL}, {_BRANCH}) AS branch FROM ch
), re AS (SELECT *, coalesce({STOP_SQL}, {_BRANCH}) AS branch FROM ce
), su AS (SELECT src, dst, edge_type, w AS n, 0.8::DOUBLE AS p FROM re WHERE outcome = 'success'
), sb AS (SELECT src, dst, edge_type, 1 + sum(round(n * p, 6)::DECIMAL(18,6))::DOUBLE AS alpha, 1 + sum(round(n * (1 - p), 6)::DECIMAL(18,6))::DOUBLE AS beta, count(*) AS n_records FROM su GROUP BY ALL
), rb AS (SELECT re.*, coalesce(alpha / (alpha + beta), 0.5) AS r FROM re LEFT JOIN sb USING (src, dst, edge_type)
), xa AS (SELECT *, CASE WHEN sum(1 - r) OVER c > 0 THEN (1 - r) / sum(1 - r) OVER c ELSE 1.0 / count(*) OVER c END AS share, CASE outcome WHEN 'failure' THEN 0.2 ELSE 0.35 END::DOUBLE AS p FROM rb WHERE branch = 'unknown' AND outcome IN ('failure', 'partial') WINDOW c AS (PARTITION BY chain_id)
), rs0 AS (SELECT *, exp(sum(ln(greatest(r, 1e-12))) OVER (PARTITION BY chain_id)) AS m FROM rb WHERE branch IN ('efficacy', 'measurement') AND outcome IN ('failure', 'partial')
), rs AS (SELECT *, least(greatest((r - m) / (1 - m), 0.0), 1.0) AS p FROM rs0 WHERE 1 - m >= 1e-6)"""
_ARMS = CH_SQL + r""", arm0 AS (
  SELECT trial_id, list_sort(list_distinct(string_split_regex(compound, ' \+ | and | plus | with '))) AS compounds, min(chain_id) AS arm_id,
    arg_min(CASE WHEN met THEN 'success' ELSE 'failure' END, (CASE WHEN population IS NULL THEN 0 ELSE 1 END, chain_id)) FILTER (WHERE met IS NOT NULL) AS own, min(trial_outcome) AS of_trial
  FROM ch WHERE compound IS NOT NULL GROUP BY 1, 2
), arm1 AS (SELECT *, CASE WHEN of_trial IN ('success', 'partial', 'failure') THEN of_trial END AS fb FROM arm0
), arms AS (SELECT *, coalesce(own, fb) AS outcome, CASE coalesce(own, fb) WHEN 'failure' THEN 0 WHEN 'partial' THEN 1 WHEN 'success' THEN 2 END AS grade FROM arm1 WHERE coalesce(own, fb) IS NOT NULL
), sp AS (SELECT a.trial_id, a.arm_id AS base_arm, b.arm_id AS combo_arm, array_to_string(list_filter(b.compounds, lambda x: NOT list_contains(a.compounds, x)), '+') AS added, CASE b.grade - a.grade WHEN 2 THEN 'strong_support' WHEN 1 THEN 'moderate_support' WHEN 0 THEN 'ambiguous' WHEN -1 THEN 'moderate_contradict' ELSE 'strong_contradict' END AS bucket
  FROM arms a JOIN arms b ON a.trial_id = b.trial_id WHERE len(a.compounds) < len(b.compounds) AND list_has_all(b.compounds, a.compounds))"""
_AE = CH_SQL + """, cc AS (SELECT * FROM ch WHERE compound IS NOT NULL), nn AS (SELECT compound, count(*) AS n FROM cc GROUP BY 1
), sg AS (SELECT chain_id, compound, unnest(list_distinct(signals)) AS ae FROM cc), kk AS (SELECT compound, ae, count(*) AS k FROM sg GROUP BY ALL), aa AS (SELECT ae, sum(k) AS all_k FROM kk GROUP BY 1
), rt AS (SELECT compound, ae, n, k, round(100.0::DOUBLE * k / n, 6) AS t, round(CASE WHEN (SELECT count(*) FROM cc) > n THEN 100.0::DOUBLE * (all_k - k) / ((SELECT count(*) FROM cc) - n) ELSE 0 END, 6) AS c FROM kk JOIN nn USING (compound) JOIN aa USING (ae)
), b0 AS (SELECT *, CASE WHEN t - c >= 20 OR t / greatest(c, 0.5) >= 3 THEN 'strong_support' WHEN t - c >= 10 OR t / greatest(c, 0.5) >= 2 THEN 'moderate_support' WHEN t - c >= 5 OR t / greatest(c, 0.5) >= 1.5 THEN 'weak_support' WHEN t - c <= -5 THEN 'weak_contradict' ELSE 'ambiguous' END AS d, round_even(t * n / 100, 0) AS x, round_even(c * n / 100, 0) AS y FROM rt
), bk AS (SELECT compound, ae, n, k, CASE WHEN d IN ('strong_support', 'moderate_support') THEN CASE WHEN x >= 5 THEN d WHEN x >= 3 THEN 'weak_support' ELSE 'ambiguous' END WHEN d = 'weak_support' THEN CASE WHEN x >= 3 THEN d ELSE 'ambiguous' END WHEN d = 'weak_contradict' THEN CASE WHEN y >= 3 THEN d ELSE 'ambiguous' END ELSE d END AS bucket FROM b0
), ab AS (SELECT compound, ae, 1 + n * po AS alpha, 1 + n * (1 - po) AS beta FROM (SELECT *, (CASE bucket WHEN 'strong_support' THEN 0.95 WHEN 'moderate_support' THEN 0.8 WHEN 'weak_support' THEN 0.65 WHEN 'weak_contradict' THEN 0.35 ELSE 0.5 END)::DOUBLE AS po FROM bk))"""
_T = "WITH "
SQL = {
    "annotation_pairs": f"{_T}{CH_SQL} SELECT chain_id, trial_id, CASE WHEN EXISTS (SELECT 1 FROM verd WHERE verd.trial_id = ch.trial_id) THEN trial_outcome END AS trial_outcome, mode, round(confidence, 6) AS confidence, operational FROM ch WHERE EXISTS (SELECT 1 FROM verd WHERE verd.trial_id = ch.trial_id)",
    "chain_edges": f"{_T}{CH_SQL} SELECT edge_type, count(*) AS uses, count(DISTINCT (src, dst)) AS edges, count(DISTINCT trial_id) AS trials FROM ce GROUP BY 1",
    "failure_branches": f"{_T}{RT_SQL} SELECT outcome, branch, count(*) AS n, sum(w::DECIMAL(18,6))::DOUBLE AS weight FROM rt GROUP BY 1, 2",
    "stop_overrides": f"SELECT nct_id, {STOP_SQL} AS branch FROM trials WHERE {STOP_SQL} IS NOT NULL",
    "attribute_success": f"{_T}{RT_SQL} SELECT * FROM sb",
    "explain_away_epoch": f"{_T}{RT_SQL} SELECT chain_id, src, dst, edge_type, round(share, 6) AS share, round(w * share, 6) AS n, p FROM xa",
    "responsibility_epoch": f"{_T}{RT_SQL} SELECT chain_id, src, dst, edge_type, w AS n, round(p, 6) AS p FROM rs",
    "censored": f"{_T}{RT_SQL} SELECT chain_id, trial_id, branch FROM rt WHERE outcome IN ('failure', 'partial') AND branch IN ('safety', 'operational')",
    "attributed_beliefs": f"{_T}{RT_SQL}, u AS (SELECT * FROM su UNION ALL SELECT src, dst, edge_type, w * share, p FROM xa UNION ALL SELECT src, dst, edge_type, w, p FROM rs) SELECT src, dst, edge_type, 1 + sum(round(n * p, 6)::DECIMAL(18,6))::DOUBLE AS alpha, 1 + sum(round(n * (1 - p), 6)::DECIMAL(18,6))::DOUBLE AS beta, count(*) AS n_records FROM u GROUP BY 1, 2, 3",
    "arm_outcomes": f"{_T}{_ARMS} SELECT trial_id, arm_id, array_to_string(compounds, '+') AS compounds, coalesce(own, fb, 'unknown') AS outcome, CASE WHEN own IS NOT NULL THEN 'arm' WHEN fb IS NOT NULL THEN 'trial' ELSE 'none' END AS told_by FROM arm1",
    "arm_differential": f"{_T}{_ARMS} SELECT * FROM sp",
    "single_arm_combo": f"{_T}{_ARMS}, al AS (SELECT * FROM arms WHERE len(compounds) > 1 AND arm_id NOT IN (SELECT combo_arm FROM sp)), x AS (SELECT arm_id, outcome, unnest(compounds) AS a, compounds FROM al), y AS (SELECT arm_id, outcome, a, unnest(compounds) AS b FROM x) SELECT arm_id, a, b, CASE outcome WHEN 'success' THEN 'weak_support' WHEN 'partial' THEN 'ambiguous' ELSE 'weak_contradict' END AS bucket FROM y WHERE a < b",
    "ae_incidence_bucket": f"{_T}{_AE} SELECT * FROM bk",
    "ae_target_class": f"{_T}{_AE}, v AS (SELECT target, ae, round(alpha / (alpha + beta), 6) AS p FROM ab JOIN (SELECT DISTINCT compound, target FROM cc WHERE target IS NOT NULL) USING (compound) WHERE alpha + beta - 2 >= 1) SELECT target, ae, count(*) AS siblings, 1 + sum(4 * CASE WHEN p >= 0.75 THEN 0.95 WHEN p >= 0.55 THEN 0.8 WHEN p >= 0.4 THEN 0.65 WHEN p <= 0.25 THEN 0.35 ELSE 0.5 END)::DOUBLE AS alpha, 1 + 4 * count(*) - sum(4 * CASE WHEN p >= 0.75 THEN 0.95 WHEN p >= 0.55 THEN 0.8 WHEN p >= 0.4 THEN 0.65 WHEN p <= 0.25 THEN 0.35 ELSE 0.5 END)::DOUBLE AS beta FROM v GROUP BY 1, 2 HAVING count(*) >= 2",
    "ae_soc_rollup": f"{_T}{CH_SQL}, s AS (SELECT compound, unnest(signals) AS ae FROM ch WHERE compound IS NOT NULL AND target IS NOT NULL), o AS (SELECT *, {_case(ORGANS, 'ae')} AS organ FROM s) SELECT coalesce(organ, 'all') AS organ, coalesce(ae, 'all') AS ae, count(*) AS reports, count(DISTINCT compound) AS compounds FROM o GROUP BY ROLLUP (organ, ae)",
    "safety_penalty": f"{_T}{_AE}, r AS (SELECT compound, ae, round(alpha / (alpha + beta), 6) AS p, round(CASE {_case(GRADES, 'ae')} WHEN 3 THEN 0.15 WHEN 4 THEN 0.3 WHEN 5 THEN 0.5 ELSE 0.05 END::DOUBLE * least(greatest((alpha / (alpha + beta) - 0.5) / 0.5, 0), 1) * least(1.0, ln(greatest(alpha + beta - 2, 0) + 1) / ln(50)), 6) AS risk FROM ab WHERE alpha + beta - 2 >= 1), k AS (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY risk DESC, ae DESC) AS rn, count(*) OVER (PARTITION BY compound) AS risks FROM r WHERE p >= 0.55) SELECT compound, least(0.6, risk) AS penalty, ae AS worst_ae, risks FROM k WHERE rn = 1",
    "survival_credit": f"{_T}{RT_SQL}, s AS (SELECT compound, ae, min(chain_id) AS f FROM (SELECT compound, chain_id, unnest(signals) AS ae FROM rt WHERE compound IS NOT NULL) GROUP BY 1, 2) SELECT s.compound, s.ae, sum(w::DECIMAL(18,6))::DOUBLE AS credit, count(*) AS chains FROM s JOIN rt ON s.compound = rt.compound AND chain_id > f WHERE outcome = 'success' OR branch IN ('efficacy', 'measurement') GROUP BY 1, 2",
    "labels": f"{_T}{CH_SQL}, o AS (SELECT *, CASE WHEN mode IN ('insufficient_information', 'dose_limiting_toxicity', 'commercial_not_scientific', 'underpowered') THEN 'ambiguous' ELSE 'failure' END AS bad FROM ch) SELECT chain_id, CASE WHEN met THEN 'success' WHEN NOT met THEN bad WHEN trial_outcome = 'success' THEN 'success' WHEN trial_outcome = 'failure' THEN bad WHEN trial_outcome = 'partial' THEN 'ambiguous' END AS label FROM o",
}
