"""How the belief operators' inputs are bound to the project's tables, in Spark and as SQL.

``evidence`` is the log of edges between listed entities; a clinical source weighs by its
trial's phase. Each extraction is one causal chain of a trial, its roles normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.sources.tables import table

PLACEHOLDERS = ["unclear", "unknown", "n/a", "not specified", "-", "none", "tbd", "not reported"]
BUCKETS = {"strong": "strong_support", "moderate": "moderate_support", "weak": "weak_support", "ambiguous": "ambiguous", "contradicts": "moderate_contradict"}
SOURCES = {"genetic": "genetic_gwas", "in_vitro": "preclinical_in_vitro", "database": "database_ot_association"}
BACKBONE = [("affects", "compound", "target"), ("modulates_via", "target", "mechanism"), ("mechanism_affects", "mechanism", "biology"), ("biology_drives", "biology", "indication"), ("endpoint_captures", "endpoint", "indication"), ("reflects_biology", "biology", "endpoint")]


# Evidence tier of each phase; any other phase counts as literature.
PHASE_TIERS = {"EARLY_PHASE1": "clinical_phase1", "PHASE1": "clinical_phase1", "PHASE2": "clinical_phase2", "PHASE2/PHASE3": "clinical_phase3", "PHASE3": "clinical_phase3", "PHASE4": "clinical_phase3"}


def phase_tier(phase: Column) -> Column:
    p = F.upper(F.replace(phase, F.lit(" "), F.lit("")))
    tiers = F.create_map(*[F.lit(x) for kv in PHASE_TIERS.items() for x in kv])
    return F.coalesce(F.element_at(tiers, p), F.lit("literature"))


def role(c: Column) -> Column:
    """Lower case, single spaces; null for blanks and words that name nothing."""
    v = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.when((v != "") & ~v.isin(PLACEHOLDERS), v)


def evidence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with bucket, tier and the two exact contributions; rows without both ends are left out."""
    e = table(spark, sf_dir, "evidence").where("src_entity_id is not null and dst_entity_id is not null")
    t = table(spark, sf_dir, "trials", "nct_id", "phase", "conditions").withColumnsRenamed({"nct_id": "source_id"})
    e = e.join(t, "source_id", "left")
    kind = F.when(F.col("source_type") == "clinical_trial", phase_tier(F.col("phase")))
    for source, tier in SOURCES.items():
        kind = kind.when(F.col("source_type") == source, F.lit(tier))
    bucket = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv]), F.col("support")), F.lit("ambiguous"))
    e = e.withColumns({"tier": kind.otherwise("literature"), "bucket": bucket})
    e = e.withColumns({"p_obs": B.lookup(B.P_OBS, F.col("bucket")), "n_eff": B.lookup(B.N_EFF, F.col("tier")) * F.coalesce("quality_score", F.lit(0.5)) * B.precision(F.col("n_obs"))})
    return e.select(
        F.col("evidence_id").alias("seq"), F.col("src_entity_id").alias("src"), F.col("dst_entity_id").alias("dst"), "edge_type", "source_id", "source_type", "tier", "bucket", "p_value",
        F.col("observed_at").alias("ts"), "conditions", "p_obs", "n_eff", B.exact(F.col("n_eff") * F.col("p_obs")).alias("up"), B.exact(F.col("n_eff") * (1 - F.col("p_obs"))).alias("down"),
    )


def beliefs(log: DataFrame, *keys: str) -> DataFrame:
    """Beta beliefs as one additive aggregate over the log."""
    keys = keys or ("src", "dst", "edge_type")
    return log.groupBy(*keys).agg((1 + F.sum("up").cast("double")).alias("alpha"), (1 + F.sum("down").cast("double")).alias("beta"), F.count("*").alias("n_records"))


def trial_digits(c: Column) -> Column:
    return F.concat(F.lit("NCT"), F.regexp_extract(c, r"(\d{8})", 1))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest classification of each trial."""
    c = table(spark, sf_dir, "classifications").where(F.col("nct_id").rlike(r"\d{8}"))
    last = F.max_by(F.struct("classification_id", "trial_outcome", "failure_modes", "confidence_overall", "operational_failure"), F.struct("classified_at", "classification_id"))
    return c.groupBy(trial_digits(F.col("nct_id")).alias("trial_id")).agg(last.alias("v")).select("trial_id", F.coalesce(role(F.col("v.trial_outcome")), F.lit("unknown")).alias("trial_outcome"), F.get("v.failure_modes", F.lit(0))["mode"].alias("mode"), F.col("v.confidence_overall").alias("confidence"), F.col("v.operational_failure").alias("operational"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain for each extraction of a known trial, with its outcome and weight.

    ``indications`` are all conditions of the trial, ``indication`` the first named one.
    """
    x = table(spark, sf_dir, "extractions").where(F.col("nct_id").rlike(r"\d{8}"))
    h = "therapeutic_hypothesis."
    x = x.select(
        F.col("extraction_id").alias("chain_id"), trial_digits(F.col("nct_id")).alias("trial_id"),
        *[role(F.col(h + c)).alias(n) for n, c in (("compound", "compound"), ("target", "claimed_target"), ("mechanism", "proposed_mechanism"), ("biology", "intended_biology"), ("endpoint", "primary_endpoint"), ("population", "target_population"))],
        F.col("results.primary_endpoint_met").alias("met"), F.col("results.safety_signals").alias("signals"), F.col("context.sample_size").alias("sample_size"), F.col("annotated_at"),
    )
    t = table(spark, sf_dir, "trials", "nct_id", "phase", "overall_status", "why_stopped", "conditions", "sponsor").withColumnRenamed("nct_id", "trial_id")
    x = x.join(t, "trial_id").join(verdicts(spark, sf_dir), "trial_id", "left")
    outcome = F.when(F.col("met"), "success").when(~F.col("met"), "failure").otherwise(F.coalesce("trial_outcome", F.lit("unknown")))
    weight = B.lookup(B.N_EFF, phase_tier(F.col("phase"))) * F.coalesce("confidence", F.lit(0.5)) * B.precision(F.col("sample_size")) * F.when(F.col("operational"), 0.2).otherwise(1.0)
    named = F.array_distinct(F.array_compact(F.transform("conditions", role)))
    return x.withColumns({"indications": F.coalesce(named, F.array().cast("array<string>")), "outcome": outcome, "w": F.round(weight, 6)}).withColumn("indication", F.get("indications", F.lit(0)))


def by_indication(chain: DataFrame) -> DataFrame:
    """Chains once for each condition of their trial; those of trials without one are left out."""
    return chain.withColumn("indication", F.explode("indications"))


def unpivot(chain: DataFrame, *keep: str) -> DataFrame:
    """The backbone edges of each chain, those into the indication once for each condition; an edge without both ends is skipped."""
    edge = lambda t, a, b: F.struct(F.lit(t).alias("edge_type"), a.alias("src"), b.alias("dst"))
    single = F.array(*[edge(t, F.col(a), F.col(b)) for t, a, b in BACKBONE if b != "indication"])
    fan = lambda t, a: F.transform("indications", lambda i: edge(t, F.col(a), i))
    into = [fan(t, a) for t, a, b in BACKBONE if b == "indication"]
    return chain.select(*keep, F.inline(F.concat(single, *into))).where("src is not null and dst is not null")


_ROLE = "nullif(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), '')"
_NOTHING = "(" + ", ".join(f"'{p}'" for p in PLACEHOLDERS) + ")"


def sql_role(expr: str) -> str:
    v = _ROLE.format(expr)
    return f"CASE WHEN {v} NOT IN {_NOTHING} THEN {v} END"


_PHASE = "CASE upper(replace(t.phase, ' ', '')) WHEN 'PHASE4' THEN 15.0 WHEN 'PHASE3' THEN 15.0 WHEN 'PHASE2/PHASE3' THEN 15.0 WHEN 'PHASE2' THEN 6.0 WHEN 'PHASE1' THEN 2.0 WHEN 'EARLY_PHASE1' THEN 2.0 ELSE 0.2 END"
_F_N = "CASE WHEN {0} > 0 THEN greatest(least(sqrt({0} / 350.0::DOUBLE), 2.5::DOUBLE), 0.5::DOUBLE) ELSE 1.0::DOUBLE END"
EV_SQL = f"""ev0 AS (
  SELECT e.evidence_id AS seq, e.src_entity_id AS src, e.dst_entity_id AS dst, e.edge_type, e.source_id, e.source_type, e.p_value, e.observed_at AS ts, t.conditions,
    CASE e.support WHEN 'strong' THEN 'strong_support' WHEN 'moderate' THEN 'moderate_support' WHEN 'weak' THEN 'weak_support' WHEN 'contradicts' THEN 'moderate_contradict' ELSE 'ambiguous' END AS bucket,
    (CASE e.support WHEN 'strong' THEN 0.95 WHEN 'moderate' THEN 0.80 WHEN 'weak' THEN 0.65 WHEN 'contradicts' THEN 0.20 ELSE 0.50 END)::DOUBLE AS p_obs,
    (CASE e.source_type WHEN 'clinical_trial' THEN {_PHASE} WHEN 'genetic' THEN 4.0 WHEN 'in_vitro' THEN 1.0 WHEN 'database' THEN 2.0 ELSE 0.2 END)::DOUBLE * coalesce(e.quality_score, 0.5) * {_F_N.format("e.n_obs")} AS n_eff
  FROM evidence e LEFT JOIN trials t ON t.nct_id = e.source_id WHERE e.src_entity_id IS NOT NULL AND e.dst_entity_id IS NOT NULL
), ev AS (SELECT *, round(n_eff * p_obs, 6)::DECIMAL(18,6) AS up, round(n_eff * (1 - p_obs), 6)::DECIMAL(18,6) AS down FROM ev0
), bel AS (SELECT src, dst, edge_type, 1 + sum(up)::DOUBLE AS alpha, 1 + sum(down)::DOUBLE AS beta, count(*) AS n_records FROM ev GROUP BY ALL)"""
_INDS = f"list_filter(list_transform(t.conditions, lambda c: {sql_role('c')}), lambda c: c IS NOT NULL)"
CH_SQL = f"""verd AS (
  SELECT 'NCT' || regexp_extract(nct_id, '(\\d{{8}})', 1) AS trial_id, arg_max({{'o': trial_outcome, 'm': failure_modes, 'c': confidence_overall, 'f': operational_failure}}, (classified_at, classification_id)) AS v
  FROM classifications WHERE regexp_matches(nct_id, '\\d{{8}}') GROUP BY 1
), ch AS (
  SELECT x.extraction_id AS chain_id, t.nct_id AS trial_id, t.phase, t.overall_status, t.why_stopped, t.conditions, t.sponsor,
    {", ".join(f"{sql_role('x.therapeutic_hypothesis.' + c)} AS {n}" for n, c in (("compound", "compound"), ("target", "claimed_target"), ("mechanism", "proposed_mechanism"), ("biology", "intended_biology"), ("endpoint", "primary_endpoint"), ("population", "target_population")))},
    {_INDS} AS inds, ({_INDS})[1] AS indication, x.results.primary_endpoint_met AS met, x.results.safety_signals AS signals, x.context.sample_size AS sample_size, x.annotated_at,
    v.v.m[1].mode AS mode, v.v.f AS operational, v.v.c AS confidence, coalesce({sql_role("v.v.o")}, 'unknown') AS trial_outcome,
    CASE WHEN x.results.primary_endpoint_met THEN 'success' WHEN NOT x.results.primary_endpoint_met THEN 'failure' ELSE coalesce({sql_role("v.v.o")}, 'unknown') END AS outcome,
    round({_PHASE}::DOUBLE * coalesce(v.v.c, 0.5) * {_F_N.format("x.context.sample_size")} * CASE WHEN v.v.f THEN 0.2 ELSE 1.0 END::DOUBLE, 6) AS w
  FROM extractions x JOIN trials t ON t.nct_id = 'NCT' || regexp_extract(x.nct_id, '(\\d{{8}})', 1) LEFT JOIN verd v ON v.trial_id = t.nct_id WHERE regexp_matches(x.nct_id, '\\d{{8}}')
), ce AS (
  SELECT * FROM ({" UNION ALL ".join(f"SELECT *, '{t}' AS edge_type, {a} AS src, {'unnest(list_distinct(inds))' if b == 'indication' else b} AS dst FROM ch" for t, a, b in BACKBONE)}) WHERE src IS NOT NULL AND dst IS NOT NULL
), ci AS (SELECT * EXCLUDE (indication), unnest(list_distinct(inds)) AS indication FROM ch
), cei AS (SELECT * EXCLUDE (indication), unnest(list_distinct(inds)) AS indication FROM ce
)"""
