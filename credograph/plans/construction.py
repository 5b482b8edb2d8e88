"""Queries of graph construction: canonical names, priors, hierarchies, appends, geometry and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.functions import text as X
from credograph.operators import attribution as A
from credograph.plans.vocabulary import endpoint_sql
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, chains, evidence_log, unpivot
from credograph.sources.tables import table

KEY = ["src", "dst", "edge_type"]
# Prior bucket of each endpoint class.
ENDPOINT_PRIORS = {"OS": "strong_support", "DFS": "moderate_support", "RFS": "moderate_support", "PFS": "moderate_support", "TTP": "moderate_support", "CR": "moderate_support", "DMFS": "weak_support", "DOR": "weak_support", "ORR": "weak_support", "safety": "weak_contradict"}
CONTROLS = ["placebo", "saline", "sham", "vehicle", "standard of care", "best supportive care"]
MERGED_TAU = 0.55


def endpoint_capture_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior belief for each endpoint and condition stated together; classes without one give none."""
    e = chains(spark, sf_dir).where("endpoint is not null and indication is not null").select("endpoint", "indication").distinct()
    p = B.lookup(B.P_OBS, F.element_at(F.create_map(*[F.lit(x) for kv in ENDPOINT_PRIORS.items() for x in kv]), X.endpoint_class(F.col("endpoint"))))
    n = B.N_EFF["database_endpoint_prior"]
    return e.withColumn("p", p).where("p is not null").select(F.col("endpoint").alias("src"), F.col("indication").alias("dst"), F.round(1 + n * F.col("p"), 6).alias("alpha"), F.round(1 + n * (1 - F.col("p")), 6).alias("beta"))


def cocondition_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biology of a chain fanned out to the trial's other conditions; edges already stated are left out."""
    c = chains(spark, sf_dir).where("biology is not null").select("biology", "indication", F.explode("conditions").alias("other")).withColumn("other", F.lower(F.trim("other")))
    stated = c.where("indication is not null").select("biology", F.col("indication").alias("other")).distinct()
    return c.where("other <> indication").join(stated, ["biology", "other"], "left_anti").groupBy("biology", "other").agg(F.count("*").alias("chains"))


def first_target_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each compound the mechanisms of its first target only, at most eight, most stated first."""
    c = chains(spark, sf_dir).where("compound is not null and target is not null and mechanism is not null")
    first = c.groupBy("compound").agg(F.min_by("target", "chain_id").alias("target"))
    m = c.join(first, ["compound", "target"]).groupBy("compound", "target", "mechanism").agg(F.count("*").alias("n"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("compound").orderBy(F.desc("n"), "mechanism"))).where("rank <= 8")


def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanisms of each biology kept while they overlap it at least 0.55 as well as the best does."""
    c = chains(spark, sf_dir).where("biology is not null and mechanism is not null").select("biology", "mechanism").distinct()
    a, b = F.array_distinct(F.split("biology", "[^a-z0-9]+")), F.array_distinct(F.split("mechanism", "[^a-z0-9]+"))
    x = c.withColumn("score", F.round(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(b)), 6))
    w = Window.partitionBy("biology")
    return x.withColumns({"best": F.max("score").over(w), "rank": F.row_number().over(w.orderBy(F.desc("score"), "mechanism"))}).where(f"rank = 1 or score > 0 and score >= {MERGED_TAU} * best").select("biology", "mechanism", "score")


def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each year's trials add: edges and trials not seen in any earlier year; year 0 is unknown."""
    e = unpivot(chains(spark, sf_dir), "trial_id", "annotated_at").withColumn("year", F.coalesce(F.year("annotated_at"), F.lit(0)))
    first = e.groupBy(*KEY).agg(F.min("year").alias("year"))
    applied = e.groupBy("trial_id").agg(F.min("year").alias("year"))
    return first.groupBy("year").agg(F.count("*").alias("new_edges")).join(applied.groupBy("year").agg(F.count("*").alias("new_trials")), "year", "left").select("year", "new_edges", F.coalesce("new_trials", F.lit(0)).alias("new_trials"))


def description_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first description of each role that a trial states, over its chains in order."""
    roles = ["target", "mechanism", "biology", "population"]
    x = chains(spark, sf_dir)
    return x.groupBy("trial_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chain_id"))).alias(c) for c in roles])


def applied_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials still to attribute: known outcome, not yet in the ledger (those classified before 2024)."""
    c = table(spark, sf_dir, "classifications", "nct_id", "classified_at").where(F.col("nct_id").rlike(r"\d{8}"))
    done = c.groupBy(F.concat(F.lit("NCT"), F.regexp_extract("nct_id", r"(\d{8})", 1)).alias("trial_id")).agg(F.min("classified_at").alias("t")).where("year(t) < 2024").select("trial_id")
    known = chains(spark, sf_dir).where("outcome <> 'unknown'").select("trial_id").distinct()
    return known.join(done, "trial_id", "left_anti")


def hazard_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the hazard ratios that extractions report with an interval."""
    x = table(spark, sf_dir, "extractions", "extraction_id", "results.effect_size").where(F.col("effect_size").rlike(r"^(Hazard Ratio|HR) [0-9.]+ "))
    num = lambda g: F.regexp_extract("effect_size", r"([0-9.]+) \([0-9]+% CI: ?([0-9.]+)(?: to |-|–)([0-9.]+)\)", g)
    x = x.select("extraction_id", *[F.nullif(num(g), F.lit("")).try_cast("double").alias(n) for g, n in ((1, "hr"), (2, "low"), (3, "high"))]).where("hr is not null")
    return x.select("extraction_id", "hr", A.hazard_bucket(F.col("hr"), F.col("low"), F.col("high")).alias("bucket"))


def overlap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of later trials by how many of their nodes earlier trials had; five pass the gate."""
    e = unpivot(chains(spark, sf_dir), "chain_id", "annotated_at").select("chain_id", F.year("annotated_at").alias("year"), F.explode(F.array("src", "dst")).alias("node")).distinct()
    seen = e.where("year < 2024").select("node").distinct().withColumn("seen", F.lit(1))
    per = e.where("year >= 2024").join(seen, "node", "left").groupBy("chain_id").agg(F.count("seen").alias("k"))
    return per.groupBy("k", (F.col("k") >= 5).alias("passes")).agg(F.count("*").alias("chains"))


def best_worst_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest success and the heaviest failure of each sponsor."""
    c = chains(spark, sf_dir).where("sponsor is not null and outcome in ('success', 'failure')")
    return c.groupBy("sponsor", "outcome").agg(F.max_by("trial_id", F.struct("w", "trial_id")).alias("trial_id"), F.max("w").alias("w"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty trials by the order of a hash; a sampling operator."""
    return table(spark, sf_dir, "trials", "nct_id").select("nct_id", F.md5(F.concat("nct_id", F.lit("#7"))).alias("h")).orderBy("h").limit(20)


def database_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed beliefs of edges that databases state: association score to bucket, number of sources to weight."""
    x = table(spark, sf_dir, "evidence").where("source_type = 'database' and src_entity_id is not null and dst_entity_id is not null").groupBy("src_entity_id", "dst_entity_id").agg(F.max("quality_score").alias("s"), F.count("*").alias("k"))
    s = F.col("s")
    bucket = F.when(s >= 0.75, "strong_support").when(s >= 0.5, "moderate_support").when(s >= 0.25, "weak_support").when(s >= 0.05, "ambiguous").when(s.isNotNull(), "weak_contradict").otherwise("ambiguous")
    n = B.N_EFF["database_ot_direct"] * F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.col("k") / 5))
    p = B.lookup(B.P_OBS, bucket)
    return x.select(F.col("src_entity_id").alias("src"), F.col("dst_entity_id").alias("dst"), bucket.alias("bucket"), F.round(1 + n * p, 6).alias("alpha"), F.round(1 + n * (1 - p), 6).alias("beta"))


def edge_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by how much evidence their edges hold, and how far their beliefs spread."""
    b = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'affects'").withColumn("p", B.expected(F.col("alpha"), F.col("beta")))
    t = b.groupBy("dst").agg(F.sum("n_records").alias("n"), F.round(F.max("p") - F.min("p"), 6).alias("spread"))
    band = F.when(F.col("n") >= 30, "mature").when(F.col("n") >= 15, "middle").otherwise("sparse")
    return t.groupBy(band.alias("band")).agg(F.count("*").alias("targets"), F.round(F.avg("spread"), 6).alias("spread"))


QUERIES = {f.__name__: f for f in (endpoint_capture_priors, cocondition_fan, first_target_mechanisms, relevance_floor, incremental_append, description_index, applied_ledger, hazard_buckets, overlap_gate, best_worst_trials, seeded_sample, database_priors, edge_maturity)}


_P = "CASE {} WHEN 'strong_support' THEN 0.95 WHEN 'moderate_support' THEN 0.8 WHEN 'weak_support' THEN 0.65 WHEN 'ambiguous' THEN 0.5 WHEN 'weak_contradict' THEN 0.35 END::DOUBLE"
_HR = r"'([0-9.]+) \([0-9]+% CI: ?([0-9.]+)(?: to |-|–)([0-9.]+)\)'"
_CLASS = "CASE " + endpoint_sql("endpoint") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENDPOINT_PRIORS.items()) + " END"
SQL = {
    "endpoint_capture_priors": f"WITH {CH_SQL}, e AS (SELECT DISTINCT endpoint, indication FROM ch WHERE endpoint IS NOT NULL AND indication IS NOT NULL), p AS (SELECT *, {_P.format(_CLASS)} AS p FROM e) SELECT endpoint AS src, indication AS dst, round(1 + 2 * p, 6) AS alpha, round(1 + 2 * (1 - p), 6) AS beta FROM p WHERE p IS NOT NULL",
    "cocondition_fan": f"WITH {CH_SQL}, c AS (SELECT biology, indication, lower(trim(other)) AS other FROM (SELECT biology, indication, unnest(conditions) AS other FROM ch WHERE biology IS NOT NULL)), s AS (SELECT DISTINCT biology, indication AS other FROM c WHERE indication IS NOT NULL) SELECT biology, other, count(*) AS chains FROM c ANTI JOIN s USING (biology, other) WHERE other <> indication GROUP BY 1, 2",
    "first_target_mechanisms": f"WITH {CH_SQL}, c AS (SELECT * FROM ch WHERE compound IS NOT NULL AND target IS NOT NULL AND mechanism IS NOT NULL), f AS (SELECT compound, arg_min(target, chain_id) AS target FROM c GROUP BY 1), m AS (SELECT compound, target, mechanism, count(*) AS n FROM c JOIN f USING (compound, target) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY n DESC, mechanism) AS rank FROM m) SELECT * FROM r WHERE rank <= 8",
    "relevance_floor": f"WITH {CH_SQL}, c AS (SELECT DISTINCT biology, mechanism FROM ch WHERE biology IS NOT NULL AND mechanism IS NOT NULL), s AS (SELECT *, list_distinct(string_split_regex(biology, '[^a-z0-9]+')) AS a, list_distinct(string_split_regex(mechanism, '[^a-z0-9]+')) AS b FROM c), x AS (SELECT biology, mechanism, round(len(list_intersect(a, b)) / sqrt(len(b)), 6) AS score FROM s), r AS (SELECT *, max(score) OVER (PARTITION BY biology) AS best, row_number() OVER (PARTITION BY biology ORDER BY score DESC, mechanism) AS k FROM x) SELECT biology, mechanism, score FROM r WHERE k = 1 OR score > 0 AND score >= {MERGED_TAU} * best",
    "incremental_append": f"WITH {CH_SQL}, e AS (SELECT *, coalesce(year(annotated_at), 0) AS y FROM ce), f AS (SELECT y, count(*) AS new_edges FROM (SELECT src, dst, edge_type, min(y) AS y FROM e GROUP BY 1, 2, 3) GROUP BY 1), t AS (SELECT y, count(*) AS new_trials FROM (SELECT trial_id, min(y) AS y FROM e GROUP BY 1) GROUP BY 1) SELECT f.y AS year, new_edges, coalesce(new_trials, 0) AS new_trials FROM f LEFT JOIN t ON f.y = t.y",
    "description_index": f"WITH {CH_SQL} SELECT trial_id, " + ", ".join(f"arg_min({c}, chain_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("target", "mechanism", "biology", "population")) + " FROM ch GROUP BY 1",
    "applied_ledger": f"WITH {CH_SQL}, d AS (SELECT 'NCT' || regexp_extract(nct_id, '(\\d{{8}})', 1) AS trial_id FROM classifications WHERE regexp_matches(nct_id, '\\d{{8}}') GROUP BY 1 HAVING year(min(classified_at)) < 2024) SELECT DISTINCT trial_id FROM ch WHERE outcome <> 'unknown' AND trial_id NOT IN (SELECT trial_id FROM d)",
    "hazard_buckets": f"WITH x AS (SELECT extraction_id, results.effect_size AS s FROM extractions WHERE regexp_matches(results.effect_size, '^(Hazard Ratio|HR) [0-9.]+ ')), n AS (SELECT extraction_id, try_cast(nullif(regexp_extract(s, {_HR}, 1), '') AS DOUBLE) AS hr, try_cast(nullif(regexp_extract(s, {_HR}, 2), '') AS DOUBLE) AS low, try_cast(nullif(regexp_extract(s, {_HR}, 3), '') AS DOUBLE) AS high FROM x) SELECT extraction_id, hr, CASE WHEN low IS NULL OR high IS NULL OR (low <= 1 AND high >= 1) THEN 'ambiguous' WHEN hr >= 1.5 THEN 'strong_support' WHEN hr >= 1.25 THEN 'moderate_support' WHEN hr >= 1 THEN 'weak_support' WHEN hr <= 0.67 THEN 'strong_contradict' WHEN hr <= 0.8 THEN 'moderate_contradict' ELSE 'weak_contradict' END AS bucket FROM n WHERE hr IS NOT NULL",
    "overlap_gate": f"WITH {CH_SQL}, e AS (SELECT chain_id, year(annotated_at) AS y, src AS node FROM ce UNION SELECT chain_id, year(annotated_at), dst FROM ce), s AS (SELECT DISTINCT node, 1 AS seen FROM e WHERE y < 2024), p AS (SELECT chain_id, count(seen) AS k FROM e LEFT JOIN s USING (node) WHERE y >= 2024 GROUP BY 1) SELECT k, k >= 5 AS passes, count(*) AS chains FROM p GROUP BY 1, 2",
    "best_worst_trials": f"WITH {CH_SQL}, r AS (SELECT sponsor, outcome, trial_id, w, row_number() OVER (PARTITION BY sponsor, outcome ORDER BY w DESC NULLS LAST, trial_id DESC) AS k FROM ch WHERE sponsor IS NOT NULL AND outcome IN ('success', 'failure')) SELECT sponsor, outcome, trial_id, w FROM r WHERE k = 1",
    "seeded_sample": "SELECT nct_id, md5(nct_id || '#7') AS h FROM trials ORDER BY h LIMIT 20",
    "database_priors": f"WITH s AS (SELECT src_entity_id AS src, dst_entity_id AS dst, max(quality_score) AS s, count(*) AS k FROM evidence WHERE source_type = 'database' AND src_entity_id IS NOT NULL AND dst_entity_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT src, dst, 12 * least(1.0, greatest(0.2, k / 5.0))::DOUBLE AS n, CASE WHEN s >= 0.75 THEN 'strong_support' WHEN s >= 0.5 THEN 'moderate_support' WHEN s >= 0.25 THEN 'weak_support' WHEN s >= 0.05 THEN 'ambiguous' WHEN s IS NOT NULL THEN 'weak_contradict' ELSE 'ambiguous' END AS bucket FROM s) SELECT src, dst, bucket, round(1 + n * {_P.format('bucket')}, 6) AS alpha, round(1 + n * (1 - {_P.format('bucket')}), 6) AS beta FROM b",
    "edge_maturity": f"WITH {EV_SQL}, t AS (SELECT dst, sum(n_records) AS n, round(max(p) - min(p), 6) AS spread FROM (SELECT *, round(alpha / (alpha + beta), 6) AS p FROM bel WHERE edge_type = 'affects') GROUP BY 1) SELECT CASE WHEN n >= 30 THEN 'mature' WHEN n >= 15 THEN 'middle' ELSE 'sparse' END AS band, count(*) AS targets, round(avg(spread), 6) AS spread FROM t GROUP BY 1",
}
