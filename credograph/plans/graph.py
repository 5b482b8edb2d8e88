"""Queries over the graph: prediction, traversal, bridges, coverage and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.operators import graph as G
from credograph.operators.attribution import success_updates
from credograph.plans.attribution import RT_SQL, _beliefs, _edges, attributed_beliefs
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, by_indication, chains, evidence_log, unpivot
from credograph.session import cut
from credograph.sources.tables import table

KEY = ["src", "dst", "edge_type"]


def _succeeded() -> Column:
    return F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)


def _chain_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = attributed_beliefs(spark, sf_dir)
    return unpivot(chains(spark, sf_dir), "chain_id").join(b, KEY)


def chain_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every chain's success probability with its bottleneck."""
    return G.chain_probabilities(_chain_beliefs(spark, sf_dir))


def compare_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds ranked within each indication by their best chain."""
    p = chain_prediction(spark, sf_dir).join(by_indication(chains(spark, sf_dir)).select("chain_id", "compound", "indication"), "chain_id").where("compound is not null")
    best = p.groupBy("indication", "compound").agg(F.max("efficacy").alias("efficacy"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("indication").orderBy(F.desc("efficacy"), "compound")))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that hold predictions back: too little data, a weak link, or a moderate one."""
    x = attributed_beliefs(spark, sf_dir)
    a, b = F.col("alpha"), F.col("beta")
    weak = F.round((1 - a / (a + b)) * B.trust(a + b - 2), 6)
    kind = F.when(a + b - 2 < 2, "DATA GAP").when(weak > 0.5, "WEAK LINK").when(weak >= 0.2, "MODERATE")
    return x.withColumns({"bottleneck": weak, "kind": kind}).where("kind is not null").select(*KEY, "bottleneck", "kind")


def best_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_of(beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'affects'"), "src", "dst")


def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound to mechanism over each target: paths of two hops, counted; ``all_simple_paths`` has the rest."""
    steps = unpivot(chains(spark, sf_dir), "trial_id").select("src", "dst", "edge_type").distinct()
    return G.two_hop_counts(steps, "affects", "modulates_via").select("via", F.col("sources").alias("compounds"), F.col("sinks").alias("mechanisms"), "paths")


def all_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All simple paths of up to six hops over every edge type, from compound to indication of the chains whose id divides by 50."""
    c = cut(chains(spark, sf_dir))
    asked = by_indication(c).where("chain_id % 50 = 0 and compound is not null").select(F.col("compound").alias("src"), F.col("indication").alias("tgt"))
    return G.simple_paths(unpivot(c, "chain_id"), asked)


def stated_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chains by signature, the first one kept."""
    roles = ["compound", "target", "mechanism", "biology", "indication", "endpoint"]
    return by_indication(chains(spark, sf_dir)).where("compound is not null").groupBy(*roles).agg(F.min("chain_id").alias("chain_id"), F.count("*").alias("n")).select("chain_id", "indication", "n")


def trial_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = unpivot(chains(spark, sf_dir), "trial_id").distinct()
    nodes = e.select("trial_id", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("trial_id").agg(F.count("*").alias("nodes"))
    return e.groupBy("trial_id").agg(F.count("*").alias("edges")).join(nodes, "trial_id")


def target_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other compounds share a target with each compound; counted, never paired."""
    b = evidence_log(spark, sf_dir).where("edge_type = 'affects'").select("src", "dst").distinct()
    n = b.groupBy("dst").agg((F.count("*") - 1).alias("others"))
    return b.join(n, "dst").groupBy("src").agg(F.count("*").alias("targets"), F.sum("others").alias("siblings"))


def ae_risk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten likeliest adverse-event edges of each compound; a report."""
    b = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'target_associated_ae' and alpha + beta - 2 >= 1")
    b = b.withColumn("p", B.expected(F.col("alpha"), F.col("beta"))).where("p >= 0.4").withColumn("score", F.round(F.col("p") * (F.col("alpha") + F.col("beta") - 2), 6))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))).where("rank <= 10").select("src", "dst", "p", "rank")


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed entity, of the smallest id, whose name is one of a compound's words."""
    names = table(spark, sf_dir, "ref_entities", "entity_id", "canonical_name").select("entity_id", F.lower("canonical_name").alias("name"))
    q = chains(spark, sf_dir).select("compound").distinct().where("compound is not null")
    parts = q.select("compound", F.explode(F.array_distinct(F.split("compound", r"[^\p{L}\p{Nd}]+"))).alias("name"))
    return parts.join(names, "name").groupBy("compound").agg(F.min("entity_id").alias("entity_id"))


def population_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations generalised to all subsets of their words of interest."""
    axes = ["metastatic", "relapsed", "refractory", "elderly", "advanced", "severe", "pediatric", "adults"]
    c = chains(spark, sf_dir).where("population is not null").select("chain_id", F.array_sort(F.array_intersect(F.split("population", " "), F.array(*[F.lit(a) for a in axes]))).alias("f")).where("size(f) > 0")
    return c.select("chain_id", F.explode(G.subsets("f")).alias("population_id")).groupBy("population_id").agg(F.count("*").alias("chains"))


def biology_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = by_indication(chains(spark, sf_dir)).where("biology is not null and outcome <> 'unknown'").withColumn("y", _succeeded())
    return G.bridges(u, "biology", "indication", "y")


def mechanism_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanism edges with evidence from at least two indications."""
    e = unpivot(by_indication(chains(spark, sf_dir)), "trial_id", "indication").where("edge_type = 'mechanism_affects'")
    return e.groupBy("src", "dst").agg(F.countDistinct("indication").alias("indications"), F.countDistinct("trial_id").alias("trials")).where("indications >= 2")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each type by the number of indications that use them."""
    e = unpivot(by_indication(chains(spark, sf_dir)), "indication").groupBy(*KEY).agg(F.countDistinct("indication").alias("k"))
    return e.groupBy("edge_type").agg(F.count("*").alias("edges"), F.sum(F.when(F.col("k") >= 2, 1).otherwise(0)).alias("shared"), F.max("k").alias("most"))


def chain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each trial's chain edges had a belief before failures were counted."""
    e = _edges(spark, sf_dir)
    touched = _beliefs(success_updates(e)).select(*KEY, F.lit(1).alias("t"))
    per = e.join(touched, KEY, "left").groupBy("trial_id").agg(F.count("*").alias("n"), F.count("t").alias("k"))
    return per.groupBy(F.when(F.col("k") == 0, "zero").when(F.col("k") < F.col("n"), "partial").otherwise("full").alias("coverage")).agg(F.count("*").alias("trials"))


# Edges that a node of each role has to have, into it or out of it.
CONTRACT = [
    ("compound", "out", "affects"), ("target", "in", "affects"), ("target", "out", "modulates_via"), ("mechanism", "in", "modulates_via"), ("mechanism", "out", "mechanism_affects"), ("biology", "in", "mechanism_affects"),
    ("biology", "out", "biology_drives"), ("biology", "out", "reflects_biology"), ("endpoint", "in", "reflects_biology"), ("endpoint", "out", "endpoint_captures"), ("indication", "in", "biology_drives"),
]


def completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the chains that lack an edge their role calls for, by role, side and edge type."""
    c = cut(chains(spark, sf_dir))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("node")) for r in ("compound", "target", "mechanism", "biology", "endpoint")])
    nodes = c.select(F.inline(F.concat(roles, F.transform("indications", lambda i: F.struct(F.lit("indication").alias("role"), i.alias("node")))))).where("node is not null").distinct()
    wanted = nodes.join(F.broadcast(spark.createDataFrame(CONTRACT, "role string, side string, edge_type string")), "role")
    e = unpivot(c, "chain_id")
    there = e.select(F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("src").alias("node"), "edge_type"), F.struct(F.lit("in").alias("side"), F.col("dst").alias("node"), "edge_type"))).alias("x")).select("x.*").distinct()
    return wanted.join(there, ["side", "node", "edge_type"], "left_anti").select("role", "node", F.concat_ws(" ", "side", "edge_type").alias("lacks"))


def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects with a reason: chains with a missing role, a non-positive weight, or a node in two roles."""
    c = chains(spark, sf_dir)
    rules = {"no compound": F.col("compound").isNull(), "no target": F.col("target").isNull(), "no mechanism": F.col("mechanism").isNull(), "no biology": F.col("biology").isNull(), "no indication": F.col("indication").isNull(), "same target and mechanism": F.coalesce(F.col("target") == F.col("mechanism"), F.lit(False))}
    return c.select("chain_id", F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))).alias("reason"))


def provenance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the evidence of each edge comes from: trials of one condition, of several, or databases."""
    log = evidence_log(spark, sf_dir)
    x = log.groupBy(*KEY).agg(F.count_if(F.col("source_type") == "clinical_trial").alias("clinical"), F.count_if(F.col("source_type") == "database").alias("database"), F.countDistinct(F.get("conditions", F.lit(0))).alias("conditions"))
    return x.withColumn("kind", F.when(F.col("clinical") == 0, "no trial").when(F.col("conditions") > 1, "cross").otherwise("same"))


def group_rate_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = by_indication(chains(spark, sf_dir)).where("outcome in ('success', 'failure')").select("chain_id", "indication", _succeeded().alias("y"))
    return G.leave_one_out_rate(c, "indication", "y")


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges a growing number of trials, in order of their ids, would cover."""
    e = unpivot(chains(spark, sf_dir), "trial_id").groupBy(*KEY).agg(F.min("trial_id").alias("first"))
    per = e.groupBy(F.col("first").alias("trial_id"), "edge_type").agg(F.count("*").alias("n"))
    return G.running_total(per, "edge_type", "trial_id", "n", "edges").select("trial_id", "edge_type", "edges")


def degree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = unpivot(chains(spark, sf_dir), "chain_id").select(*KEY).distinct()
    d = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return d.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


QUERIES = {f.__name__: f for f in (chain_prediction, compare_hypotheses, suggestions, best_target, simple_paths, all_simple_paths, stated_chains, trial_subgraph, target_siblings, ae_risk_retrieval, name_lookup, population_subsets, biology_bridges, mechanism_bridges, census, chain_coverage, completeness_audit, integrity_audit, provenance_split, group_rate_baseline, learning_curve, degree_view)}

AT_SQL = RT_SQL + """, au AS (SELECT * FROM su UNION ALL SELECT src, dst, edge_type, w * share, p FROM xa UNION ALL SELECT src, dst, edge_type, w, p FROM rs
), ab AS (SELECT src, dst, edge_type, 1 + sum(round(n * p, 6)::DECIMAL(18,6))::DOUBLE AS alpha, 1 + sum(round(n * (1 - p), 6)::DECIMAL(18,6))::DOUBLE AS beta FROM au GROUP BY ALL
), cb AS (SELECT ce.chain_id, ce.edge_type, alpha / (alpha + beta) AS p, round((1 - alpha / (alpha + beta)) * least(1.0, ln(greatest(alpha + beta - 2, 0) + 1) / ln(50)), 6) AS weak FROM ce JOIN ab USING (src, dst, edge_type) WHERE alpha + beta > 2
), cr AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY weak DESC, round(p, 6), edge_type) AS k FROM cb
), cp AS (SELECT chain_id, round(-0.1 * ln(avg(exp(-greatest(p, 1e-12) / 0.1))), 6) AS efficacy, max(weak) AS bottleneck, max(CASE WHEN k = 1 THEN edge_type END) AS bottleneck_edge, count(*) AS n_edges FROM cr GROUP BY 1)"""
_AXES = "['metastatic', 'relapsed', 'refractory', 'elderly', 'advanced', 'severe', 'pediatric', 'adults']"
_T = "WITH "
SQL = {
    "chain_prediction": f"{_T}{AT_SQL} SELECT * FROM cp",
    "compare_hypotheses": f"{_T}{AT_SQL}, b AS (SELECT indication, compound, max(efficacy) AS efficacy FROM cp JOIN ci USING (chain_id) WHERE compound IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY indication ORDER BY efficacy DESC, compound) AS rank FROM b",
    "suggestions": f"{_T}{AT_SQL}, x AS (SELECT src, dst, edge_type, alpha, beta, round((1 - alpha / (alpha + beta)) * least(1.0, ln(greatest(alpha + beta - 2, 0) + 1) / ln(50)), 6) AS bottleneck FROM ab), y AS (SELECT src, dst, edge_type, bottleneck, CASE WHEN alpha + beta - 2 < 2 THEN 'DATA GAP' WHEN bottleneck > 0.5 THEN 'WEAK LINK' WHEN bottleneck >= 0.2 THEN 'MODERATE' END AS kind FROM x) SELECT * FROM y WHERE kind IS NOT NULL",
    "best_target": f"{_T}{EV_SQL}, s AS (SELECT src, dst, round(alpha / (alpha + beta) * (alpha + beta - 1), 6) AS score FROM bel WHERE edge_type = 'affects'), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst DESC) AS k FROM s) SELECT src, dst, score FROM r WHERE k = 1",
    "simple_paths": f"{_T}{CH_SQL}, s AS (SELECT DISTINCT src, dst, edge_type FROM ce) SELECT a.dst AS via, count(DISTINCT a.src) AS compounds, count(DISTINCT b.dst) AS mechanisms, count(*) AS paths FROM s a JOIN s b ON a.dst = b.src WHERE a.edge_type = 'affects' AND b.edge_type = 'modulates_via' AND a.src <> b.dst GROUP BY 1",
    "stated_chains": f"{_T}{CH_SQL} SELECT min(chain_id) AS chain_id, indication, count(*) AS n FROM ci WHERE compound IS NOT NULL GROUP BY compound, target, mechanism, biology, indication, endpoint",
    "trial_subgraph": f"{_T}{CH_SQL}, e AS (SELECT DISTINCT trial_id, src, dst, edge_type FROM ce), n AS (SELECT trial_id, src AS node FROM e UNION SELECT trial_id, dst FROM e), k AS (SELECT trial_id, count(*) AS nodes FROM n GROUP BY 1) SELECT trial_id, count(*) AS edges, any_value(nodes) AS nodes FROM e JOIN k USING (trial_id) GROUP BY 1",
    "target_siblings": f"{_T}{EV_SQL}, b AS (SELECT DISTINCT src, dst FROM ev WHERE edge_type = 'affects'), n AS (SELECT dst, count(*) - 1 AS others FROM b GROUP BY 1) SELECT src, count(*) AS targets, sum(others)::BIGINT AS siblings FROM b JOIN n USING (dst) GROUP BY 1",
    "ae_risk_retrieval": f"{_T}{EV_SQL}, p AS (SELECT src, dst, round(alpha / (alpha + beta), 6) AS p, alpha + beta - 2 AS s FROM bel WHERE edge_type = 'target_associated_ae' AND alpha + beta - 2 >= 1), r AS (SELECT src, dst, p, row_number() OVER (PARTITION BY src ORDER BY round(p * s, 6) DESC, dst) AS rank FROM p WHERE p >= 0.4) SELECT * FROM r WHERE rank <= 10",
    "name_lookup": f"{_T}{CH_SQL}, q AS (SELECT DISTINCT compound FROM ch WHERE compound IS NOT NULL), p AS (SELECT compound, unnest(list_distinct(string_split_regex(compound, '[^\\p{{L}}\\p{{Nd}}]+'))) AS name FROM q) SELECT compound, min(entity_id) AS entity_id FROM p JOIN ref_entities ON name = lower(canonical_name) GROUP BY 1",
    "population_subsets": f"{_T}{CH_SQL}, f AS (SELECT chain_id, list_sort(list_filter({_AXES}, lambda a: list_contains(string_split(population, ' '), a))) AS f FROM ch WHERE population IS NOT NULL), m AS (SELECT chain_id, f, unnest(range(1, (1 << len(f)))) AS m FROM f WHERE len(f) > 0), s AS (SELECT chain_id, array_to_string(list_filter(f, lambda x, i: ((m >> (i - 1)::BIGINT) & 1) = 1), '__') AS population_id FROM m) SELECT population_id, count(*) AS chains FROM s GROUP BY 1",
    "biology_bridges": f"{_T}{CH_SQL}, p AS (SELECT biology, indication, avg(CASE outcome WHEN 'success' THEN 1.0 ELSE 0.0 END) AS m, count(*) AS n FROM ci WHERE biology IS NOT NULL AND outcome <> 'unknown' GROUP BY 1, 2) SELECT biology, count(*) AS sides, sum(n)::BIGINT AS uses, round(max(m) - min(m), 6) AS spread, arg_max(indication, (round(m, 9), indication)) AS high, arg_min(indication, (round(m, 9), indication)) AS low FROM p GROUP BY 1 HAVING count(*) >= 2",
    "mechanism_bridges": f"{_T}{CH_SQL} SELECT src, dst, count(DISTINCT indication) AS indications, count(DISTINCT trial_id) AS trials FROM cei WHERE edge_type = 'mechanism_affects' GROUP BY 1, 2 HAVING count(DISTINCT indication) >= 2",
    "census": f"{_T}{CH_SQL}, k AS (SELECT src, dst, edge_type, count(DISTINCT indication) AS k FROM cei GROUP BY ALL) SELECT edge_type, count(*) AS edges, sum(CASE WHEN k >= 2 THEN 1 ELSE 0 END)::BIGINT AS shared, max(k) AS most FROM k GROUP BY 1",
    "chain_coverage": f"{_T}{RT_SQL}, p AS (SELECT trial_id, count(*) AS n, count(sb.n_records) AS k FROM re LEFT JOIN sb USING (src, dst, edge_type) GROUP BY 1) SELECT CASE WHEN k = 0 THEN 'zero' WHEN k < n THEN 'partial' ELSE 'full' END AS coverage, count(*) AS trials FROM p GROUP BY 1",
    "completeness_audit": f"{_T}{CH_SQL}, n AS (SELECT 'compound' AS role, compound AS node FROM ch UNION SELECT 'target', target FROM ch UNION SELECT 'mechanism', mechanism FROM ch UNION SELECT 'biology', biology FROM ch UNION SELECT 'endpoint', endpoint FROM ch UNION SELECT 'indication', indication FROM ci), k(role, side, t) AS (VALUES ('compound', 'out', 'affects'), ('target', 'in', 'affects'), ('target', 'out', 'modulates_via'), ('mechanism', 'in', 'modulates_via'), ('mechanism', 'out', 'mechanism_affects'), ('biology', 'in', 'mechanism_affects'), ('biology', 'out', 'biology_drives'), ('biology', 'out', 'reflects_biology'), ('endpoint', 'in', 'reflects_biology'), ('endpoint', 'out', 'endpoint_captures'), ('indication', 'in', 'biology_drives')) SELECT n.role, node, side || ' ' || t AS lacks FROM n JOIN k ON k.role = n.role WHERE node IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ce WHERE edge_type = t AND ((side = 'out' AND src = node) OR (side = 'in' AND dst = node)))",
    "integrity_audit": f"{_T}{CH_SQL}, r AS (SELECT chain_id, unnest([CASE WHEN compound IS NULL THEN 'no compound' END, CASE WHEN target IS NULL THEN 'no target' END, CASE WHEN mechanism IS NULL THEN 'no mechanism' END, CASE WHEN biology IS NULL THEN 'no biology' END, CASE WHEN indication IS NULL THEN 'no indication' END, CASE WHEN target = mechanism THEN 'same target and mechanism' END]) AS reason FROM ch) SELECT * FROM r WHERE reason IS NOT NULL",
    "provenance_split": f"{_T}{EV_SQL}, x AS (SELECT src, dst, edge_type, count(*) FILTER (WHERE source_type = 'clinical_trial') AS clinical, count(*) FILTER (WHERE source_type = 'database') AS database, count(DISTINCT conditions[1]) AS conditions FROM ev GROUP BY ALL) SELECT *, CASE WHEN clinical = 0 THEN 'no trial' WHEN conditions > 1 THEN 'cross' ELSE 'same' END AS kind FROM x",
    "group_rate_baseline": f"{_T}{CH_SQL}, y AS (SELECT chain_id, indication, CASE outcome WHEN 'success' THEN 1.0::DOUBLE ELSE 0 END AS y FROM ci WHERE outcome IN ('success', 'failure')) SELECT *, round((sum(y) OVER w - y + 1.0) / (count(*) OVER w - 1 + 2.0), 6) AS rate FROM y WINDOW w AS (PARTITION BY indication)",
    "learning_curve": f"{_T}{CH_SQL}, f AS (SELECT src, dst, edge_type, min(trial_id) AS trial_id FROM ce GROUP BY ALL), p AS (SELECT trial_id, edge_type, count(*) AS n FROM f GROUP BY 1, 2) SELECT trial_id, edge_type, sum(n) OVER (PARTITION BY edge_type ORDER BY trial_id)::BIGINT AS edges FROM p",
    "degree_view": f"{_T}{CH_SQL}, e AS (SELECT DISTINCT src, dst, edge_type FROM ce), d AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM d GROUP BY 1",
}
