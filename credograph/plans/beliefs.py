"""Queries of the belief algebra: aggregates, exclusions, trajectories, pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.functions import text as X
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, chains, evidence_log
from credograph.plans.vocabulary import _DIR
from credograph.sources.tables import table

KEY = ["src", "dst", "edge_type"]
CONDITION, OFF_CONTEXT = "melanoma", 0.3
CONFIGS = [("base", 1.0, 1.0), ("half_clinical", 0.5, 1.0), ("no_genetic", 1.0, 0.0), ("double_clinical", 2.0, 1.0)]
FAMILY = 4  #: listed targets come in families of four


def edge_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("alpha"), F.col("beta")
    return beliefs(evidence_log(spark, sf_dir)).withColumns({"p": B.expected(a, b), "strength": B.strength(a, b), "variance": B.variance(a, b), "conflict": B.conflict(a, b), "trust": F.round(B.trust(a + b - 2), 6)})


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, evidence and conflicting edges by type and in all."""
    b = beliefs(evidence_log(spark, sf_dir)).withColumn("conflict", B.conflict(F.col("alpha"), F.col("beta")))
    agg = [F.count("*").alias("edges"), F.sum("n_records").alias("records"), F.sum(F.when(F.col("conflict") > 5, 1).otherwise(0)).alias("conflicting")]
    return b.rollup("edge_type").agg(*agg).withColumn("edge_type", F.coalesce("edge_type", F.lit("all")))


def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "ref_entities")
    return n.groupBy("entity_type").agg(F.count("*").alias("nodes"), F.sum(F.size(F.coalesce("synonyms", F.array().cast("array<string>")))).cast("long").alias("names"))


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-neighbours of each node over ``affects`` edges with their strongest belief."""
    b = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'affects'").withColumn("p", B.expected(F.col("alpha"), F.col("beta")))
    return b.groupBy("src").agg(F.count("*").alias("n_out"), F.max_by("dst", F.struct("p", "dst")).alias("top_dst"), F.max("p").alias("top_p"))


def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five edges that moved furthest from even odds; a report."""
    b = beliefs(evidence_log(spark, sf_dir)).withColumn("change", F.round(F.abs(F.col("alpha") / (F.col("alpha") + F.col("beta")) - 0.5), 6))
    return b.orderBy(F.desc("change"), *KEY).limit(5).select(*KEY, "change")


def tissue_conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from elsewhere count less: the context is the trial's condition."""
    here = F.coalesce(F.array_contains("conditions", CONDITION), F.lit(False))
    log = evidence_log(spark, sf_dir).withColumns({c: F.col(c) * F.when(here, 1.0).otherwise(OFF_CONTEXT).cast("decimal(3,2)") for c in ("up", "down")})
    return beliefs(log)


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's belief without each of its trials; (1, 1) where too little is left."""
    per = evidence_log(spark, sf_dir).where("source_type = 'clinical_trial'").groupBy(*KEY, "source_id").agg(F.sum("up").alias("u"), F.sum("down").alias("d"))
    w = Window.partitionBy(*KEY)
    a, b = 1 + (F.sum("u").over(w) - F.col("u")).cast("double"), 1 + (F.sum("d").over(w) - F.col("d")).cast("double")
    low = (a < 1) | (b < 1)
    return per.select(*KEY, "source_id", F.when(low, 1.0).otherwise(a).alias("alpha"), F.when(low, 1.0).otherwise(b).alias("beta"))


def retune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weightings in one pass: a column pair for each, then rows."""
    log = evidence_log(spark, sf_dir)
    aggs = []
    for name, clinical, genetic in CONFIGS:
        f = F.when(F.col("source_type") == "clinical_trial", clinical).when(F.col("source_type") == "genetic", genetic).otherwise(1.0)
        aggs += [F.sum(F.col(c) * f.cast("decimal(3,2)")).alias(f"{name}_{c}") for c in ("up", "down")]
    one = log.groupBy(*KEY).agg(*aggs)
    rows = [F.struct(F.lit(n).alias("config"), F.greatest(1 + F.col(f"{n}_up").cast("double"), F.lit(1e-6)).alias("alpha"), F.greatest(1 + F.col(f"{n}_down").cast("double"), F.lit(1e-6)).alias("beta")) for n, _, _ in CONFIGS]
    return one.select(*KEY, F.inline(F.array(*rows)))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running belief of each edge in order of time."""
    w = Window.partitionBy(*KEY).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    run = evidence_log(spark, sf_dir).select(*KEY, "seq", (1 + F.sum("up").over(w).cast("double")).alias("alpha"), (1 + F.sum("down").over(w).cast("double")).alias("beta"), F.count("*").over(w).alias("n_records"))
    return run.withColumn("p", B.expected(F.col("alpha"), F.col("beta")))


def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier records of an edge come from the same kind of source."""
    w = Window.partitionBy(*KEY, "source_type").orderBy("ts", "seq")
    return evidence_log(spark, sf_dir).select("seq", (F.row_number().over(w) - 1).cast("long").alias("earlier"))


def family_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges pooled over levels: all edges of the type, those into the target's family, the edge itself."""
    log = evidence_log(spark, sf_dir).withColumn("family", F.floor((F.col("dst") - 5001) / FAMILY))
    top = beliefs(log, "src", "edge_type").select("src", "edge_type", F.col("alpha").alias("a0"), F.col("beta").alias("b0"))
    mid = beliefs(log, "src", "edge_type", "family").select("src", "edge_type", "family", F.col("alpha").alias("a1"), F.col("beta").alias("b1"))
    low = beliefs(log, *KEY, "family")
    x = low.join(mid, ["src", "edge_type", "family"]).join(top, ["src", "edge_type"])
    a, b = B.pooled([(F.col("a0"), F.col("b0")), (F.col("a1"), F.col("b1")), (F.col("alpha"), F.col("beta"))])
    return x.select(*KEY, F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


def direction_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belief as a chain that suppresses its target sees it: without records of trials that activate theirs, backed off to the whole.

    A trial's direction is that of most of its mechanisms; records without one stay.
    """
    d = chains(spark, sf_dir).select(F.col("trial_id").alias("source_id"), X.direction(F.col("mechanism")).alias("d")).groupBy("source_id").agg((F.count_if(F.col("d") == "agonist") > F.count_if(F.col("d") == "antagonist")).alias("opposite"))
    log = evidence_log(spark, sf_dir).join(d, "source_id", "left").withColumn("opposite", F.coalesce("opposite", F.lit(False)))
    x = log.groupBy(*KEY).agg(*[F.sum(c).cast("double").alias(c) for c in ("up", "down")], *[F.sum(F.when(F.col("opposite"), F.col(c)).otherwise(0)).cast("double").alias(f"o_{c}") for c in ("up", "down")])
    whole = (1 + F.col("up"), 1 + F.col("down"))
    child = [F.greatest(1 + F.col(c) - F.col(f"o_{c}"), F.lit(1e-6)) for c in ("up", "down")]
    a, b = B.pooled([whole, (child[0], child[1])])
    return x.select(*KEY, F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"))


def capped_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = beliefs(evidence_log(spark, sf_dir))
    a, b = F.col("alpha"), F.col("beta")
    return x.select(*KEY, F.round(B.capped(a, a, b), 6).alias("alpha"), F.round(B.capped(b, a, b), 6).alias("beta"))


def bucket_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = evidence_log(spark, sf_dir)
    return log.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", B.flipped(F.col("bucket")).alias("flipped"), "n")


def modulation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket of each edge update of a classification, its support read as direction and confidence."""
    c = table(spark, sf_dir, "classifications", "confidence_overall", "edges_to_update").select(F.col("confidence_overall").alias("c"), F.inline("edges_to_update"))
    direction = F.when(F.col("support").isin("strong", "moderate"), "amplifies").when(F.col("support") == "weak", "suppresses").otherwise("neutral")
    return c.withColumn("bucket", B.modulation_bucket(direction, F.col("c"))).groupBy("edge_type", "bucket").agg(F.count("*").alias("n"))


def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs as they stood at the end of each year."""
    y = evidence_log(spark, sf_dir).groupBy(*KEY, F.year("ts").alias("year")).agg(F.sum("up").alias("u"), F.sum("down").alias("d"))
    w = Window.partitionBy(*KEY).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return y.select(*KEY, "year", (1 + F.sum("u").over(w).cast("double")).alias("alpha"), (1 + F.sum("d").over(w).cast("double")).alias("beta"))


def belief_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the beliefs by type and the share with evidence worth two trials."""
    b = beliefs(evidence_log(spark, sf_dir)).withColumn("p", B.expected(F.col("alpha"), F.col("beta")))
    q = [F.round(F.percentile("p", x), 6).alias(f"q{int(100 * x)}") for x in (0.25, 0.5, 0.75)]
    return b.groupBy("edge_type").agg(*q, F.round(F.avg(F.when(F.col("alpha") + F.col("beta") - 2 >= 2, 1.0).otherwise(0.0)), 6).alias("evidenced"))


QUERIES = {f.__name__: f for f in (edge_beliefs, graph_stats, node_stats, neighbors, top_movers, tissue_conditioned, leave_one_out, retune_grid, trajectory, cluster_order, family_backoff, direction_filtered, capped_beliefs, bucket_flips, modulation_buckets, point_in_time, belief_calibration)}

_W = "WITH " + EV_SQL
_P = "round(alpha / (alpha + beta), 6)"
_POOL = """
SELECT src, dst, edge_type, round(CASE WHEN {a} + {b} > 20 THEN {a} * (20 / ({a} + {b})) ELSE {a} END + greatest({x} - 1, 0), 6) AS alpha,
  round(CASE WHEN {a} + {b} > 20 THEN {b} * (20 / ({a} + {b})) ELSE {b} END + greatest({y} - 1, 0), 6) AS beta FROM {t}"""
SQL = {
    "edge_beliefs": f"{_W} SELECT *, {_P} AS p, round(alpha + beta - 2, 6) AS strength, round(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)), 6) AS variance, CASE WHEN alpha + beta - 2 <= 0 THEN 0 ELSE round((alpha + beta - 2) * (1 - 2 * abs(alpha / (alpha + beta) - 0.5)), 6) END AS conflict, round(least(1.0, ln(greatest(alpha + beta - 2, 0) + 1) / ln(50)), 6) AS trust FROM bel",
    "graph_stats": f"{_W}, c AS (SELECT *, CASE WHEN alpha + beta - 2 <= 0 THEN 0 ELSE round((alpha + beta - 2) * (1 - 2 * abs(alpha / (alpha + beta) - 0.5)), 6) END AS conflict FROM bel) SELECT coalesce(edge_type, 'all') AS edge_type, count(*) AS edges, sum(n_records)::BIGINT AS records, sum(CASE WHEN conflict > 5 THEN 1 ELSE 0 END)::BIGINT AS conflicting FROM c GROUP BY ROLLUP (edge_type)",
    "node_stats": "SELECT entity_type, count(*) AS nodes, sum(coalesce(len(synonyms), 0))::BIGINT AS names FROM ref_entities GROUP BY 1",
    "neighbors": f"{_W}, p AS (SELECT src, dst, {_P} AS p FROM bel WHERE edge_type = 'affects'), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst DESC) AS k, count(*) OVER (PARTITION BY src) AS n FROM p) SELECT src, n AS n_out, dst AS top_dst, p AS top_p FROM r WHERE k = 1",
    "top_movers": f"{_W} SELECT src, dst, edge_type, round(abs(alpha / (alpha + beta) - 0.5), 6) AS change FROM bel ORDER BY change DESC, src, dst, edge_type LIMIT 5",
    "tissue_conditioned": f"{_W}, f AS (SELECT *, CASE WHEN coalesce(list_contains(conditions, '{CONDITION}'), false) THEN 1.0::DECIMAL(3,2) ELSE {OFF_CONTEXT}::DECIMAL(3,2) END AS k FROM ev) SELECT src, dst, edge_type, 1 + sum(up * k)::DOUBLE AS alpha, 1 + sum(down * k)::DOUBLE AS beta, count(*) AS n_records FROM f GROUP BY ALL",
    "leave_one_out": f"{_W}, c AS (SELECT src, dst, edge_type, source_id, sum(up) AS u, sum(down) AS d FROM ev WHERE source_type = 'clinical_trial' GROUP BY ALL), s AS (SELECT src, dst, edge_type, sum(u) AS su, sum(d) AS sd FROM c GROUP BY ALL), l AS (SELECT c.src, c.dst, c.edge_type, source_id, 1 + (su - u)::DOUBLE AS a, 1 + (sd - d)::DOUBLE AS b FROM c JOIN s ON c.src = s.src AND c.dst = s.dst AND c.edge_type = s.edge_type) SELECT src, dst, edge_type, source_id, CASE WHEN a < 1 OR b < 1 THEN 1 ELSE a END AS alpha, CASE WHEN a < 1 OR b < 1 THEN 1 ELSE b END AS beta FROM l",
    "retune_grid": f"{_W}, cfg(config, c, g) AS (VALUES " + ", ".join(f"('{n}', {c}::DECIMAL(3,2), {g}::DECIMAL(3,2))" for n, c, g in CONFIGS) + "), x AS (SELECT ev.*, config, CASE source_type WHEN 'clinical_trial' THEN c WHEN 'genetic' THEN g ELSE 1.0::DECIMAL(3,2) END AS k FROM ev, cfg) SELECT src, dst, edge_type, config, greatest(1 + sum(up * k)::DOUBLE, 1e-6) AS alpha, greatest(1 + sum(down * k)::DOUBLE, 1e-6) AS beta FROM x GROUP BY ALL",
    "trajectory": f"{_W}, r AS (SELECT src, dst, edge_type, seq, 1 + (sum(up) OVER w)::DOUBLE AS alpha, 1 + (sum(down) OVER w)::DOUBLE AS beta, count(*) OVER w AS n_records FROM ev WINDOW w AS (PARTITION BY src, dst, edge_type ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) SELECT *, {_P} AS p FROM r",
    "cluster_order": f"{_W} SELECT a.seq, count(b.seq) AS earlier FROM ev a LEFT JOIN ev b ON a.src = b.src AND a.dst = b.dst AND a.edge_type = b.edge_type AND a.source_type = b.source_type AND (b.ts < a.ts OR b.ts = a.ts AND b.seq < a.seq) GROUP BY 1",
    "family_backoff": f"{_W}, f AS (SELECT *, floor((dst - 5001) / 4.0) AS family FROM ev), t0 AS (SELECT src, edge_type, 1 + sum(up)::DOUBLE AS a0, 1 + sum(down)::DOUBLE AS b0 FROM f GROUP BY ALL), t1 AS (SELECT src, edge_type, family, 1 + sum(up)::DOUBLE AS a1, 1 + sum(down)::DOUBLE AS b1 FROM f GROUP BY ALL), t2 AS (SELECT src, dst, edge_type, family, 1 + sum(up)::DOUBLE AS a2, 1 + sum(down)::DOUBLE AS b2 FROM f GROUP BY ALL), j AS (SELECT * FROM t2 JOIN t1 USING (src, edge_type, family) JOIN t0 USING (src, edge_type)), k AS (SELECT *, a0 * least(1, 20 / (a0 + b0)) + greatest(a1 - 1, 0) AS pa, b0 * least(1, 20 / (a0 + b0)) + greatest(b1 - 1, 0) AS pb FROM j)" + _POOL.format(a="pa", b="pb", x="a2", y="b2", t="k"),
    "direction_filtered": f"WITH {CH_SQL}, {EV_SQL}, td AS (SELECT trial_id, count(*) FILTER (WHERE {_DIR.format('mechanism')} > 0) > count(*) FILTER (WHERE {_DIR.format('mechanism')} < 0) AS opposite FROM ch GROUP BY 1), ed AS (SELECT ev.*, coalesce(opposite, false) AS opposite FROM ev LEFT JOIN td ON trial_id = source_id), s AS (SELECT src, dst, edge_type, 1 + sum(up)::DOUBLE AS a, 1 + sum(down)::DOUBLE AS b, greatest(1 + sum(up)::DOUBLE - coalesce(sum(up) FILTER (WHERE opposite), 0)::DOUBLE, 1e-6) AS x, greatest(1 + sum(down)::DOUBLE - coalesce(sum(down) FILTER (WHERE opposite), 0)::DOUBLE, 1e-6) AS y FROM ed GROUP BY ALL)" + _POOL.format(a="a", b="b", x="x", y="y", t="s"),
    "capped_beliefs": f"{_W} SELECT src, dst, edge_type, round(alpha * least(1, 20 / (alpha + beta)), 6) AS alpha, round(beta * least(1, 20 / (alpha + beta)), 6) AS beta FROM bel",
    "bucket_flips": f"{_W} SELECT bucket, CASE WHEN bucket LIKE '%support' THEN replace(bucket, 'support', 'contradict') WHEN bucket LIKE '%contradict' THEN replace(bucket, 'contradict', 'support') ELSE bucket END AS flipped, count(*) AS n FROM ev GROUP BY 1, 2",
    "modulation_buckets": "WITH m AS (SELECT confidence_overall AS c, unnest(edges_to_update) AS u FROM classifications), x AS (SELECT u.edge_type AS edge_type, CASE WHEN u.support IN ('strong', 'moderate') THEN 'support' WHEN u.support = 'weak' THEN 'contradict' END AS side, CASE WHEN c >= 0.85 THEN 'strong' WHEN c >= 0.7 THEN 'moderate' WHEN c >= 0.55 THEN 'weak' END AS grade FROM m) SELECT edge_type, CASE WHEN side IS NULL OR grade IS NULL THEN 'ambiguous' ELSE grade || '_' || side END AS bucket, count(*) AS n FROM x GROUP BY 1, 2",
    "point_in_time": f"{_W}, y AS (SELECT src, dst, edge_type, year(ts) AS year, sum(up) AS u, sum(down) AS d FROM ev GROUP BY ALL) SELECT a.src, a.dst, a.edge_type, a.year, 1 + sum(b.u)::DOUBLE AS alpha, 1 + sum(b.d)::DOUBLE AS beta FROM y a JOIN y b ON a.src = b.src AND a.dst = b.dst AND a.edge_type = b.edge_type AND b.year <= a.year GROUP BY ALL",
    "belief_calibration": f"{_W}, p AS (SELECT *, {_P} AS p FROM bel) SELECT edge_type, round(quantile_cont(p, 0.25), 6) AS q25, round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.75), 6) AS q75, round(avg(CASE WHEN alpha + beta - 2 >= 2 THEN 1.0 ELSE 0.0 END), 6) AS evidenced FROM p GROUP BY 1",
}
