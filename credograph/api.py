"""What a service would offer, as functions that give DataFrames; there is no server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.operators import attribution
from credograph.plans import attribution as attribution_queries
from credograph.plans import beliefs as belief_queries
from credograph.plans import graph as graph_queries
from credograph.plans.base import beliefs, chains, evidence_log
from credograph.sources.tables import table


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return belief_queries.graph_stats(spark, sf_dir)


def node(spark: SparkSession, sf_dir: str, entity_id: int) -> DataFrame:
    """The node's edges in either direction, each with its belief; the id is pushed to the scan."""
    b = beliefs(evidence_log(spark, sf_dir).where((F.col("src") == entity_id) | (F.col("dst") == entity_id)))
    names = table(spark, sf_dir, "ref_entities", "entity_id", "canonical_name")
    other = F.when(F.col("src") == entity_id, F.col("dst")).otherwise(F.col("src"))
    side = F.when(F.col("src") == entity_id, "out").otherwise("in")
    x = b.select(other.alias("entity_id"), side.alias("direction"), "edge_type", "alpha", "beta", "n_records", B.expected(F.col("alpha"), F.col("beta")).alias("p"))
    return x.join(names, "entity_id", "left")


def edge(spark: SparkSession, sf_dir: str, src: int, dst: int, edge_type: str) -> DataFrame:
    """The edge's evidence in order of time, with the belief after each record."""
    t = belief_queries.trajectory(spark, sf_dir)
    return t.where((F.col("src") == src) & (F.col("dst") == dst) & (F.col("edge_type") == edge_type)).orderBy("n_records")


def predict(spark: SparkSession, sf_dir: str, compound: str, indication: str) -> DataFrame:
    """All stated chains of the hypothesis, the least likely first; that one is the answer."""
    c = chains(spark, sf_dir).where((F.col("compound") == compound.lower().strip()) & F.array_contains("indications", indication.lower().strip())).select("chain_id", "target", "mechanism", "biology", "endpoint")
    return graph_queries.chain_prediction(spark, sf_dir).join(c, "chain_id").orderBy("efficacy", "chain_id")


def trial(spark: SparkSession, sf_dir: str, nct_id: str) -> DataFrame:
    """The trial's chains with outcome and weight."""
    return chains(spark, sf_dir).where(F.col("trial_id") == nct_id).select("chain_id", "compound", "target", "mechanism", "biology", "indication", "endpoint", "outcome", "w")


def annotate(spark: SparkSession, sf_dir: str, edges: DataFrame, most: int = 5) -> DataFrame:
    """The edges that an annotated trial's chains would move most, with their means before and after; nothing is written.

    ``edges`` has ``chain_id, src, dst, edge_type, outcome, branch, w``; its failures read the beliefs as they stand.
    """
    key = ["src", "dst", "edge_type"]
    now = attribution_queries.attributed_beliefs(spark, sf_dir).select(*key, "alpha", "beta").join(edges.select(*key).distinct(), key, "right")
    now = now.select(*key, F.coalesce("alpha", F.lit(1.0)).alias("a"), F.coalesce("beta", F.lit(1.0)).alias("b"))
    e = edges.join(now.select(*key, (F.col("a") / (F.col("a") + F.col("b"))).alias("r")), key)
    blame = attribution.explain_away(e).select(*key, (F.col("w") * F.col("share")).alias("n"), "p")
    own = attribution.responsibility(e).select(*key, F.col("w").alias("n"), "p")
    moved = attribution.success_updates(e).unionByName(blame).unionByName(own).groupBy(*key).agg(F.sum(F.col("n") * F.col("p")).alias("u"), F.sum(F.col("n") * (1 - F.col("p"))).alias("d"))
    x = now.join(moved, key).select(*key, (F.col("a") / (F.col("a") + F.col("b"))).alias("before"), ((F.col("a") + F.col("u")) / (F.col("a") + F.col("b") + F.col("u") + F.col("d"))).alias("after"))
    return x.orderBy(F.desc(F.abs(F.col("after") - F.col("before"))), *key).limit(most)
