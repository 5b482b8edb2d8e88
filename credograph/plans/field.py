"""Queries of the belief field.

A listed entity's vector is the one numbered by its id, modulo 500; a trial places an edge
at one target vector for each of its conditions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.operators import field
from credograph.plans.base import EV_SQL, beliefs, evidence_log
from credograph.sources.tables import table

KEY, N = ["src", "dst", "edge_type"], 500


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = evidence_log(spark, sf_dir).where("source_type = 'clinical_trial'").withColumn("trial", F.col("source_id"))
    place = F.sequence(F.lit(0), F.greatest(F.size(F.coalesce("conditions", F.array().cast("array<string>"))), F.lit(1)) - 1)
    at = log.select(*KEY, "trial", F.pmod("src", F.lit(N)).alias("s"), F.explode(place).alias("i")).withColumn("t", F.pmod(F.col("dst") * 7 + F.col("i"), F.lit(N)))
    return field.anchors(log, at), beliefs(log)


def _points(marginal: DataFrame) -> DataFrame:
    return marginal.select(*KEY, F.concat_ws("|", *KEY).alias("point"), F.pmod("src", F.lit(N)).alias("s"), F.pmod(F.col("dst") * 7, F.lit(N)).alias("t"))


def field_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each edge; their mass is that of its records."""
    placed, _ = _placed(spark, sf_dir)
    return placed.groupBy(*KEY).agg(F.count("*").alias("anchors"), F.countDistinct("s", "t").alias("places"), F.round(F.sum("up"), 6).alias("up"), F.round(F.sum("down"), 6).alias("down"))


def field_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, marginal = _placed(spark, sf_dir)
    x = field.query(_points(marginal), placed, table(spark, sf_dir, "embeddings", "vec_id", "embedding"), marginal)
    return x.select(*KEY, F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


def field_leave_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge's local belief without each of its trials, where there are several."""
    placed, marginal = _placed(spark, sf_dir)
    trials = placed.select(*KEY, F.col("trial").alias("without")).distinct()
    many = trials.groupBy(*KEY).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    points = _points(marginal).drop("point").join(trials.join(many, KEY, "left_semi"), KEY).withColumn("point", F.concat_ws("|", *KEY, "without"))
    x = field.query(points, placed, table(spark, sf_dir, "embeddings", "vec_id", "embedding"), marginal)
    return x.select(*KEY, "without", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


def field_against_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the geometric mean of its edges' local means, beside the softmin of local and of scalar means."""
    placed, marginal = _placed(spark, sf_dir)
    x = field.query(_points(marginal), placed, table(spark, sf_dir, "embeddings", "vec_id", "embedding"), marginal).withColumn("p", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    x = x.select(*KEY, "p").join(marginal.select(*KEY, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("q")), KEY)
    return x.groupBy("src").agg(F.round(field.chain_mean(F.col("p")), 4).alias("local_mean"), F.round(B.softmin(F.col("p")), 4).alias("local"), F.round(B.softmin(F.col("q")), 4).alias("scalar"), F.count("*").alias("edges"))


def interned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = field.interned(table(spark, sf_dir, "embeddings", "embedding"), "embedding")
    return x.agg(F.count("*").alias("vectors"), F.min(F.size("vector")).alias("axes"))


QUERIES = {f.__name__: f for f in (field_anchors, field_query, field_leave_out, field_against_scalar, interned_vectors)}

_F = f"""WITH {EV_SQL}, ct AS (SELECT * FROM ev WHERE source_type = 'clinical_trial'), m AS (SELECT src, dst, edge_type, 1 + sum(up)::DOUBLE AS a, 1 + sum(down)::DOUBLE AS b FROM ct GROUP BY ALL
), co AS (SELECT DISTINCT src, dst, edge_type, source_id, src % 500 AS s, (dst * 7 + i) % 500 AS t FROM (SELECT *, unnest(range(greatest(coalesce(len(conditions), 0), 1))) AS i FROM ct)
), kk AS (SELECT src, dst, edge_type, source_id, count(*) AS k FROM co GROUP BY ALL), ms AS (SELECT src, dst, edge_type, source_id, sum(up)::DOUBLE AS u, sum(down)::DOUBLE AS d FROM ct GROUP BY ALL
), an AS (SELECT src, dst, edge_type, source_id, s, t, u / k AS u, d / k AS d FROM ms JOIN kk USING (src, dst, edge_type, source_id) JOIN co USING (src, dst, edge_type, source_id)
), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT an.*, exp((list_cosine_similarity(a0.e, a1.e) + list_cosine_similarity(b0.e, b1.e) - 2) / 0.25) AS w
  FROM an JOIN v a0 ON a0.vec_id = an.src % 500 JOIN v a1 ON a1.vec_id = an.s JOIN v b0 ON b0.vec_id = (an.dst * 7) % 500 JOIN v b1 ON b1.vec_id = an.t
), q AS (SELECT src, dst, edge_type, 2 * any_value(a) / (any_value(a) + any_value(b)) + sum(w * u) AS alpha, 2 * any_value(b) / (any_value(a) + any_value(b)) + sum(w * d) AS beta FROM w JOIN m USING (src, dst, edge_type) GROUP BY ALL)"""
SQL = {
    "field_anchors": f"{_F} SELECT src, dst, edge_type, count(*) AS anchors, count(DISTINCT (s, t)) AS places, round(sum(u), 6) AS up, round(sum(d), 6) AS down FROM an GROUP BY ALL",
    "field_query": f"{_F} SELECT src, dst, edge_type, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM q",
    "field_leave_out": f"{_F}, tr AS (SELECT DISTINCT src, dst, edge_type, source_id FROM an), mn AS (SELECT src, dst, edge_type FROM tr GROUP BY ALL HAVING count(*) >= 2) SELECT m.src, m.dst, m.edge_type, tr.source_id AS without, round(2 * any_value(a) / (any_value(a) + any_value(b)) + sum(w * u), 6) AS alpha, round(2 * any_value(b) / (any_value(a) + any_value(b)) + sum(w * d), 6) AS beta FROM tr JOIN mn USING (src, dst, edge_type) JOIN m USING (src, dst, edge_type) JOIN w ON w.src = m.src AND w.dst = m.dst AND w.edge_type = m.edge_type AND w.source_id <> tr.source_id GROUP BY ALL",
    "field_against_scalar": f"{_F} SELECT src, round(exp(avg(ln(greatest(alpha / (alpha + beta), 1e-9)))), 4) AS local_mean, round(-0.1 * ln(avg(exp(-(alpha / (alpha + beta)) / 0.1))), 4) AS local, round(-0.1 * ln(avg(exp(-(a / (a + b)) / 0.1))), 4) AS scalar, count(*) AS edges FROM q JOIN m USING (src, dst, edge_type) GROUP BY 1",
    "interned_vectors": "SELECT count(DISTINCT list_transform(embedding, lambda x: round(x::DOUBLE, 6))) AS vectors, min(len(embedding))::INTEGER AS axes FROM embeddings",
}
