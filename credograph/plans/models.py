"""Queries of sampling, recovery, baselines by learning, ladders and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.functions import text as X
from credograph.operators import graph as G
from credograph.operators import packed, simulation
from credograph.operators.statistics import fold
from credograph.plans.attribution import attributed_beliefs, labels
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, chains, evidence_log, unpivot
from credograph.plans.statistics import FOLDS
from credograph.plans.vocabulary import area_sql, disease_sql, parent_sql
from credograph.session import cut
from credograph.sources.tables import table

KEY = ["src", "dst", "edge_type"]


def sampled_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = unpivot(chains(spark, sf_dir), "chain_id").join(attributed_beliefs(spark, sf_dir), KEY).where("alpha + beta > 2")
    return simulation.sampled_chains(e.select("chain_id", *KEY, "alpha", "beta"), 500)


def planted_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered rates of planted edges beside the true ones; reads no table."""
    r = simulation.recover(simulation.planted(spark, 4000, 20, 4))
    return r.select("edge", F.round("r", 6).alias("rate"), F.round(0.5 + 0.5 * F.pmod(F.col("edge") * 37, F.lit(20)) / 20, 6).alias("true_rate"))


def learned_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out success probability from design features alone: hashed categories, logistic fit on the other folds."""
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher
    from pyspark.ml.functions import vector_to_array

    x = chains(spark, sf_dir).join(labels(spark, sf_dir), "chain_id").where("label in ('success', 'failure')")
    x = x.select("chain_id", F.when(F.col("label") == "success", 1.0).otherwise(0.0).alias("y"), *[F.coalesce(c, F.lit("none")).alias(c) for c in ("phase", "indication", "endpoint", "sponsor")], F.log1p(F.coalesce("sample_size", F.lit(0)).cast("double")).alias("size"), fold(F.col("trial_id"), FOLDS).alias("fold"))
    x = cut(FeatureHasher(inputCols=["phase", "indication", "endpoint", "sponsor", "size"], outputCol="f", numFeatures=1024).transform(x).select("chain_id", "y", "fold", "f"))
    parts = []
    for i in range(FOLDS):
        fit = LogisticRegression(featuresCol="f", labelCol="y", regParam=0.1).fit(x.where(F.col("fold") != i))
        parts.append(fit.transform(x.where(F.col("fold") == i)).select("chain_id", "y", "fold", F.round(vector_to_array("probability")[1], 6).alias("p")))
    return reduce(DataFrame.unionByName, parts)


def edge_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out success probability from the edges of a chain alone: hashed incidence, logistic fit on the other folds."""
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    y = labels(spark, sf_dir).where("label in ('success', 'failure')").select("chain_id", F.when(F.col("label") == "success", 1.0).otherwise(0.0).alias("y"))
    e = unpivot(chains(spark, sf_dir), "chain_id", "trial_id").groupBy("chain_id", "trial_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", *KEY))).alias("edges"))
    x = e.join(y, "chain_id").withColumn("fold", fold(F.col("trial_id"), FOLDS))
    x = cut(HashingTF(inputCol="edges", outputCol="f", numFeatures=1 << 14, binary=True).transform(x).select("chain_id", "y", "fold", "f"))
    parts = []
    for i in range(FOLDS):
        fit = LogisticRegression(featuresCol="f", labelCol="y", regParam=0.3).fit(x.where(F.col("fold") != i))
        parts.append(fit.transform(x.where(F.col("fold") == i)).select("chain_id", "y", "fold", F.round(vector_to_array("probability")[1], 6).alias("p")))
    return reduce(DataFrame.unionByName, parts)


def combo_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A combination's chance over its parts' edges into the target, each edge once; softmin of their means."""
    b = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'affects'").select("src", "dst", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("p"))
    names = table(spark, sf_dir, "ref_entities", "entity_id", "canonical_name").select("entity_id", F.lower("canonical_name").alias("name"))
    c = chains(spark, sf_dir).where("compound is not null").select("chain_id", F.explode(F.array_distinct(F.split("compound", r" \+ | and | plus | with |; "))).alias("name"))
    parts = c.join(names, "name").select("chain_id", F.col("entity_id").alias("src")).distinct()
    both = parts.groupBy("chain_id").agg(F.count("*").alias("parts")).where("parts >= 2")
    e = parts.join(both, "chain_id").join(b, "src").select("chain_id", "parts", "src", "dst", "p").distinct()
    return e.groupBy("chain_id", "parts").agg(F.round(B.softmin(F.col("p")), 6).alias("efficacy"), F.count("*").alias("edges"))


def combination_parts(compounds: DataFrame, listed: DataFrame) -> DataFrame:
    """``chain_id, item_value, entity_id``: each part of a compound field, 0 for a part that the list doesn't have.

    A part is a listed compound if its letters and digits are those of the canonical name or of a
    synonym, with or without its dose and what stands in brackets; of several the smallest id.
    """
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")
    names = listed.where("entity_type = 'compound'").select("entity_id", F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("canonical_name"))).alias("name"))
    names = names.select(letters(F.col("name")).alias("k"), "entity_id").where("k <> ''").groupBy("k").agg(F.min("entity_id").alias("entity_id"))
    items = packed.split_packed(compounds, "compound", ["chain_id"]).distinct()
    bare = X.strip_dose(F.regexp_replace(F.lower("item_value"), r"\s*[(\[][^)\]]*[)\]]", " "))
    keys = items.select("item_value", F.explode(F.array_distinct(F.array(letters(F.col("item_value")), letters(bare)))).alias("k")).distinct()
    found = keys.join(names, "k").groupBy("item_value").agg(F.min("entity_id").alias("entity_id"))
    return items.join(found, "item_value", "left").select("chain_id", "item_value", F.coalesce("entity_id", F.lit(0)).cast("long").alias("entity_id")).distinct()


def combo_prediction_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As combo_prediction, of fields split by every joiner and parts mapped by name, synonym, brand or dose; unmatched parts are counted, without edges."""
    b = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'affects'").select("src", "dst", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("p"))
    parts = cut(combination_parts(cut(chains(spark, sf_dir).select("chain_id", "compound")), table(spark, sf_dir, "ref_entities")))
    who = F.when(F.col("entity_id") > 0, F.col("entity_id").cast("string")).otherwise(F.col("item_value"))
    n = parts.groupBy("chain_id").agg(F.countDistinct(who).alias("parts"), F.count_distinct(F.when(F.col("entity_id") > 0, F.col("entity_id"))).alias("matched")).where("parts >= 2")
    e = parts.where("entity_id > 0").select("chain_id", F.col("entity_id").alias("src")).distinct().join(b, "src")
    e = e.groupBy("chain_id").agg(F.round(B.softmin(F.col("p")), 6).alias("efficacy"), F.count("*").alias("edges"))
    return n.join(e, "chain_id", "left").select("chain_id", "parts", "matched", "efficacy", F.coalesce("edges", F.lit(0)).alias("edges"))


def indication_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions with all that they are kinds of, nearest first: a listed disease or the area, then the root; with the trials of each."""
    c = table(spark, sf_dir, "trials", "nct_id", "conditions").select("nct_id", F.explode("conditions").alias("condition")).where("condition is not null").withColumn("node", X.disease_slug(F.col("condition")))
    nodes = c.select("node").distinct()
    area = F.concat(F.lit("area:"), X.therapeutic_area(F.col("node")))
    up = nodes.select("node", F.coalesce(X.parent_disease(F.col("node")), area).alias("parent"))
    listed = up.select(F.col("parent").alias("node")).where("node not like 'area:%'").distinct()
    parents = up.unionByName(listed.select("node", area.alias("parent"))).unionByName(up.unionByName(listed.select("node", area.alias("parent"))).where("parent like 'area:%'").select(F.col("parent").alias("node"), F.lit("disease").alias("parent"))).distinct()
    found = G.ancestors(nodes, parents)
    return c.join(found, "node").groupBy("level", F.col("ancestor").alias("node")).agg(F.countDistinct("nct_id").alias("trials"))


def resolve_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets resolved by the first step that knows them: symbol, synonym, symbol without separators; the rest are rejects."""
    e = table(spark, sf_dir, "ref_entities").where("entity_type = 'target'")
    names = e.select("entity_id", F.lower("canonical_name").alias("n"), F.lit(1).alias("step")).unionByName(e.select("entity_id", F.explode("synonyms").alias("n"), F.lit(2).alias("step")).withColumn("n", F.lower("n")))
    names = names.unionByName(e.select("entity_id", F.regexp_replace(F.lower("canonical_name"), r"[\s_-]", "").alias("n"), F.lit(3).alias("step")))
    t = chains(spark, sf_dir).select("target").where("target is not null").distinct()
    tries = t.select("target", F.inline(F.array(F.struct(F.col("target").alias("n"), F.lit(1).alias("step")), F.struct(F.col("target").alias("n"), F.lit(2).alias("step")), F.struct(F.regexp_replace("target", r"[\s_-]", "").alias("n"), F.lit(3).alias("step")))))
    hit = tries.join(names, ["n", "step"]).groupBy("target").agg(F.min(F.struct("step", "entity_id")).alias("m"))
    return t.join(hit, "target", "left").select("target", F.coalesce("m.step", F.lit(0)).alias("step"), F.coalesce("m.entity_id", F.lit(0)).cast("long").alias("entity_id"))


def holdout_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each edge's belief is a single trial's own: the largest shift that leaving one out makes."""
    log = evidence_log(spark, sf_dir)
    per = log.groupBy(*KEY, "source_id").agg(F.sum("up").cast("double").alias("u"), F.sum("down").cast("double").alias("d"))
    w = Window.partitionBy(*KEY)
    a, b = 1 + F.sum("u").over(w), 1 + F.sum("d").over(w)
    shift = F.round(F.abs(a / (a + b) - (a - F.col("u")) / (a - F.col("u") + b - F.col("d"))), 4)
    return per.withColumn("shift", shift).groupBy(*KEY).agg(F.max("shift").alias("shift"), F.count("*").alias("sources"))


def penalty_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety penalties by form: the largest risk, their sum, and one less the product of the rest; all in one pass."""
    b = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'target_associated_ae'")
    a, c = F.col("alpha"), F.col("beta")
    x = b.withColumn("risk", F.round(0.3 * F.greatest((a / (a + c) - 0.5) / 0.5, F.lit(0.0)) * B.trust(a + c - 2), 6))
    m = x.groupBy("src").agg(F.max("risk").alias("largest"), F.sum(F.col("risk").cast("decimal(18,6)")).cast("double").alias("total"), F.round(1 - F.exp(F.sum(F.log(1 - F.col("risk")))), 5).alias("noisy_or"))
    return m.select("src", F.inline(F.array(*[F.struct(F.lit(n).alias("form"), F.least(F.lit(0.6), F.col(n)).alias("penalty")) for n in ("largest", "total", "noisy_or")])))


def hypothesis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by phase, area and endpoint class with all subtotals."""
    c = chains(spark, sf_dir).where("outcome <> 'unknown'").select(F.coalesce("phase", F.lit("none")).alias("phase"), X.therapeutic_area(X.disease_slug(F.coalesce("indication", F.lit("")))).alias("area"), F.when(F.col("outcome") == "success", 1).otherwise(0).alias("y"))
    return c.cube("phase", "area").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate")).select(F.coalesce("phase", F.lit("all")).alias("phase"), F.coalesce("area", F.lit("all")).alias("area"), "n", "rate")


QUERIES = {f.__name__: f for f in (sampled_prediction, planted_recovery, learned_baseline, edge_baseline, combo_prediction, combo_prediction_parts, indication_ancestors, resolve_ladder, holdout_provenance, penalty_forms, hypothesis_table)}


SQL = {
    "combo_prediction": f"WITH {EV_SQL}, {CH_SQL}, b AS (SELECT src, dst, alpha / (alpha + beta) AS p FROM bel WHERE edge_type = 'affects'), c AS (SELECT chain_id, unnest(list_distinct(string_split_regex(compound, ' \\+ | and | plus | with |; '))) AS name FROM ch WHERE compound IS NOT NULL), p AS (SELECT DISTINCT chain_id, entity_id AS src FROM c JOIN ref_entities ON name = lower(canonical_name)), k AS (SELECT chain_id, count(*) AS parts FROM p GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT DISTINCT chain_id, parts, src, dst, p FROM p JOIN k USING (chain_id) JOIN b USING (src)) SELECT chain_id, parts, round(-0.1 * ln(avg(exp(-greatest(p, 1e-12) / 0.1))), 6) AS efficacy, count(*) AS edges FROM e GROUP BY 1, 2",
    "indication_ancestors": f"WITH RECURSIVE c AS (SELECT nct_id, {disease_sql('c')} AS node FROM (SELECT nct_id, unnest(conditions) AS c FROM trials) WHERE c IS NOT NULL), n AS (SELECT DISTINCT node FROM c UNION SELECT 'melanoma' FROM c), p AS (SELECT node, coalesce({parent_sql('node')}, 'area:' || {area_sql('node')}) AS parent FROM n UNION SELECT 'area:' || {area_sql('node')}, 'disease' FROM n), r AS (SELECT DISTINCT node, 0 AS level, node AS ancestor FROM c UNION ALL SELECT r.node, level + 1, p.parent FROM r JOIN p ON p.node = r.ancestor WHERE level < 5) SELECT level, ancestor AS node, count(DISTINCT nct_id) AS trials FROM c JOIN r USING (node) GROUP BY 1, 2",
    "resolve_ladder": f"WITH {CH_SQL}, n AS (SELECT entity_id, lower(canonical_name) AS n, 1 AS step FROM ref_entities WHERE entity_type = 'target' UNION ALL SELECT entity_id, lower(unnest(synonyms)), 2 FROM ref_entities WHERE entity_type = 'target' UNION ALL SELECT entity_id, regexp_replace(lower(canonical_name), '[\\s_-]', '', 'g'), 3 FROM ref_entities WHERE entity_type = 'target'), t AS (SELECT DISTINCT target FROM ch WHERE target IS NOT NULL), h AS (SELECT target, n.step, entity_id, row_number() OVER (PARTITION BY target ORDER BY n.step, entity_id) AS k FROM t JOIN n ON n.n = CASE n.step WHEN 3 THEN regexp_replace(target, '[\\s_-]', '', 'g') ELSE target END) SELECT target, coalesce(step, 0) AS step, coalesce(entity_id, 0) AS entity_id FROM t LEFT JOIN (SELECT * FROM h WHERE k = 1) USING (target)",
    "holdout_provenance": f"WITH {EV_SQL}, p AS (SELECT src, dst, edge_type, source_id, sum(up)::DOUBLE AS u, sum(down)::DOUBLE AS d FROM ev GROUP BY ALL), s AS (SELECT *, 1 + sum(u) OVER w AS a, 1 + sum(d) OVER w AS b FROM p WINDOW w AS (PARTITION BY src, dst, edge_type)) SELECT src, dst, edge_type, max(round(abs(a / (a + b) - (a - u) / (a - u + b - d)), 4)) AS shift, count(*) AS sources FROM s GROUP BY ALL",
    "penalty_forms": f"WITH {EV_SQL}, r AS (SELECT src, round(0.3::DOUBLE * greatest((alpha / (alpha + beta) - 0.5) / 0.5, 0) * least(1.0, ln(greatest(alpha + beta - 2, 0) + 1) / ln(50)), 6) AS risk FROM bel WHERE edge_type = 'target_associated_ae'), m AS (SELECT src, max(risk) AS largest, sum(risk::DECIMAL(18,6))::DOUBLE AS total, round(1 - exp(sum(ln(1 - risk))), 5) AS noisy_or FROM r GROUP BY 1) SELECT src, form, least(0.6::DOUBLE, penalty) AS penalty FROM (UNPIVOT m ON largest, total, noisy_or INTO NAME form VALUE penalty)",
    "hypothesis_table": f"WITH {CH_SQL}, y AS (SELECT coalesce(phase, 'none') AS phase, {area_sql(disease_sql('coalesce(indication, ' + chr(39) * 2 + ')'))} AS area, CASE outcome WHEN 'success' THEN 1 ELSE 0 END AS y FROM ch WHERE outcome <> 'unknown') SELECT coalesce(phase, 'all') AS phase, coalesce(area, 'all') AS area, count(*) AS n, round(avg(y), 6) AS rate FROM y GROUP BY CUBE (phase, area)",
}
