"""Queries of graph upkeep: orphans, scopes, re-keyed and migrated nodes, overrides, pair and organ-class beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.functions import text as X
from credograph.operators import attribution as A
from credograph.plans.attribution import _AE, _ARMS, GRADES, ORGANS, _ae_beliefs, _case, _edges, _map, single_arm_combo
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, chains, evidence_log, unpivot
from credograph.sources.tables import table

KEY = ["src", "dst", "edge_type"]


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed entities that no evidence has at either end."""
    ends = evidence_log(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return table(spark, sf_dir, "ref_entities", "entity_id", "entity_type").join(ends, "entity_id", "left_anti")


def trial_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of each trial: its chains' edges, each once, with the chains that use it."""
    return unpivot(chains(spark, sf_dir), "trial_id", "chain_id").groupBy("trial_id", *KEY).agg(F.countDistinct("chain_id").alias("chains"))


def unscoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial-scoped ids taken back to their concepts, with the scopes that hold each."""
    scoped = unpivot(chains(spark, sf_dir), "trial_id").select(F.explode(F.array(F.concat("src", F.lit("#"), "trial_id"), F.concat("dst", F.lit("#"), "trial_id"))).alias("id")).distinct()
    return scoped.groupBy(F.regexp_replace("id", r"#NCT\d{8}$", "").alias("node")).agg(F.count("*").alias("scopes"))


def rekeyed_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs with targets named by the content of their names, so that equal names are one node."""
    e = table(spark, sf_dir, "ref_entities", "entity_id", "canonical_name").select(F.col("entity_id").alias("dst"), X.content_id("tgt:", F.col("canonical_name")).alias("key"))
    log = evidence_log(spark, sf_dir).join(e, "dst").withColumn("dst", F.col("key")).drop("key")
    return beliefs(log)


def migrated_codenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds typed by a synonym of one listed compound only, under its canonical name; chains and targets added up."""
    e = table(spark, sf_dir, "ref_entities").where("entity_type = 'compound'")
    names = e.select(F.explode("synonyms").alias("n"), F.lower("canonical_name").alias("canonical")).groupBy(F.lower("n").alias("compound")).agg(F.min("canonical").alias("canonical"), F.countDistinct("canonical").alias("k")).where("k = 1").drop("k")
    c = chains(spark, sf_dir).where("compound is not null").join(names, "compound", "left").withColumn("compound", F.coalesce("canonical", "compound"))
    return c.groupBy("compound").agg(F.count("*").alias("chains"), F.countDistinct("target").alias("targets"), F.count("canonical").alias("migrated"))


def retune_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs under overrides, all in one pass: contradictions observed at 0.35, and trials that were withdrawn dropped."""
    status = table(spark, sf_dir, "trials", "nct_id", "overall_status").select(F.col("nct_id").alias("source_id"), "overall_status")
    log = evidence_log(spark, sf_dir).join(status, "source_id", "left")
    soft = F.col("bucket") == "moderate_contradict"
    up, down = F.when(soft, B.exact(F.col("n_eff") * 0.35)).otherwise(F.col("up")), F.when(soft, B.exact(F.col("n_eff") * 0.65)).otherwise(F.col("down"))
    kept = F.coalesce(F.upper("overall_status") != "WITHDRAWN", F.lit(True))
    zero = F.lit(0).cast("decimal(18,6)")
    one = log.groupBy(*KEY).agg(F.sum(up).alias("su"), F.sum(down).alias("sd"), F.sum(F.when(kept, F.col("up")).otherwise(zero)).alias("ku"), F.sum(F.when(kept, F.col("down")).otherwise(zero)).alias("kd"))
    row = lambda n, a, b: F.struct(F.lit(n).alias("config"), (1 + F.col(a).cast("double")).alias("alpha"), (1 + F.col(b).cast("double")).alias("beta"))
    return one.select(*KEY, F.inline(F.array(row("soft_contradictions", "su", "sd"), row("without_withdrawn", "ku", "kd"))))


def informed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the beliefs once the flat prior has given way to the informed one (mean 0.75, strength 2)."""
    b = beliefs(evidence_log(spark, sf_dir))
    a, c = F.greatest(F.col("alpha") - 1 + 1.5, F.lit(1e-6)), F.greatest(F.col("beta") - 1 + 0.5, F.lit(1e-6))
    return b.select(*KEY, F.round(a / (a + c), 6).alias("mean"))


def modulation_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs of pairs of compounds that were given together, from the arms that have no smaller one to compare with; a record a pair and arm, at weight two."""
    x = single_arm_combo(spark, sf_dir).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), B.lookup(B.P_OBS, F.col("bucket")).alias("p"))
    return x.groupBy("a", "b").agg((1 + F.sum(B.exact(2 * F.col("p"))).cast("double")).alias("alpha"), (1 + F.sum(B.exact(2 * (1 - F.col("p")))).cast("double")).alias("beta"), F.count("*").alias("arms"))


def ae_organ_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organ classes shared by at least two compounds of a target: each votes by its strongest event; grades are united, grave ones marked."""
    b = _ae_beliefs(spark, sf_dir).where("alpha + beta - 2 >= 1").withColumns({"organ": _map(ORGANS, F.col("ae")), "p": B.expected(F.col("alpha"), F.col("beta")), "grade": _map(GRADES, F.col("ae"))}).where("organ is not null")
    top = b.groupBy("compound", "organ").agg(F.max(F.struct("p", "ae")).alias("m"), F.max("grade").alias("g"))
    binds = chains(spark, sf_dir).where("compound is not null and target is not null").select("compound", "target").distinct()
    v = top.join(binds, "compound").withColumn("vote", B.lookup(B.P_OBS, A.class_votes(F.col("m.p"))))
    x = v.groupBy("target", "organ").agg(F.count("*").alias("siblings"), F.sum(B.exact(4 * F.col("vote"))).alias("u"), F.max(F.col("m"))["ae"].alias("strongest"), F.array_join(F.array_sort(F.collect_set(F.col("g").cast("string"))), ",").alias("grades"), F.max(F.col("g") >= 3).alias("serious"))
    return x.where("siblings >= 2").select("target", "organ", "siblings", "strongest", "grades", "serious", (1 + F.col("u").cast("double")).alias("alpha"), (1 + 4 * F.col("siblings") - F.col("u").cast("double")).alias("beta"))


def provenance_of_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each trial's edges the records that are its own, from trials of the same first condition, from other trials, and from elsewhere."""
    log = evidence_log(spark, sf_dir).withColumns({"clinical": F.col("source_type") == "clinical_trial", "condition": F.coalesce(F.get("conditions", F.lit(0)), F.lit(""))})
    own = log.where("clinical").groupBy(*KEY, "source_id", "condition").agg(F.count("*").alias("own"))
    same = log.where("clinical").groupBy(*KEY, "condition").agg(F.count("*").alias("s"))
    whole = log.groupBy(*KEY).agg(F.count_if("clinical").alias("c"), F.count_if(~F.col("clinical")).alias("elsewhere"))
    x = own.join(same, [*KEY, "condition"]).join(whole, KEY)
    return x.select(*KEY, "source_id", "own", (F.col("s") - F.col("own")).alias("same"), (F.col("c") - F.col("s")).alias("cross"), "elsewhere")


def trial_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each edge's trials the share that points the way most do; edges of several trials only."""
    per = evidence_log(spark, sf_dir).where("source_type = 'clinical_trial'").groupBy(*KEY, "source_id").agg((F.sum("up") > F.sum("down")).alias("for"), (F.sum("up") < F.sum("down")).alias("against"))
    x = per.groupBy(*KEY).agg(F.count("*").alias("trials"), F.count_if("for").alias("f"), F.count_if("against").alias("a")).where("trials >= 2")
    return x.select(*KEY, "trials", F.round(F.greatest("f", "a") / F.col("trials"), 6).alias("concordance"))


def trial_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five edges whose means each trial moved most: with all evidence against all but its own; a report a trial."""
    log = evidence_log(spark, sf_dir)
    whole = log.groupBy(*KEY).agg(F.sum("up").alias("u"), F.sum("down").alias("d"))
    own = log.where("source_type = 'clinical_trial'").groupBy(*KEY, "source_id").agg(F.sum("up").alias("ou"), F.sum("down").alias("od"))
    mean = lambda u, d: (1 + u.cast("double")) / (2 + (u + d).cast("double"))
    x = own.join(whole, KEY).select("source_id", *KEY, F.round(mean(F.col("u") - F.col("ou"), F.col("d") - F.col("od")), 6).alias("before"), F.round(mean(F.col("u"), F.col("d")), 6).alias("after"))
    x = x.withColumn("change", F.round(F.abs(F.col("after") - F.col("before")), 6))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("change"), *KEY))).where("rank <= 5").drop("change")


def attributed_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs attributed year by year: a year's failures are split by the beliefs that the years before have left, failures included."""
    e = _edges(spark, sf_dir)
    year = table(spark, sf_dir, "trials", "nct_id", "started_at").select(F.col("nct_id").alias("trial_id"), F.coalesce(F.year("started_at"), F.lit(0)).alias("epoch"))
    return A.attribute_epochs(e.join(year, "trial_id"))


QUERIES = {f.__name__: f for f in (orphans, trial_edges, unscoped, rekeyed_beliefs, migrated_codenames, retune_overrides, informed_means, modulation_beliefs, ae_organ_class, provenance_of_trials, trial_concordance, trial_changes, attributed_by_year)}

SQL = {
    "orphans": f"WITH {EV_SQL} SELECT entity_id, entity_type FROM ref_entities WHERE entity_id NOT IN (SELECT src FROM ev) AND entity_id NOT IN (SELECT dst FROM ev)",
    "trial_edges": f"WITH {CH_SQL} SELECT trial_id, src, dst, edge_type, count(DISTINCT chain_id) AS chains FROM ce GROUP BY ALL",
    "unscoped": f"WITH {CH_SQL}, n AS (SELECT DISTINCT trial_id, src AS node FROM ce UNION SELECT trial_id, dst FROM ce) SELECT node, count(*) AS scopes FROM n GROUP BY 1",
    "rekeyed_beliefs": f"WITH {EV_SQL} SELECT src, 'tgt:' || substr(sha1(trim(regexp_replace(lower(canonical_name), '\\s+', ' ', 'g'))), 1, 12) AS dst, edge_type, 1 + sum(up)::DOUBLE AS alpha, 1 + sum(down)::DOUBLE AS beta, count(*) AS n_records FROM ev JOIN ref_entities ON entity_id = ev.dst GROUP BY ALL",
    "migrated_codenames": f"WITH {CH_SQL}, s AS (SELECT lower(n) AS n, min(lower(c)) AS c FROM (SELECT unnest(synonyms) AS n, canonical_name AS c FROM ref_entities WHERE entity_type = 'compound') GROUP BY 1 HAVING count(DISTINCT lower(c)) = 1) SELECT coalesce(c, compound) AS compound, count(*) AS chains, count(DISTINCT target) AS targets, count(c) AS migrated FROM ch LEFT JOIN s ON n = compound WHERE compound IS NOT NULL GROUP BY 1",
    "retune_overrides": f"WITH {EV_SQL}, l AS (SELECT ev.*, coalesce(upper((SELECT overall_status FROM trials WHERE nct_id = source_id)) <> 'WITHDRAWN', true) AS keep FROM ev) SELECT src, dst, edge_type, 'soft_contradictions' AS config, 1 + sum(CASE bucket WHEN 'moderate_contradict' THEN round(n_eff * 0.35, 6)::DECIMAL(18,6) ELSE up END)::DOUBLE AS alpha, 1 + sum(CASE bucket WHEN 'moderate_contradict' THEN round(n_eff * 0.65, 6)::DECIMAL(18,6) ELSE down END)::DOUBLE AS beta FROM l GROUP BY ALL UNION ALL SELECT src, dst, edge_type, 'without_withdrawn', 1 + coalesce(sum(up) FILTER (WHERE keep), 0)::DOUBLE, 1 + coalesce(sum(down) FILTER (WHERE keep), 0)::DOUBLE FROM l GROUP BY ALL",
    "informed_means": f"WITH {EV_SQL} SELECT src, dst, edge_type, round(greatest(alpha + 0.5, 1e-6) / (greatest(alpha + 0.5, 1e-6) + greatest(beta - 0.5, 1e-6)), 6) AS mean FROM bel",
    "modulation_beliefs": f"WITH {_ARMS}, al AS (SELECT * FROM arms WHERE len(compounds) > 1 AND arm_id NOT IN (SELECT combo_arm FROM sp)), x AS (SELECT outcome, unnest(compounds) AS a, compounds FROM al), y AS (SELECT outcome, a, unnest(compounds) AS b FROM x), z AS (SELECT a, b, CASE outcome WHEN 'success' THEN 0.65 WHEN 'partial' THEN 0.5 ELSE 0.35 END AS p FROM y WHERE a < b) SELECT a, b, 1 + sum(round(2 * p, 6)::DECIMAL(18,6))::DOUBLE AS alpha, 1 + sum(round(2 * (1 - p), 6)::DECIMAL(18,6))::DOUBLE AS beta, count(*) AS arms FROM z GROUP BY 1, 2",
    "provenance_of_trials": f"WITH {EV_SQL}, l AS (SELECT *, coalesce(conditions[1], '') AS condition FROM ev), o AS (SELECT src, dst, edge_type, source_id, condition, count(*) AS own FROM l WHERE source_type = 'clinical_trial' GROUP BY ALL) SELECT o.src, o.dst, o.edge_type, o.source_id, own, (SELECT count(*) FROM l WHERE l.src = o.src AND l.dst = o.dst AND l.edge_type = o.edge_type AND l.source_type = 'clinical_trial' AND l.condition = o.condition) - own AS same, (SELECT count(*) FROM l WHERE l.src = o.src AND l.dst = o.dst AND l.edge_type = o.edge_type AND l.source_type = 'clinical_trial' AND l.condition <> o.condition) AS cross, (SELECT count(*) FROM l WHERE l.src = o.src AND l.dst = o.dst AND l.edge_type = o.edge_type AND l.source_type <> 'clinical_trial') AS elsewhere FROM o",
    "trial_concordance": f"WITH {EV_SQL}, p AS (SELECT src, dst, edge_type, source_id, sign(sum(up) - sum(down)) AS d FROM ev WHERE source_type = 'clinical_trial' GROUP BY ALL) SELECT src, dst, edge_type, count(*) AS trials, round(greatest(count(*) FILTER (WHERE d = 1), count(*) FILTER (WHERE d = -1)) / count(*), 6) AS concordance FROM p GROUP BY ALL HAVING count(*) >= 2",
    "trial_changes": f"WITH {EV_SQL}, w AS (SELECT src, dst, edge_type, sum(up) AS u, sum(down) AS d FROM ev GROUP BY ALL), o AS (SELECT src, dst, edge_type, source_id, sum(up) AS ou, sum(down) AS od FROM ev WHERE source_type = 'clinical_trial' GROUP BY ALL), m AS (SELECT source_id, src, dst, edge_type, round((1 + (u - ou)::DOUBLE) / (2 + (u - ou + d - od)::DOUBLE), 6) AS before, round((1 + u::DOUBLE) / (2 + (u + d)::DOUBLE), 6) AS after FROM o JOIN w USING (src, dst, edge_type)), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(abs(after - before), 6) DESC, src, dst, edge_type) AS rank FROM m) SELECT * FROM r WHERE rank <= 5",
    "ae_organ_class": f"WITH {_AE}, b AS (SELECT compound, ae, round(alpha / (alpha + beta), 6) AS p, {_case(ORGANS, 'ae')} AS organ, {_case(GRADES, 'ae')} AS grade FROM ab WHERE alpha + beta - 2 >= 1), t AS (SELECT compound, organ, max(p) AS p, arg_max(ae, (p, ae)) AS ae, max(grade) AS g FROM b WHERE organ IS NOT NULL GROUP BY 1, 2), v AS (SELECT target, organ, t.p, t.ae, g, CASE WHEN t.p >= 0.75 THEN 0.95 WHEN t.p >= 0.55 THEN 0.8 WHEN t.p >= 0.40 THEN 0.65 WHEN t.p <= 0.25 THEN 0.35 ELSE 0.5 END AS w FROM t JOIN (SELECT DISTINCT compound, target FROM cc WHERE target IS NOT NULL) USING (compound)) SELECT target, organ, count(*) AS siblings, arg_max(ae, (p, ae)) AS strongest, array_to_string(list_sort(list_distinct(list(g::VARCHAR))), ',') AS grades, max(g) >= 3 AS serious, 1 + sum(round(4 * w, 6)::DECIMAL(18,6))::DOUBLE AS alpha, 1 + 4 * count(*) - sum(round(4 * w, 6)::DECIMAL(18,6))::DOUBLE AS beta FROM v GROUP BY 1, 2 HAVING count(*) >= 2",
}
