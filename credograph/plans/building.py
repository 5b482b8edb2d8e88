"""Queries of graph construction: skeletons with drop reasons, cells, combinations, target ladder, forks, gates; and what evidence records carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.functions import text as X
from credograph.operators.statistics import with_totals
from credograph.plans.attribution import RT_SQL, _routed
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, chains, evidence_log, verdicts
from credograph.plans.vocabulary import _DIR, _QUALIFIED, PARENT_AXES, disease_sql, parent_sql
from credograph.session import cut
from credograph.sources.tables import table



def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a registry trial makes no subgraph: the first reason of these, in order; kept trials have none."""
    t = table(spark, sf_dir, "trials", "nct_id", "conditions").withColumnRenamed("nct_id", "trial_id")
    c = chains(spark, sf_dir).groupBy("trial_id").agg(F.count("*").alias("n"), F.count("compound").alias("drugs"), F.count(F.when(X.active_part(F.col("compound")).isNotNull() & ~X.generic_name(F.col("compound")), 1)).alias("molecules"), F.count("endpoint").alias("endpoints"))
    x = t.join(c, "trial_id", "left")
    reason = F.when(F.coalesce(F.size("conditions"), F.lit(0)) < 1, "no_condition").when(F.col("n").isNull(), "not_extracted").when(F.col("drugs") == 0, "no_compound").when(F.col("molecules") == 0, "no_specific_molecule").when(F.col("endpoints") == 0, "no_endpoint")
    return x.select("trial_id", F.coalesce(reason, F.lit("kept")).alias("reason"))


def trial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of each trial: its arms by its populations by its endpoints, with the outcome told for the cell or unknown.

    Cells that no extraction tells of are counted, not written out.
    """
    c = chains(spark, sf_dir).where("compound is not null and endpoint is not null").withColumn("population", F.coalesce("population", F.lit("all comers")))
    told = c.groupBy("trial_id", "compound", "population", "endpoint").agg(F.max(F.when(F.col("met"), 2).when(~F.col("met"), 1).otherwise(0)).alias("o"))
    n = c.groupBy("trial_id").agg((F.countDistinct("compound") * F.countDistinct("population") * F.countDistinct("endpoint")).alias("cells"))
    out = told.groupBy("trial_id").agg(F.count_if(F.col("o") == 2).alias("success"), F.count_if(F.col("o") == 1).alias("failure"), F.count("*").alias("told"))
    return n.join(out, "trial_id").select("trial_id", "cells", "success", "failure", (F.col("cells") - F.col("success") - F.col("failure")).alias("unknown"))


def target_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed entity of each compound by the first step that knows it: name, synonym, without brackets, without dose; 0 for none."""
    e = table(spark, sf_dir, "ref_entities").where("entity_type = 'compound'")
    names = e.select(F.lower("canonical_name").alias("k"), F.lit(1).alias("own"), "entity_id").unionByName(e.select(F.explode("synonyms").alias("k"), F.lit(2).alias("own"), "entity_id").withColumn("k", F.lower("k")))
    c = chains(spark, sf_dir).where("compound is not null").select("compound").distinct()
    bare = F.trim(F.regexp_replace("compound", r"\s*\([^)]*\)\s*", " "))
    step = lambda i, k, own: F.struct(F.lit(i).alias("step"), k.alias("k"), F.lit(own).alias("own"))
    tries = F.array(step(1, F.col("compound"), 1), step(2, F.col("compound"), 2), step(3, bare, 1), step(3, bare, 2), step(4, X.strip_dose(bare), 1), step(4, X.strip_dose(bare), 2))
    hit = c.select("compound", F.inline(tries)).join(names, ["k", "own"]).groupBy("compound").agg(F.min(F.struct("step", "entity_id")).alias("m"))
    return c.join(hit, "compound", "left").select("compound", F.coalesce("m.step", F.lit(0)).alias("step"), F.coalesce("m.entity_id", F.lit(0)).cast("long").alias("entity_id"))


def inherited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of listed compounds with the edges that they inherit from their parts: evidence added up, parts counted."""
    c = chains(spark, sf_dir).where("compound is not null").select("compound").distinct()
    names = table(spark, sf_dir, "ref_entities", "entity_id", "canonical_name").select("entity_id", F.lower("canonical_name").alias("name"))
    parts = c.select("compound", F.explode(F.array_distinct(F.split("compound", r" \+ | and | plus | with "))).alias("name")).join(names, "name").select("compound", "entity_id").distinct()
    combo = parts.groupBy("compound").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), "+").alias("combo_id"), F.count("*").alias("parts")).where("parts >= 2")
    own = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'affects'").select("src", "dst", "alpha", "beta")
    each = combo.groupBy("combo_id").agg(F.first("compound").alias("compound"))
    x = each.join(parts, "compound").join(own, F.col("entity_id") == F.col("src"))
    return x.groupBy("combo_id", "dst").agg(F.round(1 + F.sum(F.col("alpha") - 1), 6).alias("alpha"), F.round(1 + F.sum(F.col("beta") - 1), 6).alias("beta"), F.count("*").alias("parts"))


def subgroup_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains forked for each axis of their population that defines a subgroup; other axes fork nothing."""
    c = chains(spark, sf_dir).select("chain_id", F.explode(X.qualifiers(F.col("population"))).alias("f"))
    x = c.select("chain_id", F.concat_ws("_", "f.axis", "f.level").alias("population_id"), F.col("f.axis").isin(PARENT_AXES).alias("forks"))
    return x.groupBy("population_id").agg(F.count_if("forks").alias("forked"), F.count_if(~F.col("forks")).alias("not_forked"))


def disease_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a disease to what it is a kind of; none to itself, none both ways, only between diseases of the trials or listed ones."""
    s = table(spark, sf_dir, "trials", "conditions").select(F.explode("conditions").alias("c")).where("c is not null").select(X.disease_slug(F.col("c")).alias("child")).distinct()
    e = s.select("child", X.parent_disease(F.col("child")).alias("parent")).where("parent is not null and child <> parent")
    back = e.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return e.join(back, ["child", "parent"], "left_anti")


def stamped_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of each chain from its compound's mechanisms: theirs if they agree, else of most, a tie unknown."""
    c = chains(spark, sf_dir).select("chain_id", "compound", X.direction(F.col("mechanism")).alias("d"))
    n = c.where("compound is not null").groupBy("compound").agg(F.count_if(F.col("d") == "agonist").alias("up"), F.count_if(F.col("d") == "antagonist").alias("down"))
    x = c.select("chain_id", "compound").join(n, "compound", "left")
    return x.select("chain_id", F.when(F.col("up") > F.col("down"), "agonist").when(F.col("down") > F.col("up"), "antagonist").otherwise("unknown").alias("direction"))


def build_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that a build has to reach, and edges of evidence that no listed entity carries; one row a gate."""
    r = drop_reasons(spark, sf_dir).agg(F.round(F.avg(F.when(F.col("reason") == "kept", 1.0).otherwise(0.0)), 6).alias("kept"))
    c = chains(spark, sf_dir)
    roles = c.agg(*[F.round(F.avg(F.when(F.col(k).isNotNull(), 1.0).otherwise(0.0)), 6).alias(k) for k in ("target", "mechanism", "biology", "endpoint")])
    known = table(spark, sf_dir, "ref_entities", "entity_id")
    ends = evidence_log(spark, sf_dir).select("src", "dst").distinct()
    ghost = ends.join(known.withColumnRenamed("entity_id", "src"), "src", "left_anti").agg(F.count("*").cast("double").alias("phantom_edges"))
    one = with_totals(with_totals(r, roles), ghost)
    gate = lambda n, least: F.struct(F.lit(n).alias("gate"), F.col(n).alias("value"), (F.col(n) == 0 if n == "phantom_edges" else F.col(n) >= least).alias("passed"))
    return one.select(F.inline(F.array(gate("kept", 0.5), *[gate(k, 0.6) for k in ("target", "mechanism", "biology", "endpoint")], gate("phantom_edges", 0))))


def _entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "ref_entities")
    return e.select("entity_id", F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("canonical_name"))).alias("n")).groupBy(F.lower("n").alias("name")).agg(F.min("entity_id").alias("entity_id"))


def modulation_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge updates of classifications routed to the role that their target has in a chain of the trial, or the reason why not.

    The modulator has to be listed, then the target, then the trial has to have a chain with that target.
    """
    u = table(spark, sf_dir, "classifications", "classification_id", "nct_id", "confidence_overall", "edges_to_update").where("edges_to_update is not null")
    u = u.select("classification_id", F.concat(F.lit("NCT"), F.regexp_extract("nct_id", r"(\d{8})", 1)).alias("trial_id"), F.col("confidence_overall").alias("confidence"), F.posexplode("edges_to_update").alias("pos", "e"))
    names = cut(_entity_names(spark, sf_dir))
    side = lambda name, key: names.select(F.col("name").alias(key), F.col("entity_id").alias(name))
    u = u.withColumns({"m": F.lower(F.trim("e.source_entity")), "t": F.lower(F.trim("e.target_entity"))}).join(side("modulator", "m"), "m", "left").join(side("anchor", "t"), "t", "left")
    held = chains(spark, sf_dir).where("target is not null").select("trial_id", F.col("target").alias("t")).distinct().join(side("anchor", "t"), "t").select("trial_id", "anchor").distinct().withColumn("there", F.lit(True))
    u = u.join(held, ["trial_id", "anchor"], "left")
    reason = F.when(F.col("modulator").isNull(), "modulator_not_listed").when(F.col("anchor").isNull(), "target_not_listed").when(F.col("there").isNull(), "no_chain_with_target")
    direction = F.when(F.col("e.support").isin("strong", "moderate"), "amplifies").when(F.col("e.support") == "weak", "suppresses").otherwise("neutral")
    bucket = F.when(reason.isNull(), B.modulation_bucket(direction, F.col("confidence")))
    return u.select("classification_id", "pos", F.coalesce(reason, F.lit("routed")).alias("reason"), F.when(reason.isNull(), "target").alias("layer"), bucket.alias("bucket"))


def applied_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight each record counts by in a replay: what its trial's attribution applied, else the nominal one."""
    own = _routed(spark, sf_dir).where("branch not in ('safety', 'operational') or outcome = 'success'").groupBy(F.col("trial_id").alias("source_id")).agg(F.max("w").alias("w"))
    log = evidence_log(spark, sf_dir).join(own, "source_id", "left")
    applied = (F.col("source_type") == "clinical_trial") & F.col("w").isNotNull()
    return log.select("seq", F.round(F.when(applied, F.col("w")).otherwise(F.col("n_eff")), 6).alias("n"), F.when(applied, "applied").otherwise("nominal").alias("kind"))


def toxicity_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each adverse-event edge the share of records from trials that failed by dose-limiting toxicity; one where it has none."""
    tox = verdicts(spark, sf_dir).select(F.col("trial_id").alias("source_id"), (F.col("mode") == "dose_limiting_toxicity").alias("tox"))
    log = evidence_log(spark, sf_dir).where("edge_type = 'target_associated_ae'").join(tox, "source_id", "left")
    return log.groupBy("src", "dst").agg(F.round(F.coalesce(F.avg(F.col("tox").cast("int")), F.lit(1.0)), 6).alias("share"), F.count("tox").alias("known"))


def gated_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's gravest risk: belief, trust and the share of dose-limiting toxicity, grade three for all; at most 0.6."""
    b = beliefs(evidence_log(spark, sf_dir)).where("edge_type = 'target_associated_ae'")
    a, c = F.col("alpha"), F.col("beta")
    x = b.withColumn("p", B.expected(a, c)).where("p >= 0.55 and alpha + beta - 2 >= 1").join(toxicity_share(spark, sf_dir), ["src", "dst"])
    risk = F.round(0.15 * F.least(F.greatest((a / (a + c) - 0.5) / 0.5, F.lit(0.0)), F.lit(1.0)) * B.trust(a + c - 2) * F.col("share"), 6)
    return x.withColumn("risk", risk).groupBy("src").agg(F.least(F.lit(0.6), F.max("risk")).alias("penalty"), F.max_by("dst", F.struct("risk", "dst")).alias("worst"), F.count("*").alias("risks"))


QUERIES = {f.__name__: f for f in (drop_reasons, trial_cells, target_ladder, inherited_edges, subgroup_forks, disease_hierarchy, stamped_directions, build_gates, modulation_routing, applied_weights, toxicity_share, gated_penalty)}

_GENERIC = "'pharmacotherapy', 'drug therapy', 'medication', 'medical therapy', 'medical management', 'standard treatment', 'standard therapy', 'standard of care', 'standard care', 'study drug', 'active drug', 'investigational drug', 'investigational product', 'active treatment', 'active comparator', 'experimental drug', 'active agent', 'conventional treatment', 'treatment', 'therapy', 'best available therapy', 'best available care', 'systemic therapy'"
_MOLECULE = f"len(list_filter(list_transform(string_split_regex(compound, '[;+/]| and '), lambda p: trim(p)), lambda p: p <> '' AND NOT regexp_matches(p, 'placebo|sham|vehicle'))) > 0 AND regexp_replace(rtrim(compound, '.'), 's$', '') NOT IN ({_GENERIC})"
_DROP = f"{CH_SQL}, cc AS (SELECT trial_id, count(*) AS n, count(compound) AS drugs, count(*) FILTER (WHERE compound IS NOT NULL AND {_MOLECULE}) AS molecules, count(endpoint) AS endpoints FROM ch GROUP BY 1), dr AS (SELECT nct_id AS trial_id, CASE WHEN coalesce(len(conditions), 0) < 1 THEN 'no_condition' WHEN n IS NULL THEN 'not_extracted' WHEN drugs = 0 THEN 'no_compound' WHEN molecules = 0 THEN 'no_specific_molecule' WHEN endpoints = 0 THEN 'no_endpoint' ELSE 'kept' END AS reason FROM trials LEFT JOIN cc ON cc.trial_id = nct_id)"
_STRIP = r"regexp_replace(regexp_replace({}, '\s+\d+(\.\d+)?\s*(mg|μg|ug|mcg|ng|g|iu|miu|mu|units?|u)(\s*/\s*(kg|m\^?2|m2|day|d))?\b', '', 'gi'), '\s+(q\d+h|q[idh]s?\b|[bt]?id\b|qd\b|po\b|iv\b|sc\b|im\b)', '', 'gi')"
_TOX = f"WITH {CH_SQL}, {EV_SQL}, tx AS (SELECT src, dst, verd.v.m[1].mode AS mode FROM ev LEFT JOIN verd ON verd.trial_id = ev.source_id WHERE edge_type = 'target_associated_ae'), ts AS (SELECT src, dst, round(coalesce(avg(CASE mode WHEN 'dose_limiting_toxicity' THEN 1 ELSE 0 END) FILTER (WHERE mode IS NOT NULL), 1.0), 6) AS share, count(mode) AS known FROM tx GROUP BY 1, 2)"
SQL = {
    "drop_reasons": f"WITH {_DROP} SELECT * FROM dr",
    "trial_cells": f"WITH {CH_SQL}, c AS (SELECT trial_id, compound, coalesce(population, 'all comers') AS p, endpoint, met FROM ch WHERE compound IS NOT NULL AND endpoint IS NOT NULL), a AS (SELECT DISTINCT trial_id, compound FROM c), b AS (SELECT DISTINCT trial_id, p FROM c), e AS (SELECT DISTINCT trial_id, endpoint FROM c), x AS (SELECT trial_id, compound, p, endpoint FROM a JOIN b USING (trial_id) JOIN e USING (trial_id)), o AS (SELECT x.trial_id, max(CASE WHEN met THEN 2 WHEN NOT met THEN 1 ELSE 0 END) AS o FROM x LEFT JOIN c ON c.trial_id = x.trial_id AND c.compound = x.compound AND c.p = x.p AND c.endpoint = x.endpoint GROUP BY x.trial_id, x.compound, x.p, x.endpoint) SELECT trial_id, count(*) AS cells, count(*) FILTER (WHERE o = 2) AS success, count(*) FILTER (WHERE o = 1) AS failure, count(*) FILTER (WHERE o = 0) AS unknown FROM o GROUP BY 1",
    "target_ladder": f"WITH {CH_SQL}, nm AS (SELECT lower(canonical_name) AS k, entity_id FROM ref_entities WHERE entity_type = 'compound'), sy AS (SELECT lower(k) AS k, entity_id FROM (SELECT unnest(synonyms) AS k, entity_id FROM ref_entities WHERE entity_type = 'compound')), al AS (SELECT * FROM nm UNION SELECT * FROM sy), c AS (SELECT DISTINCT compound, trim(regexp_replace(compound, '\\s*\\([^)]*\\)\\s*', ' ', 'g')) AS bare FROM ch WHERE compound IS NOT NULL), d AS (SELECT *, trim(regexp_replace({_STRIP.format('bare')}, '\\s+', ' ', 'g')) AS dose FROM c), l AS (SELECT compound, (SELECT min(entity_id) FROM nm WHERE k = compound) AS a, (SELECT min(entity_id) FROM sy WHERE k = compound) AS b, (SELECT min(entity_id) FROM al WHERE k = bare) AS c, (SELECT min(entity_id) FROM al WHERE k = CASE WHEN dose = '' THEN bare ELSE dose END) AS e FROM d) SELECT compound, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 WHEN e IS NOT NULL THEN 4 ELSE 0 END AS step, coalesce(a, b, c, e, 0) AS entity_id FROM l",
    "inherited_edges": f"WITH {CH_SQL}, {EV_SQL}, p AS (SELECT DISTINCT compound, entity_id FROM (SELECT compound, unnest(list_distinct(string_split_regex(compound, ' \\+ | and | plus | with '))) AS name FROM (SELECT DISTINCT compound FROM ch WHERE compound IS NOT NULL)) JOIN ref_entities ON lower(canonical_name) = name), k AS (SELECT DISTINCT list_sort(list(entity_id)) AS parts FROM p GROUP BY compound HAVING count(*) >= 2), u AS (SELECT array_to_string(parts, '+') AS combo_id, unnest(parts) AS e FROM k) SELECT combo_id, dst, round(1 + sum(alpha - 1), 6) AS alpha, round(1 + sum(beta - 1), 6) AS beta, count(*) AS parts FROM u JOIN bel ON bel.src = e AND edge_type = 'affects' GROUP BY 1, 2",
    "subgroup_forks": f"WITH {CH_SQL}, {_QUALIFIED}, u AS (SELECT unnest(list_filter([stage, severity, extent, setting, line, age, 'histology_' || hist], lambda v: v IS NOT NULL)) AS p FROM x JOIN ch ON ch.chain_id = x.extraction_id WHERE population IS NOT NULL) SELECT p AS population_id, count(*) FILTER (WHERE regexp_matches(p, '^(line|stage|extent|severity)_')) AS forked, count(*) FILTER (WHERE NOT regexp_matches(p, '^(line|stage|extent|severity)_')) AS not_forked FROM u GROUP BY 1",
    "disease_hierarchy": f"WITH s AS (SELECT DISTINCT {disease_sql('c')} AS child FROM (SELECT unnest(conditions) AS c FROM trials) WHERE c IS NOT NULL) SELECT child, {parent_sql('child')} AS parent FROM s WHERE {parent_sql('child')} IS NOT NULL",
    "stamped_directions": f"WITH {CH_SQL}, d AS (SELECT chain_id, compound, sign({_DIR.format('mechanism')}) AS d FROM ch), n AS (SELECT compound, count(*) FILTER (WHERE d = 1) AS up, count(*) FILTER (WHERE d = -1) AS down FROM d WHERE compound IS NOT NULL GROUP BY 1) SELECT chain_id, CASE WHEN up > down THEN 'agonist' WHEN down > up THEN 'antagonist' ELSE 'unknown' END AS direction FROM d LEFT JOIN n USING (compound)",
    "build_gates": f"WITH {_DROP}, {EV_SQL}, g AS (SELECT (SELECT round(avg(CASE reason WHEN 'kept' THEN 1.0 ELSE 0.0 END), 6) FROM dr) AS k, round(avg(CASE WHEN target IS NULL THEN 0.0 ELSE 1.0 END), 6) AS t, round(avg(CASE WHEN mechanism IS NULL THEN 0.0 ELSE 1.0 END), 6) AS m, round(avg(CASE WHEN biology IS NULL THEN 0.0 ELSE 1.0 END), 6) AS b, round(avg(CASE WHEN endpoint IS NULL THEN 0.0 ELSE 1.0 END), 6) AS e, (SELECT count(*)::DOUBLE FROM (SELECT DISTINCT src, dst FROM ev) WHERE src NOT IN (SELECT entity_id FROM ref_entities)) AS f FROM ch) SELECT 'kept' AS gate, k AS value, k >= 0.5 AS passed FROM g UNION ALL SELECT 'target', t, t >= 0.6 FROM g UNION ALL SELECT 'mechanism', m, m >= 0.6 FROM g UNION ALL SELECT 'biology', b, b >= 0.6 FROM g UNION ALL SELECT 'endpoint', e, e >= 0.6 FROM g UNION ALL SELECT 'phantom_edges', f, f = 0 FROM g",
    "modulation_routing": f"WITH {CH_SQL}, nm AS (SELECT lower(n) AS name, min(entity_id) AS id FROM (SELECT entity_id, unnest(list_append(coalesce(synonyms, []), canonical_name)) AS n FROM ref_entities) GROUP BY 1), u AS (SELECT classification_id, 'NCT' || regexp_extract(nct_id, '(\\d{{8}})', 1) AS trial_id, confidence_overall AS c, unnest(edges_to_update) AS e, generate_subscripts(edges_to_update, 1) - 1 AS pos FROM classifications), h AS (SELECT DISTINCT trial_id, id FROM ch JOIN nm ON nm.name = target), r AS (SELECT classification_id, pos, c, e.support AS support, CASE WHEN a.id IS NULL THEN 'modulator_not_listed' WHEN b.id IS NULL THEN 'target_not_listed' WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.trial_id = u.trial_id AND h.id = b.id) THEN 'no_chain_with_target' ELSE 'routed' END AS reason FROM u LEFT JOIN nm a ON a.name = lower(trim(e.source_entity)) LEFT JOIN nm b ON b.name = lower(trim(e.target_entity))) SELECT classification_id, pos::INTEGER AS pos, reason, CASE reason WHEN 'routed' THEN 'target' END AS layer, CASE WHEN reason = 'routed' THEN coalesce(CASE WHEN c >= 0.85 THEN 'strong' WHEN c >= 0.7 THEN 'moderate' WHEN c >= 0.55 THEN 'weak' END || CASE WHEN support IN ('strong', 'moderate') THEN '_support' WHEN support = 'weak' THEN '_contradict' END, 'ambiguous') END AS bucket FROM r",
    "applied_weights": f"WITH {RT_SQL}, {EV_SQL}, ow AS (SELECT trial_id, max(w) AS w FROM rt WHERE branch NOT IN ('safety', 'operational') OR outcome = 'success' GROUP BY 1) SELECT seq, round(CASE WHEN source_type = 'clinical_trial' AND w IS NOT NULL THEN w ELSE n_eff END, 6) AS n, CASE WHEN source_type = 'clinical_trial' AND w IS NOT NULL THEN 'applied' ELSE 'nominal' END AS kind FROM ev LEFT JOIN ow ON ow.trial_id = source_id",
    "toxicity_share": f"{_TOX} SELECT * FROM ts",
    "gated_penalty": f"{_TOX}, r AS (SELECT src, dst, round(0.15 * least(greatest((alpha / (alpha + beta) - 0.5) / 0.5, 0), 1) * least(1.0, ln(greatest(alpha + beta - 2, 0) + 1) / ln(50)) * share, 6) AS risk FROM bel JOIN ts USING (src, dst) WHERE edge_type = 'target_associated_ae' AND round(alpha / (alpha + beta), 6) >= 0.55 AND alpha + beta - 2 >= 1), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY risk DESC, dst DESC) AS k FROM r) SELECT src, least(0.6, max(risk)) AS penalty, max(CASE WHEN k = 1 THEN dst END) AS worst, count(*) AS risks FROM k GROUP BY 1",
}
