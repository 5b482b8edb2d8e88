"""Hypothesis queries: chains resolved by topology, pooled edges, directions, regimens, risks of the target class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credograph.functions import belief as B
from credograph.functions import text as X
from credograph.operators import graph as G
from credograph.plans.attribution import RT_SQL, attributed_beliefs
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, by_indication, chains, evidence_log, unpivot
from credograph.plans.graph import AT_SQL
from credograph.plans.vocabulary import _QUALIFIED, area_sql, disease_sql
from credograph.session import cut
from credograph.sources.tables import table

KEY = ["src", "dst", "edge_type"]
#: A query is asked for the target and conditions of each chain whose id divides by this.
EVERY = 50
# Adverse events count from this belief and this strength on; the ten gravest are told.
LEAST_BELIEF, LEAST_STRENGTH, MOST_RISKS = 0.55, 1.0, 10


def _asked(c: DataFrame) -> DataFrame:
    return by_indication(c).where(f"chain_id % {EVERY} = 0 and target is not null").select("target", "indication").distinct()


def topology_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanism and biology on a path from target to indication of at most three edges, the smallest of those that name both.

    Where no path leads there, the target's first mechanism alone. Steps are cut down to what can
    still reach the indication before they are joined, so that a hub's mechanisms don't multiply.
    """
    c = cut(chains(spark, sf_dir))
    e, asked = cut(unpivot(c, "chain_id").select(*KEY).distinct()), _asked(c)
    step = lambda t, a, b: e.where(F.col("edge_type") == t).select(F.col("src").alias(a), F.col("dst").alias(b))
    drives = step("biology_drives", "biology", "indication").join(asked.select("indication").distinct(), "indication", "left_semi")
    affects = step("mechanism_affects", "mechanism", "biology")
    first = step("modulates_via", "target", "mechanism").join(asked.select("target").distinct(), "target", "left_semi")
    # of each mechanism and indication only the smallest biology between them goes on
    reach = affects.join(drives, "biology").groupBy("mechanism", "indication").agg(F.min("biology").alias("biology"))
    best = first.join(reach, "mechanism").join(asked, ["target", "indication"], "left_semi").groupBy("target", "indication").agg(F.min(F.struct("mechanism", "biology")).alias("m"))
    alone = first.groupBy("target").agg(F.min("mechanism").alias("alone"))
    out = asked.join(best, ["target", "indication"], "left").join(alone, "target", "left")
    return out.select("target", "indication", F.coalesce("m.mechanism", "alone").alias("mechanism"), F.col("m.biology").alias("biology"))


def best_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidenced endpoint of each biology and indication: one that both are linked to, else any of the indication's."""
    b = cut(attributed_beliefs(spark, sf_dir).where("alpha + beta > 2"))
    score = F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")) * (F.col("alpha") + F.col("beta") - 1), 6)
    captures = b.where("edge_type = 'endpoint_captures'").select(F.col("src").alias("endpoint"), F.col("dst").alias("indication"), score.alias("score"))
    reflects = b.where("edge_type = 'reflects_biology'").select(F.col("src").alias("biology"), F.col("dst").alias("endpoint"))
    top = lambda x, keys: x.groupBy(*keys).agg(F.max_by("endpoint", F.struct("score", "endpoint")).alias("endpoint"))
    asked = by_indication(chains(spark, sf_dir)).where("biology is not null").select("biology", "indication").distinct()
    bridged = top(captures.join(asked, "indication").join(reflects, ["biology", "endpoint"], "left_semi"), ["biology", "indication"]).withColumnRenamed("endpoint", "bridged")
    out = asked.join(bridged, ["biology", "indication"], "left").join(top(captures, ["indication"]), "indication", "left")
    return out.select("biology", "indication", F.coalesce("bridged", "endpoint").alias("endpoint"), F.col("bridged").isNotNull().alias("bridge")).where("endpoint is not null")


def pooled_indications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs into an indication pooled over what it is a kind of: the area caps what the disease's own evidence is added to."""
    b = attributed_beliefs(spark, sf_dir).where("edge_type in ('biology_drives', 'endpoint_captures')")
    b = cut(b.withColumn("area", F.concat(F.lit("area:"), X.therapeutic_area(X.disease_slug(F.col("dst"))))))
    up = b.groupBy("src", "edge_type", "area").agg((1 + F.sum(F.col("alpha") - 1)).alias("a0"), (1 + F.sum(F.col("beta") - 1)).alias("b0"))
    x = b.join(up, ["src", "edge_type", "area"])
    a, c = B.pooled([(F.col("a0"), F.col("b0")), (F.col("alpha"), F.col("beta"))])
    return x.select(*KEY, F.round(a, 6).alias("alpha"), F.round(c, 6).alias("beta"))


def pooled_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a population responds, pooled over all coarser ones: every subset of its axes, fewest axes first."""
    x = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.target_population", "results.primary_endpoint_met").withColumn("p", X.population_id(X.qualifiers(F.col("target_population")))).where("p is not null and primary_endpoint_met is not null")
    own = cut(x.groupBy("p").agg(F.count_if("primary_endpoint_met").alias("yes"), F.count_if(~F.col("primary_endpoint_met")).alias("no")).withColumn("axes", F.split("p", "__")))
    up = own.select(F.col("p").alias("child"), F.explode(G.subsets("axes")).alias("p")).join(own.select("p", F.size("axes").alias("k"), "yes", "no"), "p")
    levels = up.groupBy("child", "k").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("k", "yes", "no"))), F.struct(F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")),
        lambda s, v: F.struct(
            F.when(s["a"].isNull(), 1.0 + v["yes"]).otherwise(B.capped(s["a"], s["a"], s["b"]) + v["yes"]).alias("a"),
            F.when(s["a"].isNull(), 1.0 + v["no"]).otherwise(B.capped(s["b"], s["a"], s["b"]) + v["no"]).alias("b"),
        ),
    )
    return levels.groupBy("child").agg(fold.alias("s"), F.count("*").alias("levels")).select(F.col("child").alias("population_id"), F.round("s.a", 6).alias("alpha"), F.round("s.b", 6).alias("beta"), "levels")


def direction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes on edges that both directions share, as a chain of either direction sees them: flat, its own side only, or backed off to the whole."""
    c = chains(spark, sf_dir).where("outcome = 'success'").withColumn("d", X.direction(F.col("mechanism")))
    e = unpivot(c, "d", "w").where("edge_type in ('modulates_via', 'mechanism_affects', 'biology_drives')").withColumns({"u": B.exact(F.col("w") * 0.8), "v": B.exact(F.col("w") * 0.2)})
    sums = [F.sum(c).cast("double").alias(c) for c in ("u", "v")] + [F.sum(F.when(F.col("d") == d, F.col(c)).otherwise(0)).cast("double").alias(f"{d}_{c}") for d in ("agonist", "antagonist") for c in ("u", "v")]
    x = e.groupBy(*KEY).agg(*sums)
    rows = []
    for mine, other in (("agonist", "antagonist"), ("antagonist", "agonist")):
        whole = (1 + F.col("u"), 1 + F.col("v"))
        side = [F.greatest(1 + F.col(k) - F.col(f"{other}_{k}"), F.lit(1e-6)) for k in ("u", "v")]
        opposite = F.col(f"{other}_u") + F.col(f"{other}_v") > 0
        back = B.pooled([whole, (side[0], side[1])])
        for mode, (a, b) in (("flat", whole), ("same_direction_only", (F.when(opposite, side[0]).otherwise(whole[0]), F.when(opposite, side[1]).otherwise(whole[1]))), ("backoff", (F.when(opposite, back[0]).otherwise(whole[0]), F.when(opposite, back[1]).otherwise(whole[1])))):
            rows.append(F.struct(F.lit(mine).alias("direction"), F.lit(mode).alias("mode"), F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta")))
    return x.select(*KEY, F.inline(F.array(*rows)))


def hypothesis_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success of each compound in each condition of its chains: the best stated chain, else the chain resolved by topology.

    Asked are the compounds and conditions of chains whose id divides by ``EVERY``; the answer says by what step it was found.
    """
    c = cut(chains(spark, sf_dir))
    b = cut(attributed_beliefs(spark, sf_dir).where("alpha + beta > 2"))
    asked = by_indication(c).where(f"chain_id % {EVERY} = 0 and compound is not null").select("compound", "indication", "target").groupBy("compound", "indication").agg(F.min("target").alias("target"))
    p = G.chain_probabilities(unpivot(c, "chain_id").join(b.select(*KEY, "alpha", "beta"), KEY)).select("chain_id", "efficacy")
    stated = by_indication(c).select("chain_id", "compound", "indication").join(asked, ["compound", "indication"], "left_semi").join(p, "chain_id")
    stated = stated.groupBy("compound", "indication").agg(F.max("efficacy").alias("stated"))
    topo = topology_chains(spark, sf_dir)
    x = asked.where("target is not null").join(topo, ["target", "indication"])
    e = unpivot(x.select(F.concat_ws("|", "compound", "indication").alias("chain_id"), "compound", "target", "mechanism", "biology", F.array("indication").alias("indications"), F.lit(None).cast("string").alias("endpoint")), "chain_id")
    topo_p = G.chain_probabilities(e.join(b.select(*KEY, "alpha", "beta"), KEY)).select(F.col("chain_id").alias("k"), F.col("efficacy").alias("resolved"))
    out = asked.join(stated, ["compound", "indication"], "left").withColumn("k", F.concat_ws("|", "compound", "indication")).join(topo_p, "k", "left")
    return out.select("compound", "indication", F.coalesce("stated", "resolved").alias("efficacy"), F.when(F.col("stated").isNotNull(), "stated").when(F.col("resolved").isNotNull(), "topology").otherwise("none").alias("step"))


def risk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverse events of each compound by its own evidence, then those of its targets' class that it has none of; the ten gravest."""
    b = cut(beliefs(evidence_log(spark, sf_dir)).withColumn("p", B.expected(F.col("alpha"), F.col("beta"))).withColumn("s", F.round(F.col("alpha") + F.col("beta") - 2, 6)))
    own = b.where("edge_type = 'target_associated_ae'").select(F.col("src").alias("compound"), F.col("dst").alias("ae"), "p", "s")
    binds = b.where("edge_type = 'affects'").select(F.col("src").alias("compound"), F.col("dst").alias("target"))
    per = binds.join(own, "compound").groupBy("target", "ae").agg(F.countDistinct("compound").alias("k"), F.round(F.avg("p"), 6).alias("p"), F.round(F.sum("s"), 6).alias("s")).where("k >= 2")
    of_class = binds.join(per, "target").groupBy("compound", "ae").agg(F.max(F.struct("p", "s")).alias("m")).select("compound", "ae", "m.p", "m.s").join(own.select("compound", "ae"), ["compound", "ae"], "left_anti")
    x = own.withColumn("tier", F.lit("compound")).unionByName(of_class.withColumn("tier", F.lit("class"))).where((F.col("p") >= LEAST_BELIEF) & (F.col("s") >= LEAST_STRENGTH))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("compound").orderBy(F.desc("p"), F.desc("s"), "ae")))
    return x.where(F.col("rank") <= MOST_RISKS).select("compound", "ae", "tier", "p", "rank")


def on_target_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an adverse event follows a target: its rate among the target's compounds over that among all, and how many of them show it."""
    b = beliefs(evidence_log(spark, sf_dir))
    binds = cut(b.where("edge_type = 'affects'").select(F.col("src").alias("compound"), F.col("dst").alias("target")).distinct())
    events = cut(b.where("edge_type = 'target_associated_ae'").select(F.col("src").alias("compound"), F.col("dst").alias("ae")).distinct())
    every = binds.select("compound").distinct().agg(F.count("*").alias("all_n"))
    base = events.join(binds.select("compound").distinct(), "compound", "left_semi").groupBy("ae").agg(F.count("*").alias("all_k"))
    n = binds.groupBy("target").agg(F.count("*").alias("n"))
    x = binds.join(events, "compound").groupBy("target", "ae").agg(F.count("*").alias("k")).join(n, "target").join(base, "ae")
    lift = (F.col("k") / F.col("n")) / (F.col("all_k") / F.col("all_n"))
    return x.join(F.broadcast(every), F.lit(True)).select("target", "ae", "k", "n", F.round(lift, 6).alias("lift"), F.when((lift >= 1.5) & (F.col("k") >= 2), "on_target").otherwise("off_target").alias("side"))


def fuzzy_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions matched to those of graph chains: exactly, else the shortest that holds or is held by it as words; by shared words, never all against all."""
    c = table(spark, sf_dir, "trials", "conditions").select(F.explode("conditions").alias("condition")).where("condition is not null").distinct()
    known = cut(c.select(F.explode(F.array_distinct(F.array(X.disease_slug(F.col("condition")), F.element_at(F.split(X.disease_slug(F.col("condition")), "_"), -1)))).alias("known")).distinct())
    asked = c.select("condition", X.slug(F.col("condition")).alias("q"))
    words = lambda x, col: x.select(col, F.explode(F.array_distinct(F.split(col, "_"))).alias("w"))
    near = words(asked.select("q").distinct(), "q").join(words(known, "known"), "w").select("q", "known").distinct()
    padded = lambda col: F.concat(F.lit("_"), F.col(col), F.lit("_"))
    near = near.where(padded("q").contains(padded("known")) | padded("known").contains(padded("q")))
    best = near.groupBy("q").agg(F.min(F.struct((F.col("q") != F.col("known")).alias("x"), F.length("known").alias("l"), "known")).alias("m"))
    return asked.join(best, "q", "left").select("condition", F.col("m.known").alias("matched"), F.when(F.col("m.known").isNull(), "none").when(F.col("m.x"), "part").otherwise("exact").alias("how"))


QUERIES = {f.__name__: f for f in (topology_chains, best_endpoints, pooled_indications, pooled_populations, direction_modes, hypothesis_query, risk_retrieval, on_target_events, fuzzy_conditions)}

_CAP = "least(1, 20 / ({0} + {1}))"
_TOPO = """ak AS (SELECT DISTINCT target, indication FROM ci WHERE chain_id % 50 = 0 AND target IS NOT NULL), ed AS (SELECT DISTINCT src, dst, edge_type FROM ce
), pt AS (SELECT ak.target, ak.indication, a.dst AS mechanism, b.dst AS biology FROM ak JOIN ed a ON a.edge_type = 'modulates_via' AND a.src = ak.target JOIN ed b ON b.edge_type = 'mechanism_affects' AND b.src = a.dst JOIN ed d ON d.edge_type = 'biology_drives' AND d.src = b.dst AND d.dst = ak.indication
), pk AS (SELECT *, row_number() OVER (PARTITION BY target, indication ORDER BY mechanism, biology) AS k FROM pt), tp AS (SELECT ak.target, ak.indication, coalesce(pk.mechanism, (SELECT min(dst) FROM ed WHERE edge_type = 'modulates_via' AND src = ak.target)) AS mechanism, biology FROM ak LEFT JOIN pk ON pk.target = ak.target AND pk.indication = ak.indication AND k = 1)"""
_DIRS = "sign(len(regexp_extract_all(mechanism, '\\b(agonism|activation|stabilization|stabilisation)\\b')) - len(regexp_extract_all(mechanism, '\\b(inhibition|antagonism|blockade|degradation|sequestration|chelation)\\b')))"
_BL = "bl AS (SELECT src, dst, edge_type, alpha, beta FROM ab WHERE alpha + beta > 2)"
SQL = {
    "topology_chains": f"WITH {CH_SQL}, {_TOPO} SELECT * FROM tp",
    "best_endpoints": f"WITH {AT_SQL}, {_BL}, cap AS (SELECT src AS endpoint, dst AS indication, round(alpha / (alpha + beta) * (alpha + beta - 1), 6) AS s FROM bl WHERE edge_type = 'endpoint_captures'), q AS (SELECT DISTINCT biology, indication FROM ci WHERE biology IS NOT NULL), o AS (SELECT q.biology, q.indication, endpoint, EXISTS (SELECT 1 FROM bl WHERE edge_type = 'reflects_biology' AND bl.src = q.biology AND bl.dst = endpoint) AS bridge, s FROM q JOIN cap USING (indication)), r AS (SELECT *, row_number() OVER (PARTITION BY biology, indication ORDER BY bridge DESC, s DESC, endpoint DESC) AS k FROM o) SELECT biology, indication, endpoint, bridge FROM r WHERE k = 1",
    "pooled_indications": f"WITH {AT_SQL}, x AS (SELECT *, {area_sql(disease_sql('dst'))} AS area FROM ab WHERE edge_type IN ('biology_drives', 'endpoint_captures')), u AS (SELECT src, edge_type, area, 1 + sum(alpha - 1) AS a0, 1 + sum(beta - 1) AS b0 FROM x GROUP BY ALL) SELECT x.src, x.dst, x.edge_type, round(a0 * {_CAP.format('a0', 'b0')} + greatest(alpha - 1, 0), 6) AS alpha, round(b0 * {_CAP.format('a0', 'b0')} + greatest(beta - 1, 0), 6) AS beta FROM x JOIN u USING (src, edge_type, area)",
    "direction_modes": f"WITH {RT_SQL}, e AS (SELECT src, dst, edge_type, {_DIRS} AS d, round(w * 0.8, 6)::DECIMAL(18,6) AS u, round(w * 0.2, 6)::DECIMAL(18,6) AS v FROM ce WHERE outcome = 'success' AND edge_type IN ('modulates_via', 'mechanism_affects', 'biology_drives')), s AS (SELECT src, dst, edge_type, sum(u)::DOUBLE AS u, sum(v)::DOUBLE AS v, coalesce(sum(u) FILTER (WHERE d = 1), 0)::DOUBLE AS pu, coalesce(sum(v) FILTER (WHERE d = 1), 0)::DOUBLE AS pv, coalesce(sum(u) FILTER (WHERE d = -1), 0)::DOUBLE AS nu, coalesce(sum(v) FILTER (WHERE d = -1), 0)::DOUBLE AS nv FROM e GROUP BY ALL), o AS (SELECT src, dst, edge_type, 'agonist' AS direction, u, v, nu AS ou, nv AS ov FROM s UNION ALL SELECT src, dst, edge_type, 'antagonist', u, v, pu, pv FROM s), m AS (SELECT *, 1 + u AS a, 1 + v AS b, greatest(1 + u - ou, 1e-6) AS x, greatest(1 + v - ov, 1e-6) AS y FROM o) SELECT src, dst, edge_type, direction, 'flat' AS mode, round(a, 6) AS alpha, round(b, 6) AS beta FROM m UNION ALL SELECT src, dst, edge_type, direction, 'same_direction_only', round(CASE WHEN ou + ov > 0 THEN x ELSE a END, 6), round(CASE WHEN ou + ov > 0 THEN y ELSE b END, 6) FROM m UNION ALL SELECT src, dst, edge_type, direction, 'backoff', round(CASE WHEN ou + ov > 0 THEN a * {_CAP.format('a', 'b')} + greatest(x - 1, 0) ELSE a END, 6), round(CASE WHEN ou + ov > 0 THEN b * {_CAP.format('a', 'b')} + greatest(y - 1, 0) ELSE b END, 6) FROM m",
    "hypothesis_query": f"WITH {AT_SQL}, {_BL}, {_TOPO}, q AS (SELECT compound, indication, min(target) AS target FROM ci WHERE chain_id % 50 = 0 AND compound IS NOT NULL GROUP BY 1, 2), st AS (SELECT compound, indication, max(efficacy) AS stated FROM ci JOIN cp USING (chain_id) GROUP BY 1, 2), te AS (SELECT q.compound, q.indication, unnest([{{'s': q.compound, 'd': q.target, 't': 'affects'}}, {{'s': q.target, 'd': tp.mechanism, 't': 'modulates_via'}}, {{'s': tp.mechanism, 'd': tp.biology, 't': 'mechanism_affects'}}, {{'s': tp.biology, 'd': q.indication, 't': 'biology_drives'}}]) AS e FROM q JOIN tp ON tp.target = q.target AND tp.indication = q.indication), tq AS (SELECT te.compound, te.indication, round(-0.1 * ln(avg(exp(-greatest(alpha / (alpha + beta), 1e-12) / 0.1))), 6) AS resolved FROM te JOIN bl ON bl.src = e.s AND bl.dst = e.d AND bl.edge_type = e.t GROUP BY 1, 2) SELECT q.compound, q.indication, coalesce(stated, resolved) AS efficacy, CASE WHEN stated IS NOT NULL THEN 'stated' WHEN resolved IS NOT NULL THEN 'topology' ELSE 'none' END AS step FROM q LEFT JOIN st ON st.compound = q.compound AND st.indication = q.indication LEFT JOIN tq ON tq.compound = q.compound AND tq.indication = q.indication",
    "pooled_populations": f"WITH RECURSIVE {_QUALIFIED}, y AS (SELECT extraction_id, list_sort(list_filter([stage, severity, extent, setting, line, age, 'histology_' || hist], lambda v: v IS NOT NULL)) AS a FROM x), o AS (SELECT a, count(*) FILTER (WHERE results.primary_endpoint_met) AS yes, count(*) FILTER (WHERE NOT results.primary_endpoint_met) AS no FROM y JOIN extractions USING (extraction_id) WHERE len(a) > 0 AND results.primary_endpoint_met IS NOT NULL GROUP BY 1), l AS (SELECT c.a AS child, len(p.a) AS k, sum(p.yes)::DOUBLE AS yes, sum(p.no)::DOUBLE AS no FROM o c JOIN o p ON list_has_all(c.a, p.a) GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY k) AS i FROM l), f AS (SELECT child, i, 1 + yes AS a, 1 + no AS b FROM n WHERE i = 1 UNION ALL SELECT f.child, n.i, f.a * least(1, 20 / (f.a + f.b)) + n.yes, f.b * least(1, 20 / (f.a + f.b)) + n.no FROM f JOIN n ON n.child = f.child AND n.i = f.i + 1) SELECT array_to_string(child, '__') AS population_id, round(arg_max(a, i), 6) AS alpha, round(arg_max(b, i), 6) AS beta, max(i) AS levels FROM f GROUP BY 1",
    "risk_retrieval": f"WITH {EV_SQL}, e AS (SELECT *, round(alpha / (alpha + beta), 6) AS p, round(alpha + beta - 2, 6) AS s FROM bel), o AS (SELECT src AS compound, dst AS ae, p, s FROM e WHERE edge_type = 'target_associated_ae'), bi AS (SELECT src AS compound, dst AS target FROM e WHERE edge_type = 'affects'), pr AS (SELECT target, ae, round(avg(p), 6) AS p, round(sum(s), 6) AS s FROM bi JOIN o USING (compound) GROUP BY 1, 2 HAVING count(DISTINCT compound) >= 2), cl AS (SELECT compound, ae, p, s, row_number() OVER (PARTITION BY compound, ae ORDER BY p DESC, s DESC) AS k FROM bi JOIN pr USING (target)), un AS (SELECT compound, ae, p, s, 'compound' AS tier FROM o UNION ALL SELECT compound, ae, p, s, 'class' FROM cl WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.compound = cl.compound AND o.ae = cl.ae)), r AS (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY p DESC, s DESC, ae) AS rank FROM un WHERE p >= 0.55 AND s >= 1) SELECT compound, ae, tier, p, rank FROM r WHERE rank <= 10",
    "on_target_events": f"WITH {EV_SQL}, bi AS (SELECT src AS compound, dst AS target FROM bel WHERE edge_type = 'affects'), o AS (SELECT src AS compound, dst AS ae FROM bel WHERE edge_type = 'target_associated_ae'), n AS (SELECT target, count(*) AS n FROM bi GROUP BY 1), ba AS (SELECT ae, count(*) AS all_k FROM o WHERE compound IN (SELECT compound FROM bi) GROUP BY 1), k AS (SELECT target, ae, count(*) AS k FROM bi JOIN o USING (compound) GROUP BY 1, 2), l AS (SELECT target, ae, k, n, (k::DOUBLE / n) / (all_k::DOUBLE / (SELECT count(DISTINCT compound) FROM bi)) AS lift FROM k JOIN n USING (target) JOIN ba USING (ae)) SELECT target, ae, k, n, round(lift, 6) AS lift, CASE WHEN lift >= 1.5 AND k >= 2 THEN 'on_target' ELSE 'off_target' END AS side FROM l",
}
