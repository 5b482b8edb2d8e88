"""Queries of entity merging: tiers, winners, folding, rewritten chains, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.operators import merge, vectors
from credograph.plans.base import CH_SQL, EV_SQL, chains, evidence_log, unpivot
from credograph.plans.vocabulary import _QUALIFIED
from credograph.session import cut
from credograph.sources.tables import table

#: Cosine from which two vectors are alike.
ALIKE = 0.40


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "ref_entities").where("entity_type = 'compound'")
    return e.select("entity_id", F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("canonical_name"))).alias("name")).groupBy(F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("k")).agg(F.min("entity_id").alias("entity_id"))


def _compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds as typed, with what tells that two are the same: the listed entity they name, their letters, their words in any order."""
    c = chains(spark, sf_dir).where("compound is not null").groupBy(F.col("compound").alias("node")).agg(F.count("*").alias("n")).withColumn("k", F.regexp_replace("node", "[^a-z0-9]", ""))
    return c.join(_names(spark, sf_dir), "k", "left").select("node", "n", F.col("entity_id").cast("string").alias("listed"), F.nullif("k", F.lit("")).alias("letters"), F.nullif(F.trim(F.array_join(F.array_sort(F.split("node", "[^a-z0-9]+")), " ")), F.lit("")).alias("words"))


def _won(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(_compounds(spark, sf_dir))
    classed = merge.classes(c, "node", [F.col("listed"), F.col("letters"), F.col("words")]).join(c, "node")
    return cut(merge.winners(classed, F.col("n").cast("double"), F.col("listed").isNotNull()))


def merge_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which compound each one is merged into: the most used of its class, a listed one of equals, then the smallest."""
    return _won(spark, sf_dir)


def merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners that took others in, with the targets of all of them."""
    t = chains(spark, sf_dir).where("compound is not null").groupBy("compound").agg(F.collect_set("target").alias("targets"), F.min("mechanism").alias("mechanism"))
    x = merge.folded(t, _won(spark, sf_dir), "compound", ["targets"], ["mechanism"]).where("size(merged_from) > 0")
    return x.select("compound", F.array_join("targets", "|").alias("targets"), "mechanism", F.array_join("merged_from", "|").alias("merged_from"))


def rewritten_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the chains before and after compounds are merged."""
    c = chains(spark, sf_dir)
    after = merge.rewritten(c, _won(spark, sf_dir), ["compound"])
    count = lambda x, name: unpivot(x, "chain_id").groupBy("edge_type").agg(F.countDistinct("src", "dst").alias(name))
    return count(c, "before").join(count(after, "after"), "edge_type")


def replayed_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs after targets of one family are merged into its first, records alike in source, support and arm counted once; the arm is the phase of evidence."""
    t = table(spark, sf_dir, "ref_entities", "entity_id", "entity_type").where("entity_type = 'target'")
    won = t.select(F.col("entity_id").alias("dst"), (F.floor((F.col("entity_id") - 5001) / 4) * 4 + 5001).alias("w"))
    log = evidence_log(spark, sf_dir).join(won, "dst", "left").withColumn("dst", F.coalesce("w", "dst")).withColumn("arm", F.col("tier"))
    return merge.replayed(log.drop("w"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct vectors with a cosine of at least ``ALIKE``; the vectors are random, so few are closer."""
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), ALIKE).select("a", "b", F.round("cosine", 4).alias("cosine"))


def cosine_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its class of alike vectors, through others too, and its number of direct links."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    same, pairs = cut(vectors.copies(e).select("vec_id", "first")), cut(vectors.similar_pairs(e, ALIKE))
    links = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    keyed = same.select(F.col("first").alias("node")).distinct().join(both.select(F.col("x").alias("node"), F.concat_ws("-", F.least("x", "y"), F.greatest("x", "y")).alias("k")), "node", "left")
    label = merge.linked(keyed, "node", "k")
    degree = both.groupBy(F.col("x").alias("first")).agg(F.count("*").alias("links"))
    return same.join(label.select(F.col("node").alias("first"), "class_id"), "first").join(degree, "first", "left").select("vec_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def box_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose box lies in another's, with the narrowest that holds it; each label's box is that of its vectors of even ids, its parent's of all."""
    e = table(spark, sf_dir, "embeddings")
    small = e.where("vec_id % 2 = 0").select(F.concat(F.lit("even "), F.col("label")).alias("key"), "embedding")
    whole = e.select(F.concat(F.lit("all "), F.col("label")).alias("key"), "embedding")
    b = cut(vectors.boxes(small.unionByName(whole), "key"))
    widths = b.groupBy("key").agg(F.sum((F.col("hi") - F.col("lo")).cast("double")).alias("width"))
    return vectors.nearest_parents(vectors.containment(b, "key"), widths)


def box_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the labels' boxes once each holds those of its children; the parent of a label is half of it."""
    e = table(spark, sf_dir, "embeddings")
    b = cut(vectors.boxes(e, "label"))
    tree = b.select(F.col("label").alias("node"), F.floor(F.col("label") / 2).cast("int").alias("parent")).distinct()
    x = vectors.expanded(b, "label", tree)
    return x.groupBy("label").agg(F.round(F.sum(F.col("hi").cast("double") - F.col("lo").cast("double")), 3).alias("width"))


def parent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations and those told by one axis less, with the chains of each; met by equal ids, never by comparing all."""
    from credograph.functions import text as X

    x = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.target_population").withColumn("p", X.population_id(X.qualifiers(F.col("target_population")))).where("p is not null")
    n = x.groupBy("p").agg(F.count("*").alias("n")).withColumn("axes", F.split("p", "__"))
    less = n.where("size(axes) > 1").select(F.col("p").alias("child"), "axes", F.explode(F.sequence(F.lit(1), F.size("axes"))).alias("i"))
    less = less.select("child", F.array_join(F.filter("axes", lambda a, k: k != F.col("i") - 1), "__").alias("parent"))
    return less.join(n.select(F.col("p").alias("parent"), F.col("n").alias("chains")), "parent").select("child", "parent", "chains")


QUERIES = {f.__name__: f for f in (merge_winners, merge_fold, rewritten_chains, replayed_beliefs, cosine_pairs, cosine_classes, box_hierarchy, box_expansion, parent_pairs)}

_W = f"""WITH RECURSIVE {CH_SQL}, nm AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, min(entity_id) AS e FROM (SELECT entity_id, unnest(list_append(coalesce(synonyms, []), canonical_name)) AS name FROM ref_entities WHERE entity_type = 'compound') GROUP BY 1
), cp AS (SELECT compound AS node, count(*) AS n, regexp_replace(compound, '[^a-z0-9]', '', 'g') AS k FROM ch WHERE compound IS NOT NULL GROUP BY 1), cn AS (SELECT cp.*, e FROM cp LEFT JOIN nm USING (k)
), ky AS (SELECT node, '0:' || e AS k FROM cn WHERE e IS NOT NULL UNION SELECT node, '1:' || k FROM cn WHERE k <> '' UNION SELECT node, '2:' || w FROM (SELECT node, trim(array_to_string(list_sort(string_split_regex(node, '[^a-z0-9]+')), ' ')) AS w FROM cn) WHERE w <> ''
), lk AS (SELECT DISTINCT a.node AS a, b.node AS b FROM ky a JOIN ky b USING (k)), re AS (SELECT node AS x, node AS y FROM cn UNION SELECT re.x, lk.b FROM re JOIN lk ON re.y = lk.a
), cl AS (SELECT x AS node, min(y) AS c FROM re GROUP BY 1), wn AS (SELECT node, first_value(node) OVER (PARTITION BY c ORDER BY n DESC, CASE WHEN e IS NULL THEN 1 ELSE 0 END, node) AS winner FROM cl JOIN cn USING (node))"""
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), pr AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.4)"
SQL = {
    "merge_winners": f"{_W} SELECT * FROM wn",
    "merge_fold": f"{_W}, t AS (SELECT compound, list_distinct(list(target) FILTER (WHERE target IS NOT NULL)) AS t, min(mechanism) AS m FROM ch WHERE compound IS NOT NULL GROUP BY 1), f AS (SELECT winner, list_sort(list_distinct(flatten(list(coalesce(t, []))))) AS targets, arg_min(m, (CASE WHEN node = winner THEN 0 ELSE 1 END, node)) FILTER (WHERE m IS NOT NULL) AS mechanism, list_sort(list(node) FILTER (WHERE node <> winner)) AS mf FROM wn JOIN t ON t.compound = node GROUP BY 1) SELECT winner AS compound, array_to_string(targets, '|') AS targets, mechanism, array_to_string(mf, '|') AS merged_from FROM f WHERE len(mf) > 0",
    "rewritten_chains": f"{_W}, b AS (SELECT edge_type, count(DISTINCT (src, dst)) AS before FROM ce GROUP BY 1), a AS (SELECT edge_type, count(DISTINCT (coalesce(winner, src), dst)) AS after FROM ce LEFT JOIN wn ON edge_type = 'affects' AND node = src GROUP BY 1) SELECT * FROM b JOIN a USING (edge_type)",
    "replayed_beliefs": f"WITH {EV_SQL}, g AS (SELECT * REPLACE (CASE WHEN dst IN (SELECT entity_id FROM ref_entities WHERE entity_type = 'target') THEN ((dst - 5001) // 4) * 4 + 5001 ELSE dst END AS dst), CASE source_type WHEN 'clinical_trial' THEN (SELECT upper(replace(phase, ' ', '')) FROM trials WHERE nct_id = source_id) ELSE source_type END AS ph FROM ev), h AS (SELECT *, CASE WHEN source_type <> 'clinical_trial' THEN source_type WHEN ph IN ('PHASE3', 'PHASE4', 'PHASE2/PHASE3') THEN 'p3' WHEN ph = 'PHASE2' THEN 'p2' WHEN ph IN ('PHASE1', 'EARLY_PHASE1') THEN 'p1' ELSE 'literature' END AS arm FROM g), f AS (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_type, source_id, bucket, arm ORDER BY ts NULLS FIRST, seq) AS k FROM h) SELECT src, dst, edge_type, 1 + sum(up)::DOUBLE AS alpha, 1 + sum(down)::DOUBLE AS beta, count(*) AS n_records FROM f WHERE k = 1 GROUP BY ALL",
    "cosine_pairs": f"WITH {_V} SELECT a, b, round(c, 4) AS cosine FROM pr",
    "cosine_classes": f"WITH RECURSIVE {_V}, l AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a) SELECT x AS vec_id, min(y) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.x) AS links FROM r GROUP BY 1",
    "parent_pairs": f"WITH {_QUALIFIED}, y AS (SELECT list_sort(list_filter([stage, severity, extent, setting, line, age, 'histology_' || hist], lambda v: v IS NOT NULL)) AS a FROM x), n AS (SELECT a, count(*) AS n FROM y WHERE len(a) > 0 GROUP BY 1) SELECT array_to_string(c.a, '__') AS child, array_to_string(p.a, '__') AS parent, p.n AS chains FROM n c JOIN n p ON len(p.a) = len(c.a) - 1 AND list_has_all(c.a, p.a)",
    "box_expansion": "WITH RECURSIVE bx AS (SELECT label, i AS axis, min(x) AS lo, max(x) AS hi FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), up AS (SELECT DISTINCT label AS node, label AS anc, 0 AS lv FROM embeddings UNION ALL SELECT node, anc // 2, lv + 1 FROM up WHERE anc // 2 <> anc AND lv < 5), e AS (SELECT anc AS label, axis, min(lo) AS lo, max(hi) AS hi FROM bx JOIN up ON up.node = bx.label GROUP BY ALL) SELECT label, round(sum(hi::DOUBLE - lo::DOUBLE), 3) AS width FROM e GROUP BY 1",
}
