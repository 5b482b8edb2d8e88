"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.llm import canonical, components, containers, frequency, leaks, spam, splits
from credograph.operators import packed
from credograph.operators.statistics import with_totals
from credograph.session import cut
from credograph.sources.tables import table


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "extractions", "therapeutic_hypothesis.claimed_target", "therapeutic_hypothesis.proposed_mechanism")
    counts = frequency.term_counts(df, {"claimed_target": frequency.whole_value(F.col("claimed_target")), "proposed_mechanism": frequency.terms(F.col("proposed_mechanism"))})
    return frequency.marked(with_totals(counts, df.agg(F.count("*").alias("n_rows"))), F.col("n_rows")).drop("n_rows")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir)


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "extractions", "extraction_id", "nct_id", "therapeutic_hypothesis.claimed_target", "therapeutic_hypothesis.rationale_strength")
    return splits.grouped(df, "extraction_id", {"trial": splits.trial_key(F.col("nct_id")), "target": splits.named(F.col("claimed_target"))}, ["rationale_strength"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).where("group_rows > 1").select("extraction_id", "group_id")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(_grouped(spark, sf_dir), "extraction_id", "rationale_strength")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.compound", "therapeutic_hypothesis.claimed_target")
    items = packed.split_packed(df, "compound", ["extraction_id"]).select("extraction_id", F.lit("compound").alias("kind"), F.col("item_value").alias("value"))
    typed = cut(items.unionByName(df.select("extraction_id", F.lit("target").alias("kind"), F.col("claimed_target").alias("value"))))
    found = canonical.match(typed.select("kind", "value"), table(spark, sf_dir, "ref_entities"))
    rows = typed.join(found, ["kind", "value"]).select("extraction_id", "kind", "entity_id").distinct()
    return rows.select("extraction_id", F.when(F.col("kind") == "target", "claimed_target").otherwise("compound").alias("field_name"), "entity_id")


def p4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claimed targets of p4 with the entity each means, 0 for none."""
    df = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.claimed_target").select("extraction_id", F.lit("target").alias("kind"), F.col("claimed_target").alias("value"))
    found = canonical.match(df.select("kind", "value"), table(spark, sf_dir, "ref_entities"))
    return df.join(found, ["kind", "value"]).select("extraction_id", "entity_id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "match_pairs", "pair_id", "left_id", "right_id", "field_name", "label", "decided_at", "loaded_at")
    return components.groups(components.accepted(pairs)).select(F.col("vertex").alias("extraction_id"), F.col("group").alias("group_id"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extraction with its group; those without links are their own."""
    ids = table(spark, sf_dir, "extractions", "extraction_id")
    return ids.join(p7_found(spark, sf_dir), "extraction_id", "left").select("extraction_id", F.coalesce("group_id", "extraction_id").alias("group_id"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.assign(table(spark, sf_dir, "documents", "doc_id", "n_tokens", "text"))


def p8_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of the dynamic programme, and what padding to their boundaries would need."""
    return containers.bucket_report(table(spark, sf_dir, "documents", "doc_id", "n_tokens", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "item_text")
    return leaks.find(docs, items).select("doc_id", "item_id").distinct()


QUERIES = {"p8_containers": p8_containers, "p8_buckets": p8_buckets, "p9_found": p9_found, "p10_found": p10_found, "p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_splits": p3_splits, "p4_found": p4_found, "p4_targets": p4_targets, "p7_found": p7_found, "p7_groups": p7_groups}

_COUNTS = r"""
WITH toks AS (
  SELECT extraction_id, 'claimed_target' AS field_name, trim(regexp_replace(lower(therapeutic_hypothesis.claimed_target), '\s+', ' ', 'g')) AS term FROM extractions
  UNION ALL
  SELECT extraction_id, 'proposed_mechanism', unnest(regexp_extract_all(lower(therapeutic_hypothesis.proposed_mechanism), '[a-z0-9]+(?:-[a-z0-9]+)*')) FROM extractions
), counts AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT extraction_id) AS records FROM toks WHERE term <> '' GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM extractions) THEN 'common' END AS mark FROM counts
)
"""
_LINKS = """
WITH RECURSIVE last AS (
  SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, field_name,
         row_number() OVER (PARTITION BY least(left_id, right_id), greatest(left_id, right_id), field_name ORDER BY decided_at DESC NULLS LAST, loaded_at DESC NULLS LAST, pair_id DESC) AS rn, label
  FROM match_pairs WHERE left_id IS NOT NULL AND right_id IS NOT NULL AND left_id <> right_id
), links AS (SELECT DISTINCT a, b FROM last WHERE rn = 1 AND label = 'merge'
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT a AS x, a AS y FROM edges UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a
), groups AS (SELECT x AS extraction_id, min(y) AS group_id FROM reach GROUP BY x)
"""
_COMPONENTS = r"""
WITH RECURSIVE k0 AS (
  SELECT extraction_id, nullif(regexp_extract(nct_id, '(\d{8})', 1), '') AS t, trim(regexp_replace(lower(therapeutic_hypothesis.claimed_target), '\s+', ' ', 'g')) AS g FROM extractions
), keyed AS (
  SELECT extraction_id, CASE WHEN t IS NOT NULL THEN 'trial:' || t END AS a, CASE WHEN g <> '' AND g NOT IN ('unclear', 'unknown', 'n/a', 'not specified', '-', 'none', 'tbd', 'not reported') THEN 'target:' || g END AS b FROM k0
), edges AS (SELECT DISTINCT a, b FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL), links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), nodes AS (SELECT a AS node FROM keyed WHERE a IS NOT NULL UNION SELECT b FROM keyed WHERE b IS NOT NULL
), lab(node, label) USING KEY (node) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT l.b, min(lab.label) FROM lab JOIN links l ON lab.node = l.a JOIN recurring.lab cur ON cur.node = l.b GROUP BY l.b HAVING min(lab.label) < min(cur.label)
), rows AS (SELECT extraction_id, coalesce(lab.label, 'alone:' || extraction_id) AS label FROM keyed LEFT JOIN lab ON lab.node = coalesce(a, b)
), sized AS (SELECT extraction_id, min(extraction_id) OVER w AS group_id, count(*) OVER w AS n FROM rows WINDOW w AS (PARTITION BY label))
"""


def _key(v: str) -> str:
    return f"regexp_replace({v}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"


def _lean(v: str) -> str:
    out = f"lower({v})"
    for sign, name in canonical.GREEK.items():
        out = f"replace({out}, '{sign}', '{name}')"
    return f"regexp_replace({out}, '\\s*[(\\[][^)\\]]*[)\\]]', ' ', 'g')"


_SUFFIX = "(alpha|beta|gamma|delta|epsilon|zeta|theta|iota|kappa|lambda|omicron|sigma|upsilon|omega)$"
_EDITS = "CASE WHEN length(regexp_replace(regexp_replace({0}, '[0-9]', '', 'g'), '" + _SUFFIX + "', '')) >= 7 THEN 2 WHEN length(regexp_replace(regexp_replace({0}, '[0-9]', '', 'g'), '" + _SUFFIX + "', '')) >= 6 THEN 1 ELSE 0 END"
_TARGETS = f"""
WITH nm AS (SELECT {_key(_lean('n'))} AS k, min(entity_id) AS id FROM (SELECT entity_id, unnest(list_append(coalesce(synonyms, []), canonical_name)) AS n FROM ref_entities WHERE entity_type = 'target') GROUP BY 1 HAVING k <> ''
), v AS (SELECT DISTINCT therapeutic_hypothesis.claimed_target AS v FROM extractions), w AS (SELECT v FROM v WHERE trim(regexp_replace(v, '\\s+', ' ', 'g')) <> '' AND lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) NOT IN ('unclear', 'unknown', 'n/a', 'not specified', '-', 'none', 'tbd', 'not reported')
), k AS (SELECT v, {_key(_lean('v'))} AS k FROM w UNION SELECT v, {_key(f"regexp_replace({_lean('v')}, '[[:space:]](protein|pathway|receptor complex|signaling|signalling|gene|gene product)[[:space:]]*$', '')")} FROM w
), ex AS (SELECT v, min(id) AS id FROM k JOIN nm USING (k) GROUP BY 1
), fz AS (SELECT v, nm.id, levenshtein(k.k, nm.k) AS far FROM k JOIN nm ON levenshtein(k.k, nm.k) <= least({_EDITS.format('k.k')}, {_EDITS.format('nm.k')}) AND regexp_replace(k.k, '[^0-9]', '', 'g') = regexp_replace(nm.k, '[^0-9]', '', 'g')
    AND (regexp_extract(k.k, '{_SUFFIX}') = '' OR regexp_extract(k.k, '{_SUFFIX}') = regexp_extract(nm.k, '{_SUFFIX}')) WHERE v NOT IN (SELECT v FROM ex)
), bz AS (SELECT v, id, row_number() OVER (PARTITION BY v ORDER BY far, id) AS r FROM fz), al AS (SELECT w.v, coalesce(ex.id, bz.id, 0) AS id FROM w LEFT JOIN ex ON ex.v = w.v LEFT JOIN bz ON bz.v = w.v AND r = 1)
"""
SQL = {
    "p4_targets": _TARGETS + "SELECT extraction_id, id AS entity_id FROM extractions JOIN al ON al.v = therapeutic_hypothesis.claimed_target",
    "p3_found": _COMPONENTS + "SELECT extraction_id, group_id FROM sized WHERE n > 1",
    "p2_found": _COUNTS + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_counts": _COUNTS + "SELECT * FROM marked",
    "p7_found": _LINKS + "SELECT * FROM groups",
    "p7_groups": _LINKS + "SELECT e.extraction_id, coalesce(g.group_id, e.extraction_id) AS group_id FROM extractions e LEFT JOIN groups g USING (extraction_id)",
}
