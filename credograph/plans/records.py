"""Queries of the record operators: drifting schemas, nested records, packed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.operators import drift, nested, packed
from credograph.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "feed_lines", "feed", "file_no", "payload")
    return drift.changes(lines).distinct()


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table of all records: every rename and retype that p1_found reports is replayed.

    The changes are gathered in the driver; they are bounded by files and fields, not by lines.
    """
    keep = ["line_id", "feed", "file_no", "line_no"]
    lines = table(spark, sf_dir, "feed_lines", *keep, "payload")
    found = drift.changes(lines).distinct().collect()
    names = drift.Names([tuple(r) for r in found], drift.REPLAYED)
    return drift.ingest(lines, keep, drift.REPLAYED, names=names)


def p1_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records have a typed value of each field that drifts most, whatever it was called or typed as in their file."""
    r = p1_records(spark, sf_dir)
    fields = {"trial_outcome": "trial_outcome", "primary_endpoint_met": "results__primary_endpoint_met", "failure_mode": "failure_modes__mode"}
    one = r.agg(*[F.count(c).alias(f) for f, c in fields.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("typed")) for f in fields])))


def _nested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return nested.tables(table(spark, sf_dir, "nested_records", "record_id", "payload"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all flat tables."""
    return reduce(DataFrame.unionByName, [t.select("record_id", "row_path", "parent_path") for t in _nested(spark, sf_dir).values()])


def p5_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's outcome beside the effect it is part of: child rows joined to their parents."""
    t = _nested(spark, sf_dir)
    up = t["effect_size"].select("record_id", F.col("row_path").alias("parent_path"), "estimate", "unit")
    return t["by_arm"].select("record_id", "row_path", "parent_path", "arm_id", "outcome").join(up, ["record_id", "parent_path"], "left")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.compound")
    return packed.split_packed(df, "compound", ["extraction_id"])


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_typed": p1_typed, "p5_found": p5_found, "p5_arms": p5_arms, "p6_found": p6_found}

def _stated(path: str, names: list[str]) -> str:
    return "(" + " OR ".join(f"len(list_filter(json_extract(j, '{path}{n}'), lambda x: json_type(x) <> 'NULL')) > 0" if "*" in path else f"coalesce(json_type(j, '{path}{n}'), 'NULL') <> 'NULL'" for n in names) + ")"


def _opened(j: str) -> str:
    return f"CASE WHEN json_type({j}) = 'VARCHAR' AND ltrim({j} ->> '$') LIKE '{{%' AND json_valid({j} ->> '$') THEN ({j} ->> '$')::JSON ELSE {j} END"


# kinds: l a list field, e an element of one, v anything else; a step opens a node and gives what lies in it
_WALK = f"""WITH RECURSIVE src AS (SELECT record_id, payload::JSON AS j FROM nested_records WHERE json_valid(payload)
), two AS (SELECT record_id, {_opened("json_extract(j, '$.therapeutic_hypothesis')")} AS a, {_opened("json_extract(j, '$.results')")} AS b FROM src
), w AS (
  SELECT record_id, 'therapeutic_hypothesis.target_population' AS path, '' AS parent, 'l' AS kind, json_extract(a, '$.target_population') AS j FROM two
  UNION ALL SELECT record_id, 'results.effect_size', '', 'l', json_extract(b, '$.effect_size') FROM two
  UNION ALL
  SELECT record_id, n.path, n.parent, n.kind, {_opened("n.j")} FROM (
    SELECT record_id, unnest(CASE
      WHEN kind = 'l' AND json_type(o) = 'ARRAY' THEN list_transform(range(json_array_length(o)::BIGINT), lambda i: {{'path': path || '[' || i || ']', 'parent': parent, 'kind': 'e', 'j': json_extract(o, '$[' || i || ']')}})
      WHEN kind = 'l' THEN [{{'path': path || '[0]', 'parent': parent, 'kind': 'e', 'j': o}}]
      WHEN json_type(o) = 'OBJECT' THEN list_transform(json_keys(o), lambda k: {{'path': path || '.' || k, 'parent': CASE kind WHEN 'e' THEN path ELSE parent END, 'kind': CASE WHEN k IN ('subgroups', 'features', 'by_arm', 'timepoints', 'arm_incidences') THEN 'l' ELSE 'v' END, 'j': json_extract(o, '$."' || k || '"')}})
      WHEN json_type(o) = 'ARRAY' THEN list_transform(range(json_array_length(o)::BIGINT), lambda i: {{'path': path || '[' || i || ']', 'parent': CASE kind WHEN 'e' THEN path ELSE parent END, 'kind': 'v', 'j': json_extract(o, '$[' || i || ']')}})
      ELSE [] END) AS n
    FROM (SELECT *, {_opened("j")} AS o FROM w WHERE j IS NOT NULL AND json_type(j) <> 'NULL'))
)"""
#: Names of the three fields in any file, as a reader of the files finds them.
_OUTCOMES = ["trial_outcome", "outcome", "overall_outcome", "trialOutcome", "trial_result", "verdict"]
_ENDPOINTS = ["primary_endpoint_met", "endpoint_met", "met_primary", "pe_met", "primaryEndpointMet", "endpoint_reached"]
_MODES = ["failure_modes", "failureModes", "failures"]
SQL = {
    "p5_found": f"{_WALK} SELECT record_id, path AS row_path, parent AS parent_path FROM w WHERE kind = 'e' AND json_type(j) <> 'NULL' AND NOT (json_type(j) = 'VARCHAR' AND trim(j ->> '$') = '')",
    "p1_typed": f"WITH l AS (SELECT ltrim(payload, chr(65279)) AS p FROM feed_lines), r AS (SELECT p::JSON AS j FROM l WHERE json_valid(p) AND json_type(p) = 'OBJECT') SELECT 'trial_outcome' AS field, count(*) AS typed FROM r WHERE {_stated('$.', _OUTCOMES)} UNION ALL SELECT 'primary_endpoint_met', count(*) FROM r WHERE {_stated('$.*.', _ENDPOINTS)} UNION ALL SELECT 'failure_mode', count(*) FROM r WHERE {_stated('$.', _MODES)}",
}
