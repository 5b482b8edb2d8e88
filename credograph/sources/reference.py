"""Offline readers of drug, target and pathway dumps, and lookups kept as tables.

Every dump is one JSON object a line or a delimited text with an explicit schema; lines that
don't parse give null keys and are left out of the lookups built on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import text as X

JSON_DUMPS = {
    "drugs": "id string, name string, synonyms array<string>, tradeNames array<string>, linkedTargets struct<rows: array<string>>",
    "associations": "targetId string, diseaseId string, diseaseName string, score double, evidenceCount long",
    "diseases": "id string, name string, ancestors array<string>",
    "mechanisms": "molecule_chembl_id string, target_chembl_id string, action_type string, mechanism_of_action string",
    "molecules": "molecule_chembl_id string, pref_name string, max_phase double, therapeutic_flag boolean, indication_class string",
    "signatures": "pert_id string, cell_id string, tissue string, up_genes array<string>, dn_genes array<string>",
    "abstracts": "pmid string, title string, abstract string",
}
TEXT_DUMPS = {
    "gene_pathways": ("\t", "gene string, pathway_id string, pathway_name string, species string"),
    "annotations": ("\t", "uniprot string, go_id string, go_name string, aspect string"),
    "pathway_parents": ("\t", "parent string, child string"),
    "drug_codes": ("|", "rxcui string, name string, term_type string"),
    "synonyms": ("\t", "cid long, synonym string"),
}


def read_dump(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A dump of a known kind with its schema."""
    if kind in JSON_DUMPS:
        return spark.read.schema(JSON_DUMPS[kind]).json(path)
    sep, schema = TEXT_DUMPS[kind]
    return spark.read.csv(path, sep=sep, schema=schema, quote="")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def drug_hits(asked: DataFrame, drugs: DataFrame) -> DataFrame:
    """``name, id, canonical, aliases, targets``: the drug that each asked ``name`` means by its name, a synonym or a trade name.

    Names are compared by letters and digits; a canonical name goes before others, then the
    smaller id. Asked names that no drug has are left out.
    """
    none = F.array().cast("array<string>")
    named = drugs.where("id is not null").select("id", F.posexplode(F.concat(F.array("name"), F.coalesce("synonyms", none), F.coalesce("tradeNames", none))).alias("rank", "n")).select("id", F.least("rank", F.lit(1)).alias("rank"), _bare(F.col("n")).alias("k")).where("k <> ''")
    best = named.groupBy("k").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))
    found = asked.select("name", _bare(F.col("name")).alias("k")).where("k <> ''").distinct().join(best, "k").drop("k")
    facts = drugs.where("id is not null").select("id", F.col("name").alias("canonical"), X.drug_aliases(F.col("name"), F.col("tradeNames"), F.col("synonyms")).alias("aliases"), F.coalesce("linkedTargets.rows", none).alias("targets"))
    return found.join(facts, "id").select("name", "id", "canonical", "aliases", "targets")


def associated(associations: DataFrame, ids: DataFrame, by: str, least: float = 0.0) -> DataFrame:
    """Associations of the asked targets or diseases (``by``: ``targetId`` or ``diseaseId``) from a score on."""
    return associations.where(F.col("score") >= least).join(ids.select(F.col("id").alias(by)).distinct(), by, "left_semi")


def directions(mechanisms: DataFrame) -> DataFrame:
    """``molecule, target, direction`` of each molecule on each target, and on all (a null target): the majority of known action types, a tie unknown."""
    d = mechanisms.where("molecule_chembl_id is not null").select(F.col("molecule_chembl_id").alias("molecule"), F.col("target_chembl_id").alias("target"), X.action_direction(F.col("action_type")).alias("d"))
    both = d.unionByName(d.where("target is not null").withColumn("target", F.lit(None).cast("string")))
    n = both.groupBy("molecule", "target").agg(F.count_if(F.col("d") == "agonist").alias("up"), F.count_if(F.col("d") == "antagonist").alias("down"))
    return n.select("molecule", "target", F.when(F.col("up") > F.col("down"), "agonist").when(F.col("down") > F.col("up"), "antagonist").otherwise("unknown").alias("direction"))


def diagnostic(molecules: DataFrame) -> DataFrame:
    """``molecule_chembl_id, diagnostic``: classed as such, or neither therapeutic nor in any phase; without facts it isn't."""
    told = F.coalesce(F.lower("indication_class").contains("diagnostic"), F.lit(False))
    idle = F.coalesce(~F.col("therapeutic_flag"), F.lit(False)) & F.coalesce(F.col("max_phase") < 1, F.lit(True))
    return molecules.where("molecule_chembl_id is not null").select("molecule_chembl_id", (told | idle).alias("diagnostic"))


def inn_names(synonyms: DataFrame, asked: DataFrame) -> DataFrame:
    """``code, name``: the first synonym of a code's compound that looks like a non-proprietary name.

    ``asked`` has ``code`` and ``cid``; ``synonyms`` has ``cid, synonym`` and their order ``pos``.
    """
    shaped = synonyms.select("cid", "pos", F.lower(F.trim("synonym")).alias("n")).where(F.col("n").rlike(r"^[a-z][a-z\-]{3,}$"))
    x = asked.join(shaped, "cid").where(_bare(F.col("n")) != _bare(F.col("code")))
    return x.groupBy("code").agg(F.min(F.struct("pos", "n"))["n"].alias("name"))


def ladder(asked: DataFrame, key: str, steps: list[DataFrame], value: str) -> DataFrame:
    """``key, value, step``: what the first table that knows a key says; later ones are asked only for what is left."""
    out = None
    left = asked.select(key).where(F.col(key).isNotNull()).distinct()
    for i, step in enumerate(steps, 1):
        known = step.groupBy(key).agg(F.min(value).alias(value))
        hit = left.join(known, key).select(key, value, F.lit(i).alias("step"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(known, key, "left_anti")
    return out


def memo(spark: SparkSession, path: str, asked: DataFrame, key: str, resolve) -> DataFrame:
    """A lookup kept as a table at ``path``: keys it lacks are resolved (``resolve`` takes and gives a frame with ``key``) and appended."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    want = asked.select(key).where(F.col(key).isNotNull()).distinct()
    misses = want.join(spark.read.parquet(path).select(key), key, "left_anti") if there else want
    resolve(misses).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(want, key, "left_semi")
