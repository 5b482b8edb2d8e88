"""Readers of registry pages, corpora, alias tables and snapshots; schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STUDY = """protocolSection struct<
  identificationModule: struct<nctId: string, briefTitle: string>,
  statusModule: struct<overallStatus: string, whyStopped: string, startDateStruct: struct<date: string>>,
  designModule: struct<phases: array<string>, studyType: string, enrollmentInfo: struct<count: bigint>>,
  conditionsModule: struct<conditions: array<string>>,
  armsInterventionsModule: struct<interventions: array<struct<type: string, name: string, otherNames: array<string>>>, armGroups: array<struct<label: string, type: string, interventionNames: array<string>>>>,
    outcomesModule: struct<primaryOutcomes: array<struct<measure: string, timeFrame: string, description: string>>, secondaryOutcomes: array<struct<measure: string, timeFrame: string, description: string>>>,
  eligibilityModule: struct<eligibilityCriteria: string, sex: string, minimumAge: string, maximumAge: string>,
  referencesModule: struct<references: array<struct<pmid: string, type: string, citation: string>>>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>>,
hasResults boolean,
resultsSection struct<outcomeMeasuresModule: struct<outcomeMeasures: array<struct<title: string, groups: array<struct<id: string, title: string, description: string>>, classes: array<struct<title: string>>>>>, adverseEventsModule: struct<
  eventGroups: array<struct<id: string, title: string, seriousNumAtRisk: bigint>>,
  seriousEvents: array<struct<term: string, stats: array<struct<groupId: string, numAffected: bigint, numAtRisk: bigint>>>>>>"""
PLACEBO = "placebo|sham|vehicle|saline"
# Titles of result classes that name no subgroup.
TOTALS = ["total", "overall", "all participants", "all patients"]
#: A serious event is kept where at least so many are affected in some group.
LEAST_AFFECTED = 3


def studies(spark: SparkSession, path: str) -> DataFrame:
    """Registry study JSON, one object a line, flattened to one row a trial; broken lines give null ids and are dropped.

    Arms are the planned ones, with their drugs; where none are planned, the groups that
    results are reported for, each once. Subgroups are the titles of result classes, once
    each whatever their case, totals left out. ``broken_lines`` gives what was dropped.
    """
    x = spark.read.schema(STUDY).json(path)
    p, none = "protocolSection.", F.array().cast("array<string>")
    drugs = lambda a: F.filter(F.transform(F.coalesce(a["interventionNames"], none), lambda n: F.trim(F.regexp_replace(n, "^[A-Za-z ]+: ", ""))), lambda n: (n != "") & ~F.lower(n).rlike(PLACEBO))
    planned = F.filter(F.transform(F.coalesce(F.col(p + "armsInterventionsModule.armGroups"), F.array()), lambda a: F.struct(F.trim(a["label"]).alias("label"), drugs(a).alias("compounds"))), lambda a: a["label"] != "")
    measures = F.col("resultsSection.outcomeMeasuresModule.outcomeMeasures")
    groups = F.filter(F.flatten(F.transform(measures, lambda m: F.coalesce(m["groups"], F.array()))), lambda g: F.coalesce(g["id"], F.lit("")) != "")
    once = F.filter(groups, lambda g, i: ~F.exists(F.slice(groups, 1, i), lambda h: h["id"] == g["id"]))
    reported = F.transform(once, lambda g: F.struct(F.coalesce(g["title"], F.lit("")).alias("label"), none.alias("compounds")))
    arms = F.when(F.size(planned) > 0, planned).otherwise(F.coalesce(reported, F.array()))
    titles = F.filter(F.transform(F.flatten(F.transform(measures, lambda m: F.coalesce(m["classes"], F.array()))), lambda c: F.trim(c["title"])), lambda x: (x != "") & ~F.lower(x).isin(TOTALS))
    subgroups = F.filter(titles, lambda x, i: ~F.exists(F.slice(titles, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return x.select(
        F.col(p + "identificationModule.nctId").alias("trial_id"), F.col(p + "identificationModule.briefTitle").alias("title"),
        F.col(p + "statusModule.overallStatus").alias("status"), F.col(p + "statusModule.whyStopped").alias("why_stopped"),
        F.col(p + "designModule.phases").alias("phases"), F.col(p + "designModule.studyType").alias("study_type"), F.col(p + "designModule.enrollmentInfo.count").alias("enrollment"),
        F.col(p + "conditionsModule.conditions").alias("conditions"), F.col(p + "armsInterventionsModule.interventions").alias("interventions"), arms.alias("arms"),
        F.col(p + "sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"), F.coalesce("hasResults", F.lit(False)).alias("has_results"), F.col("resultsSection.adverseEventsModule").alias("adverse_events"),
        F.col(p + "outcomesModule.primaryOutcomes").alias("primary_outcomes"), F.col(p + "outcomesModule.secondaryOutcomes").alias("secondary_outcomes"), F.col(p + "eligibilityModule").alias("eligibility"), F.col(p + "referencesModule.references").alias("references"), F.coalesce(subgroups, none).alias("subgroups"),
    ).where("trial_id is not null")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of what ``studies`` drops: not JSON, or without an id."""
    x = spark.read.text(path).where("trim(value) <> ''")
    return x.where(F.get_json_object("value", "$.protocolSection.identificationModule.nctId").isNull()).select(F.col("value").alias("line"))


def search(df: DataFrame, condition: str | None = None, intervention: str | None = None, phases: list[str] | None = None, statuses: list[str] | None = None, study_type: str | None = None, has_results: bool | None = None) -> DataFrame:
    """Registry search as a filter: lists are alternatives, criteria go together, text matches any part."""
    c: Column = F.lit(True)
    if condition:
        c = c & F.exists("conditions", lambda x: F.lower(x).contains(condition.lower()))
    if intervention:
        c = c & F.exists("interventions", lambda x: F.lower(x["name"]).contains(intervention.lower()))
    if phases:
        c = c & F.arrays_overlap("phases", F.array(*map(F.lit, phases)))
    if statuses:
        c = c & F.col("status").isin(statuses)
    if study_type:
        c = c & (F.col("study_type") == study_type)
    if has_results is not None:
        c = c & (F.col("has_results") == has_results)
    return df.where(F.coalesce(c, F.lit(False)))


def with_results(df: DataFrame) -> DataFrame:
    """Preset: phase 2 or 3, completed or terminated, with results."""
    return search(df, phases=["PHASE2", "PHASE3"], statuses=["COMPLETED", "TERMINATED"], has_results=True)


def stopped_drug_trials(df: DataFrame, most: int | None = None) -> DataFrame:
    """Preset: terminated or withdrawn with a reason, and a drug among the interventions; at most ``most``, by id."""
    found = search(df, statuses=["TERMINATED", "WITHDRAWN"]).where("trim(why_stopped) <> ''").where(F.exists("interventions", lambda x: x["type"].isin("DRUG", "BIOLOGICAL")))
    return found if most is None else found.orderBy("trial_id").limit(most)


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookup of many ids at once."""
    return df.join(ids.select("trial_id").distinct(), "trial_id", "left_semi")


def serious_events(df: DataFrame) -> DataFrame:
    """Serious events with their groups and rates, where some group has enough affected."""
    x = df.select("trial_id", "adverse_events.eventGroups", F.explode("adverse_events.seriousEvents").alias("e"))
    x = x.where(F.array_max(F.transform("e.stats", lambda s: s["numAffected"])) >= LEAST_AFFECTED)
    x = x.select("trial_id", "eventGroups", F.col("e.term").alias("term"), F.explode("e.stats").alias("s"))
    group = F.get(F.filter("eventGroups", lambda g: g["id"] == F.col("s.groupId")), F.lit(0))
    at_risk = F.coalesce("s.numAtRisk", group["seriousNumAtRisk"])
    return x.select("trial_id", "term", group["title"].alias("arm"), F.col("s.numAffected").alias("affected"), at_risk.alias("at_risk"), F.when(at_risk > 0, 100 * F.col("s.numAffected") / at_risk).alias("pct"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a corpus file, one a line: comments after ``#`` and blanks left out, the first of repeats kept with its place."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    x = spark.read.text(path).select(place.alias("pos"), F.trim(F.split("value", "#")[0]).alias("trial_id")).where("trial_id <> ''")
    return x.groupBy("trial_id").agg(F.min("pos").alias("pos"))


def write_corpus(ids: DataFrame, path: str, header: str) -> None:
    """Ids one a line under a comment, in order of their place; a corpus is one small file."""
    lines = ids.orderBy("pos").select(F.col("trial_id").alias("value"))
    head = ids.sparkSession.createDataFrame([(f"# {header}",)], "value string")
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)


def alias_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated symbols with aliases packed by ``|``: one row for each name, approved symbols first."""
    x = spark.read.csv(path, sep="\t", header=True, schema="symbol string, alias_symbol string, prev_symbol string, uniprot_ids string")
    names = F.concat(F.array("symbol"), *[F.split(F.regexp_replace(F.coalesce(c, F.lit("")), '"', ""), r"\|") for c in ("alias_symbol", "prev_symbol")])
    y = x.select("symbol", F.get(F.split("uniprot_ids", r"\|"), F.lit(0)).alias("uniprot"), F.posexplode(names).alias("rank", "name")).where("trim(name) <> ''")
    return y.groupBy(F.upper(F.trim("name")).alias("alias")).agg(F.min_by(F.struct("symbol", "uniprot"), F.struct(F.least("rank", F.lit(1)), "symbol")).alias("s")).select("alias", "s.symbol", "s.uniprot")


def annotation_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, against an explicit schema; what doesn't parse is kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
