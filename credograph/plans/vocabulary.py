"""Queries of canonical text: slugs, classes, features and names; their SQL states every list again as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.functions import text as X
from credograph.operators import nested
from credograph.plans.base import CH_SQL, chains
from credograph.sources.tables import table


def text_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.primary_endpoint", "therapeutic_hypothesis.intended_biology")
    return x.select("extraction_id", X.slug(F.col("intended_biology")).alias("slug"), X.measure_slug(F.col("primary_endpoint")).alias("measure"), X.measure_slug(F.col("intended_biology"), 20).alias("short"), X.content_id("bio:", F.col("intended_biology")).alias("content_id"))


def endpoint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "extractions", "therapeutic_hypothesis.primary_endpoint").where("primary_endpoint is not null")
    return x.groupBy("primary_endpoint", X.endpoint_class(F.col("primary_endpoint")).alias("endpoint_class")).agg(F.count("*").alias("n"))


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "trials", "nct_id", "conditions").select("nct_id", F.explode("conditions").alias("condition")).where("condition is not null")


def disease_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions by slug, with the disease each is a kind of and whether it is one at all."""
    v = X.disease_slug(F.col("condition"))
    return _conditions(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("n")).withColumn("slug", v).select("condition", "slug", X.parent_disease(F.col("slug")).alias("parent"), X.names_no_disease(F.col("slug")).alias("no_disease"), "n")


def therapeutic_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials by area of their conditions, each rolled up to its parent first."""
    v = X.disease_slug(F.col("condition"))
    x = _conditions(spark, sf_dir).withColumn("v", F.coalesce(X.parent_disease(v), v))
    return x.groupBy(X.therapeutic_area(F.col("v")).alias("area")).agg(F.countDistinct("nct_id").alias("trials"))


def population_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population id of each extraction, and the coarser one of the axes that define a parent population."""
    x = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.target_population").withColumn("f", X.qualifiers(F.col("target_population")))
    coarse = F.filter("f", lambda f: f["axis"].isin(PARENT_AXES))
    return x.select("extraction_id", X.population_id(F.col("f")).alias("population_id"), X.population_id(coarse).alias("parent_id")).where("population_id is not null")


# Axes that define a parent population.
PARENT_AXES = ["line", "stage", "extent", "severity", "biomarker", "functional_class"]


def population_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of nested populations on canonical axes, with their slugs; a gene's symbol is looked up among listed targets."""
    t = nested.tables(table(spark, sf_dir, "nested_records", "record_id", "payload"))["features"]
    e = table(spark, sf_dir, "ref_entities").where("entity_type = 'target'")
    names = e.select(F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("canonical_name"))).alias("n"), "canonical_name").groupBy(F.lower("n").alias("k")).agg(F.min("canonical_name").alias("symbol"))
    x = t.join(names, F.lower("key") == F.col("k"), "left").withColumn("f", X.canonical_feature(F.col("axis"), F.col("key"), F.col("level"), F.col("value"), F.col("symbol")))
    told = F.coalesce("value", F.concat_ws(" ", "t_axis", "t_key", "t_level"))
    x = x.select("record_id", "row_path", "f", "value", F.col("axis").alias("t_axis"), F.col("key").alias("t_key"), F.col("level").alias("t_level"))
    return x.select("record_id", "row_path", "f.axis", "f.key", "f.level", X.feature_slug(F.col("f"), told).alias("slug"))


def mechanism_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority direction of each target's mechanisms; a tie is unknown."""
    c = chains(spark, sf_dir).where("target is not null and mechanism is not null").withColumn("d", X.direction(F.col("mechanism")))
    x = c.groupBy("target").agg(F.count_if(F.col("d") == "agonist").alias("up"), F.count_if(F.col("d") == "antagonist").alias("down"))
    return x.withColumn("direction", F.when(F.col("up") > F.col("down"), "agonist").when(F.col("down") > F.col("up"), "antagonist").otherwise("unknown"))


def moa_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chains(spark, sf_dir).where("mechanism is not null")
    return c.groupBy(X.moa_category(F.col("mechanism"), F.col("target")).alias("category")).agg(F.count("*").alias("chains"), F.countDistinct("mechanism").alias("mechanisms"))


def stripped_doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "extractions", "extraction_id", "results.dose_information", "therapeutic_hypothesis.compound").where("dose_information is not null or compound is not null")
    return x.select("extraction_id", X.strip_dose(F.col("compound")).alias("compound"), X.strip_dose(F.concat(F.lit("x "), F.col("dose_information"))).alias("schedule"))


def compound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs of each compound field by the rules of registry names, in their order."""
    x = table(spark, sf_dir, "extractions", "extraction_id", "therapeutic_hypothesis.compound").where("trim(compound) <> ''")
    return x.select("extraction_id", F.posexplode(X.compound_names(F.col("compound"))).alias("pos", "name"))


def compound_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placebos, generic names and specific molecules among the compounds, with what is left without placebo parts."""
    c = chains(spark, sf_dir).where("compound is not null").select("compound").distinct()
    active = X.active_part(F.col("compound"))
    kind = F.when(active.isNull(), "placebo").when(X.generic_name(F.col("compound")), "generic").otherwise("molecule")
    return c.select("compound", kind.alias("kind"), active.alias("active"))


def modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modality guessed from the name; the first pattern that fits, else a small molecule."""
    c = table(spark, sf_dir, "ref_entities", "canonical_name", "entity_type").where("entity_type = 'compound'")
    return c.groupBy(X.first_class(F.col("canonical_name"), MODALITIES, "small_molecule").alias("modality")).agg(F.count("*").alias("n"))


# Modality by the first pattern found in the lower-cased name.
MODALITIES = [("antibody.drug.conjugate|adc", "adc"), (r"antibod|mab\b", "antibody"), ("gene.therap|aav|viral.vector", "gene_therapy"), ("cell.therap|car.t|car-t", "cell_therapy")]


def ae_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverse events told by extractions: id in American spelling, and whether the term sums up a trial only."""
    x = table(spark, sf_dir, "extractions", "results.safety_signals").select(F.explode("safety_signals").alias("term")).where("term is not null")
    return x.groupBy("term").agg(F.count("*").alias("n")).select("term", X.ae_id(F.col("term")).alias("ae_id"), X.meta_ae(F.col("term")).alias("meta"), "n")


def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three other names of each listed entity, none a decorated or repeated one."""
    e = table(spark, sf_dir, "ref_entities", "entity_id", "canonical_name", "synonyms")
    return e.select("entity_id", F.array_join(X.drug_aliases(F.col("canonical_name"), F.array().cast("array<string>"), F.col("synonyms")), "|").alias("aliases"))


QUERIES = {f.__name__: f for f in (text_slugs, endpoint_classes, disease_slugs, therapeutic_areas, population_qualifiers, population_features, mechanism_directions, moa_categories, stripped_doses, compound_names, compound_predicates, modalities, ae_ids, alias_lists)}

_SLUG = "regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"


def _endpoint(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '\\bdistant[\\s-]*metastas[ie]s[\\s-]*free\\s+survival\\b|\\bdmfs\\b') THEN 'DMFS' WHEN regexp_matches({x}, '\\brelapse[\\s-]*free\\s+survival\\b|\\brfs\\b') THEN 'RFS'
  WHEN regexp_matches({x}, '\\bdisease[\\s-]*free\\s+survival\\b|\\bdfs\\b') THEN 'DFS' WHEN regexp_matches({x}, '\\bduration\\s+of\\s+(overall\\s+)?response\\b|\\bdor\\b') THEN 'DOR'
  WHEN regexp_matches({x}, '\\bprogression[\\s-]*free\\s+survival\\b|\\bpfs\\b') THEN 'PFS' WHEN regexp_matches({x}, '\\boverall\\s+survival\\b|\\bos\\b') THEN 'OS' WHEN regexp_matches({x}, '\\btime\\s+to\\s+progression\\b|\\bttp\\b') THEN 'TTP'
  WHEN regexp_matches({x}, '\\b(objective|overall)\\s+response\\s+rate\\b|\\bbest\\s+overall\\s+response\\b|\\borr\\b') THEN 'ORR' WHEN regexp_matches({x}, '\\bcomplete\\s+(response|remission)\\b|\\bcr\\s+rate\\b') THEN 'CR'
  WHEN regexp_matches({x}, '\\b(adverse\\s+event|serious\\s+adverse|sae|aes?\\b|dose[\\s-]*limiting\\s+toxicit|dlt\\b|maximum\\s+tolerated\\s+dose|mtd\\b|ecog\\s+performance|blood\\s+pressure|systolic|diastolic|heart\\s+rate|temperature|body\\s+weight|weight\\b|oxygen\\s+saturation|spo2\\b|ventricular\\s+ejection|lvef\\b|electrocardiogram|ecg\\b|hematology\\s+parameter|hematology\\b|hematologic\\b|clinical\\s+chemistry|chemistry\\s+parameter|urinalysis\\b|liver\\s+function|renal\\s+function)') THEN 'safety' END"""


def endpoint_sql(c: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\s*[\\(\\[][^)\\]]*[\\)\\]]', '', 'g'), '\\s+by\\s+(investigator|bicr|irc|independent\\s+(central\\s+)?review(\\s+committee)?|central\\s+review|local\\s+review|investigator\\s+assessment|local\\s+investigator)(\\s+assessment)?', '', 'g'), '\\s+', ' ', 'g'))"
    return f"coalesce({_endpoint(f'lower({c})')}, {_endpoint(bare)}, 'other')"


def disease_sql(c: str) -> str:
    v = f"regexp_replace(regexp_replace({_SLUG.format(c)}, '_s_', '_', 'g'), '_s$', '')"
    single = f"regexp_replace(regexp_replace(regexp_replace({v}, '_metastases$', '_metastasis'), '_(tumor|cancer|carcinoma|neoplasm|sarcoma|lymphoma|leukemia)s$', '_\\1'), '_(neuro|arthro|retino|myo|nephro|encephalo)pathies$', '_\\1pathy')"
    return f"""(SELECT CASE s WHEN 'squamous_cell_carcinoma_head_and_neck' THEN 'head_and_neck_squamous_cell_carcinoma' WHEN 'prostate_adenocarcinoma' THEN 'prostate_cancer' WHEN 'prostate_carcinoma' THEN 'prostate_cancer'
  WHEN 'pancreatic_adenocarcinoma' THEN 'pancreatic_cancer' WHEN 'pancreatic_carcinoma' THEN 'pancreatic_cancer' WHEN 'colorectal_adenocarcinoma' THEN 'colorectal_cancer' WHEN 'colorectal_carcinoma' THEN 'colorectal_cancer' WHEN 'gastric_adenocarcinoma' THEN 'gastric_cancer'
  WHEN 'endometrial_adenocarcinoma' THEN 'endometrial_cancer' WHEN 'ovarian_adenocarcinoma' THEN 'ovarian_cancer' WHEN 'renal_cell_adenocarcinoma' THEN 'renal_cell_carcinoma' WHEN 'crohns_disease' THEN 'crohn_disease' WHEN 'congestive_heart_failure' THEN 'heart_failure' ELSE s END FROM (SELECT {single} AS s))"""


def parent_sql(v: str) -> str:
    return f"CASE WHEN {v} <> 'melanoma' AND ends_with({v}, '_melanoma') THEN 'melanoma' END"


def area_sql(v: str) -> str:
    return f"""CASE WHEN regexp_matches({v}, 'cancer|carcinoma|leukemia|lymphoma|sarcoma|melanoma|tumor|glioma|myeloma|blastoma|mesothelioma|neoplasm|malignan|metasta|astrocytoma|mycosis_fungoides|squamous|germ_cell|ewing|wilms|oncology') THEN 'oncology'
  WHEN {v} IN ('hypercholesterolemia', 'familial_hypercholesterolemia', 'familial_hypercholesterolemia_homozygous', 'dyslipidemia', 'atherosclerotic_cardiovascular_disease', 'cardiovascular_diseases', 'coronary_heart_disease') THEN 'cardiometabolic'
  WHEN {v} IN ('polycystic_ovary_syndrome', 'gastrinoma', 'pheochromocytoma') THEN 'endocrine_metabolic' WHEN {v} IN ('alzheimers_disease', 'cognitive_impairment', 'epilepsy', 'pain', 'arthralgia', 'familial_amyloid_polyneuropathy') THEN 'neuro'
  WHEN {v} IN ('hepatitis_c', 'condylomata_acuminata') THEN 'infectious' WHEN {v} IN ('uterine_fibroids', 'lower_urinary_tract_symptoms') THEN 'gyn_urologic' WHEN {v} IN ('actinic_keratosis', 'basal_cell_nevus_syndrome') THEN 'dermatology'
  WHEN {v} IN ('crohns_disease', 'gastric_ulcer') THEN 'gastro_immune' WHEN {v} IN ('polycythemia_vera', 'myelodysplastic_syndromes', 'neutropenia', 'chronic_myeloproliferative_disorder') THEN 'hematology_nonmalignant' ELSE 'other' END"""


_TP = "lower(therapeutic_hypothesis.target_population)"
_QUALIFIED = f"""q AS (SELECT extraction_id, {_TP} AS t FROM extractions), x AS (SELECT extraction_id,
  CASE WHEN regexp_matches(t, '\\bstage\\s+(iv|4)\\b') THEN 'stage_iv' WHEN regexp_matches(t, '\\bstage\\s+(iii[abc]?|3)\\b') THEN 'stage_iii' WHEN regexp_matches(t, '\\bstage\\s+(ii[abc]?|2)\\b') THEN 'stage_ii' WHEN regexp_matches(t, '\\bstage\\s+(i[abc]?|1)\\b') THEN 'stage_i' WHEN regexp_matches(t, '\\bstage\\s+0\\b|\\bcarcinoma\\s+in\\s+situ\\b') THEN 'stage_0' END AS stage,
  CASE WHEN regexp_matches(t, '\\bmoderate\\s*(to|-)\\s*severe\\b') THEN 'severity_moderate_severe' WHEN regexp_matches(t, '\\bmild\\s*(to|-)\\s*moderate\\b') THEN 'severity_mild_moderate' WHEN regexp_matches(t, '\\bsevere\\b') THEN 'severity_severe' WHEN regexp_matches(t, '\\bmoderate\\b') THEN 'severity_moderate' WHEN regexp_matches(t, '\\bmild\\b') THEN 'severity_mild' END AS severity,
  CASE WHEN regexp_matches(t, '\\bmetastatic\\b') THEN 'extent_metastatic' WHEN regexp_matches(t, '\\bunresectable\\b') THEN 'extent_unresectable' WHEN regexp_matches(t, '\\bresectable\\b') THEN 'extent_resectable' WHEN regexp_matches(t, '\\blocally\\s+advanced\\b') THEN 'extent_locally_advanced' WHEN regexp_matches(t, '\\bdisseminated\\b') THEN 'extent_disseminated' WHEN regexp_matches(t, '\\blocalized\\b') THEN 'extent_localized' WHEN regexp_matches(t, '\\badvanced\\b') THEN 'extent_advanced' END AS extent,
  CASE WHEN regexp_matches(t, '\\bneo[\\s-]?adjuvant\\b') THEN 'setting_neoadjuvant' WHEN regexp_matches(t, '\\badjuvant\\b') THEN 'setting_adjuvant' WHEN regexp_matches(t, '\\bmaintenance\\b') THEN 'setting_maintenance' WHEN regexp_matches(t, '\\bperioperative\\b') THEN 'setting_perioperative' END AS setting,
  CASE WHEN regexp_matches(t, '\\b(previously\\s+untreated|treatment[\\s-]na(ï|i)ve|newly\\s+diagnosed|first[\\s-]line|1l\\b)') THEN 'line_first' WHEN regexp_matches(t, '\\bsecond[\\s-]line\\b|\\b2l\\b') THEN 'line_second' WHEN regexp_matches(t, '\\b(third|3rd|later)[\\s-]line\\b|\\brefractory\\b|\\brelapsed\\b|\\bpreviously\\s+treated\\b') THEN 'line_later' END AS line,
  CASE WHEN regexp_matches(t, '\\bpediatric\\b|\\bchild(ren|hood)?\\b') THEN 'age_pediatric' WHEN regexp_matches(t, '\\belderly\\b|\\bgeriatric\\b') THEN 'age_elderly' END AS age,
  CASE WHEN regexp_matches(t, '\\bcutaneous\\b') THEN 'cutaneous' WHEN regexp_matches(t, '\\buveal\\b|\\bocular\\b') THEN 'uveal' WHEN regexp_matches(t, '\\bmucosal\\b') THEN 'mucosal' WHEN regexp_matches(t, '\\bacral\\b') THEN 'acral' WHEN regexp_matches(t, '\\bnon[\\s-]?small[\\s-]?cell\\b|\\bnsclc\\b') THEN 'non_small_cell' WHEN regexp_matches(t, '\\bsmall[\\s-]?cell\\b|\\bsclc\\b') THEN 'small_cell'
    WHEN regexp_matches(t, '\\badenocarcinoma\\b') THEN 'adenocarcinoma' WHEN regexp_matches(t, '\\bsquamous\\b') THEN 'squamous' WHEN regexp_matches(t, '\\blarge[\\s-]?cell\\b') THEN 'large_cell' WHEN regexp_matches(t, '\\btriple[\\s-]?negative\\b|\\btnbc\\b') THEN 'triple_negative' WHEN regexp_matches(t, '\\bhormone[\\s-]?receptor[\\s-]?positive\\b|\\bhr\\s*\\+') THEN 'hr_positive' WHEN regexp_matches(t, '\\bher2[\\s-]?positive\\b|\\bher2\\+') THEN 'her2_positive'
    WHEN regexp_matches(t, '\\bductal\\b') THEN 'ductal' WHEN regexp_matches(t, '\\blobular\\b') THEN 'lobular' WHEN regexp_matches(t, '\\bin[\\s-]?situ\\b|\\bdcis\\b') THEN 'in_situ' WHEN regexp_matches(t, '\\bdiffuse\\s+large\\s+b[\\s-]?cell\\b|\\bdlbcl\\b') THEN 'dlbcl' WHEN regexp_matches(t, '\\bfollicular\\b') THEN 'follicular' WHEN regexp_matches(t, '\\bnon[\\s-]?hodgkin\\b|\\bnhl\\b') THEN 'non_hodgkin' WHEN regexp_matches(t, '\\bhodgkin\\b') THEN 'hodgkin'
    WHEN regexp_matches(t, '\\bmantle[\\s-]?cell\\b') THEN 'mantle_cell' WHEN regexp_matches(t, '\\bmyeloma\\b') THEN 'myeloma' WHEN regexp_matches(t, '\\brelapsing[\\s-]?remitting\\b|\\brrms\\b') THEN 'relapsing_remitting' WHEN regexp_matches(t, '\\bprimary[\\s-]?progressive\\b') THEN 'primary_progressive' WHEN regexp_matches(t, '\\bsecondary[\\s-]?progressive\\b') THEN 'secondary_progressive' END AS hist FROM q)"""
_DIR = "(len(regexp_extract_all({0}, '\\b(agonism|activation|stabilization|stabilisation)\\b')) - len(regexp_extract_all({0}, '\\b(inhibition|antagonism|blockade|degradation|sequestration|chelation)\\b')))"
_DOSE_OFF = r"regexp_replace(regexp_replace({}, '\s+\d+(\.\d+)?\s*(mg|μg|ug|mcg|ng|g|iu|miu|mu|units?|u)(\s*/\s*(kg|m\^?2|m2|day|d))?\b', '', 'gi'), '\s+(q\d+h|q[idh]s?\b|[bt]?id\b|qd\b|po\b|iv\b|sc\b|im\b)', '', 'gi')"


def _stripped(c: str) -> str:
    v = f"trim(regexp_replace({_DOSE_OFF.format(c)}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {v} = '' THEN {c} ELSE {v} END"


def _measure(c: str, most: int) -> str:
    words = f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
    filler = "['the','of','in','on','to','for','by','with','from','and','or','a','an','as','at','is','are','be','change','changes','baseline','absolute','relative','average','mean','median','total','follow','up','followup','all','number','percentage','percent','proportion','over','per','study','assessed','measured','using','value','values','level','levels']"
    kept = f"list_filter({words}, lambda w: NOT list_contains({filler}, w))"
    used = f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words} END"
    fits = f"list_filter(range(1, len({used}) + 1), lambda i: length(array_to_string(list_slice({used}, 1, i), '_')) <= {most})"
    return f"coalesce(nullif(array_to_string(list_slice({used}, 1, coalesce(list_max({fits}), 0)), '_'), ''), 'unspecified')"


SQL = {
    "text_slugs": f"SELECT extraction_id, {_SLUG.format('therapeutic_hypothesis.intended_biology')} AS slug, {_measure('therapeutic_hypothesis.primary_endpoint', 48)} AS measure, {_measure('therapeutic_hypothesis.intended_biology', 20)} AS short, 'bio:' || substr(sha1(trim(regexp_replace(lower(therapeutic_hypothesis.intended_biology), '\\s+', ' ', 'g'))), 1, 12) AS content_id FROM extractions",
    "endpoint_classes": f"SELECT therapeutic_hypothesis.primary_endpoint AS primary_endpoint, {endpoint_sql('therapeutic_hypothesis.primary_endpoint')} AS endpoint_class, count(*) AS n FROM extractions WHERE therapeutic_hypothesis.primary_endpoint IS NOT NULL GROUP BY 1, 2",
    "disease_slugs": f"WITH c AS (SELECT c AS condition, count(*) AS n FROM (SELECT unnest(conditions) AS c FROM trials) WHERE c IS NOT NULL GROUP BY 1), s AS (SELECT *, {disease_sql('condition')} AS slug FROM c) SELECT condition, slug, {parent_sql('slug')} AS parent, slug = '' OR slug IN ('child', 'children', 'childhood', 'adult', 'adults', 'elderly', 'healthy', 'healthy_volunteer', 'healthy_volunteers', 'patients', 'none', 'other') OR length(slug) > 80 AS no_disease, n FROM s",
    "therapeutic_areas": f"WITH c AS (SELECT nct_id, unnest(conditions) AS c FROM trials), s AS (SELECT nct_id, {disease_sql('c')} AS s FROM c WHERE c IS NOT NULL), r AS (SELECT nct_id, coalesce({parent_sql('s')}, s) AS v FROM s) SELECT {area_sql('v')} AS area, count(DISTINCT nct_id) AS trials FROM r GROUP BY 1",
    "population_qualifiers": f"WITH {_QUALIFIED}, y AS (SELECT extraction_id, list_sort(list_filter([stage, severity, extent, setting, line, age, 'histology_' || hist], lambda v: v IS NOT NULL)) AS a, list_sort(list_filter([stage, severity, extent, line], lambda v: v IS NOT NULL)) AS b FROM x) SELECT extraction_id, array_to_string(a, '__') AS population_id, nullif(array_to_string(b, '__'), '') AS parent_id FROM y WHERE len(a) > 0",
    "mechanism_directions": f"WITH {CH_SQL}, d AS (SELECT target, sign({_DIR.format('mechanism')}) AS d FROM ch WHERE target IS NOT NULL AND mechanism IS NOT NULL), x AS (SELECT target, count(*) FILTER (WHERE d = 1) AS up, count(*) FILTER (WHERE d = -1) AS down FROM d GROUP BY 1) SELECT *, CASE WHEN up > down THEN 'agonist' WHEN down > up THEN 'antagonist' ELSE 'unknown' END AS direction FROM x",
    "moa_categories": f"WITH {CH_SQL}, c AS (SELECT mechanism, target, CASE string_split_regex(mechanism, '\\s+')[-1] WHEN 'inhibitor' THEN 'enzyme_inhibition' WHEN 'antagonist' THEN 'receptor_antagonism' WHEN 'agonist' THEN 'receptor_agonism' WHEN 'blocker' THEN 'receptor_antagonism' WHEN 'activator' THEN 'receptor_agonism' WHEN 'degrader' THEN 'protein_degradation' WHEN 'modulator' THEN 'other' ELSE CASE WHEN contains(mechanism, 'inhibit') THEN 'enzyme_inhibition' WHEN contains(mechanism, 'antagon') THEN 'receptor_antagonism' WHEN contains(mechanism, 'agonist') THEN 'receptor_agonism' WHEN contains(mechanism, 'block') THEN 'receptor_antagonism' WHEN contains(mechanism, 'activat') THEN 'receptor_agonism' WHEN contains(mechanism, 'degrad') THEN 'protein_degradation' WHEN contains(mechanism, 'edit') THEN 'gene_editing' END END AS k FROM ch WHERE mechanism IS NOT NULL) SELECT CASE WHEN k = 'enzyme_inhibition' AND (contains(mechanism, 'kinase') OR coalesce(contains(target, 'kinase'), false)) THEN 'kinase_inhibition' ELSE k END AS category, count(*) AS chains, count(DISTINCT mechanism) AS mechanisms FROM c GROUP BY 1",
    "stripped_doses": f"SELECT extraction_id, {_stripped('therapeutic_hypothesis.compound')} AS compound, {_stripped(chr(39) + 'x ' + chr(39) + ' || results.dose_information')} AS schedule FROM extractions WHERE results.dose_information IS NOT NULL OR therapeutic_hypothesis.compound IS NOT NULL",
    "compound_predicates": f"WITH {CH_SQL}, c AS (SELECT DISTINCT compound FROM ch WHERE compound IS NOT NULL), a AS (SELECT compound, nullif(array_to_string(list_filter(list_transform(string_split_regex(compound, '[;+/]| and '), lambda p: trim(p)), lambda p: p <> '' AND NOT regexp_matches(p, 'placebo|sham|vehicle')), '; '), '') AS active, rtrim(compound, '.') AS g FROM c) SELECT compound, CASE WHEN active IS NULL THEN 'placebo' WHEN regexp_replace(g, 's$', '') IN ('pharmacotherapy', 'drug therapy', 'medication', 'medical therapy', 'medical management', 'standard treatment', 'standard therapy', 'standard of care', 'standard care', 'study drug', 'active drug', 'investigational drug', 'investigational product', 'active treatment', 'active comparator', 'experimental drug', 'active agent', 'conventional treatment', 'treatment', 'therapy', 'best available therapy', 'best available care', 'systemic therapy') THEN 'generic' ELSE 'molecule' END AS kind, active FROM a",
    "modalities": "SELECT CASE WHEN regexp_matches(lower(canonical_name), 'antibody.drug.conjugate|adc') THEN 'adc' WHEN regexp_matches(lower(canonical_name), 'antibod|mab\\b') THEN 'antibody' WHEN regexp_matches(lower(canonical_name), 'gene.therap|aav|viral.vector') THEN 'gene_therapy' WHEN regexp_matches(lower(canonical_name), 'cell.therap|car.t') THEN 'cell_therapy' ELSE 'small_molecule' END AS modality, count(*) AS n FROM ref_entities WHERE entity_type = 'compound' GROUP BY 1",
    "ae_ids": "SELECT term, 'AE:' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(term)), '\\bdiarrhoea\\b', 'diarrhea', 'g'), '\\bhaem', 'hem', 'g'), '\\banaem', 'anem', 'g'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS ae_id, regexp_matches(lower(term), '^\\s*((all|any|total|serious)\\s+)?(adverse\\s+events?|aes?)\\s*$|^\\s*(toxicity|toxicities|side\\s+effects?)\\s*$') AS meta, count(*) AS n FROM (SELECT unnest(results.safety_signals) AS term FROM extractions) WHERE term IS NOT NULL GROUP BY 1",
}
