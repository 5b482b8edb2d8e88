"""Evidence from pathway dumps: hits of signatures, sources of a mechanism's pathways, descriptions matched to drugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tissues of an indication by the parts of its name.
TISSUES = {"skin": ["melanoma"], "lung": ["lung", "nsclc", "small cell lung"], "breast": ["breast"], "colon": ["colorectal", "colon", "rectal"], "liver": ["hepatocellular", "liver"], "prostate": ["prostate"], "kidney": ["kidney", "renal"], "neural": ["glioblastoma", "glioma", "neuroblastoma"]}
ALL_TISSUES = ["solid tumor", "advanced solid"]
# Words that say nothing of a pathway, and the least letters of a word that may be part of another.
STOP_WORDS, LEAST_LETTERS = "a an the and or of in on to for by via with from is are be as".split(), 4
# Least genes of a signature on a pathway, least share of signatures, pathways of a mechanism and of a biology at most.
LEAST_GENES, LEAST_SHARE, MOST_MECHANISM, MOST_BIOLOGY = 3, 0.5, 8, 1
# Names of pathways that are no cellular action, by tier, in this order (after "other" and "Other ...").
THERAPEUTICS, DISEASE_MODULE = "potential therapeutics|therapeutics for", r"defective\b.*\bcauses\b|deficiency\s*-|loss of function"
PATHOGENS = ["hiv virion", "listeria", "leishmania", "sars-cov", "vrna synthesis"]
GROUPINGS = ["class b/2 (secretin family receptors)", "hormone ligand-binding receptors", "peptide ligand-binding receptors", "prostanoid ligand receptors", "stimuli-sensing channels", "cation-coupled chloride cotransporters", "aspirin adme"]


def tissues(name: Column) -> Column:
    """Sorted tissues whose evidence counts for an indication; empty where nothing fits, which means all."""
    low = F.lower(name)
    every = F.coalesce(low.rlike("|".join(ALL_TISSUES)), F.lit(False))
    return F.array_sort(F.array_compact(F.array(*[F.when(every | low.rlike("|".join(parts)), t) for t, parts in TISSUES.items()])))


def invalid_mechanism(name: Column) -> Column:
    """Tier of a name that is no cellular action or process, else null."""
    n = F.lower(F.trim(name))
    return (
        F.when(n == "other", "E_placeholder").when(n.rlike(r"^other\b"), "F_residual_bucket").when(n.rlike(THERAPEUTICS), "A_therapeutic_collection")
        .when(n.rlike(DISEASE_MODULE), "B_disease_module").when(n.rlike("|".join(PATHOGENS)), "C_pathogen").when(n.isin(GROUPINGS), "D_grouping_or_PK")
    )


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def overlap(name: Column, context: Column) -> Column:
    """Words of the context that begin or end a word of the name (or the other way round), for each long enough word of the name."""
    long = lambda ws: F.filter(ws, lambda w: F.length(w) >= LEAST_LETTERS)
    own = long(words(name))
    met = F.filter(long(context), lambda c: F.exists(own, lambda p: c.startswith(p) | c.endswith(p) | p.startswith(c) | p.endswith(c)))
    return F.when(F.size(own) > 0, F.size(met) / F.size(own)).otherwise(0.0)


def pathway_hits(signatures: DataFrame, gene_pathways: DataFrame, least_genes: int = LEAST_GENES) -> DataFrame:
    """``pert_id, cell_id, pathway_id, genes``: pathways that enough of a signature's changed genes are on."""
    g = signatures.select("pert_id", "cell_id", F.explode(F.array_union(F.coalesce("up_genes", F.array().cast("array<string>")), F.coalesce("dn_genes", F.array().cast("array<string>")))).alias("gene")).distinct()
    hits = g.join(gene_pathways.select("gene", "pathway_id").distinct(), "gene").groupBy("pert_id", "cell_id", "pathway_id").agg(F.count("*").alias("genes"))
    return hits.where(F.col("genes") >= least_genes)


def pathway_consistency(signatures: DataFrame, gene_pathways: DataFrame, least_genes: int = LEAST_GENES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``pert_id, pathway_id, share, cells``: of a compound's signatures the share that hits a pathway, where it is large enough."""
    n = signatures.select("pert_id", "cell_id").distinct().groupBy("pert_id").agg(F.count("*").alias("n"))
    x = pathway_hits(signatures, gene_pathways, least_genes).groupBy("pert_id", "pathway_id").agg(F.count("*").alias("k"), F.array_sort(F.collect_set("cell_id")).alias("cells"))
    return x.join(n, "pert_id").withColumn("share", F.col("k") / F.col("n")).where(F.col("share") >= least_share).select("pert_id", "pathway_id", "share", "cells")


def pathway_indications(gene_pathways: DataFrame, associations: DataFrame, least_genes: int = 3, least_each: int = 2, least_score: float = 0.3) -> DataFrame:
    """``pathway_id, disease, genes, score``: diseases that enough genes of a pathway are associated with; gene names are the targets' ids.

    A pathway needs ``least_genes`` genes with any association, an edge ``least_each`` of its own.
    """
    a = associations.where(F.col("score") >= least_score).select(F.col("targetId").alias("gene"), F.col("diseaseName").alias("disease"), "score", "evidenceCount")
    x = gene_pathways.select("gene", "pathway_id").distinct().join(a, "gene")
    enough = x.groupBy("pathway_id").agg(F.countDistinct("gene").alias("g")).where(F.col("g") >= least_genes).select("pathway_id")
    each = x.join(enough, "pathway_id", "left_semi").groupBy("pathway_id", "disease").agg(F.count("*").alias("genes"), F.avg("score").alias("score"), F.sum("evidenceCount").alias("evidence"))
    return each.where(F.col("genes") >= least_each)


def chosen_source(candidates: DataFrame, most: int = MOST_MECHANISM, floor: float = 0.0) -> DataFrame:
    """Of each ``key`` the best pathways of one source: ``reactome`` unless the best ``go`` score is higher; ranked, at most ``most``.

    ``candidates`` has ``key, source, pathway_id, score``; of ``go`` only scores above ``floor`` count.
    """
    x = candidates.where((F.col("source") != "go") | (F.col("score") > floor))
    top = x.groupBy("key").agg(F.max(F.when(F.col("source") == "go", F.col("score"))).alias("g"), F.max(F.when(F.col("source") == "reactome", F.col("score"))).alias("r"))
    pick = top.select("key", F.when(F.col("r").isNull() | (F.col("g") > F.col("r")), "go").otherwise("reactome").alias("source"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "pathway_id")
    return x.join(pick, ["key", "source"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def described(asked: DataFrame, told: DataFrame) -> DataFrame:
    """The description that fits each drug of a trial's arm best: its own in that arm, its own in any, one that differs by a salt's word.

    ``asked`` has ``trial_id, arm_id, drug``, ``told`` the same and ``description, seq``; drugs are
    slugs. Of equally good ones the first told counts.
    """
    t = told.where("trim(description) <> ''").select("trial_id", F.col("arm_id").alias("arm"), F.col("drug").alias("d"), "description", "seq")
    # a drug meets those that share its first word; a salt only adds words
    x = asked.withColumn("w", F.split("drug", "_")[0]).join(t.withColumn("w", F.split("d", "_")[0]), ["trial_id", "w"])
    stem = (F.col("drug") == F.col("d")) | F.col("drug").startswith(F.concat("d", F.lit("_"))) | F.col("d").startswith(F.concat("drug", F.lit("_")))
    step = F.when((F.col("drug") == F.col("d")) & (F.col("arm_id") == F.col("arm")), 1).when(F.col("drug") == F.col("d"), 2).when(stem, 3)
    best = x.withColumn("step", step).where("step is not null").groupBy("trial_id", "arm_id", "drug").agg(F.min(F.struct("step", "seq", "description")).alias("m"))
    return asked.join(best, ["trial_id", "arm_id", "drug"], "left").select("trial_id", "arm_id", "drug", F.col("m.step").alias("step"), F.col("m.description").alias("description"))


def json_body(c: Column) -> Column:
    """The text of an answer without the fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*\n?", ""), r"\n?\s*```$", ""))


def number(c: Column) -> Column:
    """A number told as text: separators, signs before it and units after it are put up with; null without one."""
    return F.regexp_extract(F.regexp_replace(c, r"(?<=\d),(?=\d{3})", ""), r"^\s*[<>=~≈≤≥]*\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def filled(found: DataFrame, extra: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` filled from ``extra`` where it has nothing: null, blank or an empty list."""
    kind = dict(found.dtypes)[column]
    empty = F.col(column).isNull() | ((F.size(column) == 0) if kind.startswith("array") else (F.trim(column) == ""))
    e = extra.groupBy(key).agg(F.min(column).alias("__e"))
    return found.join(e, key, "left").withColumn(column, F.when(empty, F.coalesce("__e", column)).otherwise(F.col(column))).drop("__e")


def event_parents(terms: DataFrame, tables: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """``term, hlt, hlgt, soc, soc_name`` of adverse-event terms (slugs): up the levels as far as the tables lead.

    ``tables`` has ``hlt``, ``hlgt`` and ``soc`` (``child, parent`` from the level below) and ``direct`` (a
    term's organ class where the levels don't lead there); ``names`` has ``soc, soc_name``. A term's own
    ``fallback`` name of its class counts last. Of several parents the smallest counts.
    """
    up = {k: t.groupBy("child").agg(F.min("parent").alias(k)) for k, t in tables.items()}
    x = terms.select("term", "fallback").join(up["hlt"].withColumnRenamed("child", "term"), "term", "left")
    x = x.join(up["hlgt"].withColumnRenamed("child", "hlt"), "hlt", "left").join(up["soc"].withColumnRenamed("child", "hlgt"), "hlgt", "left")
    x = x.join(up["direct"].withColumnRenamed("child", "term"), "term", "left")
    by_name = names.groupBy(F.lower("soc_name").alias("n")).agg(F.min("soc").alias("named"))
    x = x.join(by_name, F.lower("fallback") == F.col("n"), "left").withColumn("soc", F.coalesce("soc", "direct", "named"))
    return x.join(names.groupBy("soc").agg(F.min("soc_name").alias("soc_name")), "soc", "left").select("term", "hlt", "hlgt", "soc", "soc_name")
