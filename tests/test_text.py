from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from credograph.functions import text as X
from credograph.operators import graph


def values(spark, column, rows, schema="v string"):
    df = spark.createDataFrame([(*r, i) if isinstance(r, tuple) else (r, i) for i, r in enumerate(rows)], schema + ", i int")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_endpoints(spark):
    cases = {"Progression-Free Survival (PFS) by investigator": "PFS", "Median OS": "OS", "distant metastases free survival": "DMFS", "Systolic pressure": "safety", "ECOG performance status": "safety", "LVEF": "safety", "Disease (local) Free Survival": "DFS", "ORR [cohort 2]": "ORR", "SAEs": "safety", "pain score": "other", "": "other", "Change in ECG": "safety"}
    assert dict(zip(cases, values(spark, X.endpoint_class(F.col("v")), cases))) == cases


def test_measures_and_diseases(spark):
    assert values(spark, X.measure_slug(F.col("v")), ["Change from baseline in average pain score", "the of", "", None, "a" * 60, "alpha " * 20]) == ["pain_score", "the_of", "unspecified", "unspecified", "unspecified", "_".join(["alpha"] * 8)]
    cases = {"Crohn's Disease": "crohn_disease", "Crohns disease": "crohn_disease", "Brain Metastases": "brain_metastasis", "Solid Tumors": "solid_tumor", "Multiple Sclerosis": "multiple_sclerosis", "Congestive Heart Failure": "heart_failure"}
    assert dict(zip(cases, values(spark, X.disease_slug(F.col("v")), cases))) == cases
    assert values(spark, X.parent_disease(F.col("v")), ["uveal_melanoma", "advanced_melanoma", "melanoma", "asthma"]) == ["melanoma", "melanoma", None, None]
    assert values(spark, X.names_no_disease(F.col("v")), ["child", "childhood_leukemia", None, "x" * 81]) == [True, False, True, True]
    assert values(spark, X.therapeutic_area(F.col("v")), ["wilms_disease", "pain", "asthma"]) == ["oncology", "neuro", "other"]


def test_qualifiers(spark):
    q = X.population_id(X.qualifiers(F.col("v")))
    assert values(spark, q, ["Stage IIIC Cutaneous Melanoma", "moderate to severe, metastatic or advanced", "Treatment-naïve children, first-line", "all comers", None, "stage iv"]) == ["histology_cutaneous__stage_iii", "extent_metastatic__severity_moderate_severe", "age_pediatric__line_first", None, None, "stage_iv"]


FEATURES = [
    (("gene", "pd-l1", "high", "", "CD274"), ("gene", "CD274", "positive"), "cd274_positive"), (("gene", "BRAF", "v600e", "", None), ("gene", "BRAF", "V600E"), "braf_v600e"), (("gene", "not a symbol!", "high", "x", None), ("other", "", "high"), "other_x"),
    (("biomarker", "anti-CCP", "elevated", "", None), ("biomarker", "anti_ccp", "high"), "anticcp_high"), (("line", "", "First", "", None), ("line", "", "first"), "line_first"), (("line", "", "fifth", "5th line", None), ("other", "", "fifth"), "other_5th_line"),
    (("other", "", "CR", "", None), ("response", "", "complete_response"), "response_complete_response"), (("", "", "haha_positive_baseline", "", None), ("antibody_status", "", "positive"), "antibody_status_positive"), (("other", "", "x", "Week 12", None), ("other", "", "_known_non_stratifier"), "other_week_12"),
    ((None, None, None, None, None), ("other", "", "unmapped"), "other_unmapped"),
]


def test_features(spark):
    f = X.canonical_feature(*(F.col(c) for c in ("a", "k", "l", "d", "s")))
    rows = [r for r, _, _ in FEATURES]
    assert [tuple(x) for x in values(spark, f, rows, "a string, k string, l string, d string, s string")] == [w for _, w, _ in FEATURES]
    told = F.coalesce(F.nullif("d", F.lit("")), F.concat_ws(" ", "a", "k", "l"))
    assert values(spark, X.feature_slug(f, told), rows, "a string, k string, l string, d string, s string") == [w for _, _, w in FEATURES]


@pytest.mark.parametrize("name,want", [("Sorafenib (Nexavar; BAY43-9006) + Dacarbazine (DTIC)", ["Sorafenib", "Dacarbazine"]), ("Oxaliplatin + Capecitabine 1000 mg/m^2", ["Oxaliplatin", "Capecitabine"]), ("BMS 188667 (Abatacept)", ["Abatacept"]), ("5% Dextrose/Saline", ["5% Dextrose/Saline"]), ("Aspirin 81 mg PO daily", ["Aspirin daily"]), ("5-Fluorouracil", ["5-Fluorouracil"]), ("X (with Y)", ["X (with Y)"])])
def test_compound_names(spark, name, want):
    assert values(spark, X.compound_names(F.col("v")), [name]) == [want]


def test_placebos_grades_and_events(spark):
    assert values(spark, X.active_part(F.col("v")), ["Double-blind adalimumab placebo", "infliximab infusion; AZA placebo caps", "olmesartan + candesartan placebo", None]) == [None, "infliximab infusion", "olmesartan", None]
    assert values(spark, X.generic_name(F.col("v")), ["Medications.", "chemotherapy", None]) == [True, False, False]
    assert values(spark, X.max_grade(F.col("v")), ["1,2,3-5", "any,3-4", "", None, "any"]) == [5, 4, None, None, None]
    assert values(spark, X.severity_weight(F.col("v"), F.lit(True)), ["1", "5", None]) == [0.15, 0.5, 0.15] and values(spark, X.severity_weight(F.col("v"), F.lit(False)), ["1", None]) == [0.05, 0.10]
    assert values(spark, X.ae_id(F.col("v")), ["Haemolytic anaemia", "Hemolytic anemia", ""]) == ["AE:hemolytic_anemia", "AE:hemolytic_anemia", "AE:unspecified"]
    assert values(spark, X.meta_ae(F.col("v")), ["Grade 3-5 adverse events", "Toxicity", "Hepatotoxicity", "Grade 3 hepatotoxicity", None]) == [True, True, False, False, True]


def test_directions_and_aliases(spark):
    assert values(spark, X.action_direction(F.col("v")), ["partial agonist", "DEGRADER", "vaccine", None]) == ["agonist", "antagonist", "unknown", "unknown"]
    assert values(spark, X.direction(F.col("v")), ["kinase inhibition and B-cell inhibition with agonism", "inhibition, activation", "silencing", None]) == ["antagonist", "unknown", "unknown", "unknown"]
    assert values(spark, X.moa_category(F.col("v"), F.lit("MAP kinase 1")), ["BRAF inhibitor", "partial agonist", "gene editing", "none"]) == ["kinase_inhibition", "receptor_agonism", "gene_editing", None]
    df = spark.createDataFrame([("nivolumab", ["Nivolumab bms", "Opdivo", "Other"], ["ONO-4538", "ono 4538", "component of Opdualag", "BMS-936558", "MDX-1106", "x"])], "c string, t array<string>, s array<string>")
    assert df.select(X.drug_aliases(F.col("c"), F.col("t"), F.col("s")).alias("a")).first()["a"] == ["Opdivo", "ONO-4538", "BMS-936558"]


def test_ancestors(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", "w"), ("s", "s"), (None, "a")] + [(f"n{i}", f"n{i + 1}") for i in range(9)], "node string, parent string")
    nodes = spark.createDataFrame([("a",), ("x",), ("n0",), ("alone",), ("s",)], "node string")
    got = {}
    for r in graph.ancestors(nodes, parents).orderBy("level").collect():
        got.setdefault(r["node"], []).append(r["ancestor"])
    assert got == {"a": ["a", "b", "c"], "x": ["x", "w"], "n0": [f"n{i}" for i in range(6)], "alone": ["alone"], "s": ["s"]}


def test_two_hop_counts_and_running_totals(spark):
    edges = {("a", "t", "x"), ("b", "t", "x"), ("t", "a", "y"), ("t", "m", "y"), ("c", "u", "x"), ("u", "c", "y"), ("d", "v", "x"), ("v", "m", "y")}
    paths = [(a, t, m) for a, t, k in edges for t2, m, k2 in edges if k == "x" and k2 == "y" and t == t2 and a != m]
    want = {t: (len({a for a, x, _ in paths if x == t}), len({m for _, x, m in paths if x == t}), sum(x == t for _, x, _ in paths)) for _, t, _ in paths}
    got = graph.two_hop_counts(spark.createDataFrame([*edges], "src string, dst string, edge_type string"), "x", "y").collect()
    assert {r["via"]: tuple(r)[1:] for r in got} == want
    rows = [("g", f"{i // 2:05d}", i % 5) for i in range(200)] + [("h", "00001", 7)]
    run = graph.running_total(spark.createDataFrame(rows, "g string, o string, v long"), "g", "o", "v", "s", 4).collect()
    assert all(r["s"] == sum(v for g, o, v in rows if g == r["g"] and o <= r["o"]) for r in run) and len(run) == 201
