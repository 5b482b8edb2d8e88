from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from credograph.operators import curation
from credograph.sources import reference, registry


def lines(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    return str(path)


def test_drugs(spark, tmp_path):
    p = lines(tmp_path / "d.json", [{"id": "C2", "name": "Other", "synonyms": ["Nivolumab"]}, {"id": "C1", "name": "NIVOLUMAB", "synonyms": ["ONO-4538", "Nivolumab bms"], "tradeNames": ["Opdivo"], "linkedTargets": {"rows": ["ENSG1"]}}, {"name": "no id"}])
    (tmp_path / "d.json").open("a").write("{broken\n")
    drugs = reference.read_dump(spark, "drugs", p)
    got = {r["name"]: (r["id"], r["aliases"], r["targets"]) for r in reference.drug_hits(spark.createDataFrame([("nivolumab",), ("ono 4538",), ("opdivo",), ("x",), ("",)], "name string"), drugs).collect()}
    assert got == {n: ("C1", ["Opdivo", "ONO-4538"], ["ENSG1"]) for n in ("nivolumab", "ono 4538", "opdivo")}
    a = reference.read_dump(spark, "associations", lines(tmp_path / "a.json", [{"targetId": "T1", "diseaseId": "D1", "score": 0.2}, {"targetId": "T1", "diseaseId": "D2", "score": 0.6}, {"targetId": "T2", "diseaseId": "D2", "score": 0.9}]))
    assert {r["diseaseId"] for r in reference.associated(a, spark.createDataFrame([("T1",)], "id string"), "targetId", 0.3).collect()} == {"D2"}
    assert reference.associated(a, spark.createDataFrame([("D2",)], "id string"), "diseaseId").count() == 2


def test_mechanisms_and_molecules(spark, tmp_path):
    m = reference.read_dump(spark, "mechanisms", lines(tmp_path / "m.json", [{"molecule_chembl_id": "M", "target_chembl_id": t, "action_type": a} for t, a in (("T1", "AGONIST"), ("T1", "AGONIST"), ("T1", "INHIBITOR"), ("T2", "BLOCKER"), ("T2", "VACCINE"), (None, "INHIBITOR"))]))
    assert {(r["target"], r["direction"]) for r in reference.directions(m).collect()} == {("T1", "agonist"), ("T2", "antagonist"), (None, "antagonist")}
    k = reference.read_dump(spark, "molecules", lines(tmp_path / "k.json", [{"molecule_chembl_id": "a", "indication_class": "Diagnostic Aid", "max_phase": 4.0}, {"molecule_chembl_id": "b", "therapeutic_flag": False}, {"molecule_chembl_id": "c", "therapeutic_flag": False, "max_phase": 2.0}, {"molecule_chembl_id": "d"}]))
    assert {r["molecule_chembl_id"] for r in reference.diagnostic(k).where("diagnostic").collect()} == {"a", "b"}


def test_text_dumps_and_ladders(spark, tmp_path):
    (tmp_path / "g.tsv").write_text('KRAS\tR-1\tSignaling "by" RAS\tHomo sapiens\nEGFR\tR-1\tx\tHomo sapiens\n')
    assert reference.read_dump(spark, "gene_pathways", str(tmp_path / "g.tsv")).count() == 2
    syn = spark.createDataFrame([(1, 0, "BMS-188667"), (1, 1, "332348-12-6"), (1, 2, " Abatacept"), (1, 3, "orencia"), (2, 0, "X1")], "cid long, pos int, synonym string")
    assert [tuple(r) for r in reference.inn_names(syn, spark.createDataFrame([("bms 188667", 1), ("x1", 2)], "code string, cid long")).collect()] == [("bms 188667", "abatacept")]
    step = lambda *rows: spark.createDataFrame(rows, "k string, v string")
    out = reference.ladder(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), "k", [step(("a", "1"), ("a", "0")), step(("a", "9"), ("b", "2"))], "v")
    assert {tuple(r) for r in out.collect()} == {("a", "0", 1), ("b", "2", 2)}


def test_memo_resolves_only_what_it_lacks(spark, tmp_path):
    asked: list[set] = []

    def resolve(df):
        asked.append({r["k"] for r in df.collect()})
        return df.withColumn("v", F.upper("k"))

    ask = lambda *ks: {(r["k"], r["v"]) for r in reference.memo(spark, str(tmp_path / "memo"), spark.createDataFrame([(k,) for k in ks], "k string"), "k", resolve).collect()}
    assert ask("a", "b", None) == {("a", "A"), ("b", "B")} and ask("b", "c") == {("b", "B"), ("c", "C")}
    assert asked == [{"a", "b"}, {"c"}]


def test_pathways(spark):
    sig = spark.createDataFrame([("p", "A375", ["g1", "g2"], ["g3", "g1"]), ("p", "A549", ["g1"], None), ("q", "A375", ["g1", "g2", "g3"], [])], "pert_id string, cell_id string, up_genes array<string>, dn_genes array<string>")
    gp = spark.createDataFrame([(f"g{i}", "R") for i in (1, 2, 3)] + [("g1", "S")], "gene string, pathway_id string")
    assert {(r["pert_id"], r["share"], tuple(r["cells"])) for r in curation.pathway_consistency(sig, gp).collect()} == {("p", 0.5, ("A375",)), ("q", 1.0, ("A375",))}
    assert curation.pathway_consistency(sig, gp, least_share=0.6).count() == 1
    a = spark.createDataFrame([("g1", "d1", 0.5, 1), ("g2", "d1", 0.7, 1), ("g3", "d2", 0.9, 1), ("g1", "d3", 0.1, 9)], "targetId string, diseaseName string, score double, evidenceCount long")
    assert [(r["pathway_id"], r["disease"], r["genes"], round(r["score"], 6)) for r in curation.pathway_indications(gp, a).collect()] == [("R", "d1", 2, 0.6)]


def test_sources_words_and_tiers(spark):
    c = spark.createDataFrame([("k", "reactome", "R1", 0.5), ("k", "go", "G1", 0.5), ("k", "reactome", "R2", 0.4), ("l", "go", "G1", 0.6), ("l", "go", "G0", 0.6), ("l", "reactome", "R1", 0.5), ("m", "go", "G1", 0.1)], "key string, source string, pathway_id string, score double")
    assert [(r["key"], r["pathway_id"], r["rank"]) for r in curation.chosen_source(c, 2, 0.2).orderBy("key", "rank").collect()] == [("k", "R1", 1), ("k", "R2", 2), ("l", "G0", 1), ("l", "G1", 2)]
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    assert one(curation.overlap(F.lit("Signaling by VEGF"), F.array(F.lit("vegfa"), F.lit("il")))) == 0.5 and one(curation.overlap(F.lit("of the"), F.array(F.lit("vegfa")))) == 0.0
    assert one(curation.overlap(F.lit("angiogenesis"), F.array(F.lit("gene"), F.lit("geno")))) == 0.0
    assert [one(curation.invalid_mechanism(F.lit(x))) for x in ("Other", "Other interleukin signaling", "Defective GALT causes X", "Listeria entry", "Aspirin ADME", "Ion transport by P-type ATPases")] == ["E_placeholder", "F_residual_bucket", "B_disease_module", "C_pathogen", "D_grouping_or_PK", None]
    assert one(curation.tissues(F.lit("Advanced Solid Tumors"))) == ["breast", "colon", "kidney", "liver", "lung", "neural", "prostate", "skin"] and one(curation.tissues(F.lit("NSCLC"))) == ["lung"] and one(curation.tissues(F.lit("asthma"))) == []


def test_descriptions_and_answers(spark):
    told = spark.createDataFrame([("n", "a1", "fludarabine_phosphate", "salt", 1), ("n", "a2", "drug", "other arm", 2), ("n", "a1", "drug", "own", 3), ("n", "a1", "none", " ", 4), ("m", "a1", "drug", "other trial", 5)], "trial_id string, arm_id string, drug string, description string, seq int")
    asked = spark.createDataFrame([("n", "a1", "drug"), ("n", "a3", "drug"), ("n", "a1", "fludarabine"), ("n", "a1", "none"), ("n", "a1", "dru")], "trial_id string, arm_id string, drug string")
    assert {(r["arm_id"], r["drug"], r["step"], r["description"]) for r in curation.described(asked, told).collect()} == {("a1", "drug", 1, "own"), ("a3", "drug", 2, "other arm"), ("a1", "fludarabine", 3, "salt"), ("a1", "none", None, None), ("a1", "dru", None, None)}
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    assert one(curation.json_body(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(curation.json_body(F.lit("{}"))) == "{}"
    assert [one(curation.number(F.lit(x))) for x in ("<0.05", "1,234.5 mg", "p = 3", "-2e-3", None)] == [0.05, 1234.5, None, -0.002, None]
    f = spark.createDataFrame([("a", None), ("b", []), ("c", ["x"]), ("d", None)], "k string, v array<string>")
    e = spark.createDataFrame([("a", ["y"]), ("b", ["z"]), ("c", ["w"])], "k string, v array<string>")
    assert {(r["k"], tuple(r["v"] or ())) for r in curation.filled(f, e, "k", "v").collect()} == {("a", ("y",)), ("b", ("z",)), ("c", ("x",)), ("d", ())}


def test_parents_of_events(spark):
    t = lambda *rows: spark.createDataFrame(rows, "child string, parent string")
    tables = {"hlt": t(("af", "arrhythmia"), ("odd", "nowhere")), "hlgt": t(("arrhythmia", "rhythm")), "soc": t(("rhythm", "S1")), "direct": t(("rash", "S2"), ("af", "S9"))}
    names = spark.createDataFrame([("S1", "Cardiac disorders"), ("S2", "Skin"), ("S3", "General")], "soc string, soc_name string")
    terms = spark.createDataFrame([("af", None), ("rash", "General"), ("odd", "general"), ("new", "what"), ("new2", None)], "term string, fallback string")
    got = {r["term"]: tuple(r)[1:] for r in curation.event_parents(terms, tables, names).collect()}
    assert got == {"af": ("arrhythmia", "rhythm", "S1", "Cardiac disorders"), "rash": (None, None, "S2", "Skin"), "odd": ("nowhere", None, "S3", "General"), "new": (None, None, None, None), "new2": (None, None, None, None)}


@pytest.fixture()
def study():
    return {"protocolSection": {"identificationModule": {"nctId": "NCT9"}, "armsInterventionsModule": {"armGroups": []}, "outcomesModule": {"primaryOutcomes": [{"measure": "OS"}]}, "eligibilityModule": {"sex": "ALL"}, "referencesModule": {"references": [{"pmid": "1"}]}},
            "resultsSection": {"outcomeMeasuresModule": {"outcomeMeasures": [{"groups": [{"id": "OG0", "title": "Arm A"}, {"id": "OG1", "title": "Arm B"}], "classes": [{"title": "Total"}, {"title": "Male"}]}, {"groups": [{"id": "OG0", "title": "Arm A again"}], "classes": [{"title": "male"}, {"title": "Female "}, {"title": None}]}]}}}


def test_arms_and_subgroups_from_results(spark, tmp_path, study):
    (tmp_path / "s.json").write_text(json.dumps(study) + "\n{broken\n" + json.dumps({"protocolSection": {}}) + "\n")
    r = registry.studies(spark, str(tmp_path / "s.json")).collect()
    assert len(r) == 1 and [a["label"] for a in r[0]["arms"]] == ["Arm A", "Arm B"] and r[0]["subgroups"] == ["Male", "Female"]
    assert r[0]["primary_outcomes"][0]["measure"] == "OS" and r[0]["eligibility"]["sex"] == "ALL" and r[0]["references"][0]["pmid"] == "1"
    assert registry.broken_lines(spark, str(tmp_path / "s.json")).count() == 2
