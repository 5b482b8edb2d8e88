from __future__ import annotations

import json

import pytest

from credograph.sources import registry, snapshots
from credograph.streaming import beliefs


def study(i, **more):
    return {"protocolSection": {"identificationModule": {"nctId": f"NCT{i}"}, "statusModule": {"overallStatus": more.get("status", "COMPLETED"), "whyStopped": more.get("why")}, "designModule": {"phases": more.get("phases", ["PHASE2"])}, "conditionsModule": {"conditions": ["Melanoma"]}, "armsInterventionsModule": {"interventions": [{"type": "DRUG", "name": "Xel"}], "armGroups": [{"label": "A", "interventionNames": ["Drug: Xel", "Drug: Placebo"]}]}}, "hasResults": more.get("results", True), "resultsSection": {"adverseEventsModule": {"eventGroups": [{"id": "E0", "title": "Arm A", "seriousNumAtRisk": 50}], "seriousEvents": [{"term": "rash", "stats": [{"groupId": "E0", "numAffected": 5}]}, {"term": "rare", "stats": [{"groupId": "E0", "numAffected": 1}]}]}}}


def test_registry(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text("\n".join(map(json.dumps, [study(1), study(2, status="TERMINATED", why="futility"), study(3, phases=["PHASE1"]), study(4, results=False)])) + "\n{broken\n")
    s = registry.studies(spark, str(p))
    ids = lambda df: sorted(r["trial_id"] for r in df.collect())
    assert ids(s) == ["NCT1", "NCT2", "NCT3", "NCT4"] and s.first()["arms"][0]["compounds"] == ["Xel"]
    assert ids(registry.with_results(s)) == ["NCT1", "NCT2"]
    assert ids(registry.stopped_drug_trials(s)) == ["NCT2"]
    assert ids(registry.search(s, condition="melan", intervention="XEL", has_results=False)) == ["NCT4"]
    assert [(r["term"], r["arm"], r["pct"]) for r in registry.serious_events(s.where("trial_id = 'NCT1'")).collect()] == [("rash", "Arm A", 10.0)]


def test_corpus_and_aliases(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# head\nNCT1 # one\n\nNCT2\nNCT1\n")
    assert [r["trial_id"] for r in registry.corpus(spark, str(tmp_path / "c.txt")).orderBy("pos").collect()] == ["NCT1", "NCT2"]
    (tmp_path / "d.txt").write_text("NCT0\nNCT2\n")
    both = registry.corpus(spark, str(tmp_path / "[cd].txt"))
    assert [r["trial_id"] for r in both.orderBy("pos").collect()] == ["NCT1", "NCT2", "NCT0"]
    registry.write_corpus(both, str(tmp_path / "w"), "corpus")
    assert [r["trial_id"] for r in registry.corpus(spark, str(tmp_path / "w")).orderBy("pos").collect()] == ["NCT1", "NCT2", "NCT0"]
    (tmp_path / "a.tsv").write_text("symbol\talias_symbol\tprev_symbol\tuniprot_ids\nAB1\tX1|Y1\t\tP1|P2\nX1\t\tAB1\tP3\n")
    got = {r["alias"]: (r["symbol"], r["uniprot"]) for r in registry.alias_table(spark, str(tmp_path / "a.tsv")).collect()}
    assert got == {"AB1": ("AB1", "P1"), "X1": ("X1", "P3"), "Y1": ("AB1", "P1")}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, {"name": "a", "box": [1.0]}, [{"k": "x", "s_embedding": [1.0]}], [0.1234567, 2.0])], "id long, n struct<name: string, box: array<double>>, l array<struct<k: string, s_embedding: array<double>>>, embedding array<double>")
    assert snapshots.private_paths(df.schema) == ["n.box", "l[].s_embedding", "embedding"]
    snapshots.write_public(df, str(tmp_path / "public"))
    out = spark.read.parquet(str(tmp_path / "public"))
    assert out.columns == ["id", "n", "l"] and not snapshots.private_paths(out.schema) and out.first()["n"]["name"] == "a"
    snapshots.write_private(df, str(tmp_path), "p", "embedding")
    assert snapshots.read_private(spark, str(tmp_path), "p", "embedding").first()["embedding"] == [0.123457, 2.0]
    with pytest.raises(ValueError):
        snapshots.write_private(df, str(tmp_path), "../p")
    with pytest.raises(ValueError):
        snapshots.write_private(df, str(tmp_path / "repo" / "private"), "p", public_tree=str(tmp_path / "repo"))
    assert {tuple(r) for r in snapshots.held_private(df).collect()} == {("n.box", 1), ("l[].s_embedding", 1), ("embedding", 1)}
    with pytest.raises(ValueError):
        snapshots.assert_public(df)
    empty = spark.createDataFrame([(1, None, "", {"a": {"w_weights": ""}}, 2.0)], "id long, box_min array<double>, manifold string, m map<string, struct<w_weights: string>>, vectors double")
    assert snapshots.held_private(empty).count() == 0
    snapshots.assert_public(out)


def test_private_names():
    private = ["embedding", "embeddings", "region_anchors", "anchors", "box", "box_min", "box_max", "box_params", "ellipsoid_mean", "ellipsoid_cov", "manifold", "manifold_params", "source_embedding", "belief_field", "outer_boxes", "edge_weights", "x_anchors", "a_box", "b_embeddings"]
    assert all(map(snapshots.is_private, private))
    assert not any(map(snapshots.is_private, ["alpha", "weights_of", "boxes", "vectors", "_belief_field_vectors", "fields", "name"]))


def test_stream_is_the_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", "t", "s1", i, 2.0, 0.8) for i in range(5)] + [("a", "c", "t", "s2", 9, 1.0, 0.5)], "src string, dst string, edge_type string, source_id string, seq long, n_eff double, p_obs double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = beliefs.running_beliefs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("running")) == key(beliefs.running_beliefs(df))


def test_replayed_batches_add_nothing(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2), ("s1", 1)], "source_id string, seq long")
    df.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("s1", 1), ("s1", 3)], df.schema).write.parquet(str(tmp_path / "later"))
    for k, at in enumerate(("in", "in", "later")):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / at))
        beliefs.append_batches(stream, str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("source_id", "seq").collect())) == [("s1", 1), ("s1", 3), ("s2", 2)]
