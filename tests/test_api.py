from __future__ import annotations

import os

import pytest

from credograph import api

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_views_agree(spark):
    some = api.evidence_log(spark, SF).orderBy("seq").first()
    steps = api.edge(spark, SF, some["src"], some["dst"], some["edge_type"]).collect()
    assert [r["n_records"] for r in steps] == list(range(1, len(steps) + 1))
    mine = [r for r in api.node(spark, SF, some["src"]).collect() if r["entity_id"] == some["dst"] and r["edge_type"] == some["edge_type"] and r["direction"] == "out"]
    assert [(r["alpha"], r["beta"]) for r in mine] == [(steps[-1]["alpha"], steps[-1]["beta"])]
    chain = api.chains(spark, SF).where("compound is not null and indication is not null and outcome = 'success'").first()
    found = api.predict(spark, SF, chain["compound"].upper(), chain["indication"]).collect()
    assert chain["chain_id"] in {r["chain_id"] for r in found}
    assert api.trial(spark, SF, chain["trial_id"]).count() >= 1
    assert api.node(spark, SF, -1).count() == 0


def test_annotate_moves_what_the_trial_says(spark):
    new = "chain_id long, src string, dst string, edge_type string, outcome string, branch string, w double"
    rows = [(1, "never seen", "target", "affects", "success", "unknown", 10.0), (2, "other", "target", "affects", "failure", "safety", 10.0)]
    rows += [(3, f"s{i}", "t", "affects", "failure", "unknown", 6.0) for i in range(7)]
    out = api.annotate(spark, SF, spark.createDataFrame(rows, new)).collect()
    assert len(out) == 5 and (out[0]["src"], out[0]["before"], round(out[0]["after"], 6)) == ("never seen", 0.5, round((1 + 8) / (2 + 10), 6))
    assert all(r["after"] < r["before"] for r in out[1:]) and "other" not in {r["src"] for r in out}
    assert api.annotate(spark, SF, spark.createDataFrame([], new)).count() == 0
