from __future__ import annotations

from credograph.plans import models


def test_combination_parts(spark):
    listed = spark.createDataFrame([(1, "compound", "velotamib", ["Velzara"]), (2, "compound", "corduxumab", ["CDX-14"]), (3, "target", "KRAS", ["p21"])], "entity_id long, entity_type string, canonical_name string, synonyms array<string>")
    fields = {1: "velotamib, corduxumab", 2: "velzara 50 mg / cdx-14", 3: "velotamib followed by corduxumab", 4: "velotamib & nosuchol", 5: "velotamib", 6: None, 7: "velotamib；corduxumab"}
    got = models.combination_parts(spark.createDataFrame([*fields.items()], "chain_id long, compound string"), listed).collect()
    ids = {k: sorted(r["entity_id"] for r in got if r["chain_id"] == k) for k in fields}
    assert ids == {1: [1, 2], 2: [1, 2], 3: [1, 2], 4: [0, 1], 5: [1], 6: [], 7: [1, 2]}
