from __future__ import annotations

import json

from credograph.operators import nested


def record(population, effect=None):
    return json.dumps({"therapeutic_hypothesis": {"target_population": population}, "results": {"effect_size": effect}})


def paths(payload):
    return [(r, p) for _, r, p, _ in nested.visit(payload)]


TP = "therapeutic_hypothesis.target_population"


def test_lists_and_lone_values():
    assert paths(record([{"features": {"axis": "gene"}, "subgroups": ["x", None, " ", {"features": [1, None, 2]}]}])) == [
        (f"{TP}[0]", ""), (f"{TP}[0].features[0]", f"{TP}[0]"), (f"{TP}[0].subgroups[0]", f"{TP}[0]"), (f"{TP}[0].subgroups[3]", f"{TP}[0]"),
        (f"{TP}[0].subgroups[3].features[0]", f"{TP}[0].subgroups[3]"), (f"{TP}[0].subgroups[3].features[2]", f"{TP}[0].subgroups[3]"),
    ]
    assert paths(record("adults", {"by_arm": '{"arm_id": "a", "timepoints": {"week": 4}}'})) == [
        (f"{TP}[0]", ""), ("results.effect_size[0]", ""), ("results.effect_size[0].by_arm[0]", "results.effect_size[0]"), ("results.effect_size[0].by_arm[0].timepoints[0]", "results.effect_size[0].by_arm[0]"),
    ]


def test_nothing_to_tell():
    for payload in (record(None), record(""), record([]), record([None, " "]), "", "{", "[]", "null", "3"):
        assert paths(payload) == []
    assert paths(record('{"broken')) == [(f"{TP}[0]", "")]
    assert paths(record({}))[0] == (f"{TP}[0]", "")


def test_deep(spark):
    deep = {"raw_descriptor": "x"}
    for _ in range(150):
        deep = {"subgroups": [deep]}
    rows = [(1, record(deep), "c"), (2, None, "c"), (1, record(deep), "c"), (None, record("a"), "c")]
    out = nested.flatten(spark.createDataFrame(rows, "record_id long, payload string, row_path string"))
    assert out.where("record_id = 1").count() == 302
    assert out.where("record_id is null").count() == 1
    assert nested.flatten(out.limit(0)).count() == 0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, record([{"description": "a", "features": [{"axis": "g", "key": "K", "level": None}]}], [2.5, {"estimate": 1.5, "unit": "HR"}]))], "record_id long, payload string")
    nested.write_tables(df, str(tmp_path / "t"))
    f = nested.read_table(spark, str(tmp_path / "t"), "features").collect()
    assert [(r["axis"], r["key"], r["level"], r["parent_path"]) for r in f] == [("g", "K", None, f"{TP}[0]")]
    e = nested.read_table(spark, str(tmp_path / "t"), "effect_size").orderBy("row_path").collect()
    assert [(r["estimate"], r["value"]) for r in e] == [(None, "2.5"), (1.5, None)]


def test_tables_of_all_records(spark):
    df = spark.createDataFrame([(1, record([{"description": "a", "note": {"x": 1, "features": [3]}, "features": [{"axis": "g"}]}], "HR 2")), (2, "{")], "record_id long, payload string")
    t = nested.tables(df)
    assert {tag: x.count() for tag, x in t.items()} == {"target_population": 1, "effect_size": 1, "features": 2, "subgroups": 0, "by_arm": 0, "timepoints": 0, "arm_incidences": 0}
    assert json.loads(t["target_population"].first()["payload"]) == {"description": "a", "note": {"x": 1}}
    assert sum(x.count() for x in nested.tables(df.limit(0)).values()) == 0
