from __future__ import annotations

import json

import pytest

from credograph.operators import drift

BITS = {"s": 1, "n": 2, "b": 4, "o": 8, "a": 16}


def changes(spark, *files):
    rows = [("f", n + 1, json.dumps(r) if not isinstance(r, str) else r, "x") for n, f in enumerate(files) for r in f]
    df = spark.createDataFrame(rows, "feed string, file_no int, payload string, _fields string")
    return {tuple(r)[2:] for r in drift.changes(df).collect()}


def test_kinds(spark):
    one = [{"nct_id": f"NCT0000000{i}", "outcome": ["win", "loss", "draw"][i], "p": 0.1 * i, "gone": "x", "ctx": {"size": i, "arm": "b"}, "modes": [{"m": "a", "c": 0.5}]} for i in range(3)]
    two = [{"nct_id": f"nct-0000000{i}", "result": ["win", "loss", "draw"][i], "p": str(i), "new": 1, "design": {"size": i, "arms": "b"}, "modes": [{"m": {"code": "a"}, "c": None}]} for i in range(3)]
    assert changes(spark, one, ["{broken", "", *two]) == {
        ("outcome", "result", "renamed"), ("p", "p", "retyped"), ("gone", "gone", "removed"), ("new", "new", "added"),
        ("ctx", "design", "renamed"), ("design.arm", "design.arms", "renamed"), ("modes[].m", "modes[].m", "retyped"),
    }


def test_booleans_need_more_than_chance():
    e = {("needs_review", "is_combination"): (3, 3, 0.0, True)}
    assert set(drift.diff({"needs_review": 4}, {"is_combination": 4}, e)) == {("needs_review", "needs_review", "removed"), ("is_combination", "is_combination", "added")}
    e = {("needs_review", "needsReview"): (1, 1, 0.0, True)}
    assert drift.diff({"needs_review": 4}, {"needsReview": 4}, e) == [("needs_review", "needsReview", "renamed")]


def test_only_the_topmost_path():
    before = {"a": BITS["o"], "a.b": BITS["o"], "a.b.c": 1}
    assert drift.diff(before, {"d": 1}, {}) == [("a", "a", "removed"), ("d", "d", "added")]
    assert drift.diff({"d": 1}, before, {}) == [("d", "d", "removed"), ("a", "a", "added")]
    assert drift.diff(before, {"a": BITS["a"], "a[].b": 1}, {}) == [("a", "a", "retyped")]


def test_missing_files_and_lines(spark):
    rows = [("f", 1, '{"a": 1}'), ("f", 3, '{"b": 1}'), (None, 1, '{"a": 1}'), ("f", None, '{"a": 1}'), ("g", 1, "{"), ("g", 2, '{"a": 1}'), ("h", 1, None)]
    df = spark.createDataFrame(rows, "feed string, file_no int, payload string")
    assert drift.changes(df).count() == 0
    assert drift.changes(df.limit(0)).count() == 0


def test_rescue_and_replay(spark):
    lines = ['{"nct_id": "NCT1", "results": {"p_value": "low", "effect_size": "HR 1"}, "extra": {"a": [1]}}', '﻿{"nct_id": "NCT2", "trial_result": "win", "context": {"sample_size": 7.0}}', "{", None, "[1]", '{"results": 3}']
    df = drift.ingest(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, payload string"), ["i"])
    out = {r["i"]: r for r in drift.promote(df, {"trial_outcome": ("trial_result", "string"), "p": ("results.p_value", "double")}).collect()}
    assert len(out) == len(lines) and [out[i]["_broken"] for i in range(6)] == [False, False, True, True, True, False]
    assert out[0]["results__effect_size"] == "HR 1" and out[0]["results__p_value"] is None and out[0]["p"] is None
    assert json.loads(out[0]["_rescued"]) == {"results.p_value": "low", "extra": {"a": [1]}}
    assert out[1]["trial_outcome"] == "win" and out[1]["context__sample_size"] == 7
    assert json.loads(out[5]["_rescued"]) == {"results": 3}


@pytest.mark.parametrize("v,kind,want", [(1, "double", 1.0), (True, "double", None), (10**400, "double", None), (1.5, "long", None), (2.0, "long", 2), (float("nan"), "long", None), ("x", "boolean", None), (["a"], "array<string>", ["a"]), ([1], "array<string>", None), ({"a": 1}, "json", '{"a": 1}')])
def test_cast(v, kind, want):
    assert drift._cast(v, kind) == (want, want is not None)


def test_replay_of_changes(spark):
    """Renames of all kinds, nested, in arrays, of parents, forwards and backwards, and retyped values."""

    def file(n):
        out = []
        for i in range(12):
            met, outcome, mode = i % 3 == 0, ["success", "failure", "partial"][i % 3], ["underpowered", "wrong_target"][i % 2]
            key, name, inner = (("primary_endpoint_met", "outcome", "mode"), ("endpoint_reached", "trial_outcome", "why_failed"), ("endpoint_reached", "verdict", "why_failed"))[n]
            design = "context" if n < 2 else "design"
            out.append({"nct_id": f"NCT{i:08d}", "results": {key: met if n < 2 else {"met": met}}, name: outcome if n < 2 else [outcome], "failure_modes": [{inner: mode, "evidence": f"e{i}"}], design: {"sample_size": i if n < 2 else str(i)}})
        return out

    rows = [("f", n + 1, json.dumps(r)) for n in range(3) for r in file(n)] + [("g", 1, json.dumps({"nct_id": "NCT00000001", "results": {"endpoint_reached": True}}))]
    df = spark.createDataFrame(rows, "feed string, file_no int, payload string")
    found = [("f", 2, "results.primary_endpoint_met", "results.endpoint_reached", "renamed"), ("f", 2, "outcome", "trial_outcome", "renamed"), ("f", 2, "failure_modes[].mode", "failure_modes[].why_failed", "renamed"),
             ("f", 3, "results.endpoint_reached", "results.endpoint_reached", "retyped"), ("f", 3, "trial_outcome", "verdict", "renamed"), ("f", 3, "verdict", "verdict", "retyped"), ("f", 3, "context", "design", "renamed"), ("f", 3, "design.sample_size", "design.sample_size", "retyped")]
    out = drift.ingest(df, ["feed", "file_no"], drift.REPLAYED, names=drift.Names(found, drift.REPLAYED)).collect()
    assert len(out) == 37
    for r in out[:36]:
        i = int(r["nct_id"][3:])
        assert (r["results__primary_endpoint_met"], r["trial_outcome"]) == (i % 3 == 0, ["success", "failure", "partial"][i % 3])
        assert r["failure_modes__mode"] == [["underpowered", "wrong_target"][i % 2]] == [x["mode"] for x in json.loads(r["failure_modes"])]
        assert r["context__sample_size"] == i
    assert out[36]["results__primary_endpoint_met"] is True  # what it means in the other feed


@pytest.mark.parametrize("v,kind,want", [("yes", "boolean", True), (0, "boolean", False), ("maybe", "boolean", None), ({"met": False, "basis": "x"}, "boolean", False), (["success"], "string", "success"), (6, "string", "6"), ({"code": "partial", "sub_code": None}, "string", "partial"), ({"dose": "1 mg", "schedule": "daily", "max": ""}, "string", "1 mg daily"), ("rash; nausea", "array<string>", ["rash", "nausea"]), ("213", "long", 213), ("low", "double", None), ({"exact": 0.5, "sided": 2}, "double", 0.5)])
def test_recast(v, kind, want):
    assert drift.recast(v, kind) == want
