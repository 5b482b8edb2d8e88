from __future__ import annotations

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credograph.llm import frequency


def count(spark, rows, flush=frequency.FLUSH_TERMS):
    df = spark.createDataFrame(rows, "claimed_target string, proposed_mechanism string, term string")
    out = frequency.term_counts(df, {"t": frequency.whole_value(F.col("claimed_target")), "m": frequency.terms(F.col("proposed_mechanism"))}, flush)
    return {(r["field_name"], r["term"]): (r["occurrences"], r["records"]) for r in out.collect()}


def brute(rows):
    occurrences, records = Counter(), Counter()
    for t, m, _ in rows:
        found = [("t", " ".join(t.lower().split()))] if t and t.strip() else []
        found += [("m", x) for x in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", (m or "").lower())]
        occurrences.update(found)
        records.update(set(found))
    return {k: (n, records[k]) for k, n in occurrences.items()}


def test_cases(spark):
    rows = [("HKH1", "T-cell T-cell killing", None), (" hkh1 ", "cell--x -y- z", "x"), ("a  b\tc", None, None), (None, "", None), ("  ", "!?", None), ("-", "w " * 50_000, None), ("-", "w", None), ("-", "w", None)]
    assert count(spark, rows) == brute(rows)
    assert count(spark, rows, 1) == brute(rows)
    assert count(spark, rows[:1])["m", "t-cell"] == (2, 1)
    assert frequency.term_counts(spark.createDataFrame([], "x string"), {"t": frequency.whole_value(F.col("x"))}).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("aB -1\t", max_size=6), st.text("ab- 1", max_size=12), st.none()), min_size=1, max_size=30))
def test_brute_force(spark, rows):
    assert count(spark, rows, 3) == brute(rows)


def test_marks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 5), ("e", 6)], "term string, records long")
    got = {r["term"]: r["mark"] for r in frequency.marked(df, 100).collect()}
    assert got == {"a": "rare", "b": "rare", "c": None, "d": None, "e": "common"}
