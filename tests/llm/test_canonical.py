from __future__ import annotations

import random

import pytest

from credograph.llm import canonical

ENTITIES = [(1, "compound", "tacorraypane", ["Tilodemor", "ZH-15608"]), (2, "compound", "1,3-lodarmelulant", None), (3, "compound", "KUVIMEX", ["KUVIMEX regimen"]), (4, "compound", "capovvaostel", []), (50, "target", "HKH1", ["quistel transporter 1", "GGOR1"]), (51, "target", "HKH2", ["quistel transporter 2"]), (52, "target", "KFBγ", ["zelmor phosphatase gamma", "KBET-gamma"]), (53, "target", "KFBδ", ["zelmor phosphatase delta"])]
CASES = [
    ("compound", "Tacorraypane", 1), ("compound", "tacorrapyane 1,000 mg", 1), ("compound", "oral tacoraypane (mine)", 1), ("compound", "tacorraypane, extended release", 1), ("compound", "TACORRAYPANE sodium", 1), ("compound", "Tilodmor", 1),
    ("compound", "zh 15608", 1), ("compound", "ZH15609", 0), ("compound", "ZG-15608", 0), ("compound", "1,3-lodarmelulan", 2), ("compound", "2,4-lodarmelulant", 0), ("compound", "lodarmelulant", 0), ("compound", "KUVIMEX (tacorraypane + capovvaostel)", 3), ("compound", "kuvimex regimen", 3),
    ("compound", "placebo", 0), ("compound", "standard of care", 0), ("compound", "HKH1", 0), ("compound", "capovvaostel 50/500 mg", 4), ("compound", "capovvaostel 2.5 mg/kg", 4), ("compound", "capovaostl", 4), ("compound", "capovaosl", 0),
    ("target", "hkh-1", 50), ("target", "HKH_2", 51), ("target", "HKH3", 0), ("target", "HKL1", 0), ("target", "Quistel  Transporter 1", 50), ("target", "quistl transporter 2", 51), ("target", "quistel transporter 3", 0), ("target", "HKH1 protein", 50), ("target", "HKH2 (quistel transporter 2)", 51),
    ("target", "kfb–γ", 52), ("target", "KFB gamma", 52), ("target", "KFBα", 0), ("target", "zelmor phosphatse delta", 53), ("target", "zelmor phosphatase alpha", 0), ("target", "tacorraypane", 0),
]


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame(ENTITIES, "entity_id long, entity_type string, canonical_name string, synonyms array<string>")


def test_cases(spark, entities):
    got = {(r["kind"], r["value"]): r["entity_id"] for r in canonical.match(spark.createDataFrame([(k, v) for k, v, _ in CASES], "kind string, value string"), entities).collect()}
    assert {(k, v): got[k, v] for k, v, _ in CASES} == {(k, v): e for k, v, e in CASES}


def test_nothing_and_repeats(spark, entities):
    rows = [("compound", v, 7) for v in (None, "", "  ", "Unknown", "N/A", "tacorraypane", "tacorraypane", "x" * 30_000, "()", "5 mg")]
    out = canonical.match(spark.createDataFrame(rows, "kind string, value string, entity_id long"), entities).collect()
    assert sorted((len(r["value"]), r["entity_id"]) for r in out) == [(2, 0), (4, 0), (12, 1), (30_000, 0)]
    assert canonical.match(spark.createDataFrame([], "kind string, value string"), entities).count() == 0
    assert [r["entity_id"] for r in canonical.match(spark.createDataFrame([("compound", "tacorraypane")], "kind string, value string"), entities.limit(0)).collect()] == [0]


def test_pigeonhole_misses_no_pair(spark, entities):
    """All strings within the slips of a name, against brute force."""
    random.seed(5)
    values = set()
    for name in ("tacorraypane", "capovvaostel", "tilodemor"):
        for _ in range(150):
            s = list(name)
            for _ in range(random.randrange(1, 4)):
                i = random.randrange(len(s))
                s[i : i + 1] = random.choice([[], [s[i], random.choice("abcxyz")], [random.choice("abcxyz")]])
            values.add("".join(s))
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    names = {"tacorraypane": 1, "tilodemor": 1, "lodarmelulant": 0, "kuvimex": 3, "kuvimexregimen": 3, "capovvaostel": 4}
    slips = lambda x: 2 if len(x) >= 7 else 1 if len(x) >= 6 else 0
    want = {}
    for v in values:
        near = min((distance(v, n), e) for n, e in names.items() if e)
        want[v] = near[1] if near[0] <= slips(v) else 0
    got = {r["value"]: r["entity_id"] for r in canonical.match(spark.createDataFrame([("compound", v) for v in values], "kind string, value string"), entities).collect()}
    assert got == want
