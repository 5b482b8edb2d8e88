from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credograph.llm import containers


def held(histogram, capacity):
    n, tokens = 0, Counter()
    for _, _, own in containers.buckets(histogram, capacity):
        for k, what in own:
            assert k > 0 and sum(length * each for length, each in what) <= capacity
            n += k
            for length, each in what:
                tokens[length] += k * each
    return n, tokens


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_every_item_has_a_place(histogram):
    n, tokens = held(histogram, 64)
    assert tokens == Counter(histogram)
    total = sum(k * c for k, c in histogram.items())
    assert n >= -(-total // 64) and n <= 1 + 2 * total // 64 + sum(c for k, c in histogram.items() if 2 * k > 64)


def test_close_to_the_bound():
    random.seed(6)
    histogram = Counter(min(2048, int(random.lognormvariate(4.8, 0.9)) + 1) for _ in range(50_000))
    n, _ = held(histogram, 2048)
    assert n <= 1.002 * -(-sum(k * c for k, c in histogram.items()) // 2048)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1, max_size=9))
def test_boundaries_need_the_fewest_padded_containers(histogram):
    """Against every division of the lengths."""
    lengths = sorted(histogram)

    def padded(division):
        return sum(-(-sum(histogram[k] for k in b) // (32 // b[-1])) for b in division)

    divisions = []
    for mask in range(1 << (len(lengths) - 1)):
        division, held = [], []
        for i, k in enumerate(lengths):
            held.append(k)
            if i == len(lengths) - 1 or mask >> i & 1:
                division.append(held)
                held = []
        divisions.append(division)
    found = containers.boundaries(histogram, 32)
    assert sum(n for _, _, n in found) == min(map(padded, divisions))
    assert [k for low, high, _ in found for k in lengths if low <= k <= high] == lengths
    assert sum(n for _, _, own in containers.buckets(histogram, 32) for n, _ in own) <= sum(n for _, _, n in found)


def test_report(spark):
    df = spark.createDataFrame([(i, [5, 17, 40, 100, 250, 0, 64][i % 7], None) for i in range(90)], "doc_id long, n_tokens long, text string")
    rows = containers.bucket_report(df, 100).collect()
    assert sum(r["opened_containers"] for r in rows) == containers.usage(containers.assign(df, 100), 100).first()["containers"]
    assert sum(r["items"] for r in rows) == sum([1, 1, 1, 1, 3, 0, 1][i % 7] for i in range(90))
    assert containers.bucket_report(df.limit(0)).count() == 0


def test_large_counts_cost_no_more():
    assert held({k: 10**12 + k for k in range(1, 2049)}, 2048)[1][2048] == 10**12 + 2048


def check(rows, capacity, out):
    used, parts = Counter(), defaultdict(list)
    for r in out:
        used[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["part_no"], r["first_token"], r["n_tokens"]))
    assert max(used.values(), default=0) <= capacity
    want = Counter()
    for doc, n in rows:
        want[doc] += n
    assert {d: sum(p[2] for p in ps) for d, ps in parts.items()} == dict(want)
    return used, parts


@pytest.mark.parametrize("group_rows", [100_000, 3])
def test_assignment(spark, group_rows):
    rows = [(i, [5, 17, 40, 100, 250, 0, 64][i % 7]) for i in range(90)]
    df = spark.createDataFrame([(i, n, None, "x") for i, n in rows], "doc_id long, n_tokens long, text string, container_id string")
    used, parts = check(rows, 100, containers.assign(df, 100, group_rows).collect())
    assert [p[:3] for p in sorted(parts[4])] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(len(p) == 1 for d, p in parts.items() if d % 7 != 4)
    assert sorted(used) == list(range(len(used)))


def test_counts_and_edges(spark):
    text = "It's 12 o'clock:  now\n\n-- café"
    df = spark.createDataFrame([(1, None, text), (2, -3, "a b"), (3, None, None), (4, None, ""), (5, 7, "ignored"), (5, 7, "ignored"), (None, 2, "x"), (6, None, "w " * 5000)], "doc_id long, n_tokens long, text string")
    import regex

    n = len(regex.findall(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text))
    check([(1, n), (2, 2), (3, 0), (4, 0), (5, 14), (None, 2), (6, 5001)], 2048, containers.assign(df).collect())
    assert containers.assign(df.limit(0)).count() == 0
    assert containers.usage(containers.assign(df)).first()["containers"] == 3
