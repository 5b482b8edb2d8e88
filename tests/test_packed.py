from __future__ import annotations

import random
import re

import pytest

from credograph.operators.packed import CLOSING, PHRASES, SIGNS, cuts, split_packed

CASES = {
    "a; b": ["a", "b"],
    "a,b": ["a", "b"],
    "5,7-xel + 1,3-mar": ["5,7-xel", "1,3-mar"],
    "xel,5,7-mar": ["xel", "5,7-mar"],
    "AB 12,5,7-mar": ["AB 12", "5,7-mar"],
    "xel 1,000 mg, mar": ["xel 1,000 mg", "mar"],
    "xel 50/500 mg/mar": ["xel 50/500 mg", "mar"],
    "xel 5 mg/day/mar": ["xel 5 mg/day", "mar"],
    "xel 375 mg/m2/mar": ["xel 375 mg/m2", "mar"],
    "ZRB 28168/5,7-mar": ["ZRB 28168", "5,7-mar"],
    "(1) xel (2) mar": ["xel", "mar"],
    "1) xel, 2) mar; 3) tor": ["xel", "mar", "tor"],
    "1. xel 2. mar": ["xel", "mar"],
    '"xel, low dose" with mar': ["xel, low dose", "mar"],
    "“xel and mar”": ["xel and mar"],
    "'xel';\"mar\"": ["xel", "mar"],
    "REG (xel + mar/tor)": ["REG (xel + mar/tor)"],
    "xel, mar, and tor": ["xel", "mar", "tor"],
    "xel followed by mar in combination with tor": ["xel", "mar", "tor"],
    "xel combined with mar": ["xel", "mar"],
    "xel\nmar (oral)": ["xel", "mar (oral)"],
    "xel + + mar ,": ["xel", "mar"],
    "standard of care": ["standard of care"],
    "device in place": ["device in place"],
    "n/a": ["n/a"],
    "it's one": ["it's one"],
    '"open': ['"open'],
    "(open, two": ["(open", "two"],
    "；，": ["，"],
}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "id long, v string")
    out: dict[int, list] = {}
    for r in split_packed(df, "v", ["id"]).collect():
        out.setdefault(r["id"], []).append((r["pos"], r["item_value"]))
    return {v: [x for _, x in sorted(out.get(i, []))] for i, v in enumerate(CASES)}, out


@pytest.mark.parametrize("value", list(CASES))
def test_cases(got, value):
    assert got[0][value] == CASES[value]


def test_positions(got):
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got[1].values())


def test_edges(spark):
    long = " + ".join(f"drug{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, ",", "x"), (5, long, "x"), (6, "a+b", "x"), (6, "a+b", "x")], "id long, v string, pos string")
    out = split_packed(df, "v", ["id"]).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in out} == {5: 20_000, 6: 4}
    assert split_packed(df.limit(0), "v", ["id"]).count() == 0
    with pytest.raises(ValueError):
        split_packed(df, "v", ["id", "pos"])
    assert split_packed(df, "v", ["id", "pos"], pos="place").columns == ["id", "pos", "place", "item_value"]


def test_salted_join_gives_the_same(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "id long, v string")
    assert sorted(split_packed(df, "v", ["id"]).collect()) == sorted(split_packed(df, "v", ["id"], broadcast_rows=1).collect())


@pytest.mark.parametrize("most", [{"broadcast_rows": 1}, {"broadcast_bytes": 1000}])
def test_rules_beyond_the_limits_are_not_broadcast(spark, most):
    """Their file is small enough for the planner to broadcast them of its own accord, salted."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "id long, v string")
    out = split_packed(df, "v", ["id"], **most)
    assert sorted(out.collect()) == sorted(split_packed(df, "v", ["id"]).collect())
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [3, 4])
def test_rules_against_a_walk_over_the_characters(spark, seed):
    """Random skeletons, rules in SQL against the same rules in a loop."""
    r = random.Random(seed)
    signs = "aaa99u  AAPWFBCIM;,,//|&+\n()[]\"'“”.)(😀-"
    some = {re.sub(" +", " ", "".join(r.choice(signs) for _ in range(r.randrange(1, 24)))) for _ in range(4000)}
    got = {x["s"]: x["cuts"] for x in cuts(spark.createDataFrame([(s,) for s in some], "s string")).collect()}
    assert got == {s: walk(s) for s in some}


def _marker(s: str, i: int, form: str | None = None) -> tuple[int, str] | None:
    """End and form of a list number that begins at i: ``(9)``, ``9)`` or ``9.`` before a space."""
    for f in ("(9)", "9)", "9."):
        if s.startswith(f, i) and form in (None, f) and (f != "9." or s[i + 2 : i + 3] == " "):
            return i + len(f), f
    return None


def _phrase(s: str, i: int) -> int:
    """Length of the joining phrase at i, or 0; it has to stand between spaces."""
    if i and s[i - 1] not in " \n":
        return 0
    for p in PHRASES:
        if s.startswith(p.replace("~", " "), i) and s[i + len(p) : i + len(p) + 1] in ("", " ", "\n"):
            return len(p)
    return 0


def _inside_number(s: str, i: int) -> bool:
    """Whether the comma or slash at i belongs to a dose or a chemical name."""
    before, after = s[i - 1 : i], s[i + 1 : i + 2]
    if s[i] == ",":
        return before == "9" == after and s[i + 2 : i + 4] != ",9"
    left, right = s[:i].rstrip(" ")[-1:], s[i + 1 :].lstrip(" ")
    if left == "u" and right[:1] == "u":
        return True
    return left == "9" and right[:1] == "9" and right[1:3] != ",9"


def walk(s: str) -> list[list[int]]:
    """Begin and end (exclusive, in tokens) of each value of a skeleton."""
    pieces: list[tuple[int, int]] = []
    first = len(s) - len(s.lstrip(" \n"))
    listed = _marker(s, first)
    form = listed[1] if listed else None
    begin, i, fresh = 0, 0, True  # fresh: nothing of the value has come yet

    def end(at: int, after: int) -> int:
        nonlocal begin, fresh
        pieces.append((begin, at))
        begin, fresh = after, True
        return after

    while i < len(s):
        c = s[i]
        if form and (i == first or s[i - 1] in " \n" or fresh) and (m := _marker(s, i, form)):
            i = end(i, m[0])
        elif c in " ":
            i += 1
        elif fresh and c in CLOSING and (j := _close_quote(s, i, CLOSING[c])) > 0:
            fresh, i = False, j + 1
        elif c in "([{" and (j := _close_bracket(s, i)) > 0:
            fresh, i = False, j + 1
        elif n := _phrase(s, i):
            i = end(i, i + n)
        elif c in SIGNS and not (c in ",/" and _inside_number(s, i)):
            i = end(i, i + 1)
        else:
            fresh, i = False, i + 1
    pieces.append((begin, len(s)))
    out = []
    for b, e in pieces:
        b, e = _trim(s, b, e)
        if e - b >= 2 and s[b] in CLOSING and _close_quote(s, b, CLOSING[s[b]]) == e - 1:
            b, e = _trim(s, b + 1, e - 1)
        if e > b:
            out.append([b, e])
    return out


def _trim(s: str, b: int, e: int) -> tuple[int, int]:
    while b < e and s[b] in " \n":
        b += 1
    while e > b and s[e - 1] in " \n":
        e -= 1
    return b, e


def _close_quote(s: str, i: int, mark: str) -> int:
    """Where the quote opened at i closes: the next mark before a delimiter or the end."""
    j = s.find(mark, i + 1)
    while j > 0:
        rest = s[j + 1 :].lstrip(" ")
        if not rest or rest[0] in SIGNS or rest[0] in "()" or s[j + 1] == " ":
            return j
        j = s.find(mark, j + 1)
    return -1


def _close_bracket(s: str, i: int) -> int:
    depth = 0
    for j in range(i, len(s)):
        depth += (s[j] in "([{") - (s[j] in ")]}")
        if not depth:
            return j
    return -1
