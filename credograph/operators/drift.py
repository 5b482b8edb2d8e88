"""Schemas that drift between files: rescue-column ingestion and a report of every change.

``ingest`` enforces a target schema on raw JSON lines; whatever is unknown or can't be
cast is kept as JSON in ``_rescued``. ``promote`` replays rescued values into new typed
columns; ``replay`` does so for every change that ``changes`` found, renamed or retyped,
nested or in arrays. ``changes`` compares each file of a feed with the one before it; a rename is
told from an addition by replaying the values of trials that both files export.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Container, Iterator
from itertools import repeat
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credograph.session import cut

#: Fields of the target schema and their types; ``json`` keeps nested values as JSON text.
TARGET = {
    "nct_id": "string",
    "therapeutic_hypothesis.compound": "string",
    "therapeutic_hypothesis.claimed_target": "string",
    "therapeutic_hypothesis.proposed_mechanism": "string",
    "therapeutic_hypothesis.target_population": "string",
    "results.primary_endpoint_met": "boolean",
    "results.effect_size": "string",
    "results.p_value": "double",
    "results.dose_information": "string",
    "results.safety_signals": "array<string>",
    "context.comparator": "string",
    "context.duration": "string",
    "context.sample_size": "long",
    "trial_outcome": "string",
    "reasoning": "string",
    "failure_modes": "json",
    "confidence_overall": "double",
    "needs_expert_review": "boolean",
    "review_reason": "string",
}
#: What is enforced where changes are replayed: fields of array elements too, after the array they are in.
REPLAYED = {**TARGET, "failure_modes[].mode": "array<string>", "registry_phase": "string"}
#: In an object that took the place of a single value, the keys that hold the value.
VALUE_KEYS = ("met", "code", "raw", "exact", "enrolled", "description", "value", "name")
TRUTH = {"true": True, "yes": True, "y": True, "1": True, "false": False, "no": False, "n": False, "0": False}
#: A task passes its profile on when it holds so many fields of files; the sums are the same.
FLUSH_FIELDS = 200_000
KIND = {str: 1, int: 2, float: 2, bool: 4, dict: 8, list: 16, type(None): 0}
#: Of the values of trials that carry both fields, the share that has to agree for a rename.
AGREE = 0.5
#: Two truth values agree by chance: names without a common word need so many values.
CHANCE_VALUES = 8


#: Without a common trial, the share of the words of the smaller field that the other has to use as well.
SHARED_WORDS = 0.25
WORD = -1  #: position of a word's digest; the digest of a value has that of its element


def _hash(v: Any) -> int:
    """63 bits of the canonical JSON."""
    return int.from_bytes(hashlib.blake2b(json.dumps(v, sort_keys=True).encode(), digest_size=8).digest(), "big") >> 1


def _digests(at: int, v: Any) -> set[tuple[int, int]]:
    """Of a value that says something (not null, blank, empty, or made of objects), and of its words."""
    if v is None or v == "" or isinstance(v, dict) or isinstance(v, list) and (not v or any(isinstance(x, (dict, list)) for x in v)):
        return set()
    words = re.findall(r"[^\W\d_]+", v.lower()) if isinstance(v, str) else []
    return {(at, _hash(v)), *((WORD, _hash(w)) for w in words)}


def inventory(record: dict[str, Any], wanted: Container[str] = ()) -> tuple[dict[str, int], dict[str, set[tuple[int, int]]]]:
    """Types (bits) of each field of a record, and the digests of the values of those that are wanted."""
    kinds: dict[str, int] = defaultdict(int)
    digests: dict[str, set[tuple[int, int]]] = defaultdict(set)
    stack: list[tuple[str, Any, tuple[int, ...]]] = [("", record, ())]
    while stack:
        path, v, at = stack.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                p = f"{path}.{k}" if path else k
                kinds[p] |= KIND[type(x)]
                if p in wanted:
                    digests[p] |= _digests(_hash(at) if at else 0, x)
                if isinstance(x, (dict, list)):
                    stack.append((p, x, at))
        else:
            stack.extend((f"{path}[]", x, (*at, i)) for i, x in enumerate(v) if isinstance(x, (dict, list)))
    return kinds, digests


def _cast(v: Any, kind: str) -> tuple[Any, bool]:
    """The value in the target's type, and whether that worked."""
    if v is None:
        return None, True
    if kind == "json":
        return json.dumps(v), True
    if kind == "string" and isinstance(v, str):
        return v.encode("utf-8", "replace").decode(), True
    if kind == "boolean" and isinstance(v, bool):
        return v, True
    if kind == "array<string>" and isinstance(v, list) and all(isinstance(x, str) for x in v):
        return [x.encode("utf-8", "replace").decode() for x in v], True
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        if kind == "double":
            try:
                return float(v), True
            except OverflowError:
                return None, False
        if kind == "long" and v == v and abs(v) < 2**63 and v == int(v):
            return int(v), True
    return None, False


def enforce(record: dict[str, Any], target: dict[str, str]) -> tuple[list[Any], dict[str, Any]]:
    """Typed values in the target's order, and what is rescued by path."""
    typed: dict[str, Any] = {}
    rescued: dict[str, Any] = {}
    prefixes = {p[:i] for p in target for i, c in enumerate(p) if c == "."}
    stack: list[tuple[str, Any]] = [("", record)]
    while stack:
        path, v = stack.pop()
        if path in target:
            typed[path], ok = _cast(v, target[path])
            if not ok:
                rescued[path] = v
        elif isinstance(v, dict) and (not path or path in prefixes):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in v.items())
        elif v is not None:
            rescued[path] = v
    return [typed.get(p) for p in target], rescued


def recast(v: Any, kind: str) -> Any:
    """A value of another shape in the target's type, or None: wrapped, listed, quoted or coded values."""
    value, ok = _cast(v, kind)
    if ok:
        return value
    if kind == "array<string>":
        if isinstance(v, list):
            return [recast(x, "string") for x in v]
        text = recast(v, "string")
        return None if text is None else [x for x in (x.strip() for x in re.split(r"[;\n]", text)) if x]
    if isinstance(v, dict):
        for k in VALUE_KEYS:
            if k in v:
                return recast(v[k], kind)
        parts = [recast(x, "string") for x in v.values() if not isinstance(x, (dict, list))]
        return " ".join(x for x in parts if x and x.strip()) or None if kind == "string" else None
    if isinstance(v, list):
        parts = [x for x in v if x is not None]
        if len(parts) == 1:
            return recast(parts[0], kind)
        return "; ".join(x for x in (recast(x, "string") for x in parts) if x) or None if kind == "string" else None
    if kind == "string":
        return json.dumps(v)
    if kind == "boolean":
        return TRUTH.get((v if isinstance(v, str) else json.dumps(v)).strip().lower()) if v not in (0.0, 1.0) else v == 1
    if isinstance(v, str) and re.fullmatch(r"\s*[-+]?\d+(\.\d+)?([eE][-+]?\d+)?\s*", v):
        return _cast(int(v) if re.fullmatch(r"\s*[-+]?\d+\s*", v) else float(v), kind)[0]
    return None


class Names:
    """What the fields of each file are called in the target, by the renames that ``changes`` found.

    A field keeps its identity through the renames of a feed, forwards and backwards; it
    is the target's field whose name it bears in any file. A name that no rename of its
    own feed explains means what it means in other feeds, if they agree.
    """

    def __init__(self, found: list[tuple[str, int, str, str, str]], target: dict[str, str]):
        known = {p[:i] for p in target for i in range(1, len(p) + 1) if i == len(p) or p[i] in ".["}
        self.spans: dict[str, list[tuple[str, float, float, str]]] = defaultdict(list)
        meanings: dict[str, set[str]] = defaultdict(set)
        by_feed: dict[str, list[tuple[int, str, str, str]]] = defaultdict(list)
        for feed, n, old, new, kind in found:
            by_feed[feed].append((n, old, new, kind))
        for feed, rows in by_feed.items():
            live: dict[str, tuple[str, float]] = {}  # path: its origin, and the file since when
            spans: list[tuple[str, float, float, str]] = []
            bore: dict[str, list[str]] = defaultdict(list)
            rank = {"removed": 0, "renamed": 1, "added": 2, "retyped": 3}
            for n, old, new, kind in sorted(rows, key=lambda x: (x[0], rank[x[3]], x[1].count("."), x[1])):
                if kind in ("renamed", "removed"):
                    origin, since = live.pop(old, (_resolve(old, live), float("-inf")))
                    spans.append((old, since, n, origin))
                    bore[origin].append(old)
                    for k in [k for k in live if k.startswith((old + ".", old + "["))]:
                        below, since = live.pop(k)
                        spans.append((k, since, n, below))
                        if kind == "renamed":
                            live[new + k[len(old) :]] = (below, n)
                            bore[below].append(new + k[len(old) :])
                    if kind == "renamed":
                        live[new] = (origin, n)
                        bore[origin].append(new)
                elif kind == "added":
                    live[new] = (new, n)
            spans += [(k, since, float("inf"), origin) for k, (origin, since) in live.items()]
            means = {o: next((x for x in (o, *names) if x in known), None) for o, names in bore.items()}
            for path, since, until, origin in spans:
                if (goal := means.get(origin)) and goal != path:
                    self.spans[feed].append((path, since, until, goal))
                    if path not in known:
                        meanings[path].add(goal)
        self.elsewhere = {p: min(m) for p, m in meanings.items() if len(m) == 1}
        self.held: dict[tuple[str, int], dict[str, str]] = {}

    def of(self, feed: str | None, n: int | None) -> dict[str, str]:
        if (feed, n) not in self.held:
            own = {} if feed is None or n is None else {p: t for p, since, until, t in self.spans.get(feed, []) if since <= n < until}
            self.held[feed, n] = {**self.elsewhere, **own}
        return self.held[feed, n]


def _resolve(path: str, live: dict[str, tuple[str, float]]) -> str:
    """The path with its parents called as they were when they first came."""
    up, dot, key = path.rpartition(".")
    if path in live:
        return live[path][0]
    parent = re.sub(r"(\[\])+$", "", up)
    return _resolve(parent, live) + up[len(parent) :] + dot + key if dot else path


def replay(record: dict[str, Any], target: dict[str, str], names: dict[str, str]) -> tuple[list[Any], dict[str, Any]]:
    """As ``enforce``, with every field under the target's name and in its type.

    Of several fields that mean one, that of the target's own name goes first; values that
    had to be cast from another shape stay rescued as they were, beside the typed value.
    """
    found: dict[str, list[tuple[bool, str, Any]]] = defaultdict(list)
    rescued: dict[str, Any] = {}
    prefixes = {p[:i] for p in target for i, c in enumerate(p) if c == "."}
    stack: list[tuple[str, str, Any]] = [("", "", record)]
    while stack:
        path, name, v = stack.pop()
        if name in target:
            found[name].append((path != name, path, v))
        elif isinstance(v, dict) and (not name or name in prefixes):
            for k, x in v.items():
                below = f"{path}.{k}" if path else k
                stack.append((below, names.get(below) or (f"{name}.{k}" if name else k), x))
        elif v is not None:
            rescued[path] = v
    typed: dict[str, Any] = {}
    for name, kind in target.items():
        for _, path, v in sorted(found.get(name, ()), key=lambda x: x[:2]):
            if kind == "json":
                v = _renamed(v, path, name, names)
            value, ok = _cast(v, kind)
            value = value if ok else recast(v, kind)
            if v is not None and (not ok or typed.get(name) is not None):
                rescued[path] = v
            if typed.get(name) is None:
                typed[name] = value
                for inner in (t for t in target if t.startswith(name + "[].") and kind == "json" and isinstance(v, list)):
                    typed[inner] = [recast(x.get(inner[len(name) + 3 :]), "string") if isinstance(x, dict) else recast(x, "string") for x in v]
    return [typed.get(p) for p in target], rescued


def _renamed(v: Any, path: str, name: str, names: dict[str, str]) -> Any:
    """A nested value with its keys called as in the target."""
    if isinstance(v, list):
        return [_renamed(x, f"{path}[]", f"{name}[]", names) for x in v]
    if not isinstance(v, dict):
        return v
    out: dict[str, Any] = {}
    for k, x in v.items():
        below = f"{path}.{k}"
        goal = names.get(below, "")
        key = goal[len(name) + 1 :] if goal.startswith(name + ".") and "." not in goal[len(name) + 1 :] else k
        if key != k and (key in v or key in out):
            key = k
        out[key] = _renamed(x, below, f"{name}.{key}", names)
    return out


def column_name(path: str) -> str:
    return path.replace("[]", "").replace(".", "__")


def parse(payload: Any) -> dict[str, Any] | None:
    """The object of a line; none if it can't be parsed. A byte-order mark is no part of it."""
    if not isinstance(payload, str):
        return None
    try:
        x = json.loads(payload.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def ingest(lines: DataFrame, keep: list[str], target: dict[str, str] | None = None, payload: str = "payload", names: Names | None = None, file: tuple[str, str] = ("feed", "file_no")) -> DataFrame:
    """``keep`` columns, the target's columns, ``_rescued`` (JSON by path) and ``_broken``.

    Broken, null and empty lines come with ``_broken`` true and all else null, so that no
    line is lost; repeated lines stay repeated. Columns of ``lines`` that are not in
    ``keep`` are not read; names beginning with ``_`` are reserved. With ``names`` fields
    are replayed under the target's names; ``file``, the feed and file number, has to be in ``keep``.
    """
    target = TARGET if target is None else target
    kept = lines.select(*keep).schema
    types = {"json": "string"}
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{column_name(p)}` {types.get(t, t)}" for p, t in target.items()])
    ddl += ", _rescued string, _broken boolean"

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            made: list[list[Any]] = [[] for _ in range(len(target) + 2)]
            files = zip(*(b.column(keep.index(c)).to_pylist() for c in file)) if names else repeat((None, None))
            for p, (feed, n) in zip(b.column(len(keep)).to_pylist(), files):
                record = parse(p)
                if record is None:
                    row = [None] * (len(target) + 1) + [True]
                else:
                    typed, rescued = replay(record, target, names.of(feed, n)) if names else enforce(record, target)
                    row = [*typed, json.dumps(rescued) if rescued else None, False]
                for column, x in zip(made, row):
                    column.append(x)
            kinds = [_arrow(types.get(t, t)) for t in target.values()]
            kinds += [pa.string(), pa.bool_()]
            columns = [f.name for f in kept] + [column_name(p) for p in target] + ["_rescued", "_broken"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(m, k) for m, k in zip(made, kinds)], names=columns)

    return lines.select(*keep, F.col(payload)).mapInArrow(run, ddl)


def _arrow(kind: str) -> Any:
    import pyarrow as pa

    return {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[kind]


def promote(ingested: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Replay rescued values into typed columns: ``{column: (path, type)}``.

    A value that can't be cast stays null in the column and stays rescued; an existing
    column is filled only where it is null, which is how a renamed field is joined to
    the one it was. Runs in the JVM.
    """
    rescued = F.from_json("_rescued", "map<string,string>")
    out = ingested
    for name, (path, kind) in fields.items():
        raw: Column = F.element_at(rescued, F.lit(path))
        value = F.from_json(raw, kind) if kind.startswith(("array", "struct", "map")) else raw.try_cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in out.columns else value)
    return out


def _files(lines: DataFrame, feed: str, file_no: str, payload: str) -> DataFrame:
    return lines.select(F.col(feed).cast("string").alias("feed"), F.col(file_no).cast("long").alias("n"), F.col(payload).cast("string").alias("payload")).where("feed is not null and n is not null")


def profile(lines: DataFrame, feed: str = "feed", file_no: str = "file_no", payload: str = "payload") -> DataFrame:
    """``feed, n, path, kinds``: types of each field of each file; null alone is no type.

    Each task adds up its own files' fields first. Lines that can't be parsed, and those
    without feed or file number, say nothing.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        held: dict[tuple[str, int, str], int] = defaultdict(int)

        def passed() -> Any:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int32())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feed", "n", "path", "kinds"])

        for b in batches:
            for f, n, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                record = parse(text)
                for p, k in inventory(record)[0].items() if record is not None else ():
                    held[f, n, _clean(p)] |= k
            if len(held) > FLUSH_FIELDS:
                yield passed()
        yield passed()

    return _files(lines, feed, file_no, payload).mapInArrow(run, "feed string, n long, path string, kinds int").groupBy("feed", "n", "path").agg(F.bit_or("kinds").alias("kinds"))


def _clean(path: str) -> str:
    return path.encode("utf-8", "replace").decode()


def _evidence(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``feed, n, side, trial, path, flag, at, digest`` of the fields that came (``new``) or went (``old``, under the file after).

    ``wanted``: for each file the paths that ``came`` with it and that ``went`` after it.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        names = ["feed", "n", "side", "trial", "path", "flag", "at", "digest"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for f, n, text, came, went in zip(*(b.column(i).to_pylist() for i in range(5))):
                record = parse(text)
                if record is None:
                    continue
                sides = [(n, "new", frozenset(came or ())), (n + 1, "old", frozenset(went or ()))]
                kinds, digests = inventory(record, sides[0][2] | sides[1][2])
                trial = re.sub(r"\D", "", str(record.get("nct_id") or "")) or None
                rows += [(f, at_n, side, trial, p, kinds[p] == KIND[bool], at, d) for at_n, side, paths in sides for p in paths & digests.keys() for at, d in digests[p]]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=names)

    return lines.join(wanted, ["feed", "n"]).select("feed", "n", "payload", "came", "went").mapInArrow(run, "feed string, n long, side string, trial string, path string, flag boolean, at long, digest long")


def _words(name: str) -> set[str]:
    return {w for w in re.findall(r"[a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if len(w) > 1}


class _Level:
    """Fields of a file by parent path; a child is named by the brackets between and its key."""

    def __init__(self, kinds: dict[str, int]):
        self.kinds = kinds
        self.children: dict[str, dict[str, str]] = defaultdict(dict)
        for p in kinds:
            up, dot, key = p.rpartition(".")
            parent = re.sub(r"(\[\])+$", "", up)
            self.children[parent][up[len(parent) :] + dot + key if dot else key] = p


def diff(before: dict[str, int], after: dict[str, int], evidence: dict[tuple[str, str], tuple[int, int, float, bool]]) -> list[tuple[str, str, str]]:
    """Field path, new path and kind of each topmost change; evidence: values to compare, equal ones, shared words, all flags."""
    old, new = _Level(before), _Level(after)
    found: list[tuple[str, str, str]] = []
    told: dict[tuple[str, str], tuple[int, int, float, bool]] = {}  # evidence of a pair and of all alike paths below it
    for (x, y), (n, m, w, flag) in evidence.items():
        for k in [len(x), *(i for i, c in enumerate(x) if c in ".[")]:
            if y.endswith(x[k:]):
                pair = x[:k], y[: len(y) - len(x) + k]
                n0, m0, w0, flag0 = told.get(pair, (0, 0, 0.0, True))
                told[pair] = n0 + n, m0 + m, max(w0, w), flag0 and flag

    def support(r: str, a: str) -> tuple[float, int] | None:
        """Share and number of values that speak for r going on as a."""
        both, equal, words, flags = told.get((r, a), (0, 0, 0.0, True))
        if before[r] and after[a] and not before[r] & after[a]:
            return None
        common = _words(r.rsplit(".", 1)[-1]) & _words(a.rsplit(".", 1)[-1])
        if not both:
            mine, other = _words(r.rsplit(".", 1)[-1]), _words(a.rsplit(".", 1)[-1])
            return (words, 0) if words >= SHARED_WORDS or common and len(common) >= 0.5 * len(mine | other) else None
        if equal < AGREE * both or not equal:
            return None
        if flags and not common and (equal < both or both < CHANCE_VALUES):
            return None
        return equal / both, equal

    def level(p: str, q: str) -> None:
        mine, other = old.children[p], new.children[q]
        for k in mine.keys() & other.keys():
            same(mine[k], other[k])
        removed, added = mine.keys() - other.keys(), other.keys() - mine.keys()
        pairs = sorted(((s, r, a) for r in removed for a in added if r.rpartition(".")[0] == a.rpartition(".")[0] and (s := support(mine[r], other[a])) is not None), key=lambda x: (-x[0][0], -x[0][1], x[1], x[2]))
        for _, r, a in pairs:
            if r in removed and a in added:
                removed, added = removed - {r}, added - {a}
                here = q + r if r.startswith("[") or r.startswith(".") else r
                found.append((here, other[a], "renamed"))
                same(mine[r], other[a])
        found.extend((q + r if r[0] in "[." else r, q + r if r[0] in "[." else r, "removed") for r in removed)
        found.extend((other[a], other[a], "added") for a in added)

    def same(p: str, q: str) -> None:
        if after[q] & ~before[p]:
            found.append((q, q, "retyped"))
        else:
            level(p, q)

    level("", "")
    return found


def changes(lines: DataFrame, feed: str = "feed", file_no: str = "file_no", payload: str = "payload") -> DataFrame:
    """One row per change of a file against the file numbered one less, topmost path only.

    The lines are read twice: fields are profiled first, added up within each task; then
    values are compared only for fields that went or came, by joins on trial, never within
    one task. What one task gathers is
    a pair of files' field lists, bounded by the width of the schema. Files without
    parsable lines, or whose predecessor is missing, have no changes; null feeds and
    file numbers are left out; ties between candidates go to the smaller name.
    """
    prof = cut(profile(lines, feed, file_no, payload))
    cur, prev = prof.select("feed", "n", "path", "kinds"), prof.select("feed", (F.col("n") + 1).alias("n"), "path", "kinds")
    went = prev.join(cur, ["feed", "n", "path"], "left_anti").join(cur.select("feed", "n").distinct(), ["feed", "n"], "left_semi")
    came = cur.join(prev, ["feed", "n", "path"], "left_anti").join(prev.select("feed", "n").distinct(), ["feed", "n"], "left_semi")
    moved = came.select("feed", "n", F.col("path").alias("c"), F.lit(None).cast("string").alias("w")).unionByName(went.select("feed", (F.col("n") - 1).alias("n"), F.lit(None).cast("string").alias("c"), F.col("path").alias("w")))
    wanted = moved.groupBy("feed", "n").agg(F.collect_set("c").alias("came"), F.collect_set("w").alias("went"))  # a file's fields: bounded by the schema
    # both sides in one table, repeated lines told once
    told = cut(_evidence(_files(lines, feed, file_no, payload), wanted).distinct())
    old, new = (told.where(F.col("side") == side).select("feed", "n", F.col("trial").alias("_trial"), F.col("path").alias(side), "flag", "at", "digest") for side in ("old", "new"))
    one, other = old.where(f"at <> {WORD} and _trial is not null"), new.where(f"at <> {WORD} and _trial is not null")
    key, at = ["feed", "n", "old", "new"], ["feed", "n", "_trial", "at"]
    both = one.groupBy(*at, "old").agg(F.bool_and("flag").alias("flag")).join(other.select(*at, "new").distinct(), at).groupBy(key).agg(F.count("*").alias("both"), F.bool_and("flag").alias("flag"))
    equal = one.drop("flag").join(other.drop("flag"), [*at, "digest"]).select(*key, "_trial", "at").distinct().groupBy(key).agg(F.count("*").alias("equal"))
    words, terms = [x.where(f"at = {WORD}").select("feed", "n", c, "digest").distinct() for x, c in ((old, "old"), (new, "new"))]
    n_old, n_new = words.groupBy("feed", "n", "old").agg(F.count("*").alias("n_old")), terms.groupBy("feed", "n", "new").agg(F.count("*").alias("n_new"))
    shared = words.join(terms, ["feed", "n", "digest"]).groupBy(key).agg(F.count("*").alias("shared")).join(n_old, ["feed", "n", "old"]).join(n_new, ["feed", "n", "new"])
    shared = shared.select(*key, (100 * F.col("shared") / F.least("n_old", "n_new")).cast("long").alias("words"))
    pairs = both.join(equal, key, "left").join(shared, key, "full")
    # all that one comparison needs, as rows: fields before, fields after, and evidence
    rows = (
        prev.select("feed", "n", F.lit("b").alias("side"), F.col("path").alias("p"), F.lit("").alias("q"), F.col("kinds").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"), F.lit(False).alias("flag"))
        .unionByName(cur.select("feed", "n", F.lit("a").alias("side"), F.col("path").alias("p"), F.lit("").alias("q"), F.col("kinds").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z"), F.lit(False).alias("flag")))
        .unionByName(pairs.select("feed", "n", F.lit("e").alias("side"), F.col("old").alias("p"), F.col("new").alias("q"), F.coalesce("both", F.lit(0)).cast("long").alias("x"), F.coalesce("equal", F.lit(0)).cast("long").alias("y"), F.coalesce("words", F.lit(0)).cast("long").alias("z"), F.coalesce("flag", F.lit(False)).alias("flag")))
    )

    def compare(key: tuple[Any, ...], rows: Any) -> Any:
        import pyarrow as pa

        before: dict[str, int] = {}
        after: dict[str, int] = {}
        evidence: dict[tuple[str, str], tuple[int, int, float, bool]] = {}
        for side, p, q, x, y, z, flag in zip(*(rows.column(c).to_pylist() for c in ("side", "p", "q", "x", "y", "z", "flag"))):
            if side == "e":
                evidence[p, q] = x, y, z / 100, flag
            else:
                (before if side == "b" else after)[p] = x
        found = sorted(diff(before, after, evidence)) if before and after else []
        file = [pa.array([k.as_py()] * len(found), t) for k, t in zip(key, (pa.string(), pa.int32()))]
        return pa.Table.from_arrays(file + [pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["feed", "file_no", "field_path", "new_field_path", "change_kind"])

    return rows.groupBy("feed", "n").applyInArrow(compare, "feed string, file_no int, field_path string, new_field_path string, change_kind string")
