"""Train, validation and test splits that keep related records together.

Records that share a key, directly or through others, form a component. Components are
placed by grouped iterative stratification: their label vectors are summed, the label
with the fewest rows outstanding comes first, and its components go to the split that
needs it most. Components with equal vectors are placed together, each as if alone.
"""

from __future__ import annotations

from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credograph.llm.components import contract
from credograph.session import cut

#: Values that name nothing and so join nothing.
PLACEHOLDERS = ["unclear", "unknown", "n/a", "not specified", "-", "none", "tbd", "not reported"]
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: So many labels are balanced one by one; all rarer ones count as one label.
LABELS = 1000
#: Components are placed by their label vectors; while there are more different ones than this, those of
#: the fewest rows are placed in hashed bundles of equal rarest label, as many again in all.
VECTORS = 100_000
#: Components of equal vectors are numbered in groups of about this many.
GROUP_ROWS = 100_000


def trial_key(c: Column) -> Column:
    """The eight digits, however written; null without them."""
    return F.nullif(F.regexp_extract(c, r"(\d{8})", 1), F.lit(""))


def named(c: Column) -> Column:
    """Lower case, trimmed, inner white space one space; null for blanks and placeholders."""
    v = F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.when((v != "") & ~v.isin(PLACEHOLDERS), v)


def grouped(df: DataFrame, record: str, keys: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """``record, group_id, group_rows`` and ``keep``: the smallest record of each one's component and its size.

    Links run between keys, not between records: a key with a third of all rows is one
    vertex with as many links as it has distinct other keys. Rows without a key are
    alone; rows repeated under the same record id are kept and counted.
    """
    kept = [c for c in keep or [] if c != record]
    key_columns = [F.concat(F.lit(f"{k}:"), c) for k, c in keys.items()]
    base = df.select(F.col(record).alias("__id"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], F.array_compact(F.array(*key_columns)).alias("__keys"))
    first = F.element_at("__keys", 1)
    links = base.where(F.size("__keys") > 1).select(first.alias("a"), F.explode(F.slice("__keys", 2, len(keys))).alias("b"))
    roots = contract(links.distinct())
    rows = base.withColumn("__key", F.get("__keys", F.lit(0))).drop("__keys")
    rows = rows.join(roots, rows["__key"] == roots["vertex"], "left")
    rows = rows.withColumn("__root", F.coalesce("root", "__key", F.concat(F.lit("alone:"), F.col("__id").cast("string")))).drop("root", "vertex", "__key")
    rows = cut(rows)
    sizes = rows.groupBy("__root").agg(F.min("__id").alias("group_id"), F.count("*").alias("group_rows"))
    return rows.join(sizes, "__root").select(F.col("__id").alias(record), "group_id", "group_rows", *[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)])


def share_out(needs: list[Any], rows: int, n: int, in_all: list[Any], all_rows: int) -> list[int]:
    """How many of ``n`` equal items go to whom, each to the one in greatest need at its turn.

    An item has ``rows`` rows of what is needed and ``all_rows`` in all; ties go by the
    need ``in_all``, then to the first. All but the last few turns are
    taken at once, by the level to which the needs come down.
    """
    out = [0] * len(needs)
    bulk = n - 2 * len(needs)
    if bulk > 0:
        order = sorted(needs, reverse=True)
        for k in range(1, len(order) + 1):
            level = (sum(order[:k]) - bulk * rows) / k
            if k == len(order) or level >= order[k]:
                break
        out = [max(0, int((x - level) / rows) - 1) if x > level else 0 for x in needs]
    for _ in range(n - sum(out)):
        out[max(range(len(needs)), key=lambda s: (needs[s] - out[s] * rows, in_all[s] - out[s] * all_rows, -s))] += 1
    return out


def place(classes: list[tuple[tuple[int, ...], int]], shares: list[Any]) -> list[list[int]]:
    """How many components of each class go to each split, by iterative stratification.

    ``classes``: label vector and number of components that have it. The label with the
    fewest rows outstanding comes first; of its components those of most rows; each goes
    to the split with the greatest need of that label, then of rows in all, then the first.
    Shares are best given as fractions, so that ties are ties.
    """
    n = len(classes[0][0]) if classes else 0
    outstanding = [sum(v[i] * c for v, c in classes) for i in range(n)]
    need = [[share * t for t in outstanding] for share in shares]
    out = [[0] * len(shares) for _ in classes]
    left = set(range(len(classes)))
    while left:
        live = [i for i in range(n) if outstanding[i] > 0]
        if not live:
            for k in left:
                out[k][0] = classes[k][1]
            break
        label = min(live, key=lambda i: (outstanding[i], i))
        for k in sorted((k for k in left if classes[k][0][label]), key=lambda k: (-sum(classes[k][0]), classes[k][0])):
            v, c = classes[k]
            out[k] = share_out([x[label] for x in need], v[label], c, [sum(x) for x in need], sum(v))
            for i in range(n):
                outstanding[i] -= v[i] * c
                for s, got in enumerate(out[k]):
                    need[s][i] -= v[i] * got
            left.remove(k)
    return out


def assign(records: DataFrame, record: str, label: str, shares: dict[str, float] = SHARES, labels: int = LABELS, vectors: int = VECTORS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``record, group_id, split`` of what ``grouped`` gives with the column ``label`` kept.

    Components of equal label vectors are alike, so the driver places vectors with their
    numbers of components, which is what placing all components one by one gives; which
    of them goes where is settled by their number. What reaches the driver is bounded by
    ``labels`` and ``vectors``, not by rows or components. Null labels are a label of
    their own; ties go to the smaller label and the first split.
    """
    labelled = records.select(record, "group_id", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("__l"))
    counts = labelled.groupBy("__l").agg(F.count("*").alias("n"))
    held = counts.orderBy(F.desc("n"), "__l").limit(labels).collect()
    names = [r["__l"] for r in sorted(held, key=lambda r: (r["n"], r["__l"]))]
    splits = list(shares)
    if not names:
        return records.select(record, "group_id", F.lit(splits[0]).alias("split"))
    other = F.count("*") - F.count(F.when(F.col("__l").isin(names), 1))
    vector = F.array(*[F.count(F.when(F.col("__l") == x, 1)) for x in names], other)
    comps = cut(labelled.groupBy("group_id").agg(vector.alias("v")))
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    classes = comps.groupBy("v").agg(F.count("*").alias("n")).withColumn("size", size)
    large = classes.orderBy(F.desc("size"), "v").limit(vectors + 1).collect()
    if len(large) > vectors:  # all components of at least so many rows by their own vectors, the rest in bundles
        least = large[-1]["size"] + 1
        rarest = F.array_position(F.transform("v", lambda x: (x > 0).cast("int")), 1)
        per = max(1, vectors // (len(names) + 1))
        bundle = F.when(size < least, rarest * per + F.pmod(F.xxhash64("group_id"), F.lit(per)))
        whole = comps.withColumn("b", bundle)
        sums = whole.where("b is not null").groupBy("b").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(len(names) + 1)]).alias("w"))
        comps = cut(whole.join(sums, "b", "left").select("group_id", F.coalesce("w", "v").alias("v"), F.coalesce(F.col("b"), F.lit(-1)).alias("b")))
        unit = comps.select("v", "b", F.when(F.col("b") < 0, F.col("group_id")).alias("one")).distinct()
        large = unit.groupBy("v").agg(F.count("*").alias("n")).collect()
    else:
        comps = comps.withColumn("b", F.lit(-1).cast("long"))
    listed = [(tuple(r["v"]), r["n"]) for r in large]
    rows, most = [], max(n for _, n in listed)
    for (v, _), placed in zip(listed, place(listed, [Fraction(str(x)) for x in shares.values()])):
        ends = [sum(placed[: s + 1]) for s in range(len(placed))]
        rows += [(list(v), e - n, e, splits[s]) for s, (e, n) in enumerate(zip(ends, placed)) if n]
    ranges = records.sparkSession.createDataFrame(rows, "v array<long>, from_no long, to_no long, split string")
    # the components of a vector are numbered in hashed groups, so that no vector is one task; a bundle is one component
    groups = max(1, -(-most // group_rows))
    named = comps.select("group_id", "v", F.when(F.col("b") < 0, F.col("group_id")).otherwise(-F.col("b")).alias("unit"))
    units = named.select("v", "unit").distinct().withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int"))
    sizes = units.groupBy("v", "g").agg(F.count("*").alias("n"))
    offsets = sizes.select("v", "g", (F.sum("n").over(Window.partitionBy("v").orderBy("g")) - F.col("n")).alias("offset"))
    numbered = units.withColumn("no", F.row_number().over(Window.partitionBy("v", "g").orderBy(F.xxhash64("unit"), "unit")) - 1).join(offsets, ["v", "g"]).select("v", "unit", (F.col("no") + F.col("offset")).alias("no"))
    chosen = numbered.join(ranges, "v").where("no >= from_no and no < to_no").select("v", "unit", "split")
    by_group = named.join(chosen, ["v", "unit"]).select("group_id", "split")
    return records.select(record, "group_id").join(by_group, "group_id").select(record, "group_id", "split")
