"""Items of varying length in containers of fixed capacity, with little unused space.

Optimal length buckets: a dynamic programme over the global histogram of lengths chooses
the bucket boundaries that leave least unused where every item is padded to its bucket's
boundary. Token-budget batches are formed bucket by bucket from the longest on, by actual
lengths and best fit first, on the histogram (never on the items); space that a bucket's
batches leave over is offered to the shorter buckets. Padded batches alone would leave
about a tenth unused. The histogram has at most as many entries as the capacity,
whatever the data; items then find their place by length and number, without a driver or
a sort of all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credograph.session import cut

CAPACITY = 2048
#: The published GPT-2 pre-tokenisation.
PRETOKEN = r"(?U)'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of a length are numbered in groups of about this many.
GROUP_ROWS = 100_000


def token_count(n_tokens: Column, text: Column) -> Column:
    """The given count, or where it is null or negative the pre-tokens of the text; 0 for a null text."""
    return F.coalesce(F.when(n_tokens >= 0, n_tokens), F.regexp_count(text, F.lit(PRETOKEN)), F.lit(0)).cast("long")


def batches(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Containers by contents: ``(how many, ((length, how often), ...))``, longest lengths first.

    Best fit decreasing, for all items of a length at once: they go where they leave the
    least space, into alike containers together; what finds none opens new ones.
    """
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    spaces: list[int] = []  # sorted, those in room

    def put(space: int, n: int, held: tuple[tuple[int, int], ...]) -> None:
        if not room[space]:
            insort(spaces, space)
        room[space].append((n, held))

    for length in sorted((k for k, c in histogram.items() if 0 < k <= capacity and c > 0), reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, full, ((length, each),))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            space = spaces[at]
            n, held = room[space].pop()
            if not room[space]:
                spaces.pop(at)
            each = min(space // length, max(1, left // n)) if left >= n else 1
            take = min(n, left // each)
            put(space - each * length, take, (*held, (length, each)))
            if n > take:
                put(space, n - take, held)
            left -= take * each
    return [x for space in spaces for x in room[space]]


def boundaries(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Lengths from and to of each bucket, and its containers if all its items were padded to the longest.

    The division, over all lengths, that needs the fewest padded containers; of equally
    good ones that whose last buckets are the narrowest. The time is the square of the number of lengths.
    """
    lengths = np.array(sorted(k for k, c in histogram.items() if 0 < k <= capacity and c > 0), np.int64)
    upto = np.concatenate([[0], np.cumsum([histogram[int(k)] for k in lengths])]).astype(np.int64)
    best, start = np.zeros(len(lengths) + 1, np.int64), np.zeros(len(lengths) + 1, np.int64)
    for j, longest in enumerate(lengths, 1):
        cost = best[:j] - (upto[:j] - upto[j]) // (capacity // longest)  # rounded up
        start[j] = j - 1 - int(cost[::-1].argmin())
        best[j] = cost[start[j]]
    out, j = [], len(lengths)
    while j:
        i = int(start[j])
        out.append((int(lengths[i]), int(lengths[j - 1]), int(best[j] - best[i])))
        j = i
    return out[::-1]


def buckets(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, list[tuple[int, tuple[tuple[int, int], ...]]]]]:
    """Lengths from, to, and the batches of each bucket, with what shorter buckets filled into them."""
    found = boundaries(histogram, capacity)
    own: list[list[tuple[int, tuple[tuple[int, int], ...]]]] = [[] for _ in found]
    for n, held in batches(histogram, capacity):
        own[bisect_left([to for _, to, _ in found], held[0][0])].append((n, held))
    return [(low, high, o) for (low, high, _), o in zip(found, own)]


PLACES = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "from_no", "to_no", "each", "first_container")])


def places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """For each run of item numbers of a length: how many go into a container, and the first container."""
    out, container, used = [], 0, defaultdict(int)
    for _, _, own in buckets(histogram, capacity):
        for n, held in own:
            for length, each in held:
                out.append((length, used[length], used[length] + n * each, each, container))
                used[length] += n * each
            container += n
    return out


def sized_parts(docs: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, part_no, length``: a row for each text, or for each part of one longer than the capacity."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("n_tokens"), F.col("text")).alias("total"))
    cut_up = F.transform(F.sequence(F.lit(0), F.ceil(F.col("total") / capacity) - 1), lambda i: F.least(F.lit(capacity).cast("long"), F.col("total") - i * capacity))
    lengths = F.when(F.col("total") <= capacity, F.array(F.col("total"))).otherwise(cut_up)
    return sized.select("doc_id", F.posexplode(lengths).alias("part_no", "length"))


def bucket_report(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``from_length, to_length, items, tokens, padded_containers, opened_containers`` of each bucket.

    ``padded_containers``: what its items would need, padded to the bucket's boundary and kept
    apart; ``opened_containers``: those whose longest item is of the bucket, as ``assign`` fills them.
    """
    histogram = {r["length"]: r["n"] for r in sized_parts(docs, capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    opened = {high: sum(n for n, _ in own) for _, high, own in buckets(histogram, capacity)}
    rows = []
    for low, high, padded in boundaries(histogram, capacity):
        held = [(k, c) for k, c in histogram.items() if low <= k <= high]
        rows.append((low, high, sum(c for _, c in held), sum(k * c for k, c in held), padded, opened[high]))
    return docs.sparkSession.createDataFrame(rows, "from_length long, to_length long, items long, tokens long, padded_containers long, opened_containers long")


def assign(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, part_no, first_token, n_tokens, container_id``: where each text, or part of a long one, goes.

    ``docs`` has ``doc_id, n_tokens, text``; other columns are not read. Only a text
    longer than the capacity is split: into full containers and a rest, parts from 0.
    Texts without tokens take no space and are named to container 0. Texts of equal
    length are numbered in hashed groups of about ``group_rows``, so a length that a
    third of all rows share is no single task; repeated rows get a place each. What the
    driver holds is the histogram and the runs, bounded by the capacity.
    """
    parts = cut(sized_parts(docs, capacity))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = parts.sparkSession.createDataFrame(places(histogram, capacity), PLACES)
    groups = max(1, -(-max(histogram.values(), default=1) // group_rows))
    keyed = parts.where("length > 0").withColumn("g", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(groups)).cast("int"))
    sizes = keyed.groupBy("length", "g").agg(F.count("*").alias("n"))
    offsets = sizes.select("length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "part_no")) - 1
    numbered = keyed.withColumn("no", own).join(offsets, ["length", "g"]).withColumn("no", (F.col("no") + F.col("offset")).cast("long"))
    runs = runs.withColumnRenamed("length", "l")
    placed = numbered.join(F.broadcast(runs), (F.col("length") == F.col("l")) & (F.col("no") >= F.col("from_no")) & (F.col("no") < F.col("to_no")))
    container = F.col("first_container") + F.floor((F.col("no") - F.col("from_no")) / F.col("each"))
    cols = ["doc_id", F.col("part_no").cast("int").alias("part_no"), (F.col("part_no") * capacity).cast("long").alias("first_token"), F.col("length").alias("n_tokens")]
    full = placed.select(*cols, container.cast("long").alias("container_id"))
    return full.unionByName(parts.where("length = 0").select(*cols, F.lit(0).cast("long").alias("container_id")))


def usage(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, tokens, unused_share`` of an assignment."""
    return assigned.agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).withColumn("unused_share", F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)))
