"""Vectors: search in blocks, nearest terms, kernel-localised beliefs, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credograph.session import cut

#: So many query vectors are compared at a time.
QUERY_BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one, as doubles; null for the zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def search(rows: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, cosine, rank``: the k nearest rows of each query, exact.

    ``rows`` has ``vec_id, embedding``, ``queries`` the same. Query vectors go out in
    blocks; each task keeps its own k best, so k rows a query and task are shuffled.
    Null and zero vectors are left out; a query isn't its own neighbour; ties go to the
    smaller id.
    """
    import numpy as np
    import pyarrow as pa

    out = None
    held = queries.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).where("vec_id is not null and e is not null").orderBy("vec_id")
    pending: list = []

    def part(block_rows: list) -> DataFrame:
        ids = np.array([r["vec_id"] for r in block_rows])
        q = np.array([r["e"] for r in block_rows], dtype=float)
        norm = np.linalg.norm(q, axis=1)
        ids, q = ids[norm > 0], q[norm > 0] / norm[norm > 0][:, None]
        shared = rows.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches):
            ids, q = shared.value
            best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
            for b in batches:
                vec = [x for x in b.column(1).to_pylist()]
                keep = [i for i, x in enumerate(vec) if x is not None and len(x) == q.shape[1] and any(x)]
                if not keep or not len(ids):
                    continue
                v = np.array([vec[i] for i in keep], dtype=float)
                v /= np.linalg.norm(v, axis=1)[:, None]
                own = np.asarray(b.column(0).to_numpy(zero_copy_only=False))[keep]
                s = q @ v.T
                s[ids[:, None] == own[None, :]] = -np.inf
                s, i = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(own, s.shape)])
                order = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            found = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[found], pa.int64()), pa.array(best_i[found], pa.int64()), pa.array(best_s[found], pa.float64())], names=["query_id", "vec_id", "cosine"])

        return rows.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null").mapInArrow(run, "query_id long, vec_id long, cosine double")

    for r in held.toLocalIterator():
        pending.append(r)
        if len(pending) == block:
            out = part(pending) if out is None else out.unionByName(part(pending))
            pending = []
    if pending or out is None:
        out = part(pending or []) if out is None and pending else (out.unionByName(part(pending)) if pending else rows.sparkSession.createDataFrame([], "query_id long, vec_id long, cosine double"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, least: float, pivots: int = 64, seed: int = 7, new: DataFrame | None = None) -> DataFrame:
    """``a, b, cosine``: all pairs of distinct vectors whose cosine is at least ``least``, smaller id first; exact.

    ``rows`` has ``vec_id, embedding``; equal directions are one vector, named by its smallest id
    (``copies`` gives the rest). Each vector is at home with its nearest pivot and is a guest with
    all that are at most twice the radius further, which by the triangle inequality leaves out no
    pair; pairs meet in the cell of the larger id only. Pivots are a bounded sample; they change
    the work, not the result. With ``new`` (``vec_id``) only pairs with one of these are given.
    """
    import math

    u = cut(copies(rows).where("vec_id = first").select("vec_id", "u"))
    held = [r["u"] for r in u.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(pivots).collect()]
    if not held:
        return rows.sparkSession.createDataFrame([], "a long, b long, cosine double")
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    apart = lambda p: F.sqrt(F.greatest(2 - 2 * dot(F.col("u"), p), F.lit(0.0)))
    centres = F.array(*[F.array(*map(F.lit, p)) for p in held])
    x = u.withColumn("d", F.transform(centres, apart))
    x = cut(x.withColumn("near", F.array_min("d")))
    home = x.select(F.col("vec_id").alias("b"), F.col("u").alias("ub"), (F.array_position("d", F.col("near")) - 1).cast("int").alias("cell"))
    guests = x.select(F.col("vec_id").alias("a"), F.col("u").alias("ua"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(held) - 1)), lambda c: F.get("d", c) <= F.col("near") + 2 * radius)).alias("cell"))
    pairs = home.join(guests, "cell").where("a < b").select("a", "b", dot(F.col("ua"), F.col("ub")).alias("cosine")).where(F.col("cosine") >= least)
    if new is not None:
        fresh = new.select(F.col("vec_id").alias("n")).distinct()
        marked = pairs.join(fresh.select(F.col("n").alias("a"), F.lit(True).alias("na")), "a", "left").join(fresh.select(F.col("n").alias("b"), F.lit(True).alias("nb")), "b", "left")
        pairs = marked.where("na or nb").select("a", "b", "cosine")
    return pairs


def copies(rows: DataFrame) -> DataFrame:
    """``vec_id, first, u``: each vector at length one with the smallest id of its direction; null and zero vectors are left out."""
    u = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), unit(F.col("embedding")).alias("u")).where("u is not null")
    u = u.withColumn("k", F.xxhash64(F.transform("u", lambda x: F.round(x, 12))))
    return u.join(u.groupBy("k").agg(F.min("vec_id").alias("first")), "k").select("vec_id", "first", "u")


def boxes(rows: DataFrame, key: str) -> DataFrame:
    """Axis-aligned bounds of each key's vectors: ``key, axis, lo, hi``."""
    return rows.select(key, F.posexplode("embedding").alias("axis", "x")).groupBy(key, "axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def containment(bounds: DataFrame, key: str) -> DataFrame:
    """For each two keys the share of the first one's box inside the second one's, by its geometric mean over axes."""
    a, b = bounds.alias("a"), bounds.alias("b")
    width = F.greatest(F.col("a.hi") - F.col("a.lo"), F.lit(1e-9)).cast("double")
    inside = F.greatest(F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo"), F.lit(0.0)).cast("double") / width
    x = a.join(b, F.col("a.axis") == F.col("b.axis")).where(F.col(f"a.{key}") != F.col(f"b.{key}"))
    return x.groupBy(F.col(f"a.{key}").alias("inner"), F.col(f"b.{key}").alias("outer")).agg(F.round(F.exp(F.avg(F.log(F.greatest(inside, F.lit(1e-9))))), 4).alias("share"))


def relation(ab: Column, ba: Column, high: float = 0.90, low: float = 0.30) -> Column:
    """merge, parent, child, sibling or unrelated, by how far each box holds the other."""
    return F.when((ab >= high) & (ba >= high), "merge").when(ab >= high, "child").when(ba >= high, "parent").when((ab >= low) | (ba >= low), "sibling").otherwise("unrelated")


def expanded(bounds: DataFrame, key: str, parents: DataFrame, max_depth: int = 5) -> DataFrame:
    """Bounds widened, leaves first, until every box holds those of its children; ``parents`` has ``node, parent``."""
    from credograph.operators.graph import ancestors

    up = ancestors(bounds.select(F.col(key).alias("node")).distinct(), parents.select(F.col("node").cast("string"), F.col("parent").cast("string")) if dict(bounds.dtypes)[key] == "string" else parents, max_depth)
    x = bounds.join(up, bounds[key] == up["node"])
    return x.groupBy(F.col("ancestor").alias(key), "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def nearest_parents(shares: DataFrame, widths: DataFrame, high: float = 0.90) -> DataFrame:
    """``child, parent``: of the boxes that hold a child's (by ``inner, outer, share``) the narrowest; no box is its own parent's parent.

    Two boxes that hold each other are the same and give no edge; ties go to the smaller key.
    """
    a = shares.where(F.col("share") >= high).select("inner", "outer")
    one_way = a.join(a.select(F.col("outer").alias("inner"), F.col("inner").alias("outer")), ["inner", "outer"], "left_anti")
    x = one_way.join(widths.select(F.col("key").alias("outer"), "width"), "outer")
    return x.groupBy(F.col("inner").alias("child")).agg(F.min_by("outer", F.struct("width", "outer")).alias("parent"))
