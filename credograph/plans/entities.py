"""Queries over vectors, merges, canonical text, sets and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credograph.operators import merge, vectors
from credograph.plans.base import CH_SQL, EV_SQL, beliefs, chains, evidence_log, unpivot
from credograph.session import cut
from credograph.sources.tables import table

GATE, BANDWIDTH, MOST_TERMS = 0.60, 0.25, 2000


def nearest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, against all."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vectors.search(e, e.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"), "rank")


def _centroids(e: DataFrame) -> DataFrame:
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # as many as dimensions


def nearest_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest label centroid of each vector, gated; a vocabulary goes into the plan, so it may hold ``MOST_TERMS`` at most."""
    e = table(spark, sf_dir, "embeddings")
    held = [(r["label"], r["c"]) for r in _centroids(e).orderBy("label").limit(MOST_TERMS + 1).collect()]
    if len(held) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms; use vectors.search with the terms as rows")
    terms = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*map(F.lit, c)).alias("c")) for t, c in held])
    u = e.withColumn("u", vectors.unit(F.col("embedding")))
    best = F.array_max(F.transform(terms, lambda x: F.struct(F.round(vectors.dot(F.col("u"), vectors.unit(x["c"])), 6).alias("s"), (-x["t"]).alias("t"))))
    x = u.select("vec_id", best.alias("b"))
    return x.select("vec_id", F.when(F.col("b.s") >= GATE, -F.col("b.t")).alias("term"), F.round("b.s", 4).alias("cosine"))


def kernel_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belief of each label localised at its smallest vector: anchors count by their closeness."""
    e = table(spark, sf_dir, "embeddings").withColumn("u", vectors.unit(F.col("embedding")))
    at = e.groupBy("label").agg(F.min_by("u", "vec_id").alias("q"))
    k = F.exp((vectors.dot(F.col("u"), F.col("q")) - 1) / BANDWIDTH)
    good = F.pmod("vec_id", F.lit(3)) != 0
    x = e.join(at, "label").withColumn("k", k)
    return x.groupBy("label").agg(F.round(1 + F.sum(F.when(good, F.col("k")).otherwise(0.0)), 4).alias("alpha"), F.round(1 + F.sum(F.when(good, 0.0).otherwise(F.col("k"))), 4).alias("beta"))


def label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.boxes(table(spark, sf_dir, "embeddings"), "label").select("label", "axis", F.round(F.col("lo").cast("double"), 5).alias("lo"), F.round(F.col("hi").cast("double"), 5).alias("hi"))


def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(vectors.containment(vectors.boxes(table(spark, sf_dir, "embeddings"), "label"), "label"))
    x = c.alias("a").join(c.alias("b"), (F.col("a.inner") == F.col("b.outer")) & (F.col("a.outer") == F.col("b.inner")) & (F.col("a.inner") < F.col("a.outer")))
    return x.select(F.col("a.inner").alias("a"), F.col("a.outer").alias("b"), vectors.relation(F.col("a.share"), F.col("b.share")).alias("relation"))


def merge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanism texts that are the same but for hyphens and spaces, or for the order of their words."""
    m = chains(spark, sf_dir).select("mechanism").where("mechanism is not null").distinct()
    letters = F.regexp_replace("mechanism", "[^a-z0-9]", "")
    ordered = F.array_join(F.array_sort(F.split("mechanism", "[^a-z0-9]+")), " ")
    return merge.classes(m, "mechanism", [letters, ordered]).select(F.col("node").alias("mechanism"), "class_id")


def merged_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs after targets of one family are merged into its first, alike records counted once."""
    t = table(spark, sf_dir, "ref_entities", "entity_id", "entity_type").where("entity_type = 'target'")
    mapping = t.select(F.col("entity_id").alias("node"), (F.floor((F.col("entity_id") - 5001) / 4) * 4 + 5001).alias("class_id"))
    return beliefs(merge.redirect(evidence_log(spark, sf_dir), mapping, "dst"))


def union_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials' edges united with those of earlier years, the first statement of each kept."""
    e = unpivot(chains(spark, sf_dir), "chain_id", "annotated_at").withColumn("batch", F.when(F.year("annotated_at") < 2024, 0).otherwise(1))
    return e.groupBy("src", "dst", "edge_type").agg(F.min(F.struct("batch", "chain_id")).alias("m")).select("src", "dst", "edge_type", "m.batch", "m.chain_id")


def namespaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids scoped by trial, and how many concepts each scope shares with others."""
    n = unpivot(chains(spark, sf_dir), "trial_id").select("trial_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    shared = n.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node", F.lit(1).alias("s"))
    return n.join(shared, "node", "left").select(F.concat("node", F.lit("#"), "trial_id").alias("scoped_id"), F.col("s").isNotNull().alias("shared"))


def set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge sets of trials that succeeded and failed: only the one, only the other, both."""
    e = unpivot(chains(spark, sf_dir), "outcome").select("src", "dst", "edge_type", "outcome")
    s, f = e.where("outcome = 'success'").drop("outcome").distinct(), e.where("outcome = 'failure'").drop("outcome").distinct()
    parts = [s.subtract(f).withColumn("side", F.lit("success")), f.subtract(s).withColumn("side", F.lit("failure")), s.intersect(f).withColumn("side", F.lit("both"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("side", "edge_type").agg(F.count("*").alias("edges"))


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left once every step of the backbone is fed by the step before."""
    e = unpivot(chains(spark, sf_dir), "chain_id").select("src", "dst", "edge_type").distinct()
    return merge.prune(e, {"affects": "modulates_via", "modulates_via": "mechanism_affects", "mechanism_affects": "biology_drives"}).groupBy("edge_type").agg(F.count("*").alias("edges"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly events by type and what each hour adds to the last six."""
    e = table(spark, sf_dir, "events", "ts", "event_type", "value").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    w = Window.partitionBy("event_type").orderBy(F.unix_seconds(F.col("hour").cast("timestamp"))).rangeBetween(-5 * 3600, 0)
    return e.select("event_type", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", F.col("v").cast("double").alias("value"), F.sum("n").over(w).alias("last_six"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: a gap of over six hours begins another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    e = e.withColumn("new", F.when(F.col("s") - F.lag("s").over(w) <= 6 * 3600, 0).otherwise(1))
    e = e.withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("s") - F.min("s")).alias("seconds"))


def order_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem summary by flag and status, exact."""
    d = "decimal(18,4)"
    x = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    net = F.col("l_extendedprice").cast(d) * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("quantity"), F.sum(net).cast("double").alias("net"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (nearest_search, nearest_term, kernel_query, label_boxes, box_relations, merge_classes, merged_beliefs, union_into, namespaced, set_compare, pruned, event_windows, event_sessions, order_pricing)}


_V = "emb AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), un AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM emb)"
_COS = "list_dot_product(a.v, b.v) / (a.n * b.n)"
_BOX = "bx AS (SELECT label, i - 1 AS axis, min(x) AS lo, max(x) AS hi FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)"
SQL = {
    "nearest_search": f"WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS c FROM un a JOIN un b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(c, 4) AS cosine, rank FROM r WHERE rank <= 5",
    "nearest_term": f"WITH {_V}, d AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb), m AS (SELECT label, i, avg(x) AS m FROM d GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY 1), b AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM c), s AS (SELECT a.vec_id, b.label, round({_COS}, 6) AS s FROM un a, b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s) SELECT vec_id, CASE WHEN s >= {GATE} THEN label END AS term, round(s, 4) AS cosine FROM r WHERE k = 1",
    "kernel_query": f"WITH {_V}, q AS (SELECT label, arg_min(v, vec_id) AS v, arg_min(n, vec_id) AS n FROM un GROUP BY 1), k AS (SELECT a.label, a.vec_id % 3 <> 0 AS good, exp(({_COS} - 1) / {BANDWIDTH}::DOUBLE) AS k FROM un a JOIN q b USING (label)) SELECT label, round(1 + coalesce(sum(k) FILTER (WHERE good), 0), 4) AS alpha, round(1 + coalesce(sum(k) FILTER (WHERE NOT good), 0), 4) AS beta FROM k GROUP BY 1",
    "label_boxes": f"WITH {_BOX} SELECT label, axis::INTEGER AS axis, round(lo::DOUBLE, 5) AS lo, round(hi::DOUBLE, 5) AS hi FROM bx",
    "box_relations": f"WITH {_BOX}, c AS (SELECT a.label AS i, b.label AS o, round(exp(avg(ln(greatest(greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0)::DOUBLE / greatest(a.hi - a.lo, 1e-9), 1e-9)))), 4) AS s FROM bx a JOIN bx b ON a.axis = b.axis AND a.label <> b.label GROUP BY 1, 2) SELECT x.i AS a, x.o AS b, CASE WHEN x.s >= 0.9 AND y.s >= 0.9 THEN 'merge' WHEN x.s >= 0.9 THEN 'child' WHEN y.s >= 0.9 THEN 'parent' WHEN x.s >= 0.3 OR y.s >= 0.3 THEN 'sibling' ELSE 'unrelated' END AS relation FROM c x JOIN c y ON x.i = y.o AND x.o = y.i WHERE x.i < x.o",
    "merge_classes": f"WITH RECURSIVE {CH_SQL}, m AS (SELECT DISTINCT mechanism FROM ch WHERE mechanism IS NOT NULL), k AS (SELECT mechanism, '0:' || regexp_replace(mechanism, '[^a-z0-9]', '', 'g') AS k FROM m UNION SELECT mechanism, '1:' || array_to_string(list_sort(string_split_regex(mechanism, '[^a-z0-9]+')), ' ') FROM m), e AS (SELECT DISTINCT a.mechanism AS a, b.mechanism AS b FROM k a JOIN k b USING (k)), r AS (SELECT mechanism AS x, mechanism AS y FROM m UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS mechanism, min(y) AS class_id FROM r GROUP BY 1",
    "merged_beliefs": f"WITH {EV_SQL}, g AS (SELECT * REPLACE (CASE WHEN dst IN (SELECT entity_id FROM ref_entities WHERE entity_type = 'target') THEN ((dst - 5001) // 4) * 4 + 5001 ELSE dst END AS dst) FROM ev), f AS (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_type, source_id, bucket ORDER BY seq) AS k FROM g) SELECT src, dst, edge_type, 1 + sum(up)::DOUBLE AS alpha, 1 + sum(down)::DOUBLE AS beta, count(*) AS n_records FROM f WHERE k = 1 GROUP BY ALL",
    "union_into": f"WITH {CH_SQL}, b AS (SELECT src, dst, edge_type, CASE WHEN year(annotated_at) < 2024 THEN 0 ELSE 1 END AS batch, chain_id FROM ce), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_type ORDER BY batch, chain_id) AS k FROM b) SELECT src, dst, edge_type, batch, chain_id FROM r WHERE k = 1",
    "namespaced": f"WITH {CH_SQL}, n AS (SELECT trial_id, src AS node FROM ce UNION SELECT trial_id, dst FROM ce) SELECT node || '#' || trial_id AS scoped_id, count(*) OVER (PARTITION BY node) > 1 AS shared FROM n",
    "set_compare": f"WITH {CH_SQL}, s AS (SELECT src, dst, edge_type, max(CASE outcome WHEN 'success' THEN 1 ELSE 0 END) AS s, max(CASE outcome WHEN 'failure' THEN 1 ELSE 0 END) AS f FROM ce GROUP BY ALL) SELECT CASE WHEN s + f = 2 THEN 'both' WHEN s = 1 THEN 'success' ELSE 'failure' END AS side, edge_type, count(*) AS edges FROM s WHERE s + f > 0 GROUP BY 1, 2",
    "pruned": f"WITH {CH_SQL}, e AS (SELECT DISTINCT src, dst, edge_type FROM ce), m AS (SELECT * FROM e WHERE edge_type = 'modulates_via' AND src IN (SELECT dst FROM e WHERE edge_type = 'affects')), a AS (SELECT * FROM e WHERE edge_type = 'mechanism_affects' AND src IN (SELECT dst FROM m)), d AS (SELECT * FROM e WHERE edge_type = 'biology_drives' AND src IN (SELECT dst FROM a)) SELECT edge_type, count(*) AS edges FROM (SELECT * FROM m UNION ALL SELECT * FROM a UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e WHERE edge_type NOT IN ('modulates_via', 'mechanism_affects', 'biology_drives')) GROUP BY 1",
    "event_windows": "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(value::DECIMAL(18,2)) AS v FROM events GROUP BY ALL) SELECT event_type, strftime(hour, '%Y-%m-%d %H') AS hour, n, v::DOUBLE AS value, sum(n) OVER (PARTITION BY event_type ORDER BY hour RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND CURRENT ROW)::BIGINT AS last_six FROM h",
    "event_sessions": "WITH e AS (SELECT event_id, user_id, ts, floor(epoch(ts))::BIGINT AS s FROM events), n AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM n) SELECT user_id, session, count(*) AS n, max(s) - min(s) AS seconds FROM g GROUP BY 1, 2",
    "order_pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS quantity, sum(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS net, count(*) AS n FROM lineitem GROUP BY 1, 2",
}
