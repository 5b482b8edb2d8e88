from __future__ import annotations

from pyspark.sql import functions as F

from credograph.operators import graph, simulation
from credograph.streaming import beliefs


def test_planted_rates_come_back(spark):
    rows = simulation.planted(spark, 4000, 12, 3, seed=2).persist()
    got = {r["edge"]: r["r"] for r in simulation.recover(rows, 8).collect()}
    assert sorted(got) == list(range(12))
    assert max(abs(got[e] - (0.5 + 0.5 * ((e * 37) % 12) / 12)) for e in got) < 0.12


def test_samples_depend_on_the_edge_and_seed_alone(spark):
    rows = [(c, "a", "b", t, 5.0 + i, 2.0) for c in (1, 2) for i, t in enumerate(("x", "y"))]
    df = spark.createDataFrame(rows, "chain_id long, src string, dst string, edge_type string, alpha double, beta double")
    one, other = ({r["chain_id"]: tuple(r)[1:] for r in simulation.sampled_chains(x, 200).collect()} for x in (df, df.repartition(7)))
    assert one == other and one[1] == one[2] and one[1][1] <= one[1][0] <= one[1][2]
    assert simulation.sampled_chains(df, 200, seed=1).first()["efficacy"] != one[1][0]


def test_chain_probability_names_the_bottleneck(spark):
    rows = [(1, "affects", 30.0, 2.0), (1, "modulates_via", 10.0, 30.0), (1, "biology_drives", 1.0, 1.0)]
    r = graph.chain_probabilities(spark.createDataFrame(rows, "chain_id long, edge_type string, alpha double, beta double")).first()
    assert (r["bottleneck_edge"], r["n_edges"]) == ("modulates_via", 2) and 0.25 <= r["efficacy"] <= (30 / 32 + 0.25) / 2


def test_subsets(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "f array<string>").select(F.explode(graph.subsets("f")).alias("s"))
    assert sorted(r["s"] for r in df.collect()) == ["a", "a", "a__b", "a__b__c", "a__c", "b", "b__c", "c"]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "view", 1.0), ("2024-01-01 00:50:00", "view", 2.0), ("2024-01-01 01:10:00", "view", 4.0), ("2024-01-01 09:00:00", "view", 8.0)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value", F.lit(1).alias("user_id"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = beliefs.windowed_counts(stream, "1 hour").writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["n"], r["value"]) for r in spark.table("hours").collect()) == [(1, 4.0), (2, 3.0)]
    s = beliefs.sessions(stream, "2 hours").writeStream.outputMode("append").format("memory").queryName("gaps").trigger(availableNow=True).start()
    s.awaitTermination()
    assert [r["n"] for r in spark.table("gaps").collect()] == [3]
