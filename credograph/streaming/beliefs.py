"""Beliefs kept up to date from a stream of evidence, and windows over events.

The update is additive, so the running aggregate of a stream is the batch belief.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credograph.functions.belief import exact


def running_beliefs(evidence: DataFrame, watermark: str | None = None) -> DataFrame:
    """``src, dst, edge_type, alpha, beta, n_records`` of a stream with ``n_eff, p_obs``; update or complete mode.

    With a watermark on ``ts`` a record repeated within it (same edge, source and
    sequence) counts once.
    """
    x = evidence
    if watermark:
        x = x.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["src", "dst", "edge_type", "source_id", "seq"])
    x = x.withColumns({"up": exact(F.col("n_eff") * F.col("p_obs")), "down": exact(F.col("n_eff") * (1 - F.col("p_obs")))})
    return x.groupBy("src", "dst", "edge_type").agg((1 + F.sum("up").cast("double")).alias("alpha"), (1 + F.sum("down").cast("double")).alias("beta"), F.count("*").alias("n_records"))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) counts by type, closed when the watermark passes; ``ts`` is a timestamp."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def append_batches(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("source_id", "seq"), parts: int = 256) -> object:
    """Append micro-batches of records to a table; a record told before, in the batch or the table, adds nothing.

    ``keys`` name a record, so later records of a source are kept. The table is partitioned
    by a hash of them (``_part``), and a batch is compared with the partitions it falls into only.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys)).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            new = new.persist()
            touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # at most ``parts``
            done = spark.read.parquet(path).where(F.col("_part").isin(touched)).select(*keys, "_part")
            new.join(done, [*keys, "_part"], "left_anti").write.mode("append").partitionBy("_part").parquet(path)
            new.unpersist()
        else:
            new.write.mode("append").partitionBy("_part").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
