"""Session factory and the shared-folder checkpoint used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("credograph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session that names none (tests) gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="credograph-checkpoint-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written in the shared checkpoint folder: lineage ends, lost executors lose nothing.

    Unlike a checkpoint the table hands on no partitioning or ordering, which the
    planner else unfolds over and over in loops of joins (measured: four times the
    planning with each round), and its size is known, so small sides are broadcast.
    ``release`` deletes a table that is read no more; the others go with the application's
    checkpoint folder.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Delete the tables of ``cut``; nothing that reads them may run any more."""
    for df in cuts:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, key: str, per_core: int = 2) -> DataFrame:
    """More partitions for work that is heavy on the CPU, where a small input comes in fewer than the cores can take.

    Inputs that fill the cores already are left as they are, without a shuffle; a smaller
    one is shuffled once for each time it is read.
    """
    least = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least, key)
