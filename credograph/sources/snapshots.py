"""Snapshot sinks: a public one without private fields, a private one under a private root."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and endings of private fields; no name is excepted.
PRIVATE_NAMES = {"embedding", "embeddings", "region_anchors", "anchors", "box", "box_min", "box_max", "box_params", "ellipsoid_mean", "ellipsoid_cov", "manifold", "manifold_params"}
PRIVATE_ENDINGS = ("_embedding", "_embeddings", "_field", "_box", "_boxes", "_anchors", "_weights")
PUBLIC_NAMES: frozenset[str] = frozenset()


def is_private(name: str, public: frozenset[str] = PUBLIC_NAMES) -> bool:
    return name not in public and (name in PRIVATE_NAMES or name.endswith(PRIVATE_ENDINGS))


def private_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of all private fields of a schema, nested ones too."""
    if isinstance(schema, T.ArrayType):
        return private_paths(schema.elementType, f"{at}[]")
    if isinstance(schema, T.MapType):
        return private_paths(schema.valueType, f"{at}{{}}")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += [path] if is_private(f.name) else private_paths(f.dataType, path)
    return out


def _stripped(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        kept = [_stripped(c[f.name], f.dataType).alias(f.name) for f in kind.fields if not is_private(f.name)]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType) and private_paths(kind):
        return F.transform(c, lambda x: _stripped(x, kind.elementType))
    if isinstance(kind, T.MapType) and private_paths(kind):
        return F.transform_values(c, lambda _, v: _stripped(v, kind.valueType))
    return c


def strip_private(df: DataFrame) -> DataFrame:
    """The frame without private fields at any depth; the schema is walked, not the rows."""
    return df.select(*[_stripped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if not is_private(f.name)])


def _held(c: Column, kind: T.DataType, path: str, private: bool) -> Column:
    """Paths of the private fields of a value that hold something: not null, blank or empty."""
    none = F.array().cast("array<string>")
    if private:
        filled = c.isNotNull()
        if isinstance(kind, (T.ArrayType, T.MapType)):
            filled = filled & (F.size(c) > 0)
        elif isinstance(kind, T.StringType):
            filled = filled & (c != "")
        return F.when(filled, F.array(F.lit(path))).otherwise(none)
    if not private_paths(kind):
        return none
    if isinstance(kind, T.StructType):
        parts = [_held(c[f.name], f.dataType, f"{path}.{f.name}", is_private(f.name)) for f in kind.fields]
        return F.when(c.isNotNull(), F.concat(*parts)).otherwise(none)
    values = F.map_values(c) if isinstance(kind, T.MapType) else c
    inner = kind.valueType if isinstance(kind, T.MapType) else kind.elementType
    mark = "{}" if isinstance(kind, T.MapType) else "[]"
    return F.coalesce(F.flatten(F.transform(values, lambda x: _held(x, inner, path + mark, False))), none)


def held_private(df: DataFrame) -> DataFrame:
    """``path, rows``: the private fields, at any depth, that hold a value in some row; a declared but empty one is no leak."""
    parts = [_held(F.col(f"`{f.name}`"), f.dataType, f.name, is_private(f.name)) for f in df.schema.fields]
    return df.select(F.explode(F.array_distinct(F.concat(*parts))).alias("path")).groupBy("path").agg(F.count("*").alias("rows"))


def assert_public(df: DataFrame) -> None:
    """Raise if a private field holds a value anywhere."""
    if left := sorted(r["path"] for r in held_private(df).limit(20).collect()):
        raise ValueError(f"private values: {', '.join(left)}")


def write_public(df: DataFrame, path: str) -> None:
    out = strip_private(df)
    if left := private_paths(out.schema):
        raise ValueError(f"private fields left: {left}")
    out.write.mode("overwrite").parquet(path)


def write_private(df: DataFrame, root: str, name: str, vector: str | None = None, public_tree: str | None = None) -> None:
    """Under the private root only; vectors are stored once each at six decimals, by their id."""
    target = PurePosixPath(root, name)
    if ".." in target.parts or PurePosixPath(name).is_absolute():
        raise ValueError("outside of the private root")
    if public_tree and PurePosixPath(os.path.realpath(root)).is_relative_to(os.path.realpath(public_tree)):
        raise ValueError("the private root lies inside the public tree")
    if vector:
        v = F.transform(vector, lambda x: F.round(x.cast("double"), 6))
        df = df.withColumn(vector, v).withColumn("vec_key", F.xxhash64(vector))
        df.select("vec_key", vector).dropDuplicates(["vec_key"]).write.mode("overwrite").parquet(f"{target}/vectors")
        df = df.drop(vector)
    df.write.mode("overwrite").parquet(f"{target}/rows")


def read_private(spark: SparkSession, root: str, name: str, vector: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}/rows")
    return rows.join(spark.read.parquet(f"{root}/{name}/vectors"), "vec_key", "left").drop("vec_key") if vector else rows


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot: wrapped or bare, edges under ``edges`` or ``links``."""
    edge = "array<struct<source: string, target: string, key: string, alpha: double, beta: double>>"
    body = f"nodes array<struct<id: string, node_type: string, name: string>>, edges {edge}, links {edge}"
    x = spark.read.schema(f"{body}, graph struct<{body.replace(' array', ': array')}>").option("multiLine", True).json(path)
    nodes = x.select(F.inline(F.coalesce("nodes", "graph.nodes")))
    return nodes, x.select(F.inline(F.coalesce("edges", "links", "graph.edges", "graph.links")))
