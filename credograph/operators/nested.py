"""Deeply nested records to related flat tables, in one tagged pass.

A depth-first visitor emits one row per element: the table it belongs to, its key, its
parent's key and its payload, without the lists inside it, whose elements are rows of
their own. The rows are written partitioned by table tag, and each table's schema is
applied when it is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credograph.session import shared_path

#: The lists at the top of a record, and the keys that hold lists at any depth inside them.
ROOTS = ("therapeutic_hypothesis.target_population", "results.effect_size")
LISTS = ("subgroups", "features", "by_arm", "timepoints", "arm_incidences")
TAGGED = "record_id long, table_tag string, row_path string, parent_path string, payload string"
#: Schemas of the flat tables; what a schema lacks stays in the payload.
SCHEMAS = {
    "target_population": "description string",
    "effect_size": "estimate double, unit string, ci struct<low: double, high: double>",
    "subgroups": "raw_descriptor string",
    "features": "axis string, key string, level string",
    "by_arm": "arm_id string, outcome string",
    "timepoints": "week double, observed double",
    "arm_incidences": "n_affected long, n_at_risk long",
}


def opened(v: Any) -> Any:
    """A string that holds a JSON object is that object."""
    if isinstance(v, str) and v.lstrip()[:1] == "{":
        try:
            x = json.loads(v)
        except ValueError:
            return v
        return x if isinstance(x, dict) else v
    return v


def own(v: Any, lists: tuple[str, ...] = LISTS) -> Any:
    """What an element says itself: the lists at any depth of its objects are left out."""
    if not isinstance(v, dict):
        return v
    out: dict[str, Any] = {}
    stack = [(v, out)]
    while stack:
        x, to = stack.pop()
        for k, y in x.items():
            y = opened(y)
            if isinstance(y, dict) and k not in lists:
                to[k] = {}
                stack.append((y, to[k]))
            elif k not in lists:
                to[k] = y
    return out


def visit(payload: str, roots: tuple[str, ...] = ROOTS, lists: tuple[str, ...] = LISTS) -> Iterator[tuple[str, str, str, str]]:
    """Table tag, row path, parent path and payload of each element of one record, depth first."""
    try:
        record = opened(json.loads(payload))
    except (ValueError, TypeError, RecursionError):
        return
    stack: list[tuple[str, Any, str, str]] = []  # tag of the list or "", value, path, parent row
    for root in roots:
        v: Any = record
        for key in root.split("."):
            v = opened(v.get(key)) if isinstance(v, dict) else None
        stack.append((root.rsplit(".", 1)[-1], v, root, ""))
    stack.reverse()
    while stack:
        tag, v, path, parent = stack.pop()
        v = opened(v)
        inner: list[tuple[str, Any, str, str]] = []
        if tag:
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                x = opened(x)
                if x is None or isinstance(x, str) and not x.strip():
                    continue
                inner.append(("", x, f"{path}[{i}]", parent))
            for _, x, row, up in inner:
                yield tag, row, up, json.dumps(own(x, lists))
            inner = [("", x, row, row) for _, x, row, _ in inner if isinstance(x, (dict, list))]
        elif isinstance(v, dict):
            inner = [(k if k in lists else "", x, f"{path}.{k.encode('utf-8', 'replace').decode()}", parent) for k, x in v.items()]
        elif isinstance(v, list):
            inner = [("", x, f"{path}[{i}]", parent) for i, x in enumerate(v)]
        stack.extend(reversed(inner))


def flatten(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row per element of the lists: record, table, own path, parent's path, payload.

    A lone object or scalar is element 0; null and blank elements give no row and keep
    their index. Null, empty and broken payloads give no row; repeated records give
    repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, p in zip(b["k"], b["p"]) if isinstance(p, str) for r in visit(p)]
            yield pd.DataFrame(rows, columns=["record_id", "table_tag", "row_path", "parent_path", "payload"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(payload).alias("p")).mapInPandas(run, TAGGED)


def write_tables(df: DataFrame, path: str, **at: str) -> None:
    """Write all flat tables in one pass, a folder per table."""
    flatten(df, **at).write.mode("overwrite").partitionBy("table_tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The flat table of a tag with its schema applied; scalars come in ``value``; a table that nothing was written to is empty."""
    rows = spark.read.schema(TAGGED).parquet(path).where(F.col("table_tag") == tag).drop("table_tag")
    body = F.from_json("payload", SCHEMAS[tag])
    scalar = F.when(~F.col("payload").startswith("{"), F.get_json_object(F.concat(F.lit('{"v":'), "payload", F.lit("}")), "$.v"))
    return rows.withColumn("b", body).withColumn("value", scalar).select("record_id", "row_path", "parent_path", "b.*", "value", "payload")


def tables(df: DataFrame, **at: str) -> dict[str, DataFrame]:
    """All flat tables by tag, written once to the shared folder and read from there."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "tables")
    write_tables(df, path, **at)
    return {tag: read_table(spark, path, tag) for tag in SCHEMAS}
