"""How often every distinct value or term occurs, and in how many records.

Last-seen counters: tokens come ordered by record, and a term's counter holds its
occurrences, its records and the last record that had it, so that no set of records is
kept per term. Each task counts its own records first; only one partial counter per
term and task is shuffled, so a term held by a third of all rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A task passes its counters on when it holds so many terms; the sums are the same.
FLUSH_TERMS = 500_000
RARE_RECORDS = 2
COMMON_SHARE = 0.05
TERM = r"[a-z0-9]+(?:-[a-z0-9]+)*"


def whole_value(c: Column) -> Column:
    """The value as one token: lower case, trimmed, inner white space one space; none if blank."""
    v = F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.when(v != "", F.array(v))


def terms(c: Column) -> Column:
    """Maximal matches of letters and digits with inner hyphens, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def term_counts(df: DataFrame, fields: dict[str, Column], flush_terms: int = FLUSH_TERMS) -> DataFrame:
    """``field_name, term, occurrences, records`` of every term of the fields' token arrays.

    A record is a row: repeated rows count again. Null and empty arrays and null tokens
    count nothing; an empty table gives no rows; only the fields' own columns are read.
    """

    names = list(fields)

    def count(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        counters: list[dict[str, list[int]]] = [{} for _ in names]
        schema = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])

        def passed() -> Iterator[Any]:
            for name, held in zip(names, counters):
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(list(held)), pa.array([x[0] for x in held.values()]), pa.array([x[1] for x in held.values()])], schema=schema)
                    held.clear()

        record = 0
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(len(names))]
            for row in range(b.num_rows):
                record += 1
                for held, column in zip(counters, columns):
                    for t in column[row] or ():
                        if t is None:
                            continue
                        x = held.get(t)
                        if x is None:
                            held[t] = [1, 1, record]
                        else:
                            x[0] += 1
                            if x[2] != record:
                                x[1] += 1
                                x[2] = record
                if sum(map(len, counters)) > flush_terms:  # between records only: none is counted twice
                    yield from passed()
        yield from passed()

    parts = df.select(*[c.alias(f"f{i}") for i, c in enumerate(fields.values())]).mapInArrow(count, "field_name string, term string, occurrences long, records long")
    return parts.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, n_rows: int | Column, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """``mark``: rare if in at most ``rare`` records, else common if in more than ``common`` of ``n_rows``, else null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * n_rows, "common"))
