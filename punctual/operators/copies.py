"""Exact copies of rows without shuffling whole rows.

First only two hashes per row (and a count) cross the shuffle. Where no pair of hashes
occurs twice, there are no copies. Rows whose pair does occur again are compared as a
whole, so rows that merely share their hashes stay apart. The pairs that occur again are
written once and counted: up to ``BOUND`` of them are broadcast (24 bytes each), beyond
that whole rows are grouped, copies collapsing in each task before they travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.session import cut_lineage

BOUND = 1_000_000
PAIR = ("_h1", "_h2")


def row_hashes(df: DataFrame) -> dict[str, Column]:
    """Two independent hashes of all columns; nulls count by their place."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    null = [c.isNull() for c in columns]
    return {"_h1": F.xxhash64(*columns, *null), "_h2": F.xxhash64(F.lit(7), *null, *reversed(columns))}


def repeated_pairs(df: DataFrame) -> DataFrame:
    """(_h1, _h2, _n) of the hash pairs that occur more than once."""
    pairs = df.select(*[c.alias(name) for name, c in row_hashes(df).items()])
    return pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def split_by_pairs(df: DataFrame, bound: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows that surely have no copy, and the others; None where too many pairs occur again to broadcast them."""
    pairs = cut_lineage(repeated_pairs(df))
    n = pairs.count()
    if n > bound:
        return None
    marked, known = df.withColumns(row_hashes(df)), F.broadcast(pairs.select(*PAIR))
    return marked.join(known, list(PAIR), "left_anti").drop(*PAIR), marked.join(known, list(PAIR), "left_semi").drop(*PAIR)


def distinct_rows(df: DataFrame, bound: int = BOUND) -> DataFrame:
    """The rows without their copies."""
    parts = split_by_pairs(df, bound)
    if parts is None:
        return df.dropDuplicates()
    alone, others = parts
    return alone.unionByName(others.dropDuplicates())


def copy_counts(df: DataFrame, bound: int = BOUND) -> DataFrame:
    """(duplicate_rows, distinct_rows): rows that repeat an earlier one, and the rest; one row."""
    parts = split_by_pairs(df, bound)
    wide = df if parts is None else parts[1]
    copies = wide.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))
    total = df.select(F.count(F.lit(1))).scalar()
    return repeated.select("duplicate_rows", (total - F.col("duplicate_rows")).alias("distinct_rows"))
