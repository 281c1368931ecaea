"""Monthly files by the names in their headers: layouts, aliases, and what lies where it is expected.

Files of different years name, order and add columns differently. A small job reads the
first line of every file (a task opens one file and stops after its first row); files
with the same header form a layout, and each layout is one scan whose columns are picked
and renamed by name. Layouts are put together by name, so a column that one of them lacks
is null there. Rows carry the file they came from.

The manifest lists files through the Hadoop file system, contents unread: a month may be
there, missing, empty (no bytes) or doubled (in more than one place).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.sources.schema import DATE_ALIASES, FLIGHT_COLUMNS

#: Names that mean a kept column, in rising order of precedence where a file has several.
ALIASES: dict[str, tuple[str, ...]] = {"fl_date": DATE_ALIASES}

MONTH = re.compile(r"(?<!\d)(\d{4})[-:](\d{2})(?!\d)")
#: Several part files below one folder are one place.
PART = re.compile(r"/part-[^/]*$")

HEADERS = "source_file string, header string"
FILES_PER_JOB = 200


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder, hidden ones left out; empty files are listed too."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found, every = [], files.listFiles(root, True)
    while every.hasNext():
        status = every.next()
        path = status.getPath().toString()
        hidden = any(name[:1] in "_." for name in path.removeprefix(root.toString()).split("/") if name)
        if path.endswith(suffix) and not hidden:
            found.append((path, status.getLen()))
    return sorted(found)


def month_of(path: str) -> str | None:
    """``YYYY-MM`` in the last name of a path that holds one."""
    for name in reversed(PART.sub("", path).split("/")):
        if months := MONTH.findall(name):
            return "-".join(months[-1])
    return None


def expected_months(first: str, last: str, skipped_years: Iterable[int] = ()) -> list[str]:
    year, month = int(first[:4]), int(first[5:7])
    months = []
    while (this := f"{year}-{month:02d}") <= last[:7]:
        if year not in set(skipped_years):
            months.append(this)
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
    return months


def manifest(spark: SparkSession, folder: str, months: list[str], suffix: str = ".csv") -> DataFrame:
    """(file_month, n_places, n_bytes, status): each expected month, and each month found beside them.

    ``status`` is ``present``, ``missing``, ``empty``, ``doubled`` or ``unexpected``.
    """
    listing = [(path, PART.sub("", path), month_of(path), size) for path, size in list_files(spark, folder, suffix)]
    files = spark.createDataFrame(listing, "source_file string, place string, file_month string, n_bytes bigint")
    found = files.groupBy("file_month").agg(F.count_distinct("place").alias("n_places"), F.sum("n_bytes").alias("n_bytes"))
    wanted = spark.createDataFrame([(m,) for m in months], "file_month string").withColumn("_wanted", F.lit(True))
    both = wanted.join(found, "file_month", "full").withColumns({"n_places": F.coalesce("n_places", F.lit(0)), "n_bytes": F.coalesce("n_bytes", F.lit(0))})
    status = (
        F.when(F.col("_wanted").isNull(), "unexpected")
        .when(F.col("n_places") == 0, "missing")
        .when(F.col("n_places") > 1, "doubled")
        .when(F.col("n_bytes") == 0, "empty")
        .otherwise("present")
    )
    return both.select("file_month", "n_places", "n_bytes", status.alias("status"))


def require_manifest(spark: SparkSession, folder: str, months: list[str], suffix: str = ".csv") -> list[str]:
    """Paths of exactly the expected months; an error names every month that is not there once and with content."""
    bad = manifest(spark, folder, months, suffix).where("status NOT IN ('present', 'unexpected')").orderBy("file_month").collect()
    if bad:
        raise FileNotFoundError("monthly files: " + ", ".join(f"{r.file_month} {r.status}" for r in bad))
    wanted = set(months)
    return [path for path, size in list_files(spark, folder, suffix) if size and month_of(path) in wanted]


def unsplit(spark: SparkSession) -> SparkSession:
    """A session that reads a whole file as one split, so its first row is the file's first line."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 50))
    # otherwise a file's bytes are shared out over all cores, in splits of 4 MB and more
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def read_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, header) of files that have a first line; a task opens one file and ends after that line."""
    own = unsplit(spark)

    def first_line(path: str) -> DataFrame:
        return own.read.text(path).select(F.lit(path).alias("source_file"), F.col("value").alias("header")).limit(1)

    rows = []
    for at in range(0, len(paths), FILES_PER_JOB):
        rows += reduce(DataFrame.union, [first_line(path) for path in paths[at : at + FILES_PER_JOB]]).collect()
    return spark.createDataFrame(rows, HEADERS)


def split_header(header: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([header.removeprefix("﻿")]), [])]


def chosen_columns(names: list[str], columns: Iterable[str], aliases: Mapping[str, tuple[str, ...]] = ALIASES) -> dict[str, int]:
    """Where each kept column stands in a header, by name in any case or by alias."""
    at: dict[str, int] = {}
    plain = [n.lower().replace(" ", "_").replace("-", "_") for n in names]
    for column in columns:
        if column in plain:
            at[column] = plain.index(column)
        for alias in aliases.get(column, ()):
            if alias in names:
                at[column] = names.index(alias)
    return at


def read_layouts(
    spark: SparkSession,
    paths: list[str],
    columns: Iterable[str] = tuple(FLIGHT_COLUMNS),
    required: Iterable[str] = tuple(FLIGHT_COLUMNS),
    aliases: Mapping[str, tuple[str, ...]] = ALIASES,
) -> DataFrame:
    """Kept columns of all files as text, in their fixed order, and ``source_file``.

    A file that lacks a required column stops the reading with its name; other columns that
    only some files have are null elsewhere, and those that none has are left out.
    """
    columns, required = tuple(columns), tuple(required)
    if not paths:
        raise FileNotFoundError("no monthly files")
    headers = {r["source_file"]: r["header"] for r in read_headers(spark, paths).collect()}
    layouts: dict[str, list[str]] = {}
    for path, header in sorted(headers.items()):
        layouts.setdefault(header, []).append(path)
    lacking = {}
    for header, files in layouts.items():
        at = chosen_columns(split_header(header), columns, aliases)
        if missing := [c for c in required if c not in at]:
            lacking |= {path: missing for path in files}
    if lacking:
        raise ValueError("missing columns: " + "; ".join(f"{path}: {missing}" for path, missing in sorted(lacking.items())))
    parts = []
    for header, files in layouts.items():
        names = split_header(header)
        at = chosen_columns(names, columns, aliases)
        # by position within a layout: its files have the same header, whatever its names are
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
        rows = spark.read.schema(schema).options(header=True, enforceSchema=True).csv(files)
        parts.append(rows.select(*[F.col(f"_{i}").alias(c) for c, i in at.items()], F.col("_metadata.file_path").alias("source_file")))
    if not parts:
        raise ValueError("no monthly file has a header")
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.select(*[c for c in columns if c in together.columns], "source_file")


def read_expected(
    spark: SparkSession, folder: str, months: list[str], columns: Iterable[str] = tuple(FLIGHT_COLUMNS), required: Iterable[str] = tuple(FLIGHT_COLUMNS)
) -> DataFrame:
    """The expected months of a folder, each there once, read by name."""
    return read_layouts(spark, require_manifest(spark, folder, months), columns, required)
