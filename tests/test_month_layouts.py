"""Monthly files read by name: extra, reordered and aliased columns, the manifest, and the way to the reports."""

from __future__ import annotations

import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as SF

from punctual.operators import cleaning as C
from punctual.plans import reports as R
from punctual.settings import FIXTURE, PUBLISHED
from punctual.sources import month_layouts as M
from punctual.sources import monthly_files as F
from punctual.sources.schema import FLIGHT_COLUMNS, REQUIRED_COLUMNS

COLUMNS = [c for c in FLIGHT_COLUMNS if c != "dep_time"]


def write(folder, name, header, *rows):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return f"file:{path}"


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_expected_months():
    months = M.expected_months(PUBLISHED.expected_first_month, PUBLISHED.expected_last_month, PUBLISHED.skipped_years)
    assert len(months) == 63 and months[0] == "2019-01" and months[-1] == "2026-03" and "2020-05" not in months
    assert [p.rsplit("/", 1)[1] for p in F.expected_paths("raw", PUBLISHED)] == [f"{m}.csv" for m in months]


@pytest.mark.parametrize(("path", "month"), [
    ("raw/2019/2019-01.csv", "2019-01"), ("raw/2019/2019:01.csv", "2019-01"), ("raw/file_month=2001-12/part-0000-2020-05-aa.csv", "2001-12"),
    ("raw/notes.csv", None), ("raw/2019-01/2022-07.csv", "2022-07"), ("raw/2019-013.csv", None),
])
def test_month_of_a_path(path, month):
    assert M.month_of(path) == month


def test_columns_are_found_by_name_and_alias():
    names = M.split_header('﻿"DEST", Origin ,FlightDate,"x,y",FL-DATE')
    assert names == ["DEST", "Origin", "FlightDate", "x,y", "FL-DATE"]
    assert M.chosen_columns(names, ("origin", "dest", "tail_num", "fl_date")) == {"origin": 1, "dest": 0, "fl_date": 2}
    assert M.chosen_columns(["FlightDate", "fl_date", "FL_DATE"], ("fl_date",)) == {"fl_date": 1}


def test_layouts_are_joined_by_name(spark, tmp_path):
    columns = ("origin", "dest", "fl_date", "tail_num")
    paths = [
        write(tmp_path, "2001-01.csv", "ORIGIN,DEST,FL_DATE,TAIL_NUM", "A,B,2001-01-05,N1", "A,C,2001-01-06,"),
        write(tmp_path, "2001-02.csv", "FlightDate,Extra,DEST,ORIGIN", '2001-02-01,"1,5",X,Y'),
        write(tmp_path, "2001-03.csv", "ORIGIN,DEST,FL_DATE,TAIL_NUM", "Q,R,2001-03-09,N9"),
    ]
    out = M.read_layouts(spark, paths, columns, required=("origin", "dest", "fl_date"))
    assert out.columns == [*columns, "source_file"]
    assert collected(out, *columns) == sorted([("A", "B", "2001-01-05", "N1"), ("A", "C", "2001-01-06", None), ("Y", "X", "2001-02-01", None), ("Q", "R", "2001-03-09", "N9")], key=repr)
    assert {r[0].rsplit("/", 1)[1]: r[1] for r in collected(out.groupBy("source_file").count(), "source_file", "count")} == {"2001-01.csv": 2, "2001-02.csv": 1, "2001-03.csv": 1}
    # two layouts, two scans
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2


def test_a_file_without_a_required_column_is_named(spark, tmp_path):
    good = write(tmp_path, "2001-01.csv", "ORIGIN,DEST", "A,B")
    bad = write(tmp_path, "2001-02.csv", "ORIGIN,TO", "A,B")
    with pytest.raises(ValueError, match=r"2001-02\.csv: \['dest'\]") as error:
        M.read_layouts(spark, [good, bad], ("origin", "dest"), ("origin", "dest"))
    assert "2001-01" not in str(error.value)
    assert M.read_layouts(spark, [good, bad], ("origin", "dest"), ("origin",)).count() == 2


def test_header_only_and_empty_files(spark, tmp_path):
    one = write(tmp_path, "2001-01.csv", "ORIGIN,DEST", "A,B")
    none = write(tmp_path, "2001-02.csv", "DEST,ORIGIN")
    (tmp_path / "2001-03.csv").write_text("")
    out = M.read_layouts(spark, [one, none, f"file:{tmp_path}/2001-03.csv"], ("origin", "dest"), ("origin", "dest"))
    assert collected(out, "origin", "dest") == [("A", "B")]
    with pytest.raises(ValueError, match="no monthly file has a header"):
        M.read_layouts(spark, [f"file:{tmp_path}/2001-03.csv"])
    with pytest.raises(FileNotFoundError):
        M.read_layouts(spark, [])


def test_headers_read_only_the_first_lines(spark, tmp_path):
    long = write(tmp_path, "2001-01.csv", "ORIGIN,DEST", *["A,B"] * 400_000)
    short = write(tmp_path, "2001-02.csv", "DEST", "B")
    rows = {r.source_file.rsplit("/", 1)[1]: r.header for r in M.read_headers(spark, [long, short]).collect()}
    assert rows == {"2001-01.csv": "ORIGIN,DEST", "2001-02.csv": "DEST"}
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    read = [stages.apply(i) for i in range(stages.size())]
    newest = max((x for x in read if x.inputRecords()), key=lambda x: x.stageId())
    assert newest.inputRecords() < 1000


def test_manifest(spark, tmp_path):
    write(tmp_path, "2001/2001-01.csv", "A", "1")
    write(tmp_path, "2001/2001-03.csv", "A", "1")
    write(tmp_path, "copy/2001-03.csv", "A", "1")
    write(tmp_path, "2001/file_month=2001-04/part-00000.csv", "A", "1")
    write(tmp_path, "2001/file_month=2001-04/part-00001.csv", "A", "1")
    write(tmp_path, "2001/2002-07.csv", "A", "1")
    write(tmp_path, "_temporary/2001-02.csv", "A", "1")
    (tmp_path / "2001/2001-05.csv").write_text("")
    months = M.expected_months("2001-01", "2001-05")
    rows = {r.file_month: (r.n_places, r.status) for r in M.manifest(spark, str(tmp_path), months).collect()}
    assert rows == {"2001-01": (1, "present"), "2001-02": (0, "missing"), "2001-03": (2, "doubled"), "2001-04": (1, "present"), "2001-05": (1, "empty"), "2002-07": (1, "unexpected")}
    with pytest.raises(FileNotFoundError, match="2001-02 missing, 2001-03 doubled, 2001-05 empty"):
        M.require_manifest(spark, str(tmp_path), months)
    paths = M.require_manifest(spark, str(tmp_path), ["2001-01", "2001-04"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["2001-01.csv", "part-00000.csv", "part-00001.csv"]
    assert M.list_files(spark, str(tmp_path / "nowhere")) == []


def three_layouts(flights, folder):
    """Real month files: one year as written, one reordered with an extra column, one with another name of the date."""
    F.write_months(flights.where("year < 1998"), f"{folder}/a")
    reordered = flights.where("year BETWEEN 1998 AND 1999")
    columns = [*sorted(reordered.columns, reverse=True)]
    month = SF.format_string("%04d-%02d", "year", "month")
    reordered.select(*[SF.col(c).alias(c.upper()) for c in columns], SF.lit("x").alias("EXTRA"), month.alias("file_month")).write.partitionBy("file_month").option("header", True).csv(f"{folder}/b")
    renamed = flights.where("year > 1999").withColumnRenamed("fl_date", "FlightDate")
    renamed.withColumn("file_month", month).write.partitionBy("file_month").option("header", True).csv(f"{folder}/c")


def test_from_month_files_to_the_reports(spark, tables, tmp_path):
    flights = tables.scheduled(places=True).drop("airline_name")
    three_layouts(flights, str(tmp_path / "months"))
    months = M.expected_months(FIXTURE.expected_first_month, FIXTURE.expected_last_month)
    there = {M.month_of(p) for p, _ in M.list_files(spark, str(tmp_path / "months"))}
    raw = M.read_expected(spark, str(tmp_path / "months"), [m for m in months if m in there], COLUMNS, REQUIRED_COLUMNS)
    assert raw.count() == flights.count()
    scheduled = C.clean_scheduled(raw.drop("source_file"))
    operated = C.only_operated(scheduled)
    small = replace(FIXTURE, airline_min_flights=50)
    complete = f"year < {FIXTURE.partial_year}"
    for name, got, want in (
        ("q01", R.airline_rate(operated.where(complete), small), R.airline_rate(tables.complete(places=True), small)),
        ("q05", R.airline_disruptions(scheduled), R.airline_disruptions(tables.scheduled())),
        ("q23", R.volume_by_year(scheduled.where(complete)), R.volume_by_year(tables.scheduled_complete())),
        ("q25", R.disruption_kpis(scheduled), R.disruption_kpis(tables.scheduled())),
    ):
        assert want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), name
    shutil.rmtree(tmp_path / "months" / "b")
    with pytest.raises(FileNotFoundError, match="1998-01 missing"):
        M.read_expected(spark, str(tmp_path / "months"), [m for m in months if m in there], COLUMNS, REQUIRED_COLUMNS)


def test_a_large_file_is_one_split(spark, tmp_path):
    """Rows of several splits come in any order on a cluster, and a row of data would be taken for the header."""
    path = write(tmp_path, "2019/2019-01.csv", "YEAR,NOTE", *[f"2019,{'x' * 1000}"] * 12_000)
    assert M.unsplit(spark).read.text(path).rdd.getNumPartitions() == 1
    assert collected(M.read_headers(spark, [path]), "source_file", "header") == [(path, "YEAR,NOTE")]
