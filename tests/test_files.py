"""Monthly files, table writers, report exports and arriving files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as SF

from punctual.operators import cleaning as C
from punctual.operators import quality as Q
from punctual.operators import sinks as K
from punctual.plans import reports as R
from punctual.settings import FIXTURE, PUBLISHED
from punctual.sources import monthly_files as F
from punctual.sources.schema import FLIGHT_COLUMNS
from punctual.streaming import monthly_arrivals

COLUMNS = [c for c in FLIGHT_COLUMNS if c != "dep_time"]


def test_expected_files():
    paths = F.expected_paths("raw", PUBLISHED)
    assert len(paths) == 63
    assert paths[0] == "raw/2019/2019-01.csv" and paths[-1] == "raw/2026/2026-03.csv"


def test_missing_month_fails(tables):
    flights = tables.scheduled(end="2001-10-31")
    missing = {(r.year, r.month) for r in F.missing_months(flights, FIXTURE).collect()}
    assert missing == {(2001, 11), (2001, 12)}
    with pytest.raises(FileNotFoundError):
        F.require_months(flights, FIXTURE)


def test_round_trip_and_conservation(spark, tables, tmp_path):
    flights = tables.scheduled(places=True).drop("airline_name")
    F.write_months(flights, str(tmp_path / "months"))
    back = F.read_months(spark, str(tmp_path / "months"), COLUMNS)
    assert Q.row_conservation(back, flights, "source_file").first().ok
    cleaned = C.clean(back.drop("source_file"))
    direct = tables.operated(places=True)
    assert cleaned.count() == direct.count()
    same = ["fl_date", "route", "is_delayed", "main_delay_cause", "dep_hour", "distance", "arr_delay"]
    assert cleaned.select(same).exceptAll(direct.select(same)).isEmpty()


def test_written_flights_are_pruned_by_year(spark, tables, tmp_path):
    table = K.write_flights(tables.operated(), str(tmp_path / "flights"))
    assert table.count() == tables.operated().count()
    plan = table.where("year < 1997").select("is_delayed")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "is_delayed" in plan and "route" not in plan


def test_exports_equal_the_direct_reports(spark, tables, tmp_path):
    flights, scheduled = tables.complete(places=True), tables.scheduled()
    manifest = K.export_reports(flights, scheduled, FIXTURE, str(tmp_path / "exports"))
    rows = {r.report: r for r in manifest.collect()}
    assert len(rows) == 21
    for name, report in (
        ("10_10_delay_rate_by_month", R.calendar_rate(flights, "month")),
        ("17_17_delay_severity_by_distance_group_among_delayed_operated_flights", R.distance_severity(flights)),
        ("16_16_most_common_delay_causes_among_delayed_operated_flights", R.cause_share(flights)),
        ("22_24_overview_kpi_card_for_operated_non_diverted_flights", R.kpi_overview(flights)),
    ):
        stored = spark.read.csv(rows[name].path, header=True, schema=report.schema)
        assert rows[name].n_rows == report.count()
        assert stored.exceptAll(report).isEmpty(), name


def test_exports_join_the_flights_once(spark, tables, tmp_path):
    plans = []

    def report(rows, s):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows.groupBy("tail_num").count()

    flights = tables.complete(places=True)
    assert "Join" in flights._jdf.queryExecution().optimizedPlan().toString()
    own = {f"own_{source}": (source, lambda d, s: report(d, s) if "tail_num" in d.columns else d.limit(1)) for source in ("flights", "scheduled")}
    manifest = K.export_reports(flights, tables.scheduled(), FIXTURE, str(tmp_path / "own"), own)
    assert "Join" not in plans[0] and manifest.count() == 2
    late = [(n, e) for n, e in K.EXPORTS.items() if e[0] == "departures"]
    known = {n: (e[0], lambda d, s, f=e[1]: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or f(d, s)) for n, e in late}
    K.export_reports(flights, tables.scheduled(), FIXTURE, str(tmp_path / "late"), known)
    assert "Join" not in plans[-1]


def test_arriving_files(spark, tables, tmp_path):
    flights = tables.scheduled(places=True).drop("airline_name")
    months, table, progress = (str(tmp_path / n) for n in ("months", "table", "progress"))
    early, late = flights.where("year < 2000"), flights.where("year >= 2000")
    F.write_months(early, f"{months}/early")
    for part in (None, late):
        if part is not None:
            F.write_months(part, f"{months}/late")
        arrivals = monthly_arrivals.arriving(spark, months, files_per_batch=1000)
        monthly_arrivals.clean_arrivals(arrivals, table, progress).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == tables.operated().count()
    assert stored.select("batch").distinct().count() == 2
    assert monthly_arrivals.current_daily_rate(spark, table).count() > 0


def test_copies_in_other_batches(spark, tables, tmp_path):
    """A month that arrives twice, in several part files, one file per batch."""
    flights = tables.scheduled(places=True).drop("airline_name").where("year = 1996 AND month = 3").repartition(3)
    months, table, progress = (str(tmp_path / n) for n in ("months", "table", "progress"))
    F.write_months(flights, f"{months}/a")
    F.write_months(flights, f"{months}/b")
    arrivals = monthly_arrivals.arriving(spark, months, files_per_batch=1)
    monthly_arrivals.clean_arrivals(arrivals, table, progress).awaitTermination()
    stored = spark.read.parquet(table)
    assert stored.count() == tables.operated().where("year = 1996 AND month = 3").count()


def test_a_failing_write_leaves_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out")
    K.replace_csv(spark.range(5), path)
    bad = spark.range(9).select(SF.when(SF.col("id") < 8, SF.col("id")).otherwise(SF.raise_error(SF.lit("stop"))).alias("id"))
    with pytest.raises(Exception, match="stop"):
        K.replace_csv(bad, path)
    assert spark.read.csv(path, header=True).count() == 5
    K.replace_csv(spark.range(7), path)
    assert spark.read.csv(path, header=True).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_results_do_not_depend_on_partitions(spark, tables):
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(R.calendar_rate(tables.complete(), "dep_hour").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
