"""Copies found by hashes first, and reports counted by grouping sets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from punctual.catalog import operator_queries as O
from punctual.operators import copies as D
from punctual.operators import quality as Q
from punctual.plans import reports as R
from punctual.settings import FIXTURE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark):
    values = [(1, "a", None), (1, "a", None), (1, None, "a"), (None, "a", "a"), (1, None, "a"), (1, None, "a"), (2, "b", "c"), (None, None, None), (None, None, None), (3, "d", "e")]
    return spark.createDataFrame(values, "a int, b string, c string").repartition(3)


@pytest.mark.parametrize("bound", [D.BOUND, 1, 0])
def test_distinct_rows(spark, bound):
    got = sorted(D.distinct_rows(rows(spark), bound).collect(), key=repr)
    assert got == sorted(rows(spark).dropDuplicates().collect(), key=repr) and len(got) == 6
    assert tuple(D.copy_counts(rows(spark), bound).first()) == (4, 6)


def test_rows_that_share_their_hashes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(D, "row_hashes", lambda df: {"_h1": F.lit(1), "_h2": F.coalesce(F.col("a"), F.lit(0)) % 2})
    got = sorted(D.distinct_rows(rows(spark)).collect(), key=repr)
    assert got == sorted(rows(spark).dropDuplicates().collect(), key=repr)
    assert tuple(D.copy_counts(rows(spark)).first()) == (4, 6)


def test_empty_and_all_alike(spark):
    none = rows(spark).where("a > 99")
    assert D.distinct_rows(none).collect() == [] and tuple(D.copy_counts(none).first()) == (0, 0)
    same = spark.range(1000).select(F.lit("x").alias("odd. name"), F.lit(1).alias("n"))
    assert D.distinct_rows(same).count() == 1 and tuple(D.copy_counts(same).first()) == (999, 1)


def test_only_hashes_are_shuffled(spark, tables):
    flights = tables.scheduled(places=True).drop("airline_name")
    assert len(flights.columns) > 25
    narrow = plan(D.repeated_pairs(flights))
    exchange = [line for line in narrow.splitlines() if "Exchange hashpartitioning(_h1" in line]
    assert len(exchange) == 1 and "tail_num" not in exchange[0]
    # rows without a copy go through joins against broadcast pairs, never through an exchange of their own
    alone, _ = D.split_by_pairs(flights, D.BOUND)
    assert "BroadcastHashJoin" in plan(alone) and "hashpartitioning(year" not in plan(alone)


def test_overview_counts_each_key_by_itself(spark, tables):
    flights = tables.complete(places=True)
    counts = R.overview_counts(flights)
    members = {key: flights.select(key).distinct().count() for key in ("airline_name", "origin", "route")}
    late = flights.select(F.when(F.col("is_delayed") == 1, F.col("dep_delay")).alias("m")).distinct().count()
    for key, n in {**members, "late_minutes": late}.items():
        assert counts.where(F.col("_set") == R.set_id(R.OVERVIEW, key)).count() == n, key
    card = R.kpi_overview(flights)
    # one pass over the flights, nothing written while the query is built
    assert plan(card).count("lineitem") <= 1 and plan(card).count("Expand") == 1
    want = flights.agg(
        F.count(F.lit(1)), F.sum("is_delayed"), F.countDistinct("airline_name"), F.countDistinct("origin"), F.countDistinct("route"),
        F.round(F.avg(F.when(F.col("is_delayed") == 1, F.col("dep_delay"))), 2), F.round(F.median(F.when(F.col("is_delayed") == 1, F.col("dep_delay"))), 2),
    ).first()
    got = card.first()
    assert (got[0], got[1], *got[3:]) == tuple(want)


def test_severity_counts_minutes_by_themselves(spark, tables):
    flights = tables.complete(places=True)
    got = {r.distance_group: r for r in R.distance_severity(flights).collect()}
    late = flights.where("is_delayed = 1").withColumn("g", R.X.distance_group())
    for r in late.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("dep_delay"), 2).alias("d"), F.round(F.percentile("arr_delay", 0.9), 2).alias("a")).collect():
        assert (got[r.g].delayed_flights, got[r.g].median_dep_delay, got[r.g].p90_arr_delay) == (r.n, r.d, r.a)


def test_export_totals_from_one_pass(spark, tables):
    flights = tables.complete(places=True)
    checked = Q.export_identities(flights)
    rows = checked.collect()
    n, late = flights.agg(F.count(F.lit(1)), F.sum("is_delayed")).first()
    assert {r.report for r in rows} == {*R.CALENDAR, "distance_group"} and all((r.total_flights, r.total_delayed, r.ok) == (n, late, True) for r in rows)
    assert plan(Q.export_identities(flights)).count("Expand") == 1


def test_no_flights(spark, tables):
    none = tables.complete(places=True).where("year < 0")
    assert R.kpi_overview(none).first().total_operated_flights == 0 and R.distance_severity(none).collect() == []
    assert FIXTURE is tables.s


def test_flights_are_joined_before_they_are_derived_and_once_for_copies(tables, spark):
    joined = plan(tables.scheduled(places=True))
    assert joined.index("% 1441") < joined.index("Join")
    assert "Join" not in plan(O.with_copies(tables))
