"""Preparation of the model features: what tasks of a fit read, and the order of categories."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from punctual.catalog import model_queries as Q
from punctual.plans.delay_models import features as M


def test_stored_training_vectors_are_as_long_as_in_memory(spark, tables):
    train = Q.prepared(tables).train
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = [paths(f) for f in train.inputFiles()]
    conf = spark._jsc.hadoopConfiguration()
    stored = sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files)
    vector = F.unwrap_udt(F.col("features"))
    numbers = train.agg(F.sum(F.size(vector["values"]))).first()[0]
    # a double per number and an integer per slot: splits by bytes then bound what a task keeps
    assert stored >= 12 * numbers


def test_categories_are_ordered_as_a_string_indexer_orders_them(spark, tables):
    rows = M.select(tables.operated(places=True)).withColumn(
        "op_unique_carrier", F.when(F.col("day_of_month") != 30, F.col("op_unique_carrier"))
    )
    ready = M.fit(rows, 40)
    indexer = StringIndexer(inputCols=list(M.CATEGORICAL), outputCols=[f"{c}_ix" for c in M.CATEGORICAL], handleInvalid="keep")
    expected = [list(labels) for labels in indexer.fit(ready.flat(rows)).labelsArray]
    assert ready.labels() == expected and all(expected)
