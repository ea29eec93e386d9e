"""Metrics and class balance, including a class holding most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from deskpass.operators import metrics as M


def test_per_class_and_support(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    rep = {r["class"]: r for r in M.per_class(df).collect()}
    assert sum(r.support for r in rep.values()) == len(rows)
    assert rep[0].precision == pytest.approx(5 / 6) and rep[0].recall == pytest.approx(5 / 7)
    assert rep[2].precision == 0.0 and rep[2].f1 == 0.0
    assert M.accuracy(df).first()[0] == pytest.approx(8 / 11)


@pytest.mark.parametrize("shift", [44, 58])
def test_undersample_exact_with_hot_class(spark, shift, monkeypatch):
    # class 0 holds most rows; shift 58 leaves 4 buckets so the edge bucket is large
    monkeypatch.setattr(M, "_BUCKET_SHIFT", shift)
    rows = [(i, 0 if i % 10 else 1) for i in range(3000)] + [(5000 + i, 2) for i in range(37)]
    df = spark.createDataFrame(rows, "id long, label int")
    got = sorted((r.id, r.label) for r in M.undersample(df, "label", "id").collect())
    w = Window.partitionBy("label").orderBy(M.id_hash("id"), "id")
    want = sorted((r.id, r.label) for r in df.withColumn("rk", F.row_number().over(w)).filter("rk <= 37").collect())
    assert got == want


def test_oversample_counts(spark):
    rows = [(i, 0) for i in range(100)] + [(1000 + i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label int")
    counts = {r.label: r["count"] for r in M.oversample(df, "label", "id").groupBy("label").count().collect()}
    assert counts == {0: 100, 1: 100}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    w = {r.label: r.weight for r in M.class_weights(df).distinct().collect()}
    assert w == {0: pytest.approx(4 / 6), 1: pytest.approx(4 / 2)}
