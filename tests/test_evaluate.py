"""Metrics on small score tables with known answers."""

import pytest
from pyspark.sql import functions as F

from delaylens.operators import evaluate as E


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.4), (1, 0.4), (0, 0.1), (0, 0.1)]
    return spark.createDataFrame(rows, "y int, s double")


def test_auc_counts_ties_half(scores):
    # 12 pairs: 9.0 + two half ties.
    wins = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in (0.9, 0.8, 0.4) for n in (0.8, 0.4, 0.1, 0.1))
    assert E.roc_auc(scores, "y", "s").first()[0] == pytest.approx(wins / 12)


def test_auc_agrees_with_spark_without_ties(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(400).select(
        ((F.col("id") * 7919) % 400 / 400.0).alias("s"), ((F.col("id") * 31) % 10 < 4).cast("double").alias("y")
    )
    spark_auc = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert E.roc_auc(df, "y", "s").first()[0] == pytest.approx(spark_auc)


def test_one_class_has_no_auc(scores):
    assert E.roc_auc(scores.filter("y = 1"), "y", "s").first()[0] is None


def test_curve_and_average_precision(scores):
    rows = [tuple(r) for r in E.roc_curve(scores, "y", "s").orderBy(F.desc("threshold")).collect()]
    assert rows == [(0.9, 0.0, 1 / 3), (0.8, 0.25, 2 / 3), (0.4, 0.5, 1.0), (0.1, 1.0, 1.0)]
    assert E.average_precision(scores, "y", "s").first()[0] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)


def test_confusion_with_empty_denominator(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, z int")
    row = E.confusion(df, "y", "z").first()
    assert (row.tn, row.fn, row.precision, row.recall, row.f1) == (1, 1, 0.0, 0.0, 0.0)


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, z int")
    rows = {r["class"]: r for r in E.classification_report(df, "y", "z").collect()}
    assert rows["1"].precision == pytest.approx(2 / 3) and rows["0"].recall == 0.5
    assert rows["accuracy"].f1 == 0.75 and rows["macro avg"].recall == 0.75 and rows["weighted avg"].support == 4


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (4.0, 2.0)], "y double, p double")
    row = E.regression(df, "y", "p").first()
    assert row.mae == pytest.approx(1.0) and row.rmse == pytest.approx((5 / 3) ** 0.5)
    assert row.r2 == pytest.approx(1 - 5 / (26 / 3))
    assert E.mape(df, "y", "p").first().mape == pytest.approx(0.5)
    off = E.mape(spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double"), "y", "p").first()
    assert off.mape > 1e15 and off.mape_nonzero == 0.5


def test_pinball(spark):
    df = spark.createDataFrame([(10.0, 8.0), (10.0, 10.0), (10.0, 12.0)], "y double, p double")
    row = E.pinball(df, "y", "p").first()
    assert row.pinball_loss == pytest.approx((1.8 + 0.0 + 0.2) / 3) and row.coverage == pytest.approx(2 / 3)


def test_threshold_sweep_equals_direct_f1(scores):
    values = E.sweep_values()
    assert len(values) == 36 and values[0] == 0.1 and values[-1] == 0.8
    got = {r.threshold: r.f1 for r in E.threshold_scores(scores, "y", "s").collect()}
    for t in (values[0], values[15], values[-1]):
        direct = E.confusion(scores.withColumn("z", (F.col("s") >= t).cast("int")), "y", "z").first().f1
        assert got[t] == pytest.approx(direct)
    # 0.4 <= t < 0.8 share one F1; the first of the best wins.
    assert E.best_threshold(scores, "y", "s").first().threshold == min(t for t, f in got.items() if f == max(got.values()))


def test_zero_baseline(spark):
    df = spark.createDataFrame([("a", 3.0, 1), ("a", 0.0, 0), ("b", 4.0, 1)], "s string, y double, l int")
    rows = {r.s: r for r in E.zero_baseline(df, "y", "s", ["l"]).collect()}
    assert rows["a"].baseline_mae == 1.5 and rows["a"].l_rate == 0.5 and rows["b"].baseline_rmse == 4.0
