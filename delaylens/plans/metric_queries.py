"""Splits, weights and metrics, checked on scores that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.functions import features as X
from delaylens.operators import evaluate as E
from delaylens.operators import sampling as H
from delaylens.plans.check_views import FLIGHTS, with_views
from delaylens.plans.registry import query
from delaylens.sources.tables import Tables, flights

# A score in [0, 1) with many ties, a hard prediction and a numeric forecast per flight.
SCORED = """
, scored AS (SELECT arr_delay AS y, CAST(arr_delay > 15 AS INTEGER) AS label,
    ((crs_dep_time // 100) * 7 + month * 5 + day_of_week * 3 + distance / 100) % 97 / 97 AS score,
    distance / 100 - 20 + crs_dep_time // 100 - 30 AS yhat
  FROM flights WHERE cancelled <> 1 AND diverted <> 1)"""


def sql(body: str) -> str:
    return with_views(FLIGHTS, SCORED + body)


def scored(t: Tables) -> DataFrame:
    f = X.filter_operated(
        flights(t, "arr_delay", "crs_dep_time", "month", "day_of_week", "distance", "cancelled", "diverted")
    )
    f = X.add_delay_label(X.add_dep_hour(f))
    points = F.col("dep_hour") * 7 + F.col("month") * 5 + F.col("day_of_week") * 3 + F.col("distance") / 100
    return f.select(
        F.col("arr_delay").alias("y"),
        F.col("is_delayed_15").alias("label"),
        (points % 97 / 97).alias("score"),
        (F.col("distance") / 100 - 20 + F.col("dep_hour") - 30).alias("yhat"),
    ).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@query(sql("""
, h AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) - pos AS above FROM h)
SELECT round(sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r"""))
def roc_auc(t: Tables) -> DataFrame:
    return E.roc_auc(scored(t), "label", "score")


STEPS = """
, h AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h)"""


@query(sql(STEPS + "SELECT round(score, 6) AS threshold, round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr FROM r"))
def roc_curve(t: Tables) -> DataFrame:
    return E.roc_curve(scored(t), "label", "score")


@query(sql(STEPS + "SELECT round(sum((pos / p) * (cp / (cp + cn))), 6) AS average_precision FROM r"))
def average_precision(t: Tables) -> DataFrame:
    return E.average_precision(scored(t), "label", "score")


CELLS = """
, c AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
    count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
    count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
    count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM scored)"""


@query(sql(CELLS + """
SELECT tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""))
def confusion_matrix(t: Tables) -> DataFrame:
    return E.confusion(scored(t), "label", "pred")


@query(sql(CELLS + """
, k AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f,
    tn + fp AS s FROM c
  UNION ALL
  SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM k
UNION ALL
SELECT 'accuracy', round((tn + tp) / (tn + fp + fn + tp), 6), round((tn + tp) / (tn + fp + fn + tp), 6),
  round((tn + tp) / (tn + fp + fn + tp), 6), tn + fp + fn + tp FROM c
UNION ALL
SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM k
UNION ALL
SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6),
  round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM k"""))
def classification_report(t: Tables) -> DataFrame:
    return E.classification_report(scored(t), "label", "pred")


@query(sql("""
SELECT round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse,
  round(1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS rows FROM scored"""))
def regression_metrics(t: Tables) -> DataFrame:
    return E.regression(scored(t), "y", "yhat")


@query(sql("""
SELECT round(avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) / 1e12, 6) AS mape_trillions,
  round(avg(abs(y - yhat) / abs(y)) FILTER (WHERE y <> 0), 6) AS mape_nonzero FROM scored"""))
def mape(t: Tables) -> DataFrame:
    # A zero target makes the figure about 1e14, so it is reported in trillions.
    return E.mape(scored(t), "y", "yhat").select((F.col("mape") / 1e12).alias("mape_trillions"), "mape_nonzero")


@query(sql("""
SELECT round(avg(greatest(0.9 * (y - (yhat + 60)), -0.1 * (y - (yhat + 60)))), 6) AS pinball_loss,
  round(avg(CASE WHEN y <= yhat + 60 THEN 1 ELSE 0 END), 6) AS coverage FROM scored"""))
def pinball_coverage(t: Tables) -> DataFrame:
    high = scored(t).withColumn("high", F.col("yhat") + 60)
    return E.pinball(high, "y", "high")


@query(sql("""
, th AS (SELECT CASE WHEN i = 35 THEN 0.8 ELSE 0.1::DOUBLE + i * ((0.8::DOUBLE - 0.1::DOUBLE) / 35) END AS threshold
  FROM range(36) x(i)),
h AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1)
SELECT round(threshold, 6) AS threshold,
  round(2 * sum(pos) FILTER (WHERE score >= threshold) / (
    sum(pos) FILTER (WHERE score >= threshold) + sum(neg) FILTER (WHERE score >= threshold) + sum(pos)), 6) AS f1
FROM th, h GROUP BY threshold"""))
def threshold_sweep(t: Tables) -> DataFrame:
    return E.threshold_scores(scored(t), "label", "score")


@query(sql("""
, th AS (SELECT CASE WHEN i = 35 THEN 0.8 ELSE 0.1::DOUBLE + i * ((0.8::DOUBLE - 0.1::DOUBLE) / 35) END AS threshold
  FROM range(36) x(i)),
h AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1),
f AS (SELECT threshold, 2 * sum(pos) FILTER (WHERE score >= threshold) / (
    sum(pos) FILTER (WHERE score >= threshold) + sum(neg) FILTER (WHERE score >= threshold) + sum(pos)) AS f1
  FROM th, h GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1"""))
def best_threshold(t: Tables) -> DataFrame:
    return E.best_threshold(scored(t), "label", "score")


@query(sql("""
SELECT round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS scale_pos_weight,
  round(greatest(1, (1 - avg(label)) / greatest(avg(label), 1e-6)), 6) AS balanced_weight,
  count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored"""))
def class_weights(t: Tables) -> DataFrame:
    from delaylens.ml.classify import class_weights as weights

    return weights(scored(t), "label")


@query(sql("""
SELECT CAST(label AS BIGINT) AS label, count(*) AS flights, round(sum(CASE WHEN score >= 0.5 THEN greatest(yhat, 0) ELSE 0 END), 6) AS hurdle,
  round(sum(score * greatest(yhat, 0)), 6) AS expected FROM scored GROUP BY label"""))
def hurdle_blend(t: Tables) -> DataFrame:
    from delaylens.ml.ripple_models import blend

    both = blend(scored(t).withColumn("amount", F.greatest("yhat", F.lit(0.0))), "score", "amount", 0.5)
    return both.groupBy("label").agg(
        F.count("*").alias("flights"), F.sum("hurdle").alias("hurdle"), F.sum("expected").alias("expected")
    )


SPLIT_KEYS = ("y", "label", "score", "yhat")


@query()
def sample_n(t: Tables) -> DataFrame:
    return H.sample_n(scored(t), 5_000, list(SPLIT_KEYS)).select("label", "score", "y")


@query(sql("""
SELECT CAST(label AS BIGINT) AS label, count(*) AS flights,
  count(*) - CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS train_rows,
  CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS test_rows FROM scored GROUP BY label"""))
def stratified_split(t: Tables) -> DataFrame:
    cut = H.stratified_split(scored(t), "label", 0.2, list(SPLIT_KEYS))
    return cut.groupBy("label").agg(
        F.count("*").alias("flights"), F.sum(1 - F.col("is_test")).alias("train_rows"),
        F.sum("is_test").alias("test_rows"),
    )


@query()
def random_split(t: Tables) -> DataFrame:
    """Sizes of the two parts of an unstratified 80/20 split."""
    parts = zip(("train", "test"), H.random_split(scored(t), 0.2, list(SPLIT_KEYS)))
    sizes = [df.groupBy(F.lit(name).alias("part"), "label").agg(F.count("*").alias("flights")) for name, df in parts]
    return sizes[0].unionByName(sizes[1])
