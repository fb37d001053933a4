"""Segment travel time models: a boosted mean and a boosted 90 % quantile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from delaylens.ml.boosting import Boosted, fit_boosted
from delaylens.ml.common import long_metrics
from delaylens.operators import evaluate as E
from delaylens.operators.travel_time import VALUE

FEATURES = (
    "result_code", "hour", "dow_code", "month_code", "log_count", "year",
    "segment_mean", "segment_p90", "segment_records_log",
)


def fit_mean(train: DataFrame, trees: int = 300, depth: int = 8, step: float = 0.1, seed: int = 42) -> Boosted:
    return fit_boosted(train, FEATURES, VALUE, trees, depth, step, seed=seed)


def fit_quantile(
    train: DataFrame, prob: float = 0.9, trees: int = 400, depth: int = 8, step: float = 0.05, min_leaf: int = 20, seed: int = 42
) -> Boosted:
    """Trees on the pinball loss; a leaf moves by a share of its rows' quantile of what is left."""
    return fit_boosted(train, FEATURES, VALUE, trees, depth, step, prob, min_leaf, seed=seed)


def predict(df: DataFrame, mean_model: Boosted, quantile: Boosted) -> DataFrame:
    return quantile.transform(mean_model.transform(df, "pred_mean"), "pred_p90")


def evaluate(scored: DataFrame, split: str, name: str = "segment") -> DataFrame:
    parts = [
        E.regression(scored, VALUE, "pred_mean"),
        E.mape(scored, VALUE, "pred_mean"),
        E.pinball(scored, VALUE, "pred_p90"),
    ]
    rows = [long_metrics(p, name, split) for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])

