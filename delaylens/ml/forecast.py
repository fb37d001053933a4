"""Daily delay forecasters: random forest on rolling or lag features, and recursion.

A forecast is one pass over the series: each task takes its batch of windows, runs the whole
horizon on arrays with the packed forest, and gives back the days. The state of a series is a
window of seven values; nothing is planned or stored per step.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType

from delaylens.functions.scalars import above
from delaylens.ml.common import long_metrics
from delaylens.ml.forest import Forest, fit_forest
from delaylens.operators import evaluate as E
from delaylens.operators.sampling import temporal_split
from delaylens.session import materialize, shared_dir

# Task functions travel with their code: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET = "mean_delay"
BASE = ("std_delay", "flight_count", "cancel_rate", "day_of_week", "day_of_year")
ROLLING = (*BASE, "delay_3d_avg", "delay_7d_avg")
LAGS = (*BASE, "lag1_delay", "lag2_delay", "lag3_delay", "lag7_delay")
STATE = (TARGET, "std_delay", "flight_count", "cancel_rate")
WINDOW_DAYS = 7


def fit(
    train: DataFrame, features: Sequence[str], trees: int = 300, depth: int = 30, seed: int = 42, series: Sequence[str] = ()
) -> Forest:
    return fit_forest(train, features, TARGET, [*series, "fl_date"], trees, depth, min_leaf=2, seed=seed)


def train_and_test(
    daily: DataFrame, features: Sequence[str], share: float = 0.85, trees: int = 300, depth: int = 30,
    tie_break: Sequence[str] = (),
) -> tuple[Forest, DataFrame]:
    """Fit on the first days, score the last ones."""
    shared_dir(daily.sparkSession)
    cut = materialize(temporal_split(daily, share, "fl_date", list(tie_break)))
    model = fit(cut.filter(F.col("is_train") == 1), features, trees, depth, series=tie_break)
    return model, materialize(model.transform(cut.filter(F.col("is_train") == 0)))


def evaluate(tested: DataFrame, name: str, threshold: float = 1.0) -> DataFrame:
    """MAE, RMSE, R2, and the metrics of "mean delay above the threshold"."""
    rows = tested.withColumns(
        {"_y": above(TARGET, threshold), "_z": above("prediction", threshold)}
    )
    parts = [E.regression(rows, TARGET, "prediction"), E.confusion(rows, "_y", "_z"), E.roc_auc(rows, "_y", "prediction")]
    out = [long_metrics(p, name, "test") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- recursion --------------------------------------------------------------------------------


def last_window(daily: DataFrame, *series: str, days: int = WINDOW_DAYS) -> DataFrame:
    """The last seven days of each series as arrays, oldest first."""
    back = Window.partitionBy(*series).orderBy(F.desc("fl_date"))
    recent = daily.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= days)
    packed = recent.groupBy(*series).agg(
        F.max("fl_date").alias("last_date"),
        F.sort_array(F.collect_list(F.struct("fl_date", *[F.col(c).cast("double").alias(c) for c in STATE]))).alias("w"),
    )
    return packed.select(*series, "last_date", *[F.col(f"w.{c}").alias(f"w_{c}") for c in STATE])


Inputs = Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]]


def _rolling_inputs(w: dict[str, np.ndarray], step: int) -> dict[str, np.ndarray]:
    return {
        **{c: w[c].mean(1) for c in STATE[1:]},
        "delay_3d_avg": w[TARGET][:, -3:].mean(1),
        "delay_7d_avg": w[TARGET].mean(1),
    }


def _lag_inputs(normal: np.ndarray) -> Inputs:
    """Spread, volume and cancellations drawn around their windows; ``normal`` has a draw per row, step and column."""

    def inputs(w: dict[str, np.ndarray], step: int) -> dict[str, np.ndarray]:
        def draw(c: str, i: int) -> np.ndarray:
            spread = w[c].std(1, ddof=1) if w[c].shape[1] > 1 else 0.0
            return w[c].mean(1) + spread * normal[:, step, i]

        m = w[TARGET]
        return {
            "std_delay": draw("std_delay", 0),
            "flight_count": np.floor(np.maximum(1.0, draw("flight_count", 1))),
            "cancel_rate": np.clip(draw("cancel_rate", 2), 0.0, 1.0),
            "lag1_delay": m[:, -1], "lag2_delay": m[:, -min(2, m.shape[1])],
            "lag3_delay": m[:, -min(3, m.shape[1])], "lag7_delay": m[:, 0],
        }

    return inputs


def recurse(forest: Forest, windows: dict[str, np.ndarray], first: np.ndarray, horizon: int, inputs: Inputs) -> np.ndarray:
    """Predictions (series, day) for ``horizon`` days from ``first``, each fed back into the windows."""
    w, path = dict(windows), np.empty((len(first), horizon))
    for step in range(horizon):
        day = first + step
        made = inputs(w, step)
        made["day_of_week"] = (day.astype(np.int64) + 3) % 7
        made["day_of_year"] = (day - day.astype("M8[Y]").astype("M8[D]")).astype(np.int64) + 1
        made[TARGET] = path[:, step] = forest.predict(np.column_stack([made[c] for c in forest.features]))
        w = {c: np.column_stack([w[c][:, 1:], made[c]]) for c in STATE}
    return path


def _paths(forest: Forest, state: DataFrame, horizon: int, series: Sequence[str], seed: int | None) -> DataFrame:
    """One row per series and day. Series shorter than the window keep their own length."""
    shared = forest.sent(state)
    names = list(series)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(*shared.value)
        for batch in batches:
            for _, part in batch.groupby(batch[f"w_{TARGET}"].map(len)):
                windows = {c: np.stack(part[f"w_{c}"].to_numpy()).astype(float) for c in STATE}
                first = part["last_date"].to_numpy("M8[D]") + 1
                inputs = _rolling_inputs
                if seed is not None:
                    draws = [np.random.Generator(np.random.Philox(key=[seed, int(k) & (2**64 - 1)])) for k in part["_draw"]]
                    inputs = _lag_inputs(np.stack([d.standard_normal((horizon, 3)) for d in draws]))
                path = recurse(forest, windows, first, horizon, inputs)
                out = part[names].loc[part.index.repeat(horizon)].reset_index(drop=True)
                out["fl_date"] = (first[:, None] + np.arange(horizon)).ravel().astype("M8[s]").astype(object)
                out["prediction"] = path.ravel()
                yield out

    kept = [f for f in state.schema.fields if f.name in names]
    schema = StructType([*kept, StructField("fl_date", DateType()), StructField("prediction", DoubleType())])
    return state.mapInPandas(run, schema).select(*names, "fl_date", "prediction")


def forecast(forest: Forest, daily: DataFrame, horizon: int, *series: str) -> DataFrame:
    """``horizon`` days per series (all rows without one) from the rolling model; predictions are fed back."""
    return _paths(forest, last_window(daily, *series), horizon, series, None)


def forecast_scenarios(
    forest: Forest, daily: DataFrame, horizon: int, *series: str, scenarios: int = 20, seed: int = 42
) -> DataFrame:
    """Per series and day: mean and 10/50/90 % quantiles over random-input scenarios.

    Spread, volume and cancellations are drawn around their last seven values; the draws
    depend on the seed, the series and the scenario, so a repeated run gives the same paths.
    """
    state = last_window(daily, *series).withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(scenarios))))
    state = state.withColumn("_draw", F.xxhash64(*[F.col(c) for c in series], "scenario"))
    paths = _paths(forest, state, horizon, [*series, "scenario"], seed)
    # A group holds one value per scenario.
    q = F.percentile("prediction", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    per_day = paths.groupBy(*series, "fl_date").agg(F.avg("prediction").alias("mean"), q.alias("q"))
    return per_day.select(
        *series, "fl_date", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90")
    )
