"""Model jobs at the full sizes: trees, depth, iterations and horizons, over all rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.functions import features as X
from delaylens.ml import classify as C
from delaylens.ml import common as M
from delaylens.ml import forecast as D
from delaylens.ml import isolation as I
from delaylens.ml import ripple_models as P
from delaylens.ml import segments as G
from delaylens.ml.forest import Forest
from delaylens.operators import evaluate as E
from delaylens.operators import flights as A
from delaylens.operators import ripple as R
from delaylens.operators import travel_time as V
from delaylens.plans.check_views import FLIGHTS, with_views
from delaylens.plans.registry import query
from delaylens.plans.transit_queries import found
from delaylens.plans.travel_queries import CUTOFF, readings
from delaylens.session import materialize, scratch_path
from delaylens.sources.sinks import load_model, save_model
from delaylens.sources.tables import Tables, flights

CARRIER = "op_unique_carrier"
MODEL_COLUMNS = (
    "crs_dep_time", "month", "day_of_week", "distance", "origin", "dest", "op_unique_carrier", "arr_delay",
    "cancelled", "diverted", "late_aircraft_delay", "nas_delay",
)
# No single column identifies a flight of the view; together these come close.
KEYS = ("fl_date", "crs_dep_time", "crs_arr_time", "origin", "dest", "op_unique_carrier", "arr_delay", "taxi_out")


def _model_flights(t: Tables) -> DataFrame:
    return flights(t, *dict.fromkeys((*MODEL_COLUMNS, *KEYS)))


# --- classifiers --------------------------------------------------------------------------------


@query(with_views(FLIGHTS, """
, seen AS (SELECT * FROM flights WHERE origin <> 'NATION_3'),
slots AS (SELECT origin, CAST(origin <> 'NATION_3' AS DOUBLE)
    + CAST(dest IN (SELECT dest FROM seen) AS DOUBLE)
    + CAST(op_unique_carrier IN (SELECT op_unique_carrier FROM seen) AS DOUBLE) AS active FROM flights)
SELECT origin, min(active) AS fewest, max(active) AS most FROM slots GROUP BY origin"""))
def one_hot_features(t: Tables) -> DataFrame:
    """Active slots per row: one per category, none for an origin unseen in training."""
    rows = C.model_frame(_model_flights(t), "basic", KEYS)
    seen = rows.filter(F.col("origin") != "NATION_3")
    out = Pipeline(stages=M.one_hot_stages(C.CATEGORIES, [])).fit(seen).transform(rows)
    active = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return out.groupBy("origin").agg(F.min(active).alias("fewest"), F.max(active).alias("most"))


@query()
def logistic_delay_model(t: Tables) -> DataFrame:
    train, test = C.split(C.model_frame(_model_flights(t), "basic", KEYS))
    model = C.fit_logistic(train, "basic")
    report = E.classification_report(C.scored(model, test), C.LABEL, "pred")
    long = report.unpivot(["class"], ["precision", "recall", "f1"], "metric", "value").select(
        F.lit("logistic").alias("model"), F.lit("test").alias("split"),
        F.concat("class", F.lit(" "), "metric").alias("metric"), "value",
    )
    return C.evaluate(model, test, "logistic").unionByName(long)


@query()
def boosted_delay_model(t: Tables) -> DataFrame:
    train, test = C.split(C.model_frame(_model_flights(t), "basic", KEYS))
    return C.evaluate(C.fit_boosted(train, "basic", C.FULL_SIZE["basic"], weighted=False), test, "boosted")


@query()
def feature_set_comparison(t: Tables) -> DataFrame:
    """Leaky against clean features: the leaky set must look better than it is."""
    return C.compare(_model_flights(t), C.FULL_SIZE, KEYS)


@query(with_views(FLIGHTS, "SELECT origin, count(*) AS flights, 0::BIGINT AS changed FROM flights GROUP BY origin"))
def saved_model_scores(t: Tables) -> DataFrame:
    """A model saved and loaded again scores the same; rows with a different score per origin."""
    rows = C.model_frame(_model_flights(t), "basic", KEYS)
    model = C.fit_logistic(rows, "basic")
    path = scratch_path(t.spark, "model")
    save_model(model, path)
    first = M.with_probability(model.transform(rows), "before").select(*rows.columns, "before")
    both = M.with_probability(load_model(path).transform(first), "after")
    return both.groupBy("origin").agg(
        F.count("*").alias("flights"), F.sum((F.col("before") != F.col("after")).cast("int")).alias("changed")
    )


# --- anomalies -----------------------------------------------------------------------------------


def _detected(t: Tables, *columns: str) -> DataFrame:
    """All flights with their score and flag, and of their columns those named."""
    f = flights(t, *dict.fromkeys((*I.FEATURES, *KEYS, *columns)))
    return I.detect(f, keys=[*KEYS, *I.FEATURES[:1]], keep=list(columns))


@query()
def isolation_forest_causes(t: Tables) -> DataFrame:
    """Root causes of the flagged flights, with their share of the scored ones."""
    found_rows = _detected(t, *I.FEATURES, "cancelled", "diverted")
    limits = A.air_time_limits(flights(t, "air_time"))
    scored = found_rows.filter(F.col("anomaly_score").isNotNull()).count()
    causes = A.anomaly_causes(found_rows.filter(F.col("is_anomaly") == 1), limits)
    return causes.withColumn("share_of_scored", F.col("anomalies") / F.lit(max(scored, 1)))


@query()
def isolation_forest_carrier_month(t: Tables) -> DataFrame:
    flagged = _detected(t, CARRIER, "month").filter(F.col("is_anomaly") == 1)
    return A.anomalies_by_carrier_month(flagged, flights(t, "op_unique_carrier"))


@query()
def delay_model_without_anomalies(t: Tables) -> DataFrame:
    """The clean classifier trained on flights that the forest did not flag."""
    kept = X.drop_anomalies(_detected(t, *dict.fromkeys((*MODEL_COLUMNS, *KEYS))))
    train, test = C.split(C.model_frame(kept, "predeparture", KEYS))
    return C.evaluate(C.fit_boosted(train, "predeparture", C.FULL_SIZE["predeparture"]), test, "without anomalies")


# --- daily forecasts -------------------------------------------------------------------------------


def _daily(t: Tables, *series: str) -> DataFrame:
    return materialize(A.daily_delay(flights(t, "fl_date", "arr_delay", "cancelled", *series), *series))


@query()
def daily_rolling_model(t: Tables) -> DataFrame:
    model, tested = D.train_and_test(A.add_rolling(_daily(t)), D.ROLLING)
    return D.evaluate(tested, "daily rolling")


@query()
def daily_lag_model(t: Tables) -> DataFrame:
    model, tested = D.train_and_test(A.add_lags(_daily(t)), D.LAGS)
    return D.evaluate(tested, "daily lag")


@query()
def daily_feature_importance(t: Tables) -> DataFrame:
    model, _ = D.train_and_test(A.add_rolling(_daily(t)), D.ROLLING)
    return M.ranked_importances(t.spark, model.importances())


@lru_cache(maxsize=16)
def _forecaster(session: str, t: Tables, kind: str, *series: str) -> tuple[DataFrame, Forest]:
    """The daily rows of each series and the forest over all of them, grown once per session and folder."""
    add, features = {"rolling": (A.add_rolling, D.ROLLING), "lags": (A.add_lags, D.LAGS)}[kind]
    rows = materialize(add(_daily(t, *series), *series))
    return rows, D.fit(rows, features, series=series)


def _forecast(t: Tables, kind: str, *series: str) -> DataFrame:
    rows, forest = _forecaster(t.spark.sparkContext.applicationId, t, kind, *series)
    if kind == "rolling":
        return D.forecast(forest, rows, 120, *series)
    return D.forecast_scenarios(forest, rows, 30, *series, scenarios=20)


@query()
def carrier_rolling_forecast(t: Tables) -> DataFrame:
    """120 days ahead for every carrier, predictions fed back into the window."""
    return _forecast(t, "rolling", CARRIER)


@query()
def carrier_lag_scenarios(t: Tables) -> DataFrame:
    """Thirty days ahead for every carrier under random inputs."""
    return _forecast(t, "lags", CARRIER)


@query()
def overall_rolling_forecast(t: Tables) -> DataFrame:
    """120 days ahead for all flights as one series."""
    return _forecast(t, "rolling")


@query()
def overall_lag_scenarios(t: Tables) -> DataFrame:
    """Thirty days ahead for all flights as one series under random inputs."""
    return _forecast(t, "lags")


def _ahead_sql(days: int, per_carrier: bool, bounds: str) -> str:
    """Each series' days after its last one, and that its figures stay inside those it learned from."""
    series = "op_unique_carrier, " if per_carrier else ""
    return with_views(FLIGHTS, f"""
, daily AS (
    SELECT {series}fl_date, avg(arr_delay) AS mean_delay FROM flights
    WHERE arr_delay IS NOT NULL AND fl_date IS NOT NULL {"AND op_unique_carrier IS NOT NULL" if per_carrier else ""} GROUP BY ALL),
lasts AS (SELECT {series}max(fl_date) AS last_date FROM daily {"GROUP BY op_unique_carrier" if per_carrier else ""})
SELECT {series}strftime(last_date + CAST(i AS INTEGER), '%Y-%m-%d') AS fl_date, {bounds}
FROM lasts, range(1, {days + 1}) AS ahead(i)""")


def _inside(t: Tables, kind: str, column: str, *series: str) -> Column:
    """Whether a prediction, a mean of training means, lies between the least and the largest of them."""
    rows, _ = _forecaster(t.spark.sparkContext.applicationId, t, kind, *series)
    low, high = rows.agg(F.min(D.TARGET), F.max(D.TARGET)).first()
    return F.col(column).between(F.lit(low - 1e-9), F.lit(high + 1e-9)).cast("bigint")


@query(_ahead_sql(120, True, "1::BIGINT AS inside"))
def carrier_rolling_forecast_days(t: Tables) -> DataFrame:
    """Rows, dates and bounds of ``carrier_rolling_forecast``."""
    day = F.date_format("fl_date", "yyyy-MM-dd").alias("fl_date")
    return _forecast(t, "rolling", CARRIER).select(CARRIER, day, _inside(t, "rolling", "prediction", CARRIER).alias("inside"))


@query(_ahead_sql(120, False, "1::BIGINT AS inside"))
def overall_rolling_forecast_days(t: Tables) -> DataFrame:
    """Rows, dates and bounds of ``overall_rolling_forecast``."""
    day = F.date_format("fl_date", "yyyy-MM-dd").alias("fl_date")
    return _forecast(t, "rolling").select(day, _inside(t, "rolling", "prediction").alias("inside"))


@query(_ahead_sql(30, True, "1::BIGINT AS inside, 1::BIGINT AS ordered"))
def carrier_lag_scenarios_days(t: Tables) -> DataFrame:
    """Rows, dates, bounds and order of the quantiles of ``carrier_lag_scenarios``."""
    least = _inside(t, "lags", "p10", CARRIER) * _inside(t, "lags", "p90", CARRIER) * _inside(t, "lags", "mean", CARRIER)
    ordered = (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))
    return _forecast(t, "lags", CARRIER).select(
        CARRIER, F.date_format("fl_date", "yyyy-MM-dd").alias("fl_date"), least.alias("inside"), ordered.cast("bigint").alias("ordered")
    )


@query()
def lag_feature_importance(t: Tables) -> DataFrame:
    """Importances of the forest on lags, over all flights as one series."""
    _, forest = _forecaster(t.spark.sparkContext.applicationId, t, "lags")
    return M.ranked_importances(t.spark, forest.importances())


# --- road segments ----------------------------------------------------------------------------------


@query()
def segment_models(t: Tables) -> DataFrame:
    """Mean and 90 % models with train and test metrics and the worst segments."""
    train, test = (materialize(p) for p in V.model_frames(readings(t), CUTOFF))
    with ThreadPoolExecutor(2) as both:  # neither waits for the other's jobs
        mean, high = (m.result() for m in [both.submit(G.fit_mean, train), both.submit(G.fit_quantile, train)])
    scored = {n: materialize(G.predict(p, mean, high)) for n, p in (("train", train), ("test", test))}
    worst = V.segment_errors(scored["test"]).unpivot(
        ["resultId"], ["mae", "rmse", "coverage_p90"], "metric", "value"
    )
    rows = G.evaluate(scored["train"], "train").unionByName(G.evaluate(scored["test"], "test"))
    return rows.unionByName(
        worst.select(F.concat(F.lit("segment "), "resultId").alias("model"), F.lit("test").alias("split"), "metric", "value")
    )


# --- follow-on delays ---------------------------------------------------------------------------------


def _ripple_rows(t: Tables) -> DataFrame:
    return P.split(R.incident_dataset(found(t)))


@query()
def ripple_model_metrics(t: Tables) -> DataFrame:
    """Both classifiers, the positive-delay regressor and the two blends."""
    rows = _ripple_rows(t)
    scored = rows
    for label, name in (("ripple_label", "ripple_p"), ("severe_label", "severe_p")):
        scored = P.add_probability(scored, P.fit_classifier(rows, label, P.CLASSIFIER), name)
    scored = materialize(P.add_amount(scored, P.fit_positive(rows, P.REGRESSOR)))
    ripple, edge = P.classifier_metrics(scored, "ripple_label", "ripple_p", "ripple_classifier")
    severe, _ = P.classifier_metrics(scored, "severe_label", "severe_p", "severe_classifier")
    both = P.blend(scored, "ripple_p", "amount", edge)
    parts = [
        severe,
        P.regression_metrics(scored, "amount", "positive_delay_regression", positive_only=True),
        P.regression_metrics(both, "hurdle", "delay_prediction_threshold"),
        P.regression_metrics(both, "expected", "delay_prediction_expected"),
    ]
    for part in parts:
        ripple = ripple.unionByName(part)
    return ripple


@query()
def ripple_feature_importance(t: Tables) -> DataFrame:
    """Split importance of the ripple classifier, permutation effect on the regressor."""
    rows = _ripple_rows(t)
    names = [*[f"{c}_mean" for c in P.CATEGORIES], *P.NUMBERS]
    split = M.importances(t.spark, P.fit_classifier(rows, "ripple_label", P.CLASSIFIER), names)
    permuted = P.permutation_importance(rows.filter(F.col("is_train") == 0), P.fit_positive(rows, P.REGRESSOR))
    return (
        split.select(F.lit("ripple_classifier").alias("model"), "feature", "importance")
        .unionByName(
            permuted.select(
                F.lit("positive_delay_regressor").alias("model"), "feature",
                F.col("mean_abs_change").alias("importance"),
            )
        )
    )
