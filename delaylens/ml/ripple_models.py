"""Models of follow-on delay: two classifiers, a positive-delay regressor, their blends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.functions import scalars as S
from delaylens.ml.common import long_metrics, with_probability, with_weight
from delaylens.operators import evaluate as E
from delaylens.operators.ordered import running
from delaylens.operators.ripple import DATASET_COLUMNS, TARGETS
from delaylens.operators.sampling import row_hash, temporal_split
from delaylens.session import materialize, shared_dir

CATEGORIES = ("station_key", "subway_code", "subway_line", "day_name")
NOT_FEATURES = (*TARGETS, "ripple_label", "severe_label", "subway_timestamp", "incident_id", *CATEGORIES)
NUMBERS = tuple(c for c in DATASET_COLUMNS if c not in NOT_FEATURES)
FEATURES = (*CATEGORIES, *NUMBERS)
TARGET = "target_surface_delay"


@dataclass(frozen=True)
class Size:
    trees: int
    depth: int
    step: float = 0.05


# Full-size training parameters.
CLASSIFIER = Size(1500, 7)
REGRESSOR = Size(2000, 8)


def split(dataset: DataFrame, share: float = 0.8, validation: float = 0.15) -> DataFrame:
    """Add ``is_train``, and ``is_validation`` for the latest part of the training rows.

    Early stopping watches that part, never the test rows.
    """
    text = dataset.withColumns({c: S.as_category(c) for c in CATEGORIES})
    cut = materialize(temporal_split(text, share, "subway_timestamp", ["incident_id"]))
    train = temporal_split(
        cut.filter(F.col("is_train") == 1).withColumnRenamed("is_train", "_t"),
        1 - validation, "subway_timestamp", ["incident_id"],
    ).select(*text.columns, F.lit(1).alias("is_train"), (F.col("is_train") == 0).alias("is_validation"))
    test = cut.filter(F.col("is_train") == 0).withColumn("is_validation", F.lit(False))
    return materialize(train.unionByName(test))


def _stages(label: str, kind: str) -> list:
    """Categories as smoothed target means, so a new station or code needs no own bin."""
    indexed, encoded = [f"{c}_index" for c in CATEGORIES], [f"{c}_target" for c in CATEGORIES]
    # The encoder's columns still carry the index's nominal metadata, which would make the
    # trees read a mean as a category; arithmetic drops it.
    plain = ", ".join(f"{c}_target + 0.0D AS {c}_mean" for c in CATEGORIES)
    return [
        StringIndexer(inputCols=list(CATEGORIES), outputCols=indexed, handleInvalid="keep"),
        TargetEncoder(
            inputCols=indexed, outputCols=encoded, labelCol=label, targetType=kind, smoothing=10.0,
            handleInvalid="keep",
        ),
        SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"),
        VectorAssembler(inputCols=[*[f"{c}_mean" for c in CATEGORIES], *NUMBERS], outputCol="features"),
    ]


def fit_classifier(rows: DataFrame, label: str, size: Size = CLASSIFIER, seed: int = 42) -> PipelineModel:
    shared_dir(rows.sparkSession)
    weighted = with_weight(rows.filter(F.col("is_train") == 1), label, "balanced_weight")
    model = GBTClassifier(
        labelCol=label, weightCol="weight", validationIndicatorCol="is_validation", maxIter=size.trees,
        maxDepth=size.depth, stepSize=size.step, seed=seed,
    )
    return Pipeline(stages=[*_stages(label, "binary"), model]).fit(weighted)


def fit_positive(rows: DataFrame, size: Size = REGRESSOR, seed: int = 42) -> PipelineModel:
    """Regressor of log(1 + delay) on the training incidents that had a delay."""
    shared_dir(rows.sparkSession)
    positive = rows.filter((F.col("is_train") == 1) & (F.col(TARGET) > 0))
    logged = positive.withColumn("log_delay", F.log1p(TARGET))
    model = GBTRegressor(
        labelCol="log_delay", predictionCol="log_prediction", validationIndicatorCol="is_validation",
        maxIter=size.trees, maxDepth=size.depth, stepSize=size.step, seed=seed,
    )
    return Pipeline(stages=[*_stages("log_delay", "continuous"), model]).fit(logged)


def add_probability(rows: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    return with_probability(model.transform(rows), name).select(*rows.columns, name)


def add_amount(rows: DataFrame, model: PipelineModel, name: str = "amount") -> DataFrame:
    """Delay given that there is one, never negative."""
    done = model.transform(rows).withColumn(name, S.clipped_expm1("log_prediction"))
    return done.select(*rows.columns, name)


def blend(df: DataFrame, probability: str, amount: str, threshold: float | Column) -> DataFrame:
    """``hurdle``: the amount where the probability reaches the threshold, else 0.
    ``expected``: probability times amount."""
    edge = F.lit(threshold) if isinstance(threshold, float) else threshold
    hit = F.when(F.col(probability) >= edge, F.col(amount)).otherwise(F.lit(0.0))
    return df.withColumns({"hurdle": hit, "expected": F.col(probability) * F.col(amount)})


def _part(df: DataFrame, split_name: str) -> DataFrame:
    return df.filter(F.col("is_train") == int(split_name == "train"))


def classifier_metrics(scored: DataFrame, label: str, probability: str, name: str) -> tuple[DataFrame, float]:
    """Metric rows for both splits at the threshold with the best training F1."""
    best = E.best_threshold(_part(scored, "train"), label, probability).first()["threshold"]
    called = scored.withColumn("_pred", (F.col(probability) >= best).cast("int"))
    rows = None
    for part_name in ("train", "test"):
        part = _part(called, part_name)
        figures = [
            E.ranking(part, label, probability),
            E.confusion(part, label, "_pred").withColumn("threshold", F.lit(best)),
        ]
        for f in figures:
            found = long_metrics(f, name, part_name)
            rows = found if rows is None else rows.unionByName(found)
    return rows, best


def regression_metrics(scored: DataFrame, prediction: str, name: str, positive_only: bool = False) -> DataFrame:
    rows = None
    for part_name in ("train", "test"):
        part = _part(scored, part_name)
        if positive_only:
            part = part.filter(F.col(TARGET) > 0)
        found = long_metrics(E.regression(part, TARGET, prediction), name, part_name)
        rows = found if rows is None else rows.unionByName(found)
    return rows


def permutation_importance(
    rows: DataFrame, model: PipelineModel, prediction: str = "log_prediction", seed: int = 42
) -> DataFrame:
    """Effect of shuffling one feature at a time, over all rows.

    Both orders of the rows are ranked slice by slice. Every row appears once per feature with that feature taken from another row;
    all copies are scored in one pass. Gives the mean absolute change of the prediction
    and the rise of the squared error.
    """
    keys, one = ["incident_id", "subway_timestamp"], rows.withColumn("_one", F.lit(1))
    first = running(one, [row_hash(keys, seed + 1), *keys], sums=["_one"]).withColumnRenamed("_one_run", "_own")
    ranked = materialize(
        running(first, [row_hash(keys, seed + 2), *keys], sums=["_one"]).withColumnRenamed("_one_run", "_other").drop("_one")
    )
    donors = ranked.select(F.col("_other").alias("_own"), *[F.col(c).alias(f"_d_{c}") for c in FEATURES])
    base = model.transform(ranked).select("_own", F.col(prediction).alias("_base"))
    copies = ranked.join(donors, "_own").withColumn("feature", F.explode(F.array(*map(F.lit, FEATURES))))
    mixed = copies.withColumns(
        {c: F.when(F.col("feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)) for c in FEATURES}
    ).withColumn("_y", F.log1p(TARGET))
    done = model.transform(mixed).join(base, "_own")
    error = lambda p: F.pow(F.col("_y") - F.col(p), 2)
    return done.groupBy("feature").agg(
        F.avg(F.abs(F.col(prediction) - F.col("_base"))).alias("mean_abs_change"),
        (F.avg(error(prediction)) - F.avg(error("_base"))).alias("squared_error_rise"),
    ).orderBy(F.desc("mean_abs_change"), "feature")
