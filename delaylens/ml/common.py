"""Shared model steps: encoders, scoring columns, importances, metric rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "model string, split string, metric string, value double"


def one_hot_stages(categories: Sequence[str], numbers: Sequence[str], output: str = "features") -> list:
    """Index, one-hot and assemble. A category unseen in training gets the zero vector:
    the indexer keeps it as its last index, and the encoder drops the last one."""
    indexed = [f"{c}_index" for c in categories]
    hot = [f"{c}_hot" for c in categories]
    return [
        StringIndexer(inputCols=list(categories), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="error", dropLast=True),
        VectorAssembler(inputCols=[*hot, *numbers], outputCol=output),
    ]


def with_probability(df: DataFrame, name: str = "score") -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight of the positive class: negatives per positive, and its form floored at 1."""
    pos = F.coalesce(F.sum((F.col(label) == 1).cast("bigint")), F.lit(0))
    neg = F.coalesce(F.sum((F.col(label) == 0).cast("bigint")), F.lit(0))
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    return df.agg(pos.alias("pos"), neg.alias("neg")).withColumns(
        {
            "scale_pos_weight": F.try_divide("neg", "pos"),
            "balanced_weight": F.greatest(F.lit(1.0), (1 - share) / F.greatest(share, F.lit(1e-6))),
        }
    )


def with_weight(df: DataFrame, label: str, kind: str = "scale_pos_weight", name: str = "weight") -> DataFrame:
    weight = class_weights(df, label).first()[kind]
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(weight or 1.0))).otherwise(F.lit(1.0)))


def long_metrics(wide: DataFrame, model: str, split: str) -> DataFrame:
    """One-row metrics frame to (model, split, metric, value) rows."""
    as_double = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    return as_double.unpivot([], as_double.columns, "metric", "value").select(
        F.lit(model).alias("model"), F.lit(split).alias("split"), "metric", "value"
    )


def feature_names(scored: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, from the assembler's metadata."""
    attrs = scored.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in slots]


def importances(
    spark: SparkSession, model: PipelineModel, names: Sequence[str], stage: int = -1
) -> DataFrame:
    """Feature importances, highest first; one row per feature."""
    vector = model.stages[stage].featureImportances.toArray()
    return ranked_importances(spark, [(n, float(v)) for n, v in zip(names, vector)])


def ranked_importances(spark: SparkSession, rows: Sequence[tuple[str, float]]) -> DataFrame:
    ranked = spark.createDataFrame(rows, "feature string, importance double")
    return ranked.orderBy(F.desc("importance"), "feature")


def as_rows(spark: SparkSession, figures: Mapping[str, float], model: str, split: str) -> DataFrame:
    rows = [(model, split, k, float(v)) for k, v in figures.items()]
    return spark.createDataFrame(rows, METRIC_SCHEMA)
