"""Writers and readers of derived tables, metrics and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_incidents(df: DataFrame, path: str) -> None:
    """The incident dataset as Parquet, split by month so that readers can prune."""
    split = df.withColumn("incident_month", F.date_format("subway_timestamp", "yyyy-MM"))
    split.write.mode("overwrite").partitionBy("incident_month").parquet(path)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Long metrics table (model, split, metric, value) as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model STRING, split STRING, metric STRING, value DOUBLE").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
