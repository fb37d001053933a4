"""Frame-level feature steps built from the column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylens.functions import scalars as S


def add_dep_hour(df: DataFrame) -> DataFrame:
    """Add ``crs_dep_time_min`` and ``dep_hour``; a frame that has ``dep_hour`` is returned as is."""
    if "dep_hour" in df.columns:
        return df
    return df.withColumns(
        {"crs_dep_time_min": S.hhmm_to_minutes("crs_dep_time"), "dep_hour": S.hour_of_hhmm("crs_dep_time")}
    )


def add_arr_hour(df: DataFrame) -> DataFrame:
    return df.withColumn("arr_hour", S.hour_of_hhmm("crs_arr_time"))


def add_delay_label(df: DataFrame, threshold: float = 15) -> DataFrame:
    """Add ``is_delayed_15``; a frame that has it is returned as is."""
    if "is_delayed_15" in df.columns:
        return df
    text = isinstance(df.schema["arr_delay"].dataType, T.StringType)
    delay = S.to_number("arr_delay") if text else S.nan_to_null("arr_delay")
    return df.withColumn("arr_delay", delay).withColumn("is_delayed_15", S.delay_label("arr_delay", threshold))


def filter_operated(df: DataFrame) -> DataFrame:
    return df.filter(S.operated("cancelled", "diverted"))


def filter_valid(df: DataFrame) -> DataFrame:
    return df.filter(S.valid_flight("distance", "air_time"))


def add_predeparture(df: DataFrame, weekend_from: int = 5) -> DataFrame:
    return df.withColumns(
        {
            "is_weekend": S.is_weekend("day_of_week", weekend_from),
            "is_peak_summer": S.is_peak_summer("month"),
            "distance_bucket": S.distance_bucket("distance"),
        }
    )


def add_post_departure_flags(df: DataFrame) -> DataFrame:
    """Flags known only after departure; they leak the label and serve the comparison model."""
    return df.withColumns(
        {
            "late_aircraft_binary": S.truth(F.col("late_aircraft_delay") > 0),
            "nas_binary": S.truth(F.col("nas_delay") > 0),
        }
    )


def month_from_date(df: DataFrame, date: str = "fl_date") -> DataFrame:
    return df.withColumn("month", F.month(F.col(date).try_cast("date")))


def drop_null_rows(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset))


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def drop_anomalies(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Keep the rows not flagged; unscored rows stay."""
    return df.filter(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
