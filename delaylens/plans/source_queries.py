"""Sources and sinks, exercised on data written from the views and read back.

Every table goes through the shared folder in the format its reader expects, so these
queries grow with the given tables and have the same SQL as the direct ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.operators import evaluate as E
from delaylens.operators import flights as A
from delaylens.operators import ripple as R
from delaylens.ml.common import long_metrics
from delaylens.plans import metric_queries as Q
from delaylens.plans.check_views import CODEBOOK, FLIGHTS, INCIDENTS, TRANSIT, TRAVEL, with_views
from delaylens.plans.registry import query
from delaylens.plans.transit_queries import found
from delaylens.session import scratch_path
from delaylens.sources import readers, sinks
from delaylens.sources.tables import Tables, code_files, flights, transit_raw, travel_time

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"

FLIGHT_SUMS = """
SELECT strftime(fl_date, '%Y-%m') AS fl_month, op_unique_carrier, count(*) AS flights,
  CAST(sum(cancelled) AS BIGINT) AS cancelled, round(sum(arr_delay), 6) AS arr_minutes, sum(distance) AS miles
FROM flights GROUP BY ALL"""


def _flight_sums(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format("fl_date", "yyyy-MM").alias("fl_month"), "op_unique_carrier").agg(
        F.count("*").alias("flights"), F.sum("cancelled").alias("cancelled"),
        F.sum("arr_delay").alias("arr_minutes"), F.sum(F.col("distance").cast("double")).alias("miles"),
    )


def _written(t: Tables, df: DataFrame, name: str) -> str:
    path = scratch_path(t.spark, name)
    sinks.write_csv(df, path)
    return path


@query(with_views(FLIGHTS, FLIGHT_SUMS))
def load_flights_csv(t: Tables) -> DataFrame:
    return _flight_sums(readers.load_flights(t.spark, _written(t, flights(t), "flights")))


@query(with_views(FLIGHTS, FLIGHT_SUMS))
def load_flights_parquet(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "flights")
    flights(t).write.parquet(path)
    return _flight_sums(readers.load_flights(t.spark, path, "parquet"))


@query(with_views(FLIGHTS, """
SELECT CAST(CASE WHEN fl_date < DATE '1997-01-01' THEN NULL ELSE month END AS BIGINT) AS month,
  count(*) AS flights FROM flights GROUP BY 1"""))
def load_untyped_csv(t: Tables) -> DataFrame:
    # Dates before 1997 are written as text that is no date, months are written wrong.
    f = flights(t, "fl_date", "origin")
    bad = F.when(F.col("fl_date") < "1997-01-01", "n/a").otherwise(F.col("fl_date").cast("string"))
    path = _written(t, f.select(bad.alias("fl_date"), F.lit(99).alias("month"), "origin"), "untyped")
    return readers.load_flights_with_month(t.spark, path).groupBy("month").agg(F.count("*").alias("flights"))


@query(with_views(TRAVEL, f"""
SELECT CAST(2014 + reading_id % 3 AS BIGINT) AS year, resultId, timeInSeconds, "count",
  strftime(updated, {STAMP}) AS updated, strftime(updated_local, {STAMP}) AS updated_local,
  CAST(hour AS BIGINT) AS hour, dow, month FROM travel"""))
def load_travel_time_csv(t: Tables) -> DataFrame:
    # Three yearly folders, told apart by name as the feed's files are.
    folder = scratch_path(t.spark, "travel")
    rows = travel_time(t)
    paths = []
    for part in range(3):
        path = f"{folder}-{2014 + part}"
        chosen = rows.filter(F.col("reading_id") % 3 == part).select(
            "resultId", "timeInSeconds", "count",
            F.concat(F.date_format("updated", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("updated"),
        )
        chosen.write.option("header", True).csv(path)
        paths.append(path)
    return readers.load_travel_time(t.spark, paths)


def _mode_csv(t: Tables, mode: str) -> str:
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Toronto"), F.col("timestamp"))
    feed = transit_raw(t).filter(F.col("mode") == mode).select(
        "_id", F.date_format(local, "yyyy-MM-dd").alias("Date"),
        F.when(F.col("_id") % 11 == 0, "24:61").otherwise(F.date_format(local, "HH:mm")).alias("Time"),
        F.when(F.col("_id") % 13 != 0, F.col("station")).alias("Station"),
        F.col("code").alias("Code"), F.col("line").alias("Line"),
        F.when(F.col("_id") % 7 == 0, "unknown").otherwise(F.col("min_delay").cast("string")).alias("Min Delay"),
        *([F.col("min_gap").alias("Min Gap")] if mode != "subway" else []),
    )
    return _written(t, feed, mode)


@query(with_views(TRANSIT, f"""
SELECT _id, mode, station_key, code, line, CASE WHEN _id % 7 <> 0 THEN min_delay END AS min_delay,
  CASE WHEN mode <> 'subway' THEN min_gap END AS min_gap,
  strftime(date_trunc('minute', timestamp), {STAMP}) AS timestamp
FROM transit WHERE _id % 11 <> 0 AND _id % 13 <> 0"""))
def load_mode_files(t: Tables) -> DataFrame:
    modes = [
        readers.load_mode_file(t.spark, _mode_csv(t, mode), mode) for mode in ("subway", "bus", "streetcar")
    ]
    return readers.union_feeds(*modes).select("_id", "mode", "station_key", "code", "line", "min_delay", "min_gap", "timestamp")


@query(with_views(CODEBOOK, "SELECT code, description FROM codebook"))
def load_codebook_files(t: Tables) -> DataFrame:
    # The middle file is missing and the last one lacks the columns; both are skipped.
    first, second = code_files(t)
    paths = [
        _written(t, first, "codes"), scratch_path(t.spark, "absent"), _written(t, second, "codes"),
        _written(t, first.select(F.col("CODE").alias("other")), "codes"),
    ]
    return readers.load_codebook(t.spark, paths)


@query(with_views(INCIDENTS, """
SELECT station_key, count(*) AS incidents, CAST(sum(matched_surface_events) AS DOUBLE) AS events,
  round(sum(matched_surface_delay), 6) AS delay FROM incidents GROUP BY 1"""))
def incident_table_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "incidents")
    sinks.write_incidents(R.labelled(found(t)), path)
    return sinks.read_incidents(t.spark, path).groupBy("station_key").agg(
        F.count("*").alias("incidents"), F.sum("target_surface_events").alias("events"),
        F.sum("target_surface_delay").alias("delay"),
    )


@query(Q.sql(Q.CELLS + """
SELECT 'stand-in' AS model, 'test' AS split, metric, round(value, 6) AS value FROM (
  SELECT unnest(['tn', 'fp', 'fn', 'tp', 'precision', 'recall', 'f1']) AS metric,
    unnest([tn::DOUBLE, fp, fn, tp, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)]) AS value
  FROM c)"""))
def metrics_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "metrics")
    sinks.write_metrics(long_metrics(E.confusion(Q.scored(t), "label", "pred"), "stand-in", "test"), path)
    return sinks.read_metrics(t.spark, path)


@query(with_views(FLIGHTS, """
SELECT op_unique_carrier, count(*) AS total_flights FROM flights GROUP BY 1"""))
def flights_view_whole(t: Tables) -> DataFrame:
    """All columns of the view with every dimension joined: no flight is lost or doubled."""
    every = flights(t).dropna(subset=["origin", "dest"])
    return A.carrier_reliability(every).select("op_unique_carrier", "total_flights")
