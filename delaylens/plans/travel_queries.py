"""Queries over the road segment readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.functions import scalars as S
from delaylens.operators import travel_time as V
from delaylens.plans.check_views import TRAVEL, with_views
from delaylens.plans.registry import query
from delaylens.session import materialize
from delaylens.sources.readers import add_local_features
from delaylens.sources.tables import Tables, travel_time

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
CUTOFF = "2024-01-25"
MIN_RECORDS = 330  # the usual 500 would leave no segment in the small tables


def sql(body: str) -> str:
    return with_views(TRAVEL, body)


def readings(t: Tables) -> DataFrame:
    return add_local_features(travel_time(t))


@query(sql(f"""
SELECT reading_id, strftime(updated_local, {STAMP}) AS updated_local, CAST(hour AS BIGINT) AS hour, dow, month
FROM travel"""))
def local_time_features(t: Tables) -> DataFrame:
    return readings(t).select("reading_id", "updated_local", "hour", "dow", "month")


@query(sql(f"""
SELECT CAST(year AS BIGINT) AS year, count(*) AS records, count(DISTINCT resultId) AS segments,
  strftime(min(updated_local), {STAMP}) AS start, strftime(max(updated_local), {STAMP}) AS "end",
  round(avg(timeInSeconds), 6) AS mean_time, round(avg("count"), 6) AS mean_sample_size,
  round(quantile_cont(timeInSeconds, 0.5), 6) AS median_time,
  round(quantile_cont(timeInSeconds, 0.8), 6) AS p80_time,
  round(quantile_cont(timeInSeconds, 0.9), 6) AS p90_time
FROM travel GROUP BY 1"""))
def travel_yearly(t: Tables) -> DataFrame:
    return V.yearly(readings(t))


PROFILE = """round(avg(timeInSeconds), 6) AS mean_time, count(*) AS sample_records,
  round(quantile_cont(timeInSeconds, 0.5), 6) AS median_time FROM travel GROUP BY ALL"""


CUBE = """round(avg(timeInSeconds), 6) AS mean_time, round(avg("count"), 6) AS mean_sample_size, count(*) AS records,
  round(quantile_cont(timeInSeconds, 0.5), 6) AS median_time, round(quantile_cont(timeInSeconds, 0.8), 6) AS p80_time,
  round(quantile_cont(timeInSeconds, 0.9), 6) AS p90_time FROM travel GROUP BY ALL"""


@query(sql(" UNION ALL ".join(
    f"SELECT '{level}' AS level, CAST({column} AS VARCHAR) AS key, {CUBE}" for level, column in V.LEVELS.items())))
def travel_profile_cube(t: Tables) -> DataFrame:
    return V.profile_cube(readings(t)).drop("start", "end")


@query(sql(f"SELECT CAST(hour AS BIGINT) AS hour, {PROFILE}"))
def travel_hourly(t: Tables) -> DataFrame:
    return V.hourly(readings(t))


@query(sql(f"""
SELECT p.position, p.dow, mean_time, sample_records, median_time
FROM (SELECT unnest(range(1, 8)) AS position,
  unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS dow) p
LEFT JOIN (SELECT dow, {PROFILE}) USING (dow)"""))
def travel_weekday(t: Tables) -> DataFrame:
    return V.weekdays(readings(t))


@query(sql(f"SELECT * FROM (SELECT month, {PROFILE}) ORDER BY month DESC LIMIT 24"))
def travel_monthly(t: Tables) -> DataFrame:
    return V.monthly(readings(t))


SEGMENTS = f"""
, stats AS (SELECT resultId, count(*) AS records, avg(timeInSeconds) AS mean_time,
    avg("count") AS mean_sample_size, quantile_cont(timeInSeconds, 0.5) AS median_time,
    quantile_cont(timeInSeconds, 0.9) AS p90_time
  FROM travel GROUP BY 1 HAVING count(*) >= {MIN_RECORDS})"""
SEGMENT_OUT = """resultId, records, round(mean_time, 6) AS mean_time, round(mean_sample_size, 6) AS mean_sample_size,
  round(median_time, 6) AS median_time, round(p90_time, 6) AS p90_time"""


def _segments(t: Tables) -> DataFrame:
    return V.segments(readings(t), MIN_RECORDS)


@query(sql(f"{SEGMENTS} SELECT {SEGMENT_OUT} FROM stats"))
def segment_stats(t: Tables) -> DataFrame:
    return _segments(t)


@query(sql(f"""{SEGMENTS}
SELECT 'worst' AS list, {SEGMENT_OUT} FROM (SELECT * FROM stats ORDER BY p90_time DESC, resultId LIMIT 15)
UNION ALL
SELECT 'best', {SEGMENT_OUT} FROM (SELECT * FROM stats ORDER BY mean_time, resultId LIMIT 15)"""))
def segment_worst_best(t: Tables) -> DataFrame:
    return V.worst_and_best(materialize(_segments(t)), k=15)


@query(sql(f"""{SEGMENTS}
SELECT round(quantile_cont(records, 0.5), 6) AS median_records, round(quantile_cont(records, 0.05), 6) AS p5_records,
  round(quantile_cont(records, 0.95), 6) AS p95_records,
  round(avg(CASE WHEN records >= 350 THEN 1 ELSE 0 END), 6) AS dense_share
FROM (SELECT CAST(records AS DOUBLE) AS records FROM stats)"""))
def segment_coverage(t: Tables) -> DataFrame:
    return V.coverage(materialize(_segments(t)), dense=350)


@query(sql("""
SELECT round(avg(timeInSeconds) FILTER (WHERE isodow(updated_local) <= 5), 6) AS weekday_mean,
  round(avg(timeInSeconds) FILTER (WHERE isodow(updated_local) >= 6), 6) AS weekend_mean FROM travel"""))
def weekday_weekend_mean(t: Tables) -> DataFrame:
    return V.weekday_weekend(readings(t))


@query(sql(f"""{SEGMENTS}
, h AS (SELECT hour, quantile_cont(timeInSeconds, 0.5) AS m FROM travel GROUP BY 1)
SELECT CAST(hour AS BIGINT) AS peak_hour, round(m, 6) AS peak_median,
  (SELECT max(month) FROM travel) AS recent_month,
  (SELECT round(min(p90_time), 6) FROM (SELECT p90_time FROM stats ORDER BY p90_time DESC LIMIT 15)) AS long_tail
FROM h ORDER BY m DESC, hour LIMIT 1"""))
def travel_peaks(t: Tables) -> DataFrame:
    r = readings(t)
    worst = V.worst_and_best(materialize(_segments(t)), k=15).filter(F.col("list") == "worst")
    return V.peaks(V.hourly(r), r.select("month").distinct(), worst)


@query(sql("""
SELECT count(*) AS records, count(DISTINCT resultId) AS segments,
  strftime(min(updated_local), '%Y-%m-%d') AS first_day, strftime(max(updated_local), '%Y-%m-%d') AS last_day
FROM travel"""))
def travel_overview(t: Tables) -> DataFrame:
    return V.overview(readings(t))


# --- features and residuals -------------------------------------------------------------------


@query(sql("""
SELECT reading_id, round(ln(1 + "count"), 6) AS log_count, round(exp(timeInSeconds / 100) - 1, 6) AS back,
  round(greatest(timeInSeconds - 100, 0), 6) AS clipped FROM travel"""))
def log_features(t: Tables) -> DataFrame:
    return readings(t).select(
        "reading_id", F.log1p("count").alias("log_count"),
        S.clipped_expm1(F.col("timeInSeconds") / 100).alias("back"),
        F.greatest(F.col("timeInSeconds") - 100, F.lit(0.0)).alias("clipped"),
    )


@query(sql(f"""
SELECT CASE WHEN updated_local < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS part,
  resultId, count(*) AS records FROM travel GROUP BY ALL"""))
def date_split(t: Tables) -> DataFrame:
    parts = zip(("train", "test"), V.split_by_date(readings(t), CUTOFF))
    sizes = [
        df.groupBy(F.lit(name).alias("part"), "resultId").agg(F.count("*").alias("records"))
        for name, df in parts
    ]
    return sizes[0].unionByName(sizes[1])


# Segments S7 and S19 are held out of training, so that unseen ones occur.
HELD_OUT = ("S7", "S19")
TRAIN = f"updated_local < TIMESTAMP '{CUTOFF}' AND resultId NOT IN {HELD_OUT}"


def _train_test(t: Tables) -> tuple[DataFrame, DataFrame]:
    train, test = V.split_by_date(readings(t), CUTOFF)
    return train.filter(~F.col("resultId").isin(*HELD_OUT)), test


@query(sql(f"""
, c AS (SELECT resultId, row_number() OVER (ORDER BY resultId) - 1 AS code
  FROM (SELECT DISTINCT resultId FROM travel WHERE {TRAIN})),
m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS code FROM (SELECT DISTINCT month FROM travel))
SELECT reading_id, coalesce(c.code, -1) AS result_code, m.code AS month_code,
  CAST(isodow(updated_local) - 1 AS BIGINT) AS dow_code
FROM travel LEFT JOIN c USING (resultId) JOIN m USING (month) WHERE updated_local >= TIMESTAMP '{CUTOFF}'"""))
def ordinal_codes(t: Tables) -> DataFrame:
    train, test = _train_test(t)
    out = V.attach_code(test, V.codes(train, "resultId", "result_code"), "resultId", "result_code")
    out = V.attach_code(out, V.codes(readings(t), "month", "month_code"), "month", "month_code")
    return out.select("reading_id", "result_code", "month_code", F.weekday("updated_local").alias("dow_code"))


@query(sql(f"""
, s AS (SELECT resultId, avg(timeInSeconds) AS m, quantile_cont(timeInSeconds, 0.9) AS p, count(*) AS n
  FROM travel WHERE {TRAIN} GROUP BY 1)
SELECT reading_id, round(coalesce(m, (SELECT avg(m) FROM s)), 6) AS segment_mean,
  round(coalesce(p, (SELECT avg(p) FROM s)), 6) AS segment_p90,
  round(coalesce(ln(1 + n), 0), 6) AS segment_records_log
FROM travel LEFT JOIN s USING (resultId) WHERE updated_local >= TIMESTAMP '{CUTOFF}'"""))
def segment_priors(t: Tables) -> DataFrame:
    train, test = _train_test(t)
    out = V.attach_priors(test, materialize(V.priors(train)))
    return out.select("reading_id", "segment_mean", "segment_p90", "segment_records_log")


@query(sql(f"""
SELECT resultId, count(*) AS records, round(avg(abs(timeInSeconds - (40 + hour))), 6) AS mae,
  round(sqrt(avg((timeInSeconds - (40 + hour)) ** 2)), 6) AS rmse,
  round(avg(CASE WHEN timeInSeconds <= 80 + "count" THEN 1 ELSE 0 END), 6) AS coverage_p90
FROM travel WHERE updated_local >= TIMESTAMP '{CUTOFF}' GROUP BY 1 ORDER BY mae DESC, resultId LIMIT 15"""))
def segment_errors(t: Tables) -> DataFrame:
    _, test = V.split_by_date(readings(t), CUTOFF)
    # Stand-in predictions that SQL can state too.
    scored = test.withColumns({"pred_mean": F.col("hour") + 40, "pred_p90": F.col("count") + 80})
    return V.segment_errors(scored)
