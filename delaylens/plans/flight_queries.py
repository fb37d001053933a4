"""Queries over the flight view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.functions import features as X
from delaylens.functions import scalars as S
from delaylens.operators import flights as A
from delaylens.operators import joins as J
from delaylens.operators.ordered import top_k
from delaylens.operators.sampling import sample_n
from delaylens.plans.check_views import FLIGHTS, with_views
from delaylens.plans.registry import query
from delaylens.session import materialize
from delaylens.sources.tables import Tables, flights

def rows_counted():
    return F.count("*").alias("flights")


def sql(body: str) -> str:
    return with_views(FLIGHTS, body)


# --- scalar steps -------------------------------------------------------------------------


@query(sql("""
SELECT CAST(crs_dep_time AS BIGINT) AS crs_dep_time,
  CAST((crs_dep_time // 100) * 60 + crs_dep_time % 100 AS BIGINT) AS minutes, count(*) AS flights
FROM flights GROUP BY 1, 2"""))
def hhmm_minutes(t: Tables) -> DataFrame:
    f = flights(t, "crs_dep_time")
    return f.groupBy("crs_dep_time", S.hhmm_to_minutes("crs_dep_time").alias("minutes")).agg(rows_counted())


@query(sql("""
SELECT CAST(crs_dep_time // 100 AS BIGINT) AS dep_hour, CAST(crs_arr_time // 100 AS BIGINT) AS arr_hour,
  count(*) AS flights FROM flights GROUP BY 1, 2"""))
def dep_hour(t: Tables) -> DataFrame:
    f = X.add_arr_hour(X.add_dep_hour(flights(t, "crs_dep_time", "crs_arr_time")))
    return f.groupBy("dep_hour", "arr_hour").agg(rows_counted())


@query(sql("""
SELECT arr_delay, CAST(CASE WHEN arr_delay > 15 THEN 1 ELSE 0 END AS BIGINT) AS is_delayed_15,
  count(*) AS flights FROM flights GROUP BY 1, 2"""))
def delay_label(t: Tables) -> DataFrame:
    return X.add_delay_label(flights(t, "arr_delay")).groupBy("arr_delay", "is_delayed_15").agg(rows_counted())


@query(sql("""
SELECT op_unique_carrier, count(*) AS flights, sum(distance) AS miles FROM flights
WHERE cancelled <> 1 AND diverted <> 1 GROUP BY 1"""))
def operated_flights(t: Tables) -> DataFrame:
    f = X.filter_operated(flights(t, "op_unique_carrier", "cancelled", "diverted", "distance"))
    return f.groupBy("op_unique_carrier").agg(rows_counted(), F.sum("distance").alias("miles"))


@query(sql("""
SELECT op_unique_carrier, count(*) AS flights, sum(air_time) AS air_minutes FROM flights
WHERE distance > 0 AND air_time > 0 GROUP BY 1"""))
def valid_flights(t: Tables) -> DataFrame:
    f = X.filter_valid(flights(t, "op_unique_carrier", "distance", "air_time"))
    return f.groupBy("op_unique_carrier").agg(rows_counted(), F.sum("air_time").alias("air_minutes"))


@query(sql("""
SELECT CAST(day_of_week AS BIGINT) AS day_of_week, CAST(month AS BIGINT) AS month, distance,
  CAST(CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CAST(CASE WHEN month IN (6, 7, 8) THEN 1 ELSE 0 END AS BIGINT) AS is_peak_summer,
  CAST(CASE WHEN distance < 0 THEN NULL WHEN distance <= 300 THEN 0 WHEN distance <= 800 THEN 1
    WHEN distance <= 1500 THEN 2 WHEN distance <= 3000 THEN 3 WHEN distance <= 6000 THEN 4 END AS BIGINT)
    AS distance_bucket,
  count(*) AS flights FROM flights GROUP BY ALL"""))
def predeparture_features(t: Tables) -> DataFrame:
    f = X.add_predeparture(flights(t, "day_of_week", "month", "distance"))
    return f.groupBy(*f.columns).agg(rows_counted())


@query(sql("""
SELECT distance, air_time, round(60 * distance / air_time, 6) AS speed_mph, count(*) AS flights
FROM flights GROUP BY ALL"""))
def flight_speed(t: Tables) -> DataFrame:
    f = flights(t, "distance", "air_time")
    return f.groupBy("distance", "air_time", S.speed_mph("distance", "air_time").alias("speed_mph")).agg(rows_counted())


@query(sql("""
SELECT CAST(CASE WHEN late_aircraft_delay > 0 THEN 1 ELSE 0 END AS BIGINT) AS late_aircraft_binary,
  CAST(CASE WHEN nas_delay > 0 THEN 1 ELSE 0 END AS BIGINT) AS nas_binary,
  count(*) AS flights FROM flights GROUP BY ALL"""))
def leaky_flags(t: Tables) -> DataFrame:
    f = X.add_post_departure_flags(flights(t, "late_aircraft_delay", "nas_delay"))
    return f.groupBy("late_aircraft_binary", "nas_binary").agg(rows_counted())


@query(sql("""
SELECT 'any' AS dropped_when, op_unique_carrier, count(*) AS flights FROM flights
WHERE dep_delay IS NOT NULL AND arr_delay IS NOT NULL AND distance IS NOT NULL AND air_time IS NOT NULL
GROUP BY ALL
UNION ALL
SELECT 'all', op_unique_carrier, count(*) FROM flights
WHERE dep_delay IS NOT NULL OR arr_delay IS NOT NULL GROUP BY ALL"""))
def drop_null_rows(t: Tables) -> DataFrame:
    f = flights(t, "op_unique_carrier", "dep_delay", "arr_delay", "distance", "air_time")
    rows = {
        "any": X.drop_null_rows(f, ["dep_delay", "arr_delay", "distance", "air_time"]),
        "all": X.drop_null_rows(f, ["dep_delay", "arr_delay"], how="all"),
    }
    parts = [
        df.groupBy(F.lit(how).alias("dropped_when"), "op_unique_carrier").agg(rows_counted()) for how, df in rows.items()
    ]
    return parts[0].unionByName(parts[1])


@query("""
SELECT text, TRY_CAST(text AS DOUBLE) AS number, count(*) AS orders FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS text
  FROM orders) GROUP BY ALL""")
def numeric_coerce(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise((key % 100).cast("string"))
    rows = t.read("orders").select(text.alias("text"))
    return rows.groupBy("text", S.to_number("text").alias("number")).agg(F.count("*").alias("orders"))


@query(sql("""
, route AS (SELECT op_unique_carrier, origin, dest, median(arr_delay) AS m FROM flights GROUP BY ALL),
carrier AS (SELECT op_unique_carrier, median(arr_delay) AS m FROM flights GROUP BY ALL)
SELECT op_unique_carrier, origin, dest, count(*) AS flights,
  round(sum(coalesce(arr_delay, route.m, carrier.m)), 6) AS imputed_minutes
FROM flights LEFT JOIN route USING (op_unique_carrier, origin, dest) LEFT JOIN carrier USING (op_unique_carrier)
GROUP BY ALL"""))
def impute_group_median(t: Tables) -> DataFrame:
    f = flights(t, "op_unique_carrier", "origin", "dest", "arr_delay")
    return A.impute_group_median(f).groupBy("op_unique_carrier", "origin", "dest").agg(
        rows_counted(), F.sum("arr_delay").alias("imputed_minutes")
    )


@query(sql("""
, s AS (SELECT avg(dep_delay) AS dm, stddev_pop(dep_delay) AS ds, avg(arr_delay) AS am,
    stddev_pop(arr_delay) AS asd, avg(distance) AS xm, stddev_pop(distance) AS xs,
    avg(air_time) AS tm, stddev_pop(air_time) AS tsd
  FROM flights WHERE dep_delay IS NOT NULL AND arr_delay IS NOT NULL AND air_time IS NOT NULL)
SELECT round((dep_delay - dm) / ds, 6) AS dep_delay, round((arr_delay - am) / asd, 6) AS arr_delay,
  round((distance - xm) / xs, 6) AS distance, round((air_time - tm) / tsd, 6) AS air_time,
  count(*) AS flights
FROM flights, s WHERE dep_delay IS NOT NULL AND arr_delay IS NOT NULL AND air_time IS NOT NULL
GROUP BY ALL"""))
def standard_scale(t: Tables) -> DataFrame:
    from delaylens.ml.isolation import FEATURES, standardize

    scaled = standardize(flights(t, *FEATURES).dropna(), FEATURES)
    rounded = scaled.select(*[F.round(c, 6).alias(c) for c in FEATURES])
    return rounded.groupBy(*FEATURES).agg(rows_counted())


# --- joins ----------------------------------------------------------------------------------


@query("""
SELECT event_id, CAST(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS BIGINT) AS is_anomaly
FROM events""")
def left_join_flags(t: Tables) -> DataFrame:
    events = t.read("events")
    scored = events.filter(F.col("event_type") == "error").select(
        "event_id", S.above("value", 100).alias("is_anomaly")
    )
    return J.attach_flag(events.select("event_id"), scored, "event_id", "is_anomaly")


@query(sql("""
SELECT origin, CAST(month AS BIGINT) AS month, count(*) AS flights FROM flights
WHERE origin IN (SELECT origin FROM flights GROUP BY origin ORDER BY count(*) DESC, origin LIMIT 5)
GROUP BY ALL"""))
def top_key_semi_join(t: Tables) -> DataFrame:
    f = flights(t, "origin", "month")
    busiest = top_k(f.groupBy("origin").agg(rows_counted()), "flights", 5, "origin")
    return J.keep_top_keys(f, busiest, "origin").groupBy("origin", "month").agg(rows_counted())


@query(sql("""
, c AS (SELECT month, op_unique_carrier, count(*) AS n FROM flights
  WHERE cancelled = 1 AND day_of_month = 31 GROUP BY ALL)
SELECT CAST(m.month AS BIGINT) AS month, k.op_unique_carrier, coalesce(c.n, 0) AS cancelled_flights
FROM range(1, 13) m(month) CROSS JOIN (SELECT DISTINCT op_unique_carrier FROM flights) k
LEFT JOIN c ON c.month = m.month AND c.op_unique_carrier = k.op_unique_carrier"""))
def zero_filled_counts(t: Tables) -> DataFrame:
    f = flights(t, "month", "op_unique_carrier", "cancelled", "day_of_month")
    hit = f.filter((F.col("cancelled") == 1) & (F.col("day_of_month") == 31))  # shorter months have none
    counts = hit.groupBy("month", "op_unique_carrier").agg(F.count("*").alias("cancelled_flights"))
    return J.zero_fill(counts, f, "op_unique_carrier", "month", A.MONTHS, {"cancelled_flights": 0})


@query(sql("""
SELECT day_of_month, flights FROM (
  SELECT CAST(day_of_month AS BIGINT) AS day_of_month, count(*) // 500 AS flights FROM flights GROUP BY 1)
ORDER BY flights DESC, day_of_month LIMIT 10"""))
def topk_tiebreak(t: Tables) -> DataFrame:
    days = flights(t, "day_of_month").groupBy("day_of_month").agg(
        F.floor(F.count("*") / 500).alias("flights")
    )
    return top_k(days, "flights", 10, "day_of_month")


# --- aggregates -----------------------------------------------------------------------------


@query(sql("""
SELECT round(avg(arr_delay), 6) AS mean_arr_delay,
  round(avg(CASE WHEN arr_delay > 15 THEN 1 ELSE 0 END), 6) AS delayed_share, count(*) AS flights
FROM flights"""))
def delay_kpis(t: Tables) -> DataFrame:
    return A.kpis(flights(t, "arr_delay"))


@query(sql("""
SELECT CAST(crs_dep_time // 100 AS BIGINT) AS dep_hour,
  round(avg(CASE WHEN arr_delay > 15 THEN 1 ELSE 0 END), 6) AS delay_rate FROM flights GROUP BY 1"""))
def delay_rate_by_hour(t: Tables) -> DataFrame:
    return A.delay_rate_by_hour(flights(t, "crs_dep_time", "arr_delay"))


@query(sql("""
SELECT origin, round(avg(arr_delay), 6) AS mean_arr_delay FROM flights
GROUP BY origin ORDER BY avg(arr_delay) DESC, origin LIMIT 15"""))
def top_delay_origins(t: Tables) -> DataFrame:
    return A.top_delay_origins(flights(t, "origin", "arr_delay"))


@query(sql("SELECT origin, " + ", ".join(
    f"round(avg(arr_delay) FILTER (WHERE month = {m}), 6) AS m{m:02d}" for m in range(1, 13)
) + """ FROM flights WHERE origin IN (
  SELECT origin FROM flights GROUP BY origin ORDER BY count(*) DESC, origin LIMIT 25) GROUP BY origin"""))
def origin_month_matrix(t: Tables) -> DataFrame:
    return A.origin_month_matrix(flights(t, "origin", "month", "arr_delay"), k=25)


@query(sql("SELECT CAST(month AS BIGINT) AS month, count(*) AS flight_count FROM flights GROUP BY 1"))
def monthly_volume(t: Tables) -> DataFrame:
    return A.monthly_volume(X.month_from_date(flights(t, "fl_date")))


@query(sql("""
, v AS (SELECT * FROM flights WHERE distance > 0 AND air_time > 0)
SELECT CAST(m.month AS BIGINT) AS month, k.op_unique_carrier, count(v.fl_date) AS flight_count
FROM (SELECT DISTINCT month FROM v) m CROSS JOIN (SELECT DISTINCT op_unique_carrier FROM flights) k
LEFT JOIN v ON v.month = m.month AND v.op_unique_carrier = k.op_unique_carrier GROUP BY ALL"""))
def monthly_carrier_volume(t: Tables) -> DataFrame:
    return A.monthly_carrier_volume(flights(t, "month", "op_unique_carrier", "distance", "air_time"))


ROUTE_RATE = """SELECT origin, dest, count(*) AS flights,
    round(avg(CASE WHEN arr_delay > 15 THEN 1 ELSE 0 END), 6) AS delay_rate
  FROM flights WHERE distance > 0 AND air_time > 0 GROUP BY ALL"""


@query(sql(f"SELECT * FROM ({ROUTE_RATE}) WHERE flights >= 50"))
def route_delay_rate(t: Tables) -> DataFrame:
    return A.route_delay(flights(t, "origin", "dest", "arr_delay", "distance", "air_time"), 50)


@query(sql(f"""
, r AS (SELECT * FROM ({ROUTE_RATE}) WHERE flights >= 100)
SELECT * FROM r
WHERE origin IN (SELECT origin FROM r GROUP BY origin ORDER BY sum(flights) DESC, origin LIMIT 20)
  AND dest IN (SELECT dest FROM r GROUP BY dest ORDER BY sum(flights) DESC, dest LIMIT 20)"""))
def top_airport_route_delay(t: Tables) -> DataFrame:
    busy = A.route_delay(flights(t, "origin", "dest", "arr_delay", "distance", "air_time"), 100)
    return A.within_top_airports(busy, "flights", 20)


@query(sql("""
SELECT op_unique_carrier, round(avg(coalesce(taxi_out, 0) + coalesce(taxi_in, 0)), 6) AS taxi_time
FROM flights GROUP BY 1"""))
def taxi_time_by_carrier(t: Tables) -> DataFrame:
    return A.taxi_time_by_carrier(flights(t, "op_unique_carrier", "taxi_out", "taxi_in"))


@query(sql("""
SELECT op_unique_carrier, count(*) AS flights, CAST(sum(cancelled) AS BIGINT) AS cancelled,
  round(sum(cancelled) / count(*), 6) AS cancel_rate FROM flights GROUP BY 1"""))
def cancel_rate_year(t: Tables) -> DataFrame:
    return A.cancel_rate(flights(t, "op_unique_carrier", "cancelled"))


@query(sql("""
SELECT op_unique_carrier, CAST(month AS BIGINT) AS month, count(*) AS flights,
  CAST(sum(cancelled) AS BIGINT) AS cancelled, round(sum(cancelled) / count(*), 6) AS cancel_rate
FROM flights GROUP BY ALL"""))
def cancel_rate_month(t: Tables) -> DataFrame:
    return A.cancel_rate_by_month(flights(t, "op_unique_carrier", "month", "cancelled"))


@query(sql("""
SELECT CAST(month AS BIGINT) AS month,
  count(*) FILTER (WHERE security_delay > 0) AS num_security_delayed_flights FROM flights GROUP BY ALL"""))
def security_delay_month(t: Tables) -> DataFrame:
    return A.security_delay_by_month(flights(t, "month", "security_delay"))


@query(sql("""
SELECT op_unique_carrier, count(*) AS total_flights,
  round(avg(CASE WHEN arr_delay <= 15 AND cancelled = 0 AND diverted = 0 THEN 1 ELSE 0 END), 6) AS on_time_rate,
  round(avg(cancelled), 6) AS cancel_rate, round(avg(diverted), 6) AS divert_rate
FROM flights GROUP BY 1"""))
def carrier_reliability(t: Tables) -> DataFrame:
    return A.carrier_reliability(flights(t, "op_unique_carrier", "arr_delay", "cancelled", "diverted"))


# A flag that SQL can state, in place of the forest's, for the anomaly reports.
FLAG = "dep_delay IS NOT NULL AND arr_delay IS NOT NULL AND air_time IS NOT NULL AND (dep_delay > 80 OR air_time < 35)"


def _flagged(t: Tables, *columns: str) -> DataFrame:
    f = flights(t, *dict.fromkeys(("dep_delay", "arr_delay", "distance", "air_time", *columns)))
    return f.filter(FLAG)


@query(sql(f"""
, a AS (SELECT * FROM flights WHERE {FLAG})
SELECT CAST(m.month AS BIGINT) AS month, k.op_unique_carrier, count(a.fl_date) AS anomaly_count
FROM (SELECT DISTINCT month FROM a) m CROSS JOIN (SELECT DISTINCT op_unique_carrier FROM flights) k
LEFT JOIN a ON a.month = m.month AND a.op_unique_carrier = k.op_unique_carrier GROUP BY ALL"""))
def anomaly_carrier_month(t: Tables) -> DataFrame:
    return A.anomalies_by_carrier_month(
        _flagged(t, "month", "op_unique_carrier"), flights(t, "op_unique_carrier")
    )


@query(sql(f"""
, q AS (SELECT quantile_cont(air_time, 0.01) AS low, quantile_cont(air_time, 0.99) AS high FROM flights)
SELECT CASE WHEN air_time < low THEN 'Abnormally Short Air Time'
    WHEN air_time > high THEN 'Abnormally Long Air Time' WHEN diverted = 1 THEN 'Diversion'
    WHEN cancelled = 1 THEN 'Cancellation' WHEN dep_delay > 90 THEN 'Extreme Departure Delay'
    WHEN arr_delay > 90 THEN 'Extreme Arrival Delay' WHEN 60 * distance / air_time < 150 THEN 'Unusually Slow'
    WHEN 60 * distance / air_time > 650 THEN 'Unrealistically Fast' ELSE 'Other / Data Quality' END AS anomaly_cause,
  count(*) AS anomalies
FROM flights, q WHERE {FLAG} GROUP BY ALL"""))
def anomaly_causes(t: Tables) -> DataFrame:
    limits = A.air_time_limits(flights(t, "air_time"))
    return A.anomaly_causes(_flagged(t, "cancelled", "diverted"), limits)


@query(sql(f"""
, a AS (SELECT * FROM flights WHERE {FLAG}),
top AS (SELECT origin FROM a GROUP BY origin ORDER BY count(*) DESC, origin LIMIT 10)
SELECT CAST(m.month AS BIGINT) AS month, top.origin, count(a.fl_date) AS anomaly_count
FROM (SELECT DISTINCT month FROM a) m CROSS JOIN top
LEFT JOIN a ON a.month = m.month AND a.origin = top.origin GROUP BY ALL"""))
def anomaly_origin_month(t: Tables) -> DataFrame:
    return A.anomalies_by_origin_month(_flagged(t, "month", "origin"), flights(t, "origin"))


CAUSE_SQL = {c: f"sum({c} / 60.0)" for c in A.CAUSES}


@query(sql("""
, h AS (SELECT """ + ", ".join(f"{e} AS {c}" for c, e in CAUSE_SQL.items()) + """ FROM flights),
l AS (UNPIVOT h ON """ + ", ".join(A.CAUSES) + """ INTO NAME c VALUE hours)
SELECT CASE c """ + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in S.CAUSE_LABELS.items()) + """ END AS delay_cause,
  round(hours, 6) AS total_hours, round(100 * hours / (SELECT sum(hours) FROM l), 6) AS percent_of_total FROM l"""))
def delay_cause_totals(t: Tables) -> DataFrame:
    return A.cause_totals(flights(t, *A.CAUSES))


@query(sql("SELECT CAST(month AS BIGINT) AS month, " + ", ".join(
    f"round({e}, 6) AS {c}" for c, e in CAUSE_SQL.items()) + " FROM flights GROUP BY 1"))
def delay_cause_month(t: Tables) -> DataFrame:
    return A.cause_hours(X.month_from_date(flights(t, "fl_date", *A.CAUSES)), "month")


@query(sql("SELECT op_unique_carrier, " + ", ".join(
    f"round({e}, 6) AS {c}" for c, e in CAUSE_SQL.items()) + " FROM flights GROUP BY 1"))
def delay_cause_carrier(t: Tables) -> DataFrame:
    return A.cause_hours(flights(t, "op_unique_carrier", *A.CAUSES), "op_unique_carrier")


@query(sql("SELECT op_unique_carrier, " + ", ".join(
    f"round(100 * {e} / sum(({' + '.join(A.CAUSES)}) / 60.0), 6) AS {c}" for c, e in CAUSE_SQL.items()
) + " FROM flights GROUP BY 1"))
def delay_cause_share(t: Tables) -> DataFrame:
    return A.cause_shares(flights(t, "op_unique_carrier", *A.CAUSES))


@query(sql("""
SELECT origin, dest, count(*) AS flight_count FROM flights GROUP BY ALL
ORDER BY flight_count DESC, origin, dest LIMIT 15"""))
def busiest_routes(t: Tables) -> DataFrame:
    return A.busiest_routes(flights(t, "origin", "dest"))


@query(sql("""
, r AS (SELECT origin, dest, count(*) AS n FROM flights GROUP BY ALL HAVING count(*) >= 100),
k AS (SELECT * FROM r
  WHERE origin IN (SELECT origin FROM r GROUP BY origin ORDER BY sum(n) DESC, origin LIMIT 20)
    AND dest IN (SELECT dest FROM r GROUP BY dest ORDER BY sum(n) DESC, dest LIMIT 20))
SELECT o.origin, d.dest, coalesce(k.n, 0) AS flight_count
FROM (SELECT DISTINCT origin FROM k) o CROSS JOIN (SELECT DISTINCT dest FROM k) d
LEFT JOIN k ON k.origin = o.origin AND k.dest = d.dest"""))
def route_volume_matrix(t: Tables) -> DataFrame:
    """The zero-filled matrix, its columns listed as rows so that they can be named beforehand."""
    wide = A.matrix(materialize(A.route_volume(flights(t, "origin", "dest"))), "flight_count", fill=0)
    cells = [c for c in wide.columns if c != "origin"]
    return wide.unpivot("origin", cells, "dest", "flight_count") if cells else wide.selectExpr("origin", "origin AS dest", "0L AS flight_count")


@query(sql("""
SELECT airport, departures, arrivals, departures + arrivals AS total_activity FROM (
  SELECT coalesce(o.origin, d.dest) AS airport, coalesce(o.n, 0) AS departures, coalesce(d.n, 0) AS arrivals
  FROM (SELECT origin, count(*) AS n FROM flights GROUP BY 1) o
  FULL JOIN (SELECT dest, count(*) AS n FROM flights GROUP BY 1) d ON o.origin = d.dest)
ORDER BY total_activity DESC, airport LIMIT 25"""))
def airport_activity(t: Tables) -> DataFrame:
    return A.airport_activity(flights(t, "origin", "dest"), k=25)


@query(sql("""
SELECT op_unique_carrier, max(miles) AS max_daily_carrier_distance, round(max(miles) / 1000, 6) AS distance_kmiles
FROM (SELECT op_unique_carrier, fl_date, sum(distance) AS miles FROM flights
      WHERE distance > 0 AND air_time > 0 GROUP BY ALL)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def max_daily_carrier_distance(t: Tables) -> DataFrame:
    return A.max_daily_carrier_distance(flights(t, "op_unique_carrier", "fl_date", "distance", "air_time"))


@query(sql("""
SELECT concat(origin, '-', dest) AS route, count(*) AS flight_count FROM flights GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 20"""))
def top_routes_year(t: Tables) -> DataFrame:
    return A.top_routes(flights(t, "origin", "dest"))


@query(sql("""
, r AS (SELECT *, concat(origin, '-', dest) AS route FROM flights)
SELECT CAST(month AS BIGINT) AS month, route, count(*) AS flight_count FROM r
WHERE route IN (SELECT route FROM r GROUP BY 1 ORDER BY count(*) DESC, route LIMIT 20) GROUP BY ALL"""))
def top_routes_month(t: Tables) -> DataFrame:
    return A.top_routes_by_month(flights(t, "month", "origin", "dest"))


@query(sql("""
, v AS (SELECT op_unique_carrier, 60 * distance / air_time AS speed FROM flights
  WHERE distance > 0 AND air_time > 0),
q AS (SELECT op_unique_carrier, quantile_cont(speed, 0.25) AS q1, quantile_cont(speed, 0.5) AS median,
    quantile_cont(speed, 0.75) AS q3 FROM v GROUP BY 1)
SELECT op_unique_carrier, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3,
  round(min(speed) FILTER (WHERE speed BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(speed) FILTER (WHERE speed BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) AS flights
FROM v JOIN q USING (op_unique_carrier) GROUP BY 1"""))
def speed_distribution(t: Tables) -> DataFrame:
    return A.speed_distribution(flights(t, "op_unique_carrier", "distance", "air_time"))


@query()
def distance_delay_sample(t: Tables) -> DataFrame:
    columns = ("distance", "arr_delay", "op_unique_carrier", "air_time", "fl_date", "crs_dep_time", "taxi_out")
    valid = X.filter_valid(flights(t, *columns))
    return sample_n(valid, 10_000, list(columns)).select("distance", "arr_delay", "op_unique_carrier")


# --- daily series ---------------------------------------------------------------------------

DAILY_SQL = """
, daily AS (
  SELECT fl_date, avg(arr_delay) AS mean_delay, coalesce(stddev_samp(arr_delay), 0) AS std_delay,
    count(*) AS flight_count, avg(cancelled) AS cancel_rate,
    isodow(fl_date) - 1 AS day_of_week, dayofyear(fl_date) AS day_of_year
  FROM flights WHERE arr_delay IS NOT NULL GROUP BY fl_date)"""
DAILY_OUT = """SELECT strftime(fl_date, '%Y-%m-%d') AS fl_date, round(mean_delay, 6) AS mean_delay,
  round(std_delay, 6) AS std_delay, flight_count, round(cancel_rate, 6) AS cancel_rate,
  CAST(day_of_week AS BIGINT) AS day_of_week, CAST(day_of_year AS BIGINT) AS day_of_year"""


def _daily(t: Tables) -> DataFrame:
    return A.daily_delay(flights(t, "fl_date", "arr_delay", "cancelled"))


@query(sql(DAILY_SQL + DAILY_OUT + " FROM daily"))
def daily_delay(t: Tables) -> DataFrame:
    return _daily(t)


@query(sql(DAILY_SQL + """
, w AS (SELECT *, avg(mean_delay) OVER (ORDER BY fl_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a3,
    avg(mean_delay) OVER (ORDER BY fl_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS a7,
    row_number() OVER (ORDER BY fl_date) AS rn FROM daily)
""" + DAILY_OUT + ", round(a3, 6) AS delay_3d_avg, round(a7, 6) AS delay_7d_avg FROM w WHERE rn >= 7"))
def daily_rolling(t: Tables) -> DataFrame:
    return A.add_rolling(_daily(t))


@query(sql(DAILY_SQL + """
, w AS (SELECT *, avg(mean_delay) OVER (ORDER BY fl_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a3,
    avg(mean_delay) OVER (ORDER BY fl_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS a7,
    row_number() OVER (ORDER BY fl_date) AS rn FROM daily)
""" + DAILY_OUT + ", round(a3, 6) AS delay_3d_avg, round(a7, 6) AS delay_7d_avg FROM w WHERE rn >= 8"))
def daily_rolling_prior(t: Tables) -> DataFrame:
    return A.add_rolling(_daily(t), include_current=False)


@query(sql(DAILY_SQL + ", w AS (SELECT *, " + ", ".join(
    f"lag(mean_delay, {k}) OVER (ORDER BY fl_date) AS l{k}" for k in (1, 2, 3, 7)
) + " FROM daily) " + DAILY_OUT + "".join(
    f", round(l{k}, 6) AS lag{k}_delay" for k in (1, 2, 3, 7)) + " FROM w WHERE l7 IS NOT NULL"))
def daily_lags(t: Tables) -> DataFrame:
    return A.add_lags(_daily(t))
