"""SQL text of the domain views, for the check queries."""

FLIGHTS = """
lines AS (
  SELECT *, (l_returnflag = 'R' AND l_linenumber = 7) AS is_c,
         (l_returnflag = 'A' AND l_linenumber = 6 AND l_linestatus = 'O') AS is_v,
         l_quantity * 3 - 100 + CASE WHEN l_partkey % 40 = 0 THEN 120 ELSE 0 END AS base
  FROM lineitem),
timed AS (
  SELECT *, CASE WHEN is_c OR is_v THEN NULL ELSE base + l_linenumber - 4 END AS arr FROM lines),
flights AS (
  SELECT CAST(l_shipdate AS DATE) AS fl_date,
    year(l_shipdate) AS year, month(l_shipdate) AS month, day(l_shipdate) AS day_of_month,
    isodow(CAST(l_shipdate AS DATE)) AS day_of_week,
    concat('C', l_suppkey % 15) AS op_unique_carrier,
    so.n_name AS origin, cu.n_name AS dest,
    CAST((l_partkey % 24) * 100 + l_orderkey % 60 AS INTEGER) AS crs_dep_time,
    CAST(((l_partkey + 2) % 24) * 100 + l_orderkey % 60 AS INTEGER) AS crs_arr_time,
    CASE WHEN is_c THEN 1 ELSE 0 END AS cancelled, CASE WHEN is_v THEN 1 ELSE 0 END AS diverted,
    CASE WHEN is_c THEN NULL ELSE base END AS dep_delay, arr AS arr_delay,
    CAST(100 + (l_partkey % 50) * 100 AS DOUBLE) AS distance,
    CASE WHEN is_c OR is_v THEN NULL ELSE CAST(20 + (l_partkey % 50) * 12 + l_linenumber AS DOUBLE) END AS air_time,
    CASE WHEN is_c THEN NULL ELSE CAST(10 + l_orderkey % 20 AS DOUBLE) END AS taxi_out,
    CASE WHEN is_c THEN NULL ELSE CAST(3 + l_partkey % 9 AS DOUBLE) END AS taxi_in,
    CASE WHEN arr > 15 AND l_linenumber IN (1, 2) THEN CAST(arr AS INTEGER) ELSE 0 END AS carrier_delay,
    CASE WHEN arr > 15 AND l_linenumber = 3 THEN CAST(arr AS INTEGER) ELSE 0 END AS weather_delay,
    CASE WHEN arr > 15 AND l_linenumber = 4 THEN CAST(arr AS INTEGER) ELSE 0 END AS nas_delay,
    CASE WHEN arr > 15 AND l_linenumber = 5 THEN CAST(arr AS INTEGER) ELSE 0 END AS security_delay,
    CASE WHEN arr > 15 AND l_linenumber IN (6, 7) THEN CAST(arr AS INTEGER) ELSE 0 END AS late_aircraft_delay
  FROM timed
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cu ON c_nationkey = cu.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation so ON s_nationkey = so.n_nationkey)"""

TRANSIT = """
feed AS (
  SELECT event_id AS _id,
    CASE event_type WHEN 'error' THEN 'subway' WHEN 'signup' THEN 'streetcar' ELSE 'bus' END AS mode,
    CASE event_id % 4
      WHEN 0 THEN concat('stop ', user_id % 20, ' Station')
      WHEN 1 THEN concat('STOP ', user_id % 20, ' STN')
      WHEN 2 THEN concat('  Stop  ', user_id % 20, ' and King')
      ELSE concat('Stop ', user_id % 20, ' Platform') END AS station,
    concat('K', CAST(json_extract_string(props, '$.k') AS INTEGER) % 8) AS code,
    concat('L', user_id % 3) AS line, value AS min_delay,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS min_gap, ts AS timestamp
  FROM events),
keyed AS (
  SELECT *, regexp_replace(trim(regexp_replace(upper(station), '\\s+', ' ', 'g')),
                           '( STATION| STN| PLATFORM| AND .*)', '', 'g') AS station_key
  FROM feed),
transit AS (SELECT * FROM keyed WHERE timestamp IS NOT NULL AND station_key <> ''),
subway AS (SELECT * FROM transit WHERE mode = 'subway'),
surface AS (SELECT * FROM transit WHERE mode <> 'subway')"""

CODEBOOK = """
codebook AS (
  SELECT code, arg_max(description, ord) AS description FROM (
    SELECT concat('K', n_nationkey % 7) AS code, n_name AS description, n_nationkey AS ord
    FROM nation)
  GROUP BY code)"""

INCIDENTS = (
    TRANSIT
    + """,
incidents AS (
  SELECT s._id AS subway_id, s.station_key, s.timestamp AS subway_timestamp, s.code AS subway_code,
    s.line AS subway_line, s.min_delay AS subway_delay,
    count(f._id) AS matched_surface_events,
    coalesce(round(sum(f.min_delay), 6), 0) AS matched_surface_delay,
    coalesce(date_diff('microsecond', s.timestamp, max(f.timestamp)) / 60e6, 0) AS max_offset_minutes,
    count(f._id) FILTER (WHERE f.mode = 'bus') AS bus_hits,
    count(f._id) FILTER (WHERE f.mode = 'streetcar') AS streetcar_hits
  FROM subway s
  LEFT JOIN surface f ON f.station_key = s.station_key AND f.timestamp >= s.timestamp
    AND f.timestamp <= s.timestamp + INTERVAL 60 MINUTE
  WHERE s.station_key IN (SELECT station_key FROM surface)
    AND s.station_key NOT LIKE '%TORONTO TRANSIT%'
  GROUP BY s._id, s.station_key, s.timestamp, s.code, s.line, s.min_delay)"""
)

IMPACTS = (
    INCIDENTS
    + """,
impacts AS (
  SELECT station_key, count(*) AS subway_incidents,
    CAST(sum(matched_surface_events) AS BIGINT) AS surface_events_in_window,
    CAST(sum(CAST(matched_surface_delay AS DECIMAL(18, 9))) AS DOUBLE) AS surface_delay_minutes,
    CAST(sum(bus_hits) AS BIGINT) AS bus_hits, CAST(sum(streetcar_hits) AS BIGINT) AS streetcar_hits,
    CAST(sum(CAST(subway_delay AS DECIMAL(18, 9))) AS DOUBLE) / count(subway_delay) AS avg_subway_delay,
    sum(matched_surface_events) / count(*) AS surface_events_per_subway,
    CAST(sum(CAST(matched_surface_delay AS DECIMAL(18, 9))) AS DOUBLE) / count(*) AS avg_surface_delay_per_subway
  FROM incidents GROUP BY station_key HAVING sum(matched_surface_events) > 0)"""
)

TRAVEL = """
readings AS (
  SELECT event_id AS reading_id, concat('S', user_id % 30) AS resultId, value AS timeInSeconds,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS "count", ts AS updated, year(ts) AS year,
    ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto' AS updated_local
  FROM events),
travel AS (
  SELECT *, hour(updated_local) AS hour, dayname(updated_local) AS dow,
    strftime(updated_local, '%Y-%m') AS month FROM readings)"""


def r6(expr: str) -> str:
    """Round a double half up in decimal, for figures that often end in an exact half."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28, 12)), 6) AS DOUBLE)"


def with_views(views: str, body: str) -> str:
    return f"WITH {views.strip()}\n{body.strip()}"
