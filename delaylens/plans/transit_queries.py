"""Queries over the transit feeds and the follow-on delays between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.functions import scalars as S
from delaylens.ml import ordered_targets as T
from delaylens.operators import evaluate as E
from delaylens.operators import ripple as R
from delaylens.operators.ordered import top_k
from delaylens.operators import sampling as H
from delaylens.plans.check_views import CODEBOOK, IMPACTS, INCIDENTS, TRANSIT, r6, with_views
from delaylens.plans.registry import half_up, query, tidy
from delaylens.session import materialize
from delaylens.sources.readers import merge_codebook, union_feeds
from delaylens.sources.tables import Tables, code_files, subway, surface, transit, transit_raw

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def feed_sql(body: str) -> str:
    return with_views(TRANSIT, body)


def incident_sql(body: str) -> str:
    return with_views(INCIDENTS, body)


def impact_sql(body: str) -> str:
    return with_views(IMPACTS, body)


def found(t: Tables) -> DataFrame:
    return R.incidents(subway(t), surface(t))


def codebook(t: Tables) -> DataFrame:
    return merge_codebook(code_files(t))


# --- cleaning ---------------------------------------------------------------------------------


@query(feed_sql(f"""
SELECT _id, mode, station, station_key, code, line, min_delay, min_gap,
  strftime(timestamp, {STAMP}) AS timestamp FROM transit"""))
def transit_clean(t: Tables) -> DataFrame:
    return transit(t).select(
        "_id", "mode", "station", "station_key", "code", "line", "min_delay", "min_gap", "timestamp"
    )


@query(feed_sql("SELECT mode, station_key, count(*) AS events FROM surface GROUP BY ALL"))
def surface_union(t: Tables) -> DataFrame:
    feed = transit(t)
    both = union_feeds(feed.filter(F.col("mode") == "bus"), feed.filter(F.col("mode") == "streetcar").drop("min_gap"))
    return both.groupBy("mode", "station_key").agg(F.count("*").alias("events"))


@query(with_views(CODEBOOK, "SELECT code, description FROM codebook"))
def codebook_last_wins(t: Tables) -> DataFrame:
    return codebook(t)


@query(feed_sql("SELECT station, station_key, count(*) AS events FROM keyed GROUP BY ALL"))
def normalize_station(t: Tables) -> DataFrame:
    return (
        transit_raw(t)
        .groupBy("station", S.normalize_station("station").alias("station_key"))
        .agg(F.count("*").alias("events"))
    )


@query(f"""
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(
    date_trunc('minute', ts) AT TIME ZONE 'America/Toronto' AT TIME ZONE 'UTC', {STAMP}) END AS utc
FROM events""")
def combine_datetime(t: Tables) -> DataFrame:
    clock = F.when(F.col("event_id") % 10 == 0, "25:99").otherwise(F.date_format("ts", "HH:mm"))
    return t.read("events").select(
        "event_id", S.combine_datetime(F.date_format("ts", "yyyy-MM-dd"), clock).alias("utc")
    )


@query(feed_sql("""
SELECT CAST(hour(timestamp) AS BIGINT) AS hour, dayname(timestamp) AS day_name,
  CAST(CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CAST(month(timestamp) AS BIGINT) AS month, CAST(quarter(timestamp) AS BIGINT) AS quarter,
  CAST(week(timestamp) AS BIGINT) AS weekofyear,
  CAST(hour(timestamp) * 60 + minute(timestamp) AS BIGINT) AS minute_of_day, count(*) AS events
FROM subway GROUP BY ALL"""))
def incident_calendar(t: Tables) -> DataFrame:
    parts = [c.alias(n) for n, c in S.incident_calendar("timestamp").items()]
    return subway(t).groupBy(*parts).agg(F.count("*").alias("events"))


@query("""
SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii_chars,
  md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii_md5 FROM documents""")
def clean_ascii(t: Tables) -> DataFrame:
    text = S.clean_ascii("text")
    return t.read("documents").select(
        "doc_id", F.length(text).alias("ascii_chars"), F.md5(text).alias("ascii_md5")
    )


# --- matching -----------------------------------------------------------------------------------


@query(feed_sql(f"""
SELECT s._id AS subway_id, s.station_key, strftime(s.timestamp, {STAMP}) AS subway_timestamp,
  s.code AS subway_code, s.line AS subway_line, strftime(f.timestamp, {STAMP}) AS surface_timestamp,
  f.mode, f.min_delay AS surface_delay, f.min_gap AS surface_gap, f.line AS surface_line,
  f.station_key AS surface_station_key, f.code AS surface_code,
  {r6("date_diff('microsecond', s.timestamp, f.timestamp) / 60e6")} AS offset_minutes
FROM subway s JOIN surface f ON f.station_key = s.station_key AND f.timestamp >= s.timestamp
  AND f.timestamp <= s.timestamp + INTERVAL 60 MINUTE
WHERE s.station_key NOT LIKE '%TORONTO TRANSIT%'"""), ready=True)
def ripple_matches(t: Tables) -> DataFrame:
    return R.matched_pairs(subway(t), surface(t), form=tidy)


@query(incident_sql(f"""
SELECT subway_id, station_key, strftime(subway_timestamp, {STAMP}) AS subway_timestamp, subway_code,
  subway_line, subway_delay, matched_surface_events, matched_surface_delay,
  {r6('max_offset_minutes')} AS max_offset_minutes, bus_hits, streetcar_hits FROM incidents"""))
def ripple_incidents(t: Tables) -> DataFrame:
    return found(t).drop("_raw_delay")


@query(incident_sql("""
SELECT CAST(CASE WHEN matched_surface_delay > 0 THEN 1 ELSE 0 END AS BIGINT) AS ripple_label,
  CAST(CASE WHEN matched_surface_delay >= 60 OR matched_surface_events >= 3 OR max_offset_minutes >= 30
    THEN 1 ELSE 0 END AS BIGINT) AS severe_label,
  subway_code, count(*) AS incidents FROM incidents GROUP BY ALL"""))
def ripple_labels(t: Tables) -> DataFrame:
    rows = R.labelled(found(t))
    return rows.groupBy("ripple_label", "severe_label", "subway_code").agg(F.count("*").alias("incidents"))


# --- station reports ------------------------------------------------------------------------------


@query(impact_sql("""
SELECT station_key, subway_incidents, surface_events_in_window,
  round(surface_delay_minutes, 6) AS surface_delay_minutes, bus_hits, streetcar_hits,
  round(avg_subway_delay, 6) AS avg_subway_delay,
  round(surface_events_per_subway, 6) AS surface_events_per_subway,
  round(avg_surface_delay_per_subway, 6) AS avg_surface_delay_per_subway FROM impacts"""))
def station_impacts(t: Tables) -> DataFrame:
    return R.station_impacts(found(t)).orderBy(F.desc("surface_events_per_subway"), "station_key")


TOP_CODES = """
, counts AS (SELECT station_key, subway_code, count(*) AS n FROM incidents GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY n DESC, subway_code) AS rn FROM counts),
top AS (
  SELECT station_key, string_agg(concat(subway_code, ': ', coalesce(description, 'Unknown')), '; ' ORDER BY rn)
    AS top_codes
  FROM ranked LEFT JOIN codebook ON code = subway_code WHERE rn <= 3 GROUP BY station_key)"""


@query(with_views(INCIDENTS + ",\n" + CODEBOOK.strip(), TOP_CODES + "SELECT station_key, top_codes FROM top"))
def station_top_codes(t: Tables) -> DataFrame:
    return R.station_top_codes(found(t), codebook(t))


@query(with_views(IMPACTS + ",\n" + CODEBOOK.strip(), TOP_CODES + """
SELECT i.station_key, i.subway_incidents, printf('%.2f', surface_events_per_subway) AS events_per_subway,
  printf('%.1f', avg_surface_delay_per_subway) AS delay_per_subway, bus_hits, streetcar_hits,
  printf('%.1f', avg_subway_delay) AS subway_delay, top_codes
FROM impacts i JOIN top USING (station_key)
ORDER BY surface_events_per_subway DESC, station_key LIMIT 10"""))
def formatted_station_report(t: Tables) -> DataFrame:
    rows = materialize(found(t))
    best = top_k(R.station_impacts(rows), "surface_events_per_subway", 10, "station_key")
    named = best.join(R.station_top_codes(rows, codebook(t)), "station_key")
    return named.select(
        "station_key", "subway_incidents",
        S.fixed("surface_events_per_subway", 2).alias("events_per_subway"),
        S.fixed("avg_surface_delay_per_subway", 1).alias("delay_per_subway"),
        "bus_hits", "streetcar_hits", S.fixed("avg_subway_delay", 1).alias("subway_delay"), "top_codes",
    )


@query(impact_sql("""
SELECT (SELECT count(*) FROM subway) AS subway_incidents, (SELECT count(*) FROM surface) AS surface_events,
  count(*) AS stations_linked,
  round(quantile_cont(surface_events_per_subway, 0.5), 6) AS median_events_per_subway,
  round(quantile_cont(avg_surface_delay_per_subway, 0.5), 6) AS median_delay_per_subway,
  round(sum(bus_hits) / sum(surface_events_in_window), 6) AS bus_share,
  arg_max(station_key, surface_events_per_subway) AS top_station,
  round(max(surface_events_per_subway), 6) AS top_events_per_subway,
  round(arg_max(avg_surface_delay_per_subway, surface_events_per_subway), 6) AS top_delay_per_subway,
  arg_max(station_key, avg_surface_delay_per_subway) AS peak_delay_station,
  round(max(avg_surface_delay_per_subway), 6) AS peak_delay_per_subway FROM impacts"""))
def ripple_headline(t: Tables) -> DataFrame:
    return R.headline(subway(t), surface(t), materialize(R.station_impacts(found(t))))


FOCUS = """
, focus AS (SELECT station_key, surface_events_in_window FROM impacts
  ORDER BY surface_events_in_window DESC, station_key LIMIT 1)"""
BUSY_DAY = FOCUS + """
, day AS (SELECT station_key, CAST(subway_timestamp AS DATE) AS day,
    CAST(sum(matched_surface_events) AS BIGINT) AS pairs
  FROM incidents WHERE station_key IN (SELECT station_key FROM focus) AND matched_surface_events > 0
  GROUP BY ALL ORDER BY pairs DESC, day LIMIT 1)"""


@query(impact_sql(FOCUS + "SELECT * FROM focus"))
def focus_station(t: Tables) -> DataFrame:
    return R.focus_station(R.station_impacts(found(t)))


@query(impact_sql(BUSY_DAY + "SELECT station_key, strftime(day, '%Y-%m-%d') AS day, pairs FROM day"))
def busiest_day(t: Tables) -> DataFrame:
    rows = materialize(found(t))
    return R.busiest_day(rows, R.focus_station(R.station_impacts(rows)))


@query(impact_sql(BUSY_DAY + f"""
, own AS (SELECT i.* FROM incidents i JOIN day d
  ON i.station_key = d.station_key AND CAST(subway_timestamp AS DATE) = d.day),
pairs AS (SELECT f.timestamp, f.min_delay FROM own o JOIN surface f ON f.station_key = o.station_key
  AND f.timestamp >= o.subway_timestamp AND f.timestamp <= o.subway_timestamp + INTERVAL 60 MINUTE),
a AS (SELECT time_bucket(INTERVAL 15 MINUTE, subway_timestamp) AS slot, count(*) AS n FROM own GROUP BY 1),
b AS (SELECT time_bucket(INTERVAL 15 MINUTE, timestamp) AS slot, count(*) AS n, sum(min_delay) AS m
  FROM pairs GROUP BY 1),
ends AS (SELECT min(x) AS lo, max(x) AS hi FROM (
  SELECT subway_timestamp AS x FROM own UNION ALL SELECT timestamp FROM pairs)),
grid AS (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, lo),
    CASE WHEN time_bucket(INTERVAL 15 MINUTE, hi) = hi THEN hi
      ELSE time_bucket(INTERVAL 15 MINUTE, hi) + INTERVAL 15 MINUTE END, INTERVAL 15 MINUTE)) AS slot FROM ends)
SELECT (SELECT station_key FROM day) AS station_key, strftime(grid.slot, {STAMP}) AS slot,
  coalesce(a.n, 0) AS subway_incidents, coalesce(b.n, 0) AS surface_events,
  round(coalesce(m, 0), 6) AS surface_delay,
  round(sum(coalesce(m, 0)) OVER (ORDER BY grid.slot), 6) AS cumulative_delay
FROM grid LEFT JOIN a ON a.slot = grid.slot LEFT JOIN b ON b.slot = grid.slot"""))
def ripple_timeline(t: Tables) -> DataFrame:
    rows = materialize(found(t))
    day = R.busiest_day(rows, R.focus_station(R.station_impacts(rows)))
    return R.timeline(rows, surface(t), day)


@query(with_views(INCIDENTS + ",\n" + CODEBOOK.strip(), """
SELECT subway_code, count(subway_id) AS total_incidents,
  round(avg(CASE WHEN matched_surface_events > 0 THEN 1 ELSE 0 END), 6) AS share_with_surface,
  round(avg(matched_surface_events), 6) AS avg_surface_events,
  round(avg(matched_surface_delay), 6) AS avg_surface_delay,
  concat(subway_code, ' - ', coalesce(any_value(description), 'Unknown')) AS label
FROM incidents LEFT JOIN codebook ON code = subway_code GROUP BY subway_code
HAVING count(subway_id) >= 30 ORDER BY avg(matched_surface_events) DESC, subway_code LIMIT 12"""))
def ripple_by_code(t: Tables) -> DataFrame:
    return R.by_code(found(t), codebook(t))


@query(incident_sql("""
SELECT CAST(isodow(subway_timestamp) - 1 AS BIGINT) AS weekday_no, dayname(subway_timestamp) AS day_name, """
    + ", ".join(
        f"CAST(coalesce(sum(matched_surface_events) FILTER (WHERE hour(subway_timestamp) = {h}), 0) AS BIGINT)"
        f" AS h{h:02d}" for h in range(24))
    + " FROM incidents WHERE matched_surface_events > 0 GROUP BY 1, 2"))
def ripple_dow_hour(t: Tables) -> DataFrame:
    return R.weekday_hour_matrix(found(t))


@query(incident_sql("""
SELECT CAST(isodow(subway_timestamp) - 1 AS BIGINT) AS weekday_no, dayname(subway_timestamp) AS day_name,
  CAST(hour(subway_timestamp) AS BIGINT) AS hour, CAST(sum(matched_surface_events) AS BIGINT) AS events
FROM incidents WHERE matched_surface_events > 0 GROUP BY ALL ORDER BY events DESC, weekday_no, hour LIMIT 1"""))
def ripple_peak_slot(t: Tables) -> DataFrame:
    return R.peak_slot(found(t))


@query(incident_sql(f"""
SELECT station_key, {r6('avg(max_offset_minutes)')} AS avg_recovery_minutes FROM incidents
WHERE matched_surface_events > 0 GROUP BY 1 ORDER BY avg(max_offset_minutes) DESC, 1 LIMIT 10"""))
def ripple_recovery(t: Tables) -> DataFrame:
    return R.recovery(found(t))


@query(impact_sql("""
SELECT 'ratio' AS list, station_key, bus_hits, streetcar_hits FROM (
  SELECT * FROM impacts ORDER BY surface_events_per_subway DESC, station_key LIMIT 10)
UNION ALL
SELECT 'added delay', station_key, bus_hits, streetcar_hits FROM (
  SELECT * FROM impacts ORDER BY avg_surface_delay_per_subway DESC, station_key LIMIT 6)"""))
def station_mode_mix(t: Tables) -> DataFrame:
    rows = materialize(R.station_impacts(found(t)))
    lists = {
        "ratio": top_k(rows, "surface_events_per_subway", 10, "station_key"),
        "added delay": top_k(rows, "avg_surface_delay_per_subway", 6, "station_key"),
    }
    parts = [
        df.select(F.lit(n).alias("list"), "station_key", "bus_hits", "streetcar_hits") for n, df in lists.items()
    ]
    return parts[0].unionByName(parts[1])


# --- history features -------------------------------------------------------------------------------

HIST = """
, d AS (SELECT subway_id AS incident_id, station_key, subway_timestamp, subway_code, subway_line, subway_delay,
    matched_surface_delay AS delay, matched_surface_events AS events, max_offset_minutes AS linger
  FROM incidents),
g AS (SELECT avg(delay) AS delay, avg(events) AS events, avg(linger) AS linger FROM d)"""


def _over(key: str, frame: str = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING") -> str:
    part = f"PARTITION BY {key} " if key else ""
    return f"OVER ({part}ORDER BY subway_timestamp, incident_id {frame})"


def _prev(value: str, key: str) -> str:
    # Sums are decimal on both sides, so that they do not depend on the order of addition.
    over = _over("d." + key)
    total = f"CAST(sum(CAST(d.{value} AS DECIMAL(28, 18))) {over} AS DOUBLE)"
    return r6(f"coalesce({total} / count(*) {over}, g.{value})")


GLOBAL_MEAN = r6(
    f"coalesce(CAST(sum(CAST(d.delay AS DECIMAL(28, 18))) {_over('')} AS DOUBLE) / count(*) {_over('')}, 0)"
)

MEANS = {
    "station_prev_delay_mean": ("delay", "station_key"), "station_prev_events_mean": ("events", "station_key"),
    "station_prev_linger_mean": ("linger", "station_key"), "code_prev_delay_mean": ("delay", "subway_code"),
    "code_prev_events_mean": ("events", "subway_code"), "line_prev_delay_mean": ("delay", "subway_line"),
}
COUNTS = {"station_prev_incidents": "station_key", "code_prev_incidents": "subway_code",
          "line_prev_incidents": "subway_line"}


def _history(t: Tables, *kinds: str) -> DataFrame:
    base = materialize(R.labelled(found(t)))
    return R.add_history(base, R.target_means(base), kinds=kinds or ("station", "code", "line"))


@query(incident_sql(HIST + "SELECT incident_id, " + ", ".join(
    f"{_prev(v, k)} AS {n}" for n, (v, k) in MEANS.items()) + " FROM d, g"))
def prior_means(t: Tables) -> DataFrame:
    return half_up(_history(t).select("incident_id", *MEANS), *MEANS)


@query(incident_sql(HIST + f"""
SELECT incident_id, round(coalesce(sum(delay) {_over('station_key')}, 0), 6) AS station_prev_delay_total FROM d"""))
def prior_totals(t: Tables) -> DataFrame:
    return _history(t, "station").select("incident_id", "station_prev_delay_total")


@query(incident_sql(HIST + "SELECT incident_id, " + ", ".join(
    f"row_number() {_over(k, '')} - 1 AS {n}" for n, k in COUNTS.items()) + " FROM d"))
def prior_counts(t: Tables) -> DataFrame:
    return _history(t).select("incident_id", *COUNTS)


LAST3 = "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"


@query(incident_sql(HIST + f"""
SELECT incident_id, round(coalesce(avg(d.delay) {_over('station_key', LAST3)}, g.delay), 6) AS recent_station_delay_3,
  round(coalesce(avg(d.events) {_over('station_key', LAST3)}, g.events), 6) AS recent_station_events_3
FROM d, g"""))
def recent_means(t: Tables) -> DataFrame:
    return R.add_recent(_history(t, "station")).select(
        "incident_id", "recent_station_delay_3", "recent_station_events_3"
    )


@query(incident_sql(HIST + f"""
SELECT incident_id, {GLOBAL_MEAN} AS global_prev_delay FROM d"""))
def global_prior_mean(t: Tables) -> DataFrame:
    rows = R.add_global_history(R.labelled(found(t))).select("incident_id", "global_prev_delay")
    return half_up(rows, "global_prev_delay")


@query(incident_sql(HIST + f"""
SELECT incident_id, station_key, strftime(subway_timestamp, {STAMP}) AS subway_timestamp, subway_code,
  subway_line, subway_delay, CAST(hour(subway_timestamp) AS BIGINT) AS hour,
  dayname(subway_timestamp) AS day_name,
  CAST(CASE WHEN isodow(subway_timestamp) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  CAST(month(subway_timestamp) AS BIGINT) AS month, CAST(quarter(subway_timestamp) AS BIGINT) AS quarter,
  CAST(week(subway_timestamp) AS BIGINT) AS weekofyear,
  CAST(hour(subway_timestamp) * 60 + minute(subway_timestamp) AS BIGINT) AS minute_of_day,
  """ + ", ".join(f"{_prev(v, k)} AS {n}" for n, (v, k) in MEANS.items()) + f""",
  round(coalesce(sum(d.delay) {_over('station_key')}, 0), 6) AS station_prev_delay_total,
  """ + ", ".join(f"row_number() {_over(k, '')} - 1 AS {n}" for n, k in COUNTS.items()) + f""",
  round(coalesce(avg(d.delay) {_over('station_key', LAST3)}, g.delay), 6) AS recent_station_delay_3,
  round(coalesce(avg(d.events) {_over('station_key', LAST3)}, g.events), 6) AS recent_station_events_3,
  {GLOBAL_MEAN} AS global_prev_delay,
  d.delay AS target_surface_delay, CAST(d.events AS DOUBLE) AS target_surface_events,
  {r6('d.linger')} AS target_linger_minutes,
  CAST(CASE WHEN d.delay > 0 THEN 1 ELSE 0 END AS BIGINT) AS ripple_label,
  CAST(CASE WHEN d.delay >= 60 OR d.events >= 3 OR d.linger >= 30 THEN 1 ELSE 0 END AS BIGINT) AS severe_label
FROM d, g"""))
def ripple_dataset(t: Tables) -> DataFrame:
    return half_up(R.incident_dataset(found(t)), *MEANS, "global_prev_delay")


# --- categories as target means ---------------------------------------------------------------------

SPLIT = HIST + """
, n AS (SELECT count(*) AS n FROM d),
s AS (SELECT d.*, CASE WHEN row_number() OVER (ORDER BY subway_timestamp, incident_id)
    <= CAST(floor((SELECT n FROM n) * 0.8) AS BIGINT) THEN 1 ELSE 0 END AS is_train FROM d)"""

CATEGORY = {"station_key": "station_key", "subway_code": "subway_code", "subway_line": "subway_line",
            "day_name": "dayname(subway_timestamp)"}
_HIT = "CASE WHEN delay > 0 THEN 1 ELSE 0 END"


@query(incident_sql(HIST + f"""
, p AS (SELECT *, {_HIT} AS hit, coalesce(avg({_HIT}) {_over('')}, 0) AS prior FROM d)
SELECT incident_id, """ + ", ".join(
    f"round((coalesce(sum(hit) {_over(k)}, 0) + prior * 10.0) / (count(*) {_over(k)} + 10.0), 6) AS {c}_mean"
    for c, k in CATEGORY.items()) + " FROM p"))
def ordered_target_means(t: Tables) -> DataFrame:
    rows = T.add_ordered_means(R.labelled(found(t)), "ripple_label", list(CATEGORY))
    return rows.select("incident_id", *[f"{c}_mean" for c in CATEGORY])


@query(incident_sql(SPLIT + f"""
, tr AS (SELECT *, {_HIT} AS hit FROM s WHERE is_train = 1),
m AS (SELECT avg({_HIT}) AS prior FROM s WHERE is_train = 1)
SELECT incident_id, """ + ", ".join(
    f"round((coalesce(k{i}.t, 0) + prior * 10.0) / (coalesce(k{i}.n, 0) + 10.0), 6) AS {c}_mean"
    for i, c in enumerate(CATEGORY)) + " FROM m, s " + " ".join(
    f"LEFT JOIN (SELECT {k} AS k, sum(hit) AS t, count(*) AS n FROM tr GROUP BY 1) k{i} ON {k} IS NOT DISTINCT FROM k{i}.k"
    for i, k in enumerate(CATEGORY.values())) + " WHERE is_train = 0"))
def scored_target_means(t: Tables) -> DataFrame:
    """The later fifth of the incidents, scored by the state of the earlier ones."""
    rows = materialize(R.labelled(found(t)))
    cut = materialize(H.temporal_split(rows, 0.8, "subway_timestamp", ["incident_id"]))
    state = T.target_state(cut.filter(F.col("is_train") == 1), "ripple_label", list(CATEGORY))
    later = cut.filter(F.col("is_train") == 0)
    return T.score_means(later, state, list(CATEGORY)).select("incident_id", *[f"{c}_mean" for c in CATEGORY])


# --- splits and baselines -----------------------------------------------------------------------------

@query(incident_sql(SPLIT + "SELECT incident_id, CAST(is_train AS BIGINT) AS is_train FROM s"))
def temporal_split(t: Tables) -> DataFrame:
    rows = materialize(R.labelled(found(t)))
    return H.temporal_split(rows, 0.8, "subway_timestamp", ["incident_id"]).select("incident_id", "is_train")


@query(incident_sql(SPLIT + """
SELECT CASE WHEN is_train = 1 THEN 'train' ELSE 'test' END AS split, count(*) AS incidents,
  round(avg(abs(delay)), 6) AS baseline_mae, round(sqrt(avg(delay * delay)), 6) AS baseline_rmse,
  round(avg(CASE WHEN delay > 0 THEN 1 ELSE 0 END), 6) AS ripple_label_rate,
  round(avg(CASE WHEN delay >= 60 OR events >= 3 OR linger >= 30 THEN 1 ELSE 0 END), 6) AS severe_label_rate
FROM s GROUP BY 1"""))
def zero_baseline(t: Tables) -> DataFrame:
    rows = materialize(R.labelled(found(t)))
    cut = H.temporal_split(rows, 0.8, "subway_timestamp", ["incident_id"])
    named = cut.withColumn("split", F.when(F.col("is_train") == 1, "train").otherwise("test"))
    return E.zero_baseline(named, "target_surface_delay", "split", ["ripple_label", "severe_label"])
