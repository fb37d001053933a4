"""Flight aggregates: volume, delay, reliability, causes, routes and airports.

Each function takes a flight frame and reads only the columns it names, so the scan
below it is pruned to those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylens.functions import features as X
from delaylens.functions import scalars as S
from delaylens.operators.joins import keep_top_keys, merge_counts, zero_fill
from delaylens.operators.ordered import histogram, histogram_quantiles, quantiles, top_k
from delaylens.operators.radix import bounded, radix_quantiles
from delaylens.session import materialize

MONTHS = tuple(range(1, 13))
CARRIER = "op_unique_carrier"


def _known(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def _count(df: DataFrame, *keys: str, name: str = "flight_count") -> DataFrame:
    return _known(df, *keys).groupBy(*keys).agg(F.count("*").alias(name))


def _seen_months(df: DataFrame) -> list[int]:
    """All months that occur in the data: as many as one key has rows in the result."""
    return sorted(r["month"] for r in df.select("month").dropna().distinct().collect())


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("arr_delay").alias("mean_arr_delay"),
        F.avg(S.delay_label("arr_delay")).alias("delayed_share"),
        F.count("*").alias("flights"),
    )


def delay_rate_by_hour(df: DataFrame) -> DataFrame:
    labelled = _known(X.add_delay_label(X.add_dep_hour(df)), "dep_hour")
    return labelled.groupBy("dep_hour").agg(F.avg("is_delayed_15").alias("delay_rate"))


def top_delay_origins(df: DataFrame, k: int = 15) -> DataFrame:
    means = _known(df, "origin").groupBy("origin").agg(F.avg("arr_delay").alias("mean_arr_delay"))
    return top_k(means, "mean_arr_delay", k, "origin")


def origin_month_matrix(df: DataFrame, k: int = 25) -> DataFrame:
    """Mean delay by origin and month for the busiest origins, from one scan."""
    cells = materialize(
        _known(df, "origin")
        .groupBy("origin", "month")
        .agg(F.count("*").alias("flight_count"), F.avg("arr_delay").alias("mean_delay"))
    )
    load = cells.groupBy("origin").agg(F.sum("flight_count").alias("flight_count"))
    kept = keep_top_keys(cells, top_k(load, "flight_count", k, "origin"), "origin")
    wide = kept.groupBy("origin").pivot("month", list(MONTHS)).agg(F.first("mean_delay"))
    return wide.select("origin", *[F.col(str(m)).alias(f"m{m:02d}") for m in MONTHS])


def monthly_volume(df: DataFrame) -> DataFrame:
    return _count(df, "month")


def monthly_carrier_volume(df: DataFrame) -> DataFrame:
    """Valid flights per month and carrier; every carrier has a row in every month seen."""
    # One pass counts the valid flights and keeps the carriers that have none.
    valid = F.coalesce(S.valid_flight("distance", "air_time"), F.lit(False))
    counts = materialize(
        _known(df, "month", CARRIER).groupBy("month", CARRIER).agg(F.count_if(valid).alias("flight_count"))
    )
    months = _seen_months(counts.filter(F.col("flight_count") > 0))
    return zero_fill(counts, counts, CARRIER, "month", months, {"flight_count": 0})


def route_delay(df: DataFrame, min_flights: int) -> DataFrame:
    rates = (
        _known(X.filter_valid(df), "origin", "dest")
        .groupBy("origin", "dest")
        .agg(F.count("*").alias("flights"), F.avg(S.truth(F.col("arr_delay") > 15)).alias("delay_rate"))
    )
    return rates.filter(F.col("flights") >= min_flights)


def within_top_airports(routes: DataFrame, count: str, k: int) -> DataFrame:
    """Routes whose origin and destination are both among the k busiest of their kind.

    The route frame feeds three branches, so it is computed once.
    """
    routes = materialize(routes)
    tops = {
        side: top_k(routes.groupBy(side).agg(F.sum(count).alias("_load")), "_load", k, side)
        for side in ("origin", "dest")
    }
    for side, top in tops.items():
        routes = keep_top_keys(routes, top, side)
    return routes


def matrix(routes: DataFrame, value: str, dests: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """Origin by destination, one column per given destination.

    Without a list the columns are the destinations of ``routes``, which ``within_top_airports``
    has bounded to k, so none is lost.
    """
    if dests is None:
        dests = sorted(r["dest"] for r in routes.select("dest").dropna().distinct().collect())
    wide = routes.groupBy("origin").pivot("dest", dests).agg(F.first(value))
    return wide.fillna(fill) if fill is not None else wide


def taxi_time_by_carrier(df: DataFrame) -> DataFrame:
    return _known(df, CARRIER).groupBy(CARRIER).agg(F.avg(S.taxi_total(df)).alias("taxi_time"))


def cancel_rate(df: DataFrame) -> DataFrame:
    sums = _known(df, CARRIER).groupBy(CARRIER).agg(
        F.count("*").alias("flights"), F.coalesce(F.sum("cancelled"), F.lit(0)).alias("cancelled")
    )
    return sums.withColumn("cancel_rate", F.col("cancelled") / F.col("flights"))


def cancel_rate_by_month(df: DataFrame) -> DataFrame:
    sums = materialize(
        _known(df, CARRIER, "month")
        .groupBy(CARRIER, "month")
        .agg(F.count("*").alias("flights"), F.coalesce(F.sum("cancelled"), F.lit(0)).alias("cancelled"))
    )
    full = zero_fill(sums, sums, CARRIER, "month", _seen_months(sums), {"flights": 0, "cancelled": 0})
    return full.withColumn("cancel_rate", F.try_divide("cancelled", "flights"))


def security_delay_by_month(df: DataFrame) -> DataFrame:
    column = S.find_column(df, "security", "delay")
    hit = S.truth(F.col(column) > 0)
    return _known(df, "month").groupBy("month").agg(F.sum(hit).alias("num_security_delayed_flights"))


def carrier_reliability(df: DataFrame) -> DataFrame:
    """On-time, cancellation and diversion rates per carrier, most reliable first."""
    on_time = S.on_time("arr_delay", "cancelled", "diverted").cast("int")
    rates = _known(df, CARRIER).groupBy(CARRIER).agg(
        F.count(on_time).alias("total_flights"),
        F.avg(on_time).alias("on_time_rate"),
        F.avg("cancelled").alias("cancel_rate"),
        F.avg("diverted").alias("divert_rate"),
    )
    return rates.orderBy(F.desc_nulls_last("on_time_rate"), CARRIER)


# --- anomalies ------------------------------------------------------------------------------

# Cause names and limits, weakest rule first; a later rule overrides.
CAUSE_RULES = (
    ("Unrealistically Fast", "speed_mph", ">", 650.0),
    ("Unusually Slow", "speed_mph", "<", 150.0),
    ("Extreme Arrival Delay", "arr_delay", ">", 90.0),
    ("Extreme Departure Delay", "dep_delay", ">", 90.0),
    ("Cancellation", "cancelled", "=", 1.0),
    ("Diversion", "diverted", "=", 1.0),
    ("Abnormally Long Air Time", "air_time", ">", None),
    ("Abnormally Short Air Time", "air_time", "<", None),
)
OTHER_CAUSE = "Other / Data Quality"


def air_time_limits(df: DataFrame) -> tuple[float, float]:
    """1 % and 99 % quantiles of air time over all flights, a frame that is cheap to read again."""
    row = quantiles(df, "air_time", {"low": 0.01, "high": 0.99}, store=False).first()
    return (row["low"], row["high"])


def anomaly_cause(low: float, high: float) -> Column:
    """The strongest rule that fires, as one CASE read from the strongest rule down."""
    bound = {"Abnormally Long Air Time": high, "Abnormally Short Air Time": low}
    out = None
    for name, column, op, limit in reversed(CAUSE_RULES):
        value = S.speed_mph("distance", "air_time") if column == "speed_mph" else F.col(column)
        edge = F.lit(bound.get(name, limit))
        fires = {">": value > edge, "<": value < edge, "=": value == edge}[op]
        out = F.when(fires, name) if out is None else out.when(fires, name)
    return out.otherwise(OTHER_CAUSE)


def anomaly_causes(flagged: DataFrame, limits: tuple[float, float]) -> DataFrame:
    return flagged.groupBy(anomaly_cause(*limits).alias("anomaly_cause")).agg(
        F.count("*").alias("anomalies")
    )


def anomalies_by_carrier_month(flagged: DataFrame, carriers: DataFrame) -> DataFrame:
    counts = materialize(_count(flagged, "month", CARRIER, name="anomaly_count"))
    return zero_fill(counts, carriers, CARRIER, "month", _seen_months(counts), {"anomaly_count": 0})


def anomalies_by_origin_month(flagged: DataFrame, origins: DataFrame, k: int = 10) -> DataFrame:
    """Monthly anomalies of the k origins that have most of them."""
    counts = materialize(_count(flagged, "month", "origin", name="anomaly_count"))
    full = zero_fill(counts, origins, "origin", "month", _seen_months(counts), {"anomaly_count": 0})
    totals = full.groupBy("origin").agg(F.sum("anomaly_count").alias("_total"))
    return keep_top_keys(full, top_k(totals, "_total", k, "origin"), "origin")


# --- delay causes ----------------------------------------------------------------------------

CAUSES = tuple(S.CAUSE_LABELS)


def _with_cause(df: DataFrame) -> DataFrame:
    return df.dropna(how="all", subset=list(CAUSES))


def _hours(name: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(name, F.lit(0)) / 60.0), F.lit(0.0)).alias(name)


def cause_hours(df: DataFrame, *keys: str) -> DataFrame:
    """Delay hours per cause, one column per cause."""
    return _known(_with_cause(df), *keys).groupBy(*keys).agg(*[_hours(c) for c in CAUSES])


def cause_totals(df: DataFrame) -> DataFrame:
    """Hours and share of every cause; five rows."""
    long = cause_hours(df).unpivot([], list(CAUSES), "cause", "total_hours")
    every = Window.partitionBy()
    share = 100 * F.try_divide(F.col("total_hours"), F.sum("total_hours").over(every))
    return long.select(
        S.relabel("cause", S.CAUSE_LABELS).alias("delay_cause"), "total_hours",
        share.alias("percent_of_total"),
    ).orderBy(F.desc("total_hours"), "delay_cause")


def cause_shares(df: DataFrame, key: str = CARRIER) -> DataFrame:
    """Percent of each cause within the row's total."""
    hours = cause_hours(df, key)
    total = sum((F.col(c) for c in CAUSES[1:]), F.col(CAUSES[0]))
    return hours.select(key, *[(100 * F.try_divide(F.col(c), total)).alias(c) for c in CAUSES])


# --- routes and airports ----------------------------------------------------------------------


def route_counts(df: DataFrame) -> DataFrame:
    return _count(df, "origin", "dest")


def busiest_routes(df: DataFrame, k: int = 15) -> DataFrame:
    return top_k(route_counts(df), "flight_count", k, "origin", "dest")


def route_volume(df: DataFrame, min_flights: int = 100, k: int = 20) -> DataFrame:
    busy = route_counts(df).filter(F.col("flight_count") >= min_flights)
    return within_top_airports(busy, "flight_count", k)


def airport_activity(df: DataFrame, k: int = 25) -> DataFrame:
    """Departures plus arrivals per airport; both come from one count of the pairs."""
    pairs = materialize(df.groupBy("origin", "dest").agg(F.count("*").alias("n")))

    def side(column: str, name: str) -> DataFrame:
        return _known(pairs, column).groupBy(F.col(column).alias("airport")).agg(F.sum("n").alias(name))

    both = merge_counts(side("origin", "departures"), side("dest", "arrivals"), "airport", ("departures", "arrivals"))
    total = F.col("departures") + F.col("arrivals")
    return top_k(both.withColumn("total_activity", total), "total_activity", k, "airport")


def max_daily_carrier_distance(df: DataFrame, k: int = 10) -> DataFrame:
    """Longest distance a carrier flew on one day, all its flights together."""
    valid = _known(X.filter_valid(df), CARRIER, "fl_date")
    days = valid.groupBy(CARRIER, "fl_date").agg(F.sum("distance").alias("distance"))
    best = days.groupBy(CARRIER).agg(F.max("distance").alias("max_daily_carrier_distance"))
    out = top_k(best, "max_daily_carrier_distance", k, CARRIER)
    return out.withColumn("distance_kmiles", F.col("max_daily_carrier_distance") / 1000)


def _top_routes(counts: DataFrame, k: int) -> DataFrame:
    return top_k(counts.withColumn("route", S.route_key("origin", "dest")), "flight_count", k, "route")


def top_routes(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most flown routes; pairs are counted before the text key is built."""
    return _top_routes(route_counts(df), k).select("route", "flight_count")


def top_routes_by_month(df: DataFrame, k: int = 20) -> DataFrame:
    """Monthly flights of the k most flown routes, from one scan."""
    cells = materialize(
        _known(df, "origin", "dest").groupBy("origin", "dest", "month").agg(F.count("*").alias("flight_count"))
    )
    year = cells.groupBy("origin", "dest").agg(F.sum("flight_count").alias("flight_count"))
    kept = keep_top_keys(_known(cells, "month"), _top_routes(year, k), "origin", "dest")
    return kept.select("month", S.route_key("origin", "dest").alias("route"), "flight_count")


def speed_distribution(df: DataFrame) -> DataFrame:
    """Box plot figures of flight speed per carrier: quartiles and 1.5 IQR whiskers."""
    speed = materialize(
        _known(X.filter_valid(df), CARRIER).select(CARRIER, S.speed_mph("distance", "air_time").alias("speed"))
    )
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quart = materialize(radix_quantiles(speed, "speed", probs, [CARRIER], store=False))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("speed").between(F.col("q1") - reach, F.col("q3") + reach), F.col("speed"))
    return (
        speed.join(bounded(quart, [CARRIER]), CARRIER)
        .groupBy(CARRIER, "q1", "median", "q3")
        .agg(
            F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"),
            F.count("*").alias("flights"),
        )
    )


def impute_group_median(df: DataFrame, value: str = "arr_delay") -> DataFrame:
    """Fill a missing delay with the median of carrier and route, else of the carrier."""
    routes = histogram(df, value, [CARRIER, "origin", "dest"])
    carriers = materialize(routes.groupBy(CARRIER, "_v").agg(F.sum("_n").alias("_n")))
    route = histogram_quantiles(routes, {"_route_median": 0.5}, [CARRIER, "origin", "dest"])
    carrier = histogram_quantiles(carriers, {"_carrier_median": 0.5}, [CARRIER])
    return (
        df.join(route, [CARRIER, "origin", "dest"], "left")
        .join(carrier, CARRIER, "left")
        .withColumn(value, F.coalesce(value, "_route_median", "_carrier_median"))
        .drop("_route_median", "_carrier_median")
    )


# --- daily series ------------------------------------------------------------------------------


def daily_delay(df: DataFrame, *series: str) -> DataFrame:
    """One row per day (and series): delay mean, spread, flights, calendar."""
    daily = (
        _known(df, "arr_delay", "fl_date", *series)
        .groupBy(*series, "fl_date")
        .agg(
            F.avg("arr_delay").alias("mean_delay"),
            F.coalesce(F.stddev_samp("arr_delay"), F.lit(0.0)).alias("std_delay"),
            F.count("*").alias("flight_count"),
            F.coalesce(F.avg("cancelled"), F.lit(0.0)).alias("cancel_rate"),
        )
    )
    return daily.withColumns(
        {"day_of_week": F.weekday("fl_date"), "day_of_year": F.dayofyear("fl_date")}
    )


def _days(*series: str):
    # A series has one row per calendar day, so a partition is bounded by the calendar.
    return Window.partitionBy(*series).orderBy("fl_date")


def add_rolling(daily: DataFrame, *series: str, spans=(3, 7), include_current: bool = True) -> DataFrame:
    """Rolling means over k rows, null until k rows exist.

    ``include_current`` counts the day itself, which is the target; without it the k days
    before are used.
    """
    out = {}
    for k in spans:
        frame = _days(*series).rowsBetween(-(k - 1), 0) if include_current else _days(*series).rowsBetween(-k, -1)
        out[f"delay_{k}d_avg"] = F.when(
            F.count("mean_delay").over(frame) == k, F.avg("mean_delay").over(frame)
        )
    return daily.withColumns(out).dropna(subset=list(out))


def add_lags(daily: DataFrame, *series: str, lags=(1, 2, 3, 7)) -> DataFrame:
    out = {f"lag{k}_delay": F.lag("mean_delay", k).over(_days(*series)) for k in lags}
    return daily.withColumns(out).dropna(subset=list(out))
