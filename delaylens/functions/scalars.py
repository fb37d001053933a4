"""Column expressions: clock times, flags, station names, calendars, coercions.

Every function takes and returns ``Column`` objects, so all of them stay inside
whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes removed from station names, in order of removal.
STATION_SUFFIXES = (
    " STATION", " STN", " PLATFORM", " BD", " YUS", " RT", " LINE", " SUBWAY", " LOOP",
)

# Upper edges (inclusive) of the distance buckets, in miles.
DISTANCE_EDGES = (300, 800, 1500, 3000, 6000)

# Delay cause columns and their report labels.
CAUSE_LABELS = {
    "carrier_delay": "Airline Operations",
    "weather_delay": "Weather",
    "nas_delay": "Airport / ATC",
    "security_delay": "Security",
    "late_aircraft_delay": "Late Aircraft",
}

# Weekday names, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

LOCAL_ZONE = "America/Toronto"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def truth(cond: Column) -> Column:
    """A comparison in which an unknown counts as false, as 0/1."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def nan_to_null(col: Column | str) -> Column:
    c = _c(col)
    return F.when(~F.isnan(c), c)


def to_number(text: Column | str) -> Column:
    """Text to number: what is no number, and NaN, become null.

    A Java type suffix such as in ``5d`` is no part of a number here.
    """
    c = _c(text)
    return nan_to_null(F.when(~c.rlike(r"[\d.][dDfF]\s*$"), c.try_cast("double")))


# --- clock and calendar -------------------------------------------------------------


def hhmm_to_minutes(col: Column | str) -> Column:
    """Clock code HHMM to minutes since midnight; 2400 gives 1440."""
    c = _c(col).cast("int")
    return F.floor(c / 100).cast("int") * 60 + F.pmod(c, F.lit(100))


def hour_of_hhmm(col: Column | str) -> Column:
    return F.floor(hhmm_to_minutes(col) / 60).cast("int")


def is_weekend(day_of_week: Column | str, weekend_from: int = 5) -> Column:
    """1 from ``weekend_from`` on. Days count Monday = 1, so the default takes Friday in;
    pass 6 for Saturday and Sunday only."""
    return (_c(day_of_week) >= weekend_from).cast("int")


def is_peak_summer(month: Column | str) -> Column:
    return _c(month).isin(6, 7, 8).cast("int")


def combine_datetime(date: Column | str, clock: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Local date and HH:MM text to a UTC timestamp without zone; bad input gives null.

    A local time inside a daylight-saving gap moves forward by the gap, one inside an
    overlap takes the earlier offset.
    """
    day, at = _c(date).try_cast("date").cast("string"), F.trim(_c(clock))
    local = F.when(
        at.rlike(r"^\d{1,2}:\d{1,2}$"),
        F.concat(day, F.lit(" "), at).try_cast("timestamp_ntz"),
    )
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def local_time(ts_utc: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts_utc).cast("timestamp_ntz"))


def day_name(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "EEEE")


def month_label(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def _micros(span: Column) -> Column:
    """Microseconds of a day-time interval. Timestamps without zone are subtracted as they
    are, so the session zone and its clock changes never enter."""
    part = lambda unit: F.extract(F.lit(unit), span)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def minutes_between(end: Column | str, start: Column | str) -> Column:
    """Elapsed minutes with microsecond precision, for timestamps without zone."""
    return _micros(_c(end) - _c(start)) / F.lit(60e6)


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return _micros(_c(ts) - F.lit("1970-01-01").cast("timestamp_ntz"))


def time_cell(ts: Column | str, minutes: int) -> Column:
    """Number of the cell of the given length a timestamp without zone falls in."""
    return F.floor(epoch_micros(ts) / F.lit(minutes * 60_000_000))


def incident_calendar(ts: Column | str) -> dict[str, Column]:
    t = _c(ts)
    return {
        "hour": F.hour(t),
        "day_name": day_name(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "weekofyear": F.weekofyear(t),
        "minute_of_day": F.hour(t) * 60 + F.minute(t),
    }


# --- flights --------------------------------------------------------------------------


def delay_label(arr_delay: Column | str, threshold: float = 15) -> Column:
    """1 when the delay exceeds the threshold; a missing delay counts as not delayed."""
    return truth(nan_to_null(arr_delay) > threshold)


def operated(cancelled: Column | str, diverted: Column | str) -> Column:
    return (_c(cancelled) != 1) & (_c(diverted) != 1)


def valid_flight(distance: Column | str, air_time: Column | str) -> Column:
    return (_c(distance) > 0) & (_c(air_time) > 0)


def distance_bucket(distance: Column | str) -> Column:
    """Right-closed buckets 0..4; null, negative or too long gives null."""
    d = _c(distance)
    out = F.when(d < 0, F.lit(None).cast("int"))
    for code, edge in enumerate(DISTANCE_EDGES):
        out = out.when(d <= edge, F.lit(code))
    return out


def speed_mph(distance: Column | str, air_time: Column | str) -> Column:
    """Miles per hour. Zero air time gives infinity, as floating point division does."""
    d, a = _c(distance).cast("double"), _c(air_time).cast("double")
    return F.when(
        a == 0,
        F.when(d > 0, F.lit(float("inf"))).when(d < 0, F.lit(float("-inf"))),
    ).otherwise(F.try_divide(d * 60, a))


def on_time(arr_delay: Column | str, cancelled: Column | str, diverted: Column | str) -> Column:
    """True/false/null: an unknown delay is late, unknown flags stay unknown."""
    return (
        F.coalesce(_c(arr_delay) <= 15, F.lit(False))
        & (_c(cancelled) == 0)
        & (_c(diverted) == 0)
    )


def taxi_total(df: DataFrame) -> Column:
    """Sum of whichever taxi columns the frame has, nulls as zero."""
    present = [c for c in ("taxi_out", "taxi_in") if c in df.columns]
    if not present:
        raise ValueError("the frame has no taxi column")
    total = F.lit(0.0)
    for name in present:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    return total


def find_column(df: DataFrame, *parts: str) -> str:
    """First column whose lower-case name holds all the parts."""
    for name in df.columns:
        if all(part in name.lower() for part in parts):
            return name
    raise ValueError(f"no column holds {parts}")


def route_key(origin: Column | str, dest: Column | str) -> Column:
    return F.concat_ws("-", _c(origin), _c(dest))


# --- transit --------------------------------------------------------------------------


def normalize_station(name: Column | str) -> Column:
    """Station key: upper case, suffixes and apostrophes removed, blanks collapsed,
    the part before the first ' AND '. Null gives the empty string."""
    blanks = r"(?U)\s+"
    key = F.regexp_replace(F.upper(_c(name)), r"(?U)^\s+|\s+$", "")
    for suffix in STATION_SUFFIXES:
        key = F.replace(key, F.lit(suffix), F.lit(""))
    key = F.replace(key, F.lit("'"), F.lit(""))
    key = F.trim(F.regexp_replace(key, blanks, " "))
    key = F.trim(F.substring_index(key, " AND ", 1))
    return F.coalesce(key, F.lit(""))


def upper_code(code: Column | str) -> Column:
    """Upper-case incident code; a missing one becomes the text NAN."""
    return F.coalesce(F.upper(_c(code)), F.lit("NAN"))


def clean_ascii(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"[^\x00-\x7F]", "")


def ripple_label(delay: Column | str) -> Column:
    return truth(_c(delay) > 0)


def severe_label(delay: Column | str, events: Column | str, linger: Column | str) -> Column:
    return truth((_c(delay) >= 60) | (_c(events) >= 3) | (_c(linger) >= 30))


# --- numbers and text -------------------------------------------------------------------


def clipped_expm1(col: Column | str) -> Column:
    return F.greatest(F.expm1(_c(col)), F.lit(0.0))


def above(col: Column | str, threshold: float) -> Column:
    return truth(_c(col) > threshold)


def as_category(col: Column | str) -> Column:
    """Text form of a categorical feature; a missing value becomes 'nan'."""
    return F.coalesce(_c(col).cast("string"), F.lit("nan"))


def fixed(col: Column | str, digits: int) -> Column:
    """Text with a fixed number of decimals; an exact half goes to the even digit."""
    x = _c(col).cast("double")
    # Only a multiple of 1 / 2**(digits + 1) can lie exactly half-way.
    scaled = x * F.lit(float(2 ** (digits + 1)))
    even = F.bround(x.cast("decimal(28,12)"), digits).cast("double")
    return F.format_string(f"%.{digits}f", F.when(scaled == F.floor(scaled), even).otherwise(x))


def percent(col: Column | str, digits: int = 1) -> Column:
    return F.concat(fixed(_c(col) * 100, digits), F.lit("%"))


def relabel(col: Column | str, labels: Mapping[str, str]) -> Column:
    """Look a value up in a small fixed mapping; unknown values give null."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _c(col))
