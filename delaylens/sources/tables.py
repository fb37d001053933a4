"""Views of the three domains over the given star-schema and event tables.

The given tables hold no flight, transit or road data, so each domain is expressed
over them by fixed formulas. A view takes the columns its caller needs and joins only
the dimensions those columns come from: every dimension is keyed by a unique column and
joined from the left, so leaving one out never changes the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.functions import scalars as S

FLIGHT_COLUMNS = (
    "fl_date", "year", "month", "day_of_month", "day_of_week", "op_unique_carrier", "origin", "dest",
    "crs_dep_time", "crs_arr_time", "cancelled", "diverted", "dep_delay", "arr_delay", "distance",
    "air_time", "taxi_out", "taxi_in", "carrier_delay", "weather_delay", "nas_delay",
    "security_delay", "late_aircraft_delay",
)


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate",
)


def _flight_measures() -> dict[str, Column]:
    number = F.col("l_linenumber")
    cancelled = (F.col("l_returnflag") == "R") & (number == 7)
    diverted = (F.col("l_returnflag") == "A") & (number == 6) & (F.col("l_linestatus") == "O")
    base = F.col("l_quantity") * 3 - 100 + F.when(F.col("l_partkey") % 40 == 0, 120).otherwise(0)
    arrived = ~(cancelled | diverted)
    arr = F.when(arrived, base + number - 4)
    step = F.col("l_partkey") % 50

    def share(*numbers: int):
        return F.when((arr > 15) & number.isin(*numbers), arr.cast("int")).otherwise(F.lit(0))

    day = F.col("l_shipdate").cast("date")
    return {
        "fl_date": day,
        "year": F.year(day),
        "month": F.month(day),
        "day_of_month": F.dayofmonth(day),
        "day_of_week": F.weekday(day) + 1,
        "op_unique_carrier": F.concat(F.lit("C"), F.col("l_suppkey") % 15),
        "crs_dep_time": ((F.col("l_partkey") % 24) * 100 + F.col("l_orderkey") % 60).cast("int"),
        "crs_arr_time": (((F.col("l_partkey") + 2) % 24) * 100 + F.col("l_orderkey") % 60).cast("int"),
        "cancelled": cancelled.cast("int"),
        "diverted": diverted.cast("int"),
        "dep_delay": F.when(~cancelled, base),
        "arr_delay": arr,
        "distance": (100 + step * 100).cast("double"),
        "air_time": F.when(arrived, (20 + step * 12 + number).cast("double")),
        "taxi_out": F.when(~cancelled, (10 + F.col("l_orderkey") % 20).cast("double")),
        "taxi_in": F.when(~cancelled, (3 + F.col("l_partkey") % 9).cast("double")),
        "carrier_delay": share(1, 2),
        "weather_delay": share(3),
        "nas_delay": share(4),
        "security_delay": share(5),
        "late_aircraft_delay": share(6, 7),
    }


def flights(t: Tables, *columns: str) -> DataFrame:
    """One row per line item as a flight; ``columns`` limits both scan and joins.

    Joins move the few columns of the line item; what is derived from them comes last.
    """
    wanted = columns or FLIGHT_COLUMNS
    out = t.read("lineitem").select(*LINE_COLUMNS)
    if "origin" in wanted:
        places = t.read("nation").select("n_nationkey", F.col("n_name").alias("origin"))
        by_supplier = (
            t.read("supplier")
            .join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select("s_suppkey", "origin")
        )
        out = out.join(by_supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if "dest" in wanted:
        places = t.read("nation").select("n_nationkey", F.col("n_name").alias("dest"))
        by_customer = (
            t.read("customer")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("c_custkey", "dest")
        )
        by_order = (
            t.read("orders")
            .join(by_customer, F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("o_orderkey", "dest")
        )
        out = out.join(by_order, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    measures = _flight_measures()
    return out.select(*[measures[c].alias(c) if c in measures else F.col(c) for c in wanted])


def transit_raw(t: Tables) -> DataFrame:
    """Incident feed as it arrives: text station, text clock and code, before cleaning."""
    events = t.read("events")
    stop = (F.col("user_id") % 20).cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    station = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("stop "), stop, F.lit(" Station")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("STOP "), stop, F.lit(" STN")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("  Stop  "), stop, F.lit(" and King")))
        .otherwise(F.concat(F.lit("Stop "), stop, F.lit(" Platform")))
    )
    mode = (
        F.when(F.col("event_type") == "error", "subway")
        .when(F.col("event_type") == "signup", "streetcar")
        .otherwise("bus")
    )
    return events.select(
        F.col("event_id").alias("_id"),
        mode.alias("mode"),
        station.alias("station"),
        F.concat(F.lit("K"), k % 8).alias("code"),
        F.concat(F.lit("L"), F.col("user_id") % 3).alias("line"),
        F.col("value").alias("min_delay"),
        k.cast("double").alias("min_gap"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
    )


def _cleaned(feed: DataFrame) -> DataFrame:
    return (
        feed.filter(F.col("timestamp").isNotNull())
        .withColumn("station_key", S.normalize_station("station"))
        .filter(F.col("station_key") != "")
    )


def transit(t: Tables) -> DataFrame:
    """Cleaned incidents of all modes with their station key."""
    return _cleaned(transit_raw(t))


def subway(t: Tables) -> DataFrame:
    """Subway incidents; a feed is picked before its stations are cleaned, which costs most."""
    return _cleaned(transit_raw(t).filter(F.col("mode") == "subway"))


def surface(t: Tables) -> DataFrame:
    """Buses and streetcars as one feed, in one scan."""
    return _cleaned(transit_raw(t).filter(F.col("mode") != "subway"))


def code_files(t: Tables) -> list[DataFrame]:
    """The two code tables, in the order in which they are read."""
    nation = t.read("nation")
    key = F.col("n_nationkey")
    # Seven codes for all nations; K7 has no description.
    rows = nation.select(
        F.concat(F.lit("K"), key % 7).alias("CODE"), F.col("n_name").alias("DESCRIPTION"), key.alias("row_no")
    )
    return [rows.filter(F.col("row_no") < 20), rows.filter(F.col("row_no") >= 20)]


def travel_time(t: Tables) -> DataFrame:
    """Segment readings with their UTC time, before local time features."""
    ts = F.col("ts").cast("timestamp_ntz")
    return t.read("events").select(
        F.col("event_id").alias("reading_id"),
        F.concat(F.lit("S"), F.col("user_id") % 30).alias("resultId"),
        F.col("value").alias("timeInSeconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("count"),
        ts.alias("updated"),
        F.year(ts).alias("year"),
    )
