"""Readers for the raw feeds: flight CSV/Parquet, incident CSVs, code tables, road CSVs."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.functions import scalars as S

#: Files whose first line is read at a time.
HEADER_READERS = 16

# The flight file's columns in file order, with their types.
FLIGHT_TYPES = {
    "year": "int", "month": "int", "day_of_month": "int", "day_of_week": "int", "fl_date": "date",
    "op_unique_carrier": "string", "op_carrier_fl_num": "double",
    "origin": "string", "origin_city_name": "string", "origin_state_nm": "string",
    "dest": "string", "dest_city_name": "string", "dest_state_nm": "string",
    "crs_dep_time": "int", "dep_time": "double", "dep_delay": "double", "taxi_out": "double",
    "wheels_off": "double", "wheels_on": "double", "taxi_in": "double", "crs_arr_time": "int",
    "arr_time": "double", "arr_delay": "double", "cancelled": "tinyint", "cancellation_code": "string",
    "diverted": "tinyint", "crs_elapsed_time": "double", "actual_elapsed_time": "double",
    "air_time": "double", "distance": "float", "carrier_delay": "int", "weather_delay": "int",
    "nas_delay": "int", "security_delay": "int", "late_aircraft_delay": "int",
}


def _conform(df: DataFrame) -> DataFrame:
    """Give the known columns their types; what does not fit becomes null, and so does NaN."""
    out = []
    for name, found in df.dtypes:
        kind, col = FLIGHT_TYPES.get(name, found), F.col(name)
        if kind in ("int", "tinyint", "float", "double"):
            number = S.to_number(col) if found == "string" else S.nan_to_null(col)
            col = number.try_cast(kind)
        elif kind != found:
            col = col.try_cast(kind)
        out.append(col.alias(name))
    return df.select(*out)


def _columns(spark: SparkSession, file: str) -> tuple[str, ...]:
    return tuple(spark.read.option("header", True).csv(file).columns)


def header_groups(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[tuple[str, ...], list[str]]]:
    """The files under all paths by their header, in the order of the first file of each header.

    Only names of files and their first lines are read, many files at a time. Files without any line
    have no header and are left out.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = []
    for p in paths:
        files += sorted(unquote(f) for f in spark.read.text(p).inputFiles())
    files = list(dict.fromkeys(files))
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(lambda f: _columns(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files):
        if header:
            groups.setdefault(header, []).append(file)
    return list(groups.items())


def read_csv(spark: SparkSession, path: str | Sequence[str], with_file: bool = False) -> DataFrame:
    """CSV with a header, all columns text, matched by name whatever their order in a file.

    Files are read in groups of one header each, since Spark itself matches the columns of several files by
    place; a column that a file lacks is null there. ``with_file`` adds ``_name`` and ``_path`` of the file and,
    as ``_line``, the place of a row among those of its file's name. Paths without a line give no columns.
    """
    parts = []
    for header, files in header_groups(spark, path):
        part = spark.read.option("header", True).option("enforceSchema", False).csv(files)
        if with_file:
            name, whole = F.col("_metadata.file_name"), F.col("_metadata.file_path")
            line = F.struct(name.alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
            part = part.select(*[part[f"`{c}`"] for c in part.columns], name.alias("_name"), whole.alias("_path"), line.alias("_line"))
        parts.append(part)
    return union_feeds(*parts) if parts else spark.createDataFrame([], "_name string, _path string" if with_file else "_none string").limit(0)


def load_flights(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv") -> DataFrame:
    """Flight table with fixed types; ``fl_date`` that is no date becomes null.

    Columns are matched by header name, so a path may carry them in any order or leave
    some out.
    """
    if fmt == "csv":
        raw = read_csv(spark, path)
    else:
        raw = spark.read.format(fmt).load(path)
    return _conform(raw)


def load_flights_with_month(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """As ``load_flights``, with ``month`` taken from the date instead of the file."""
    return load_flights(spark, path, fmt).withColumn("month", F.month("fl_date"))


def add_local_features(df: DataFrame, zone: str = S.LOCAL_ZONE) -> DataFrame:
    """Local time of ``updated`` (UTC) with hour, weekday name and yyyy-MM month."""
    local = df.withColumn("updated_local", S.local_time("updated", zone))
    return local.withColumns(
        {
            "hour": F.hour("updated_local"),
            "dow": S.day_name("updated_local"),
            "month": S.month_label("updated_local"),
        }
    )


def load_travel_time(
    spark: SparkSession, paths: str | Sequence[str], add_time_features: bool = True
) -> DataFrame:
    """Yearly road CSVs as one table; the year comes from the end of each file's name, or
    of its folder's name where Spark has named the files itself."""
    raw = read_csv(spark, paths, with_file=True)
    missing = [F.lit(None).cast("string").alias(c) for c in ("resultId", "timeInSeconds", "count", "updated") if c not in raw.columns]
    raw = raw.select("*", *missing)
    by_file = F.regexp_extract("_name", r"-(\d+)\.[^.]*$", 1).try_cast("int")
    by_folder = F.regexp_extract("_path", r"-(\d+)/[^/]*$", 1).try_cast("int")
    # The session zone never enters: text with an offset is shifted by hand, text without
    # one is already UTC.
    offset = F.regexp_extract("updated", r":\d{2}(?:\.\d+)?\s*([+-]\d{2}(?::?\d{2})?)$", 1)
    digits = F.regexp_replace(offset, ":", "")
    minutes = (
        F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    ) * F.when(digits.startswith("-"), -1).otherwise(1)
    wall = F.regexp_replace("updated", r"(:\d{2}(?:\.\d+)?)\s*(?:Z|[+-]\d{2}(?::?\d{2})?)$", "$1").try_cast("timestamp_ntz")
    utc = wall - F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))
    out = raw.select(
        "resultId", F.col("timeInSeconds").try_cast("double").alias("timeInSeconds"), F.col("count").try_cast("bigint").alias("count"),
        utc.alias("updated"),
        F.coalesce(by_file, by_folder).alias("year"),
    )
    return add_local_features(out) if add_time_features else out


def clean_mode(raw: DataFrame, mode: str, zone: str = S.LOCAL_ZONE) -> DataFrame:
    """Incident rows of one mode: complete, with a valid time and a station key."""
    gap = F.col("Min Gap") if "Min Gap" in raw.columns else F.lit(None)
    ident = F.col("_id").try_cast("bigint") if "_id" in raw.columns else F.lit(None).cast("bigint")
    out = raw.dropna(subset=["Station", "Time", "Date"]).select(
        ident.alias("_id"),
        F.lit(mode).alias("mode"),
        F.col("Station").alias("station"),
        F.col("Code").alias("code"),
        F.col("Line").alias("line"),
        S.to_number("Min Delay").alias("min_delay"),
        S.to_number(gap.cast("string")).alias("min_gap"),
        S.combine_datetime("Date", "Time", zone).alias("timestamp"),
        S.normalize_station("Station").alias("station_key"),
    )
    return out.filter(F.col("timestamp").isNotNull() & (F.col("station_key") != ""))


def load_mode_file(
    spark: SparkSession, path: str | Sequence[str], mode: str, zone: str = S.LOCAL_ZONE
) -> DataFrame:
    return clean_mode(read_csv(spark, path), mode, zone)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Feeds of several modes as one; a column that one of them lacks is null there."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def merge_codebook(files: Sequence[DataFrame]) -> DataFrame:
    """One description per upper-case code; a later file, then a later row, wins.

    A table without both columns is skipped. Row order inside a table is its ``row_no``
    column if it has one; tables of ``load_codebook`` are in the order of their part files'
    names and of the lines in them.
    """
    parts = []
    for number, book in enumerate(files):
        if not {"CODE", "DESCRIPTION"} <= set(book.columns):
            continue
        if "_line" in book.columns:
            row = F.col("_line")
        else:
            number_in = F.col("row_no") if "row_no" in book.columns else F.monotonically_increasing_id()
            row = F.struct(F.lit("").alias("name"), F.lit(0).cast("bigint").alias("block"), number_in.cast("bigint").alias("row"))
        parts.append(
            book.select(
                F.upper(F.col("CODE").cast("string")).alias("code"),
                F.col("DESCRIPTION").cast("string").alias("description"),
                F.struct(F.lit(number).alias("file"), row.alias("row")).alias("at"),
            ).filter(F.col("code").isNotNull())
        )
    if not parts:
        raise ValueError("no usable code table")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    # A missing description must win too when it comes last, hence the struct.
    last = F.max_by(F.struct("description"), "at")
    return merged.groupBy("code").agg(last.alias("last")).select("code", "last.description")


def load_codebook(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Merge code CSVs; files that are missing or unreadable are skipped."""
    books = []
    for path in paths:
        try:
            books.append(read_csv(spark, path, with_file=True))
        except AnalysisException:
            continue
    return merge_codebook(books)
