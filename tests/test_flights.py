"""Flight aggregates on small tables: null keys, ties, rule order, gaps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from delaylens.operators import flights as A


def test_rates_count_unknown_delay_as_on_schedule(spark):
    df = spark.createDataFrame(
        [("A", "B", 20.0, 100.0, 60.0), ("A", "B", None, 100.0, 60.0), (None, "B", 20.0, 100.0, 60.0), ("A", "B", 20.0, 0.0, 60.0)],
        "origin string, dest string, arr_delay double, distance double, air_time double",
    )
    assert [tuple(r) for r in A.route_delay(df, 1).collect()] == [("A", "B", 2, 0.5)]
    assert A.kpis(df).first().delayed_share == 0.75


def test_monthly_carrier_volume_fills_carriers_without_valid_flights(spark):
    df = spark.createDataFrame(
        [(1, "A", 10.0, 5.0), (1, "A", 10.0, 5.0), (2, "B", None, 5.0), (3, "B", 1.0, 5.0)],
        "month int, op_unique_carrier string, distance double, air_time double",
    )
    got = sorted(map(tuple, A.monthly_carrier_volume(df).select("month", "op_unique_carrier", "flight_count").collect()))
    assert got == [(1, "A", 2), (1, "B", 0), (3, "A", 0), (3, "B", 1)]


def test_cancel_rate_by_month_has_null_for_no_flights(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 1, 0), ("B", 2, None)], "op_unique_carrier string, month int, cancelled int")
    rows = {(r.op_unique_carrier, r.month): (r.flights, r.cancelled, r.cancel_rate) for r in A.cancel_rate_by_month(df).collect()}
    assert rows == {("A", 1): (2, 1, 0.5), ("A", 2): (0, 0, None), ("B", 1): (0, 0, None), ("B", 2): (1, 0, 0.0)}


CASES = [
    # dep, arr, distance, air_time, cancelled, diverted, cause with limits 30 and 300
    (0.0, 0.0, 500.0, 60.0, 0, 0, "Other / Data Quality"),
    (0.0, 0.0, 700.0, 60.0, 0, 0, "Unrealistically Fast"),
    (0.0, 0.0, 100.0, 60.0, 0, 0, "Unusually Slow"),
    (0.0, 91.0, 100.0, 60.0, 0, 0, "Extreme Arrival Delay"),
    (91.0, 91.0, 100.0, 60.0, 0, 0, "Extreme Departure Delay"),
    (90.0, 90.0, 500.0, 60.0, 0, 0, "Other / Data Quality"),
    (91.0, 91.0, 500.0, 60.0, 1, 0, "Cancellation"),
    (91.0, 91.0, 500.0, 60.0, 1, 1, "Diversion"),
    (91.0, 91.0, 500.0, 301.0, 1, 1, "Abnormally Long Air Time"),
    (0.0, 0.0, 500.0, 300.0, 0, 0, "Unusually Slow"),
    (91.0, 91.0, 500.0, 29.0, 1, 1, "Abnormally Short Air Time"),
    (0.0, 0.0, 500.0, 0.0, 0, 0, "Abnormally Short Air Time"),
    (0.0, 0.0, 500.0, None, 0, 0, "Other / Data Quality"),
]


def test_anomaly_cause_precedence(spark):
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CASES)],
        "i int, dep_delay double, arr_delay double, distance double, air_time double, cancelled int, diverted int, want string",
    )
    rows = df.select("i", "want", A.anomaly_cause(30.0, 300.0).alias("got")).orderBy("i").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_infinite_speed_counts_as_fast(spark):
    df = spark.createDataFrame([(0.0, 0.0, 500.0, 0.0, 0, 0)], "dep_delay double, arr_delay double, distance double, air_time double, cancelled int, diverted int")
    assert df.select(A.anomaly_cause(-1.0, 300.0)).first()[0] == "Unrealistically Fast"


def test_causes_drop_rows_without_any(spark):
    names = ", ".join(f"{c} int" for c in A.CAUSES)
    df = spark.createDataFrame([(60, None, None, None, None), (None,) * 5, (0, 30, 0, 0, 30)], names)
    rows = {r.delay_cause: (r.total_hours, r.percent_of_total) for r in A.cause_totals(df).collect()}
    assert rows["Airline Operations"] == (1.0, 50.0) and rows["Weather"] == (0.5, 25.0) and rows["Security"] == (0.0, 0.0)


def test_share_of_nothing_is_null(spark):
    names = "op_unique_carrier string, " + ", ".join(f"{c} int" for c in A.CAUSES)
    df = spark.createDataFrame([("A", 0, 0, 0, 0, 0)], names)
    assert A.cause_shares(df).first().weather_delay is None


@pytest.fixture(scope="module")
def days(spark):
    base = dt.date(2024, 1, 1)
    rows = [(base + dt.timedelta(days=i if i < 5 else i + 10), float(v), 0) for i in range(9) for v in ((i, i + 2) if i else (4,))]
    rows += [(base, None, 1), (None, 5.0, 0)]
    return A.daily_delay(spark.createDataFrame(rows, "fl_date date, arr_delay double, cancelled int"))


def test_daily_frame(days):
    rows = days.orderBy("fl_date").collect()
    assert len(rows) == 9
    assert (rows[0].mean_delay, rows[0].std_delay, rows[0].flight_count, rows[0].cancel_rate) == (4.0, 0.0, 1, 0.0)
    assert (rows[0].day_of_week, rows[0].day_of_year, rows[1].mean_delay) == (0, 1, 2.0)
    assert rows[1].std_delay == pytest.approx(2**0.5)


def test_rolling_is_by_row_and_can_leave_the_day_out(days):
    means = [r.mean_delay for r in days.orderBy("fl_date").collect()]
    with_day = A.add_rolling(days).orderBy("fl_date").collect()
    assert len(with_day) == 3 and with_day[0].delay_7d_avg == pytest.approx(sum(means[:7]) / 7)
    before = A.add_rolling(days, include_current=False).orderBy("fl_date").collect()
    assert len(before) == 2 and before[0].delay_3d_avg == pytest.approx(sum(means[4:7]) / 3)
    lags = A.add_lags(days).orderBy("fl_date").collect()
    assert [(r.lag1_delay, r.lag7_delay) for r in lags] == [(means[6], means[0]), (means[7], means[1])]


def test_imputation_falls_back_to_the_carrier(spark):
    df = spark.createDataFrame(
        [("C", "A", "B", 1.0), ("C", "A", "B", 3.0), ("C", "A", "B", None), ("C", "X", "Y", None), ("D", "A", "B", None)],
        "op_unique_carrier string, origin string, dest string, arr_delay double",
    )
    got = A.impute_group_median(df).groupBy("op_unique_carrier", "origin").agg(F.sum("arr_delay").alias("s"))
    assert {(r[0], r[1]): r.s for r in got.collect()} == {("C", "A"): 6.0, ("C", "X"): 2.0, ("D", "A"): None}


def test_months_are_not_capped(spark):
    """Fifteen month values, as a file with wrong months has them: no row is lost."""
    rows = spark.range(60).select(
        (F.col("id") % 15).cast("int").alias("month"), F.lit("C1").alias("op_unique_carrier"), F.lit(0).alias("cancelled")
    )
    assert A.cancel_rate_by_month(rows).agg(F.sum("flights")).first()[0] == 60


def test_matrix_takes_the_destinations_it_finds(spark):
    routes = spark.createDataFrame([("A", "X", 3), ("A", "Y", 2), ("B", "Z", 1)], "origin string, dest string, n int")
    assert A.matrix(routes, "n", fill=0).orderBy("origin").collect() == [("A", 3, 2, 0), ("B", 0, 0, 1)]
