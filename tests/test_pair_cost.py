"""What a pair of the pair listing costs: nothing is formatted once per pair."""

import datetime as dt

from pyspark.sql import functions as F

from delaylens.operators import ripple as R
from delaylens.plans.registry import run, tidy

START = dt.datetime(1969, 12, 31, 23, 30)
FEED = "_id int, mode string, station_key string, timestamp timestamp_ntz, min_delay double, min_gap double, line string, code string"


def _feed(spark, mode, micros):
    rows = [
        (i % 5, mode, None if i % 9 == 8 else f"S{i % 2}", None if i % 7 == 6 else START + dt.timedelta(microseconds=m),
         [None, float("nan"), 1.0000005, -2.5][i % 4], 0.1 * i, f"L{i}", None if i % 3 else "c1")
        for i, m in enumerate(micros)
    ]
    return spark.createDataFrame(rows + rows[:2], FEED)


def test_early_form_gives_the_same_pairs(spark):
    a = _feed(spark, "subway", range(0, 4_000_000_000, 390_000_010))
    b = _feed(spark, "bus", [*range(0, 4_000, 30), *range(15, 7_300_000_000, 90_000_001), 3_600_000_000, 3_600_000_001])
    want = sorted(map(str, tidy(R.matched_pairs(a, b)).collect()))
    got = R.matched_pairs(a, b, form=tidy)
    assert len(want) > 200 and sorted(map(str, got.collect())) == want
    assert got.dtypes == tidy(R.matched_pairs(a, b)).dtypes


def test_window_ends_are_kept(spark):
    a = _feed(spark, "subway", [0])
    for micros, pairs in ((0, 1), (3_600_000_000, 1), (3_600_000_001, 0)):
        b = _feed(spark, "bus", [micros])
        assert R.matched_pairs(a, b.limit(1)).count() == 2 * pairs


def test_nothing_is_formatted_above_the_join(tables):
    df = run("ripple_matches", tables)
    above = df._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert "date_format" not in above and "round(" not in above and "make_dt_interval" not in above
    assert df.filter(F.col("offset_minutes") > 60).count() == 0


def test_a_feed_is_picked_before_stations_are_cleaned(tables):
    from delaylens.sources.tables import subway

    plan = subway(tables)._jdf.queryExecution().optimizedPlan().toString()
    picked = next(line for line in plan.splitlines() if "Filter" in line)
    assert picked.index("error") < picked.lower().index("regexp_replace")
