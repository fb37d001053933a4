import datetime as dt

import numpy as np
import pytest

from delaylens.operators import travel_time as V

SCHEMA = "resultId string, timeInSeconds double, count bigint, updated_local timestamp_ntz, hour int, dow string, month string, year int"
START = dt.datetime(2024, 1, 1)


def test_levels_equal_their_own_profiles(spark):
    rows = [
        (None if i % 13 == 0 else f"S{i % 3 if i % 2 else 0}", None if i % 7 == 0 else float("nan") if i % 19 == 0 else float(i * i % 23),
         None if i % 5 == 0 else i, START + dt.timedelta(hours=i), i % 24, "Monday" if i % 2 else None, "2024-01", 2024)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.level, r.key): r for r in V.profile_cube(df).collect()}
    position = {"hour": 4, "weekday": 5, "month": 6, "year": 7, "segment": 0}
    want = {(level, str(r[at])) for level, at in position.items() for r in rows if r[at] is not None}
    assert set(got) == want
    for (level, key), r in got.items():
        own = [x for x in rows if x[position[level]] is not None and str(x[position[level]]) == key]
        values = [x[1] for x in own if x[1] is not None and x[1] == x[1]]
        counts = [x[2] for x in own if x[2] is not None]
        assert r.records == len(own) and r.start == min(x[3] for x in own) and r.end == max(x[3] for x in own)
        assert r.mean_time == pytest.approx(np.mean(values)) and r.mean_sample_size == pytest.approx(np.mean(counts))
        for name, p in (("median_time", 0.5), ("p80_time", 0.8), ("p90_time", 0.9)):
            assert r[name] == pytest.approx(np.quantile(values, p))


def test_no_rows_and_one_level(spark):
    df = spark.createDataFrame([("a", None, None, START, 1, None, None, None)], SCHEMA)
    assert V.profile_cube(df.limit(0)).count() == 0
    only = V.profile_cube(df, levels={"segment": "resultId"}, probs={"q": 0.5}).collect()
    assert [(r.level, r.key, r.records, r.mean_time, r.q) for r in only] == [("segment", "a", 1, None, None)]


def test_one_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 1, START, 1, "Monday", "2024-01", 2024)] * 3, SCHEMA)
    plans = []
    real = V.materialize
    V.materialize = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d)
    try:
        df.write.parquet(f"{tmp_path}/t")
        V.profile_cube(spark.read.parquet(f"{tmp_path}/t")).count()
    finally:
        V.materialize = real
    assert len(plans) == 1 and plans[0].count("FileScan parquet") == 1 and "Expand" in plans[0]
