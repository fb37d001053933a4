"""Joins: bands against brute force, domains, lookups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from delaylens.operators import joins as J
from delaylens.operators import ordered as O
from delaylens.operators import ripple as R
from delaylens.sources import readers

START = dt.datetime(2024, 1, 1)
FEED = "_id bigint, mode string, station_key string, code string, line string, min_delay double, min_gap double, timestamp timestamp_ntz"


def row(i, mode, station, seconds, delay=1.0, code="c1"):
    return (i, mode, station, code, "L", delay, 2.0, START + dt.timedelta(seconds=seconds))


@pytest.fixture(scope="module")
def feeds(spark):
    """One station holds most of everything; ids repeat; instants repeat."""
    rng = random.Random(3)
    place = lambda: rng.choice(["HOT"] * 7 + ["B", "C", "TORONTO TRANSIT YARD"])
    subway = [row(i % 150, "subway", place(), rng.randrange(0, 40_000, 30), rng.choice([None, 3.3])) for i in range(200)]
    surface = [
        row(i, rng.choice(["bus", "streetcar"]), place(), rng.randrange(0, 40_000, 30), rng.choice([None, 0.1, 0.2, 7.25]))
        for i in range(400)
    ]
    subway += [row(900, "subway", "LONELY", 10), row(901, "subway", "EDGE", 0), row(901, "subway", "EDGE", 0)]
    surface += [row(900 + n, "bus", "EDGE", s) for n, s in enumerate((0, 3600, 3601, -1))]
    return subway, surface, spark.createDataFrame(subway, FEED), spark.createDataFrame(surface, FEED)


def brute(subway, surface):
    for s in subway:
        if "TORONTO TRANSIT" in s[2]:
            continue
        hits = [f for f in surface if f[2] == s[2] and s[7] <= f[7] <= s[7] + dt.timedelta(hours=1)]
        if any(f[2] == s[2] for f in surface):
            yield s, hits


def test_pairs_equal_brute_force(feeds):
    subway, surface, a, b = feeds
    want = sorted((s[0], s[7], f[7], f[5] or 0.0) for s, hits in brute(subway, surface) for f in hits)
    got = R.matched_pairs(a, b).select("subway_id", "subway_timestamp", "surface_timestamp", "surface_delay")
    assert sorted(map(tuple, got.collect())) == want


def test_incidents_equal_brute_force(feeds):
    subway, surface, a, b = feeds
    want = []
    for s, hits in brute(subway, surface):
        last = max(((f[7] - s[7]).total_seconds() / 60 for f in hits), default=0.0)
        want.append((s[0], s[2], s[7], len(hits), round(sum(f[5] or 0 for f in hits), 6), last, sum(f[1] == "bus" for f in hits)))
    got = R.incidents(a, b).select(
        "subway_id", "station_key", "subway_timestamp", "matched_surface_events",
        F.round("matched_surface_delay", 6), "max_offset_minutes", "bus_hits",
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_window_ends_are_inclusive(feeds):
    _, _, a, b = feeds
    rows = R.incidents(a.filter("station_key = 'EDGE'"), b).collect()
    assert [(r.matched_surface_events, r.max_offset_minutes) for r in rows] == [(2, 60.0), (2, 60.0)]


def test_session_zone_and_its_clock_change_do_not_matter(spark):
    change = dt.datetime(2024, 3, 10, 1, 59) - START
    a = spark.createDataFrame([row(1, "subway", "S", change.total_seconds())], FEED)
    b = spark.createDataFrame([row(5, "bus", "S", change.total_seconds() + 3540)], FEED)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert R.matched_pairs(a, b).first().offset_minutes == 59.0
        assert R.incidents(a, b).first().max_offset_minutes == 59.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_delay_gives_exactly_zero(spark):
    a = spark.createDataFrame([row(1, "subway", "S", 5000)], FEED)
    b = spark.createDataFrame([row(i, "bus", "S", i, 0.1) for i in range(100)] + [row(999, "bus", "S", 5100, 0.0)], FEED)
    only = R.incidents(a, b).first()
    assert (only.matched_surface_events, only.matched_surface_delay) == (1, 0.0)


def test_stations_and_codes(feeds):
    _, _, a, b = feeds
    found = R.incidents(a, b)
    impacts = {r.station_key: r for r in R.station_impacts(found).collect()}
    assert "LONELY" not in impacts and "TORONTO TRANSIT YARD" not in impacts
    edge = impacts["EDGE"]
    assert (edge.subway_incidents, edge.surface_events_in_window, edge.bus_hits, edge.avg_subway_delay) == (2, 4, 4, 1.0)
    book = a.sparkSession.createDataFrame([("C1", "Träger fault")], "code string, description string")
    assert {r.top_codes for r in R.station_top_codes(found, book).collect()} == {"C1: Trger fault"}


def test_timeline_counts_an_event_once_per_incident(spark):
    a = spark.createDataFrame([row(1, "subway", "S", 0), row(2, "subway", "S", 600)], FEED)
    b = spark.createDataFrame([row(5, "bus", "S", 700, 4.0), row(6, "bus", "S", 1801, 1.0)], FEED)
    found = R.incidents(a, b)
    day = R.busiest_day(found, R.focus_station(R.station_impacts(found)))
    rows = R.timeline(found, b, day).orderBy("slot").collect()
    assert [r.subway_incidents for r in rows] == [2, 0, 0, 0]
    assert [r.surface_events for r in rows] == [2, 0, 2, 0]
    assert [r.cumulative_delay for r in rows] == [8.0, 8.0, 10.0, 10.0]


def test_recent_rows_cross_block_borders(spark):
    rows = [(i, "S", START + dt.timedelta(minutes=i), float(i * i % 17), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(
        rows, "incident_id int, station_key string, subway_timestamp timestamp_ntz, target_surface_delay double, target_surface_events double"
    ).withColumns({
        "target_linger_minutes": F.lit(0.0),
    })
    fallback = {t: -1.0 for t in R.TARGETS}
    with_history = R.add_history(df, fallback, kinds=("station",))
    small = {r.incident_id: r for r in R.add_recent(with_history, block=7).collect()}
    assert len(small) == 40
    for i in range(40):
        last = [float(j * j % 17) for j in range(max(0, i - 3), i)]
        every = [float(j * j % 17) for j in range(i)]
        assert small[i].recent_station_delay_3 == pytest.approx(sum(last) / len(last) if last else -1.0)
        assert small[i].station_prev_delay_mean == pytest.approx(sum(every) / len(every) if every else -1.0)
        assert small[i].station_prev_delay_total == pytest.approx(sum(every))
        assert small[i].station_prev_incidents == i


def test_history_of_all_kinds_comes_from_one_sweep(spark, monkeypatch):
    keys = ["S", "T", None]
    rows = [
        (i, keys[min(2, i % 5)] if i % 3 else "S", f"c{i % 4}", "L", START + dt.timedelta(minutes=i // 2),
         None if i % 11 == 0 else float(i * i % 17), float(i % 5), 0.5 * i)
        for i in range(90)
    ] + [(7, "S", "c1", "L", START, 3.0, 1.0, 1.0)] * 2
    df = spark.createDataFrame(
        rows, "incident_id int, station_key string, subway_code string, subway_line string, subway_timestamp timestamp_ntz, "
        "target_surface_delay double, target_surface_events double, target_linger_minutes double")
    stored = []
    for module in (R, O):
        monkeypatch.setattr(module, "materialize", lambda d, real=module.materialize: stored.append(1) or real(d))
    got = R.add_history(df, {t: -1.0 for t in R.TARGETS}, overall=True).collect()
    assert len(stored) == 2 and len(got) == len(rows)

    def when(r):
        return r[4], r[0]

    def mean(values, default):
        return pytest.approx(sum(values) / len(values)) if values else default

    for r in got:
        if r.incident_id == 7:
            continue  # several rows with one order
        own = rows[r.incident_id]
        before = [x for x in rows if when(x) < when(own)]
        station = [x for x in before if x[1] == own[1]]
        assert r.station_prev_incidents == len(station)
        assert r.station_prev_delay_total == pytest.approx(sum(x[5] or 0 for x in station))
        assert r.station_prev_linger_mean == mean([x[7] for x in station], -1.0)
        assert r.code_prev_events_mean == mean([x[6] for x in before if x[2] == own[2]], -1.0)
        assert r.line_prev_delay_mean == r.global_prev_delay or not before
        assert r.global_prev_delay == mean([x[5] or 0 for x in before], 0.0)
    seven = sorted(r.line_prev_incidents for r in got if r.incident_id == 7)
    assert len(seven) == 3 and len(set(seven)) == 3
    assert R.add_history(df.limit(0), {t: 0.0 for t in R.TARGETS}).count() == 0


def test_zero_fill_and_merge(spark):
    counts = spark.createDataFrame([("a", 1, 5)], "k string, m int, n bigint")
    domain = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    got = sorted(tuple(r) for r in J.zero_fill(counts, domain, "k", "m", [1, 2], {"n": 0}).collect())
    assert got == [("a", 1, 5), ("a", 2, 0), ("b", 1, 0), ("b", 2, 0)]
    left = spark.createDataFrame([("x", 1)], "k string, l int")
    right = spark.createDataFrame([("y", 2)], "k string, r int")
    assert sorted(map(tuple, J.merge_counts(left, right, "k", ["l", "r"]).collect())) == [("x", 1, 0), ("y", 0, 2)]


def test_lookup_and_flags(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    dim = spark.createDataFrame([("a", "first")], "code string, text string")
    assert sorted(map(tuple, J.lookup(df, dim, "c", "code", "text", "Unknown").collect())) == [("a", "first"), ("z", "Unknown")]
    flags = spark.createDataFrame([("a", 1)], "c string, flag int")
    assert sorted(map(tuple, J.attach_flag(df, flags, "c", "flag").collect())) == [("a", 1), ("z", 0)]
    assert J.keep_keys(df, flags, "c").count() == 1


def test_codebook_last_wins(spark):
    one = spark.createDataFrame([("k1", "old", 1), ("k1", "newer", 2), (None, "none", 3)], "CODE string, DESCRIPTION string, row_no int")
    two = spark.createDataFrame([("K1", "newest", 1), ("k2", "two", 2)], "CODE string, DESCRIPTION string, row_no int")
    other = spark.createDataFrame([("x",)], "name string")
    got = {r.code: r.description for r in readers.merge_codebook([one, other, two]).collect()}
    assert got == {"K1": "newest", "K2": "two"}
    with pytest.raises(ValueError):
        readers.merge_codebook([other])
