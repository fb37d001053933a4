"""Target means of earlier rows against a plain loop, and no leak of a noise label."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from delaylens.ml.ordered_targets import add_ordered_means, score_means, target_state
from delaylens.operators import evaluate as E

START = dt.datetime(2024, 1, 1)
SCHEMA = "incident_id long, subway_timestamp timestamp, a string, b string, y int"


def rows_of(n, seed=5):
    rng = random.Random(seed)
    return [
        (i, START + dt.timedelta(minutes=rng.randrange(n // 2)), rng.choice(["hot"] * 6 + ["x", "y", None]), f"k{rng.randrange(n)}", rng.randrange(2))
        for i in range(n)
    ]


def test_like_a_loop(spark):
    rows = rows_of(600)
    got = {r["incident_id"]: (r["a_mean"], r["b_mean"]) for r in add_ordered_means(spark.createDataFrame(rows, SCHEMA), "y", ["a", "b"]).collect()}
    seen, n, total = {}, 0, 0
    for i, _, a, b, y in sorted(rows, key=lambda r: (r[1], r[0])):
        prior = total / n if n else 0.0
        for at, key in ((0, ("a", a)), (1, ("b", b))):
            m, t = seen.get(key, (0, 0))
            assert got[i][at] == pytest.approx((t + 10 * prior) / (m + 10), abs=1e-12)
            seen[key] = (m + 1, t + y)
        n, total = n + 1, total + y
    assert len(got) == 600


def test_noise_label_is_not_read_off_rare_keys(spark):
    """Nearly every row has a key of its own: a plain mean separates the classes, an ordered one can't."""
    df = spark.createDataFrame(rows_of(6000, seed=9), SCHEMA)
    ordered = add_ordered_means(df, "y", ["a", "b"])
    plain = score_means(df, target_state(df, "y", ["b"]), ["b"])
    area = lambda d, c: E.roc_auc(d, "y", c).first()[0]
    assert abs(area(ordered, "b_mean") - 0.5) < 0.03 and abs(area(ordered, "a_mean") - 0.5) < 0.03
    assert area(plain, "b_mean") > 0.7


def test_state_scores_unseen_and_null_values(spark):
    train = spark.createDataFrame([(1, START, "p", None, 1), (2, START, "p", None, 0), (3, START, "q", None, 1), (4, START, "q", None, None)], SCHEMA)
    state = target_state(train, "y", ["a", "b"])
    new = spark.createDataFrame([(9, START, "p", None, None), (10, START, "new", "new", None), (11, START, None, None, None)], SCHEMA)
    got = {r["incident_id"]: (r["a_mean"], r["b_mean"]) for r in score_means(new, state, ["a", "b"]).collect()}
    prior = 2 / 4
    assert got[9] == pytest.approx(((1 + 10 * prior) / 12, (2 + 10 * prior) / 14))
    assert got[10] == pytest.approx((prior, prior)) and got[11][0] == pytest.approx(prior)


def test_empty_and_without_weight(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert add_ordered_means(none, "y", ["a"]).count() == 0
    state = target_state(none, "y", ["a"])
    one = spark.createDataFrame([(1, START, "p", "r", 1)], SCHEMA).withColumn("a_mean", F.lit("taken"))
    assert score_means(one, state, ["a"]).first()["a_mean"] == 0.0
    assert add_ordered_means(one, "y", ["a"], weight=0.0).first()["a_mean"] is None
