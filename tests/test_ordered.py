"""Order-dependent operators against plain windows and plain Python, hot keys included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from delaylens.operators import sampling as H
from delaylens.operators.ordered import first_k, histogram, histogram_quantiles, quantiles, running, top_k


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows, 70 % of them under one key, some without a key."""
    rng = random.Random(7)
    keys = ["hot"] * 1400 + ["b"] * 500 + ["c"] * 90 + [None] * 10
    rows = [(i, k, rng.randrange(300), rng.randrange(-50, 50), rng.random()) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "id int, k string, t int, v int, x double").repartition(5).cache()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_equals_window(skewed, keys):
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("id", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    got = running(skewed.withColumn("w", F.col("v")), ["t", "id"], sums=["v"], maxes=["w"], keys=keys, slices=13)
    both = got.join(want, "id")
    assert both.count() == 2000
    assert both.filter((F.col("v_run") != F.col("s")) | (F.col("w_run") != F.col("m"))).count() == 0


def test_running_descending_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "t int, v int")
    rows = {r["t"]: r["v_run"] for r in running(df, [F.col("t").desc()], sums=["v"], slices=3).collect()}
    assert rows == {4: 7, 3: 7, 2: 12, 1: 12}


def test_hot_key_is_cut_into_slices(skewed, spark):
    ranged = skewed.repartitionByRange(13, "k", "t", "id").withColumn("s", F.spark_partition_id())
    largest = ranged.groupBy("s").count().agg(F.max("count")).first()[0]
    assert largest < 1400 / 3


def test_quantiles_like_pandas(skewed):
    pandas = skewed.filter("k is not null").toPandas().groupby("k")["x"].quantile([0.01, 0.5, 0.9]).unstack()
    got = quantiles(
        skewed.filter("k is not null"), "x", {"a": 0.01, "b": 0.5, "c": 0.9}, keys=["k"]
    ).collect()
    assert len(got) == 3
    for r in got:
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(pandas.loc[r["k"]]), abs=1e-12)


def test_quantiles_without_keys_skip_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (4.0,), (float("nan"),)], "x double")
    assert quantiles(df, "x", {"m": 0.5, "q": 0.25}).first().asDict() == {"m": 2.0, "q": 1.5}


def test_histogram_merges_extra(skewed):
    hist = histogram(skewed, "v", ["k"], {"_s": F.sum("t")})
    assert hist.agg(F.sum("_n")).first()[0] == 2000
    assert hist.agg(F.sum("_s")).first()[0] == skewed.agg(F.sum("t")).first()[0]
    assert histogram_quantiles(hist, {"m": 0.5}, ["k"]).count() == 4


def test_approximate_quantile_is_close(skewed):
    got = quantiles(skewed, "x", {"m": 0.5}, approx=True).first()["m"]
    assert abs(got - quantiles(skewed, "x", {"m": 0.5}).first()["m"]) < 0.01


@pytest.mark.parametrize("k", [0, 1, 700, 1333, 2000, 5000])
def test_first_k_is_exact(skewed, k):
    out = first_k(skewed, lambda rows: F.lit(k), "t", ["t", "id"])
    picked = {r["id"] for r in out.filter("_first = 1").collect()}
    ordered = [r["id"] for r in skewed.orderBy("t", "id").collect()]
    assert out.count() == 2000 and picked == set(ordered[:k])


def test_first_k_per_class(skewed):
    out = first_k(skewed, lambda rows: F.floor(rows / 3), "t", ["t", "id"], key="k")
    counts = {r["k"]: (r["n"], r["f"]) for r in out.groupBy("k").agg(F.count("*").alias("n"), F.sum("_first").alias("f")).collect()}
    assert counts == {"hot": (1400, 466), "b": (500, 166), "c": (90, 30), None: (10, 3)}


def test_first_k_keeps_every_class(spark):
    many = spark.range(6000).select((F.col("id") % 1500).alias("k"), "id")
    out = first_k(many, lambda rows: F.floor(rows / 2), "id", ["id"], key="k")
    per_class = out.groupBy("k").agg(F.count("*").alias("n"), F.sum("_first").alias("f"))
    assert per_class.count() == 1500 and per_class.filter("n = 4 AND f = 2").count() == 1500


def test_time_cut_does_not_depend_on_the_zone(spark):
    rows = spark.range(100).select("id", F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7)").alias("ts"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/Toronto", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            train = H.temporal_split(rows, 0.8, "ts", ["id"]).filter("is_train = 1")
            assert sorted(r["id"] for r in train.collect()) == list(range(80)), other
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sample_sizes_and_repeatability(skewed):
    once = sorted(r["id"] for r in H.sample_n(skewed, 123, ["id"]).collect())
    again = sorted(r["id"] for r in H.sample_n(skewed.repartition(3), 123, ["id"]).collect())
    assert len(set(once)) == 123 and once == again
    assert once != sorted(r["id"] for r in H.sample_n(skewed, 123, ["id"], seed=1).collect())
    assert H.sample_n(skewed, 99_999, ["id"]).count() == 2000


def test_sample_with_equal_hashes_is_exact(spark):
    same = spark.range(50).select(F.lit(1).alias("a"))
    assert H.sample_n(same, 20, ["a"]).count() == 20


def test_splits(skewed):
    cut = H.stratified_split(skewed, "k", 0.2, ["id"])
    got = {r["k"]: r["s"] for r in cut.groupBy("k").agg(F.sum("is_test").alias("s")).collect()}
    assert got == {"hot": 280, "b": 100, "c": 18, None: 2}
    near = H.stratified_split(skewed, "k", 0.2, ["id"], exact=False).agg(F.avg("is_test")).first()[0]
    assert abs(near - 0.2) < 0.05
    train, test = H.random_split(skewed, 0.2, ["id"])
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    timed = H.temporal_split(skewed, 0.85, "t", ["id"])
    assert timed.agg(F.sum("is_train")).first()[0] == 1700
    last = timed.filter("is_train = 1").agg(F.max(F.struct("t", "id"))).first()[0]
    assert timed.filter("is_train = 0").agg(F.min(F.struct("t", "id"))).first()[0] > last


def test_top_k_ties_and_nulls(spark):
    df = spark.createDataFrame([("c", 5), ("a", 5), ("b", 5), ("d", None), ("e", 1)], "k string, n int")
    assert [r["k"] for r in top_k(df, "n", 2, "k").collect()] == ["a", "b"]
    assert [r["k"] for r in top_k(df, "n", 9, "k", ascending=True).collect()] == ["e", "a", "b", "c", "d"]
