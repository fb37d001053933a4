"""Road segment travel times: profiles, rankings, coverage, priors and residuals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.functions import scalars as S
from delaylens.operators.ordered import histogram, histogram_quantiles, quantiles, running, top_k
from delaylens.session import materialize

VALUE = "timeInSeconds"


# Aggregates that merge from the histogram, so one scan serves them and the quantiles.
MERGED = {
    "records": lambda: F.sum("_n"),
    "mean_time": lambda: F.try_divide(
        F.sum(F.col("_v") * F.col("_n")), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))
    ),
    "mean_sample_size": lambda: F.try_divide(F.sum("_samples"), F.sum("_sampled")),
    "start": lambda: F.min("_start"),
    "end": lambda: F.max("_end"),
}


def _profile(df: DataFrame, key: str, probs: Mapping[str, float], **figures: str) -> DataFrame:
    """``figures`` (output name = entry of ``MERGED``) and exact quantiles per key."""
    extra = {
        "_samples": F.sum("count"), "_sampled": F.count("count"),
        "_start": F.min("updated_local"), "_end": F.max("updated_local"),
    }
    hist = histogram(df.filter(F.col(key).isNotNull()), VALUE, [key], extra)
    plain = hist.groupBy(key).agg(*[MERGED[source]().alias(name) for name, source in figures.items()])
    return plain.join(histogram_quantiles(hist, probs, [key]), key, "left")


def yearly(df: DataFrame) -> DataFrame:
    stats = _profile(
        df, "year", {"median_time": 0.5, "p80_time": 0.8, "p90_time": 0.9},
        records="records", start="start", end="end", mean_time="mean_time", mean_sample_size="mean_sample_size",
    )
    distinct = df.filter(F.col("year").isNotNull()).groupBy("year").agg(F.countDistinct("resultId").alias("segments"))
    return stats.join(distinct, "year")


#: Levels of the profile cube and the columns that hold their keys.
LEVELS = {"hour": "hour", "weekday": "dow", "month": "month", "year": "year", "segment": "resultId"}


def profile_cube(
    df: DataFrame, levels: Mapping[str, str] = LEVELS, probs: Mapping[str, float] | None = None
) -> DataFrame:
    """Figures and exact quantiles of every key of every level from one scan.

    One row per level and key (as text): records, mean_time, mean_sample_size, start, end and the quantiles.
    Grouping sets count the distinct values of all levels together, and this one histogram is
    ranked once. A null key has no row; null values count as records only.
    """
    probs = probs or {"median_time": 0.5, "p80_time": 0.8, "p90_time": 0.9}
    names, columns = list(levels), [f"_key{i}" for i in range(len(levels))]
    rows = df.select(
        *[F.col(c).cast("string").alias(k) for k, c in zip(columns, levels.values())],
        S.nan_to_null(F.col(VALUE).cast("double")).alias("_v"), F.col("count").alias("_count"), F.col("updated_local").alias("_at"),
    )
    sets = rows.groupingSets([[F.col(k), F.col("_v")] for k in columns], *map(F.col, columns), F.col("_v")).agg(
        F.grouping_id().alias("_id"), F.count("*").alias("_n"), F.sum("_count").alias("_samples"),
        F.count("_count").alias("_sampled"), F.min("_at").alias("_start"), F.max("_at").alias("_end"),
    )
    # In a set the bit of its own key, counted from the value's, is 0 and all other keys' bits are 1.
    own = [F.expr(f"(_id >> {len(columns) - i}) & 1") == 0 for i in range(len(columns))]
    level = F.coalesce(*[F.when(o, F.lit(n)) for o, n in zip(own, names)])
    key = F.coalesce(*[F.when(o, F.col(k)) for o, k in zip(own, columns)])
    hist = materialize(
        sets.select(level.alias("level"), key.alias("key"), "_v", "_n", "_samples", "_sampled", "_start", "_end").where("key IS NOT NULL")
    )
    plain = hist.groupBy("level", "key").agg(*[build().alias(name) for name, build in MERGED.items()])
    return plain.join(histogram_quantiles(hist, probs, ["level", "key"]), ["level", "key"], "left")


def _by(df: DataFrame, key: str) -> DataFrame:
    return _profile(df, key, {"median_time": 0.5}, mean_time="mean_time", sample_records="records")


def hourly(df: DataFrame) -> DataFrame:
    return _by(df, "hour")


def weekdays(df: DataFrame) -> DataFrame:
    """All seven weekdays in order; a day without readings has null figures."""
    spark = df.sparkSession
    week = spark.range(7).select(
        (F.col("id") + 1).alias("position"),
        F.element_at(F.array(*map(F.lit, S.WEEKDAYS)), (F.col("id") + 1).cast("int")).alias("dow"),
    )
    return week.join(_by(df, "dow"), "dow", "left").orderBy("position")


def monthly(df: DataFrame, k: int = 24) -> DataFrame:
    return top_k(_by(df, "month"), "month", k)


def segments(df: DataFrame, min_records: int = 500) -> DataFrame:
    stats = _profile(
        df, "resultId", {"median_time": 0.5, "p90_time": 0.9},
        records="records", mean_time="mean_time", mean_sample_size="mean_sample_size",
    )
    return stats.filter(F.col("records") >= min_records)


def worst_and_best(stats: DataFrame, k: int = 15) -> DataFrame:
    worst = top_k(stats, "p90_time", k, "resultId").withColumn("list", F.lit("worst"))
    best = top_k(stats, "mean_time", k, "resultId", ascending=True).withColumn("list", F.lit("best"))
    return worst.unionByName(best)


def coverage(stats: DataFrame, dense: int = 1000) -> DataFrame:
    probs = {"median_records": 0.5, "p5_records": 0.05, "p95_records": 0.95}
    found = quantiles(stats, "records", probs).first()
    share = stats.agg(F.avg((F.col("records") >= dense).cast("int")).alias("dense_share"))
    return share.withColumns({n: F.lit(found[n] if found else None).cast("double") for n in probs})


def weekday_weekend(df: DataFrame) -> DataFrame:
    day = F.col("dow")
    return df.agg(
        F.avg(F.when(day.isin(*S.WEEKDAYS[:5]), F.col(VALUE))).alias("weekday_mean"),
        F.avg(F.when(day.isin(*S.WEEKDAYS[5:]), F.col(VALUE))).alias("weekend_mean"),
    )


def peaks(by_hour: DataFrame, by_month: DataFrame, worst: DataFrame) -> DataFrame:
    """Peak hour by median (the first one), last month, lowest p90 of the worst segments."""
    peak = top_k(by_hour, "median_time", 1, "hour").select(
        F.col("hour").alias("peak_hour"), F.col("median_time").alias("peak_median"), F.lit(1).alias("_row")
    )
    last = by_month.agg(F.max("month").alias("recent_month")).withColumn("_row", F.lit(1))
    tail = worst.agg(F.min("p90_time").alias("long_tail")).withColumn("_row", F.lit(1))
    return peak.join(last, "_row").join(tail, "_row").drop("_row")


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("records"),
        F.countDistinct("resultId").alias("segments"),
        F.date_format(F.min("updated_local"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("updated_local"), "yyyy-MM-dd").alias("last_day"),
    )


# --- model features --------------------------------------------------------------------------


def split_by_date(df: DataFrame, cutoff: str, ts: str = "updated_local") -> tuple[DataFrame, DataFrame]:
    """Rows before local midnight of the cutoff, and the rest."""
    edge = F.lit(cutoff).cast("timestamp_ntz")
    return df.filter(F.col(ts) < edge), df.filter(F.col(ts) >= edge)


def priors(train: DataFrame) -> DataFrame:
    """Mean, p90 and size per segment, from training rows only."""
    return _profile(
        train, "resultId", {"segment_p90": 0.9}, segment_mean="mean_time", segment_records="records"
    )


def attach_priors(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Priors on any rows; an unseen segment takes the unweighted mean over segments."""
    mean = stats.agg(F.avg("segment_mean").alias("m"), F.avg("segment_p90").alias("p")).first()
    joined = df.join(stats, "resultId", "left")
    return joined.withColumns(
        {
            "segment_mean": F.coalesce("segment_mean", F.lit(mean["m"])),
            "segment_p90": F.coalesce("segment_p90", F.lit(mean["p"])),
            "segment_records_log": F.coalesce(F.log1p("segment_records"), F.lit(0.0)),
        }
    ).drop("segment_records")


def codes(values: DataFrame, column: str, name: str) -> DataFrame:
    """Dense codes 0.. in sorted order for the distinct values of a column."""
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    numbered = running(distinct.withColumn("_one", F.lit(1)), [column], sums=["_one"])
    return numbered.select(column, (F.col("_one_run") - 1).alias(name))


def attach_code(df: DataFrame, dim: DataFrame, column: str, name: str) -> DataFrame:
    """Code of a category; unseen ones get -1."""
    return df.join(dim, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def model_frames(df: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with all nine model features."""
    local = df.withColumns({"log_count": F.log1p("count"), "dow_code": F.weekday("updated_local")})
    train, test = split_by_date(local, cutoff)
    segment_codes, month_codes = codes(train, "resultId", "result_code"), codes(local, "month", "month_code")
    stats = priors(train)

    def dress(part: DataFrame) -> DataFrame:
        part = attach_code(part, segment_codes, "resultId", "result_code")
        return attach_priors(attach_code(part, month_codes, "month", "month_code"), stats)

    return dress(train), dress(test)


def segment_errors(
    df: DataFrame, mean: str = "pred_mean", p90: str = "pred_p90", k: int | None = 15
) -> DataFrame:
    """MAE, RMSE and p90 coverage per segment, worst MAE first."""
    error = F.col(VALUE) - F.col(mean)
    per = df.filter(F.col("resultId").isNotNull()).groupBy("resultId").agg(
        F.count("*").alias("records"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg((F.col(VALUE) <= F.col(p90)).cast("int")).alias("coverage_p90"),
    )
    return per if k is None else top_k(per, "mae", k, "resultId")
