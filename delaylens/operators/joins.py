"""Joins: key-list membership, activity merge, lookups, domains, and time bands."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.functions.scalars import epoch_micros, time_cell
from delaylens.operators.ordered import running
from delaylens.session import materialize


def keep_keys(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is in ``keys``. Spark broadcasts the list when its size allows."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def keep_top_keys(df: DataFrame, ranked: DataFrame, *on: str) -> DataFrame:
    """As ``keep_keys`` for a list that ``limit`` has already bounded to k rows."""
    return df.join(F.broadcast(ranked.select(*on)), list(on), "left_semi")


def attach_flag(df: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """Left join of scores by key; rows without a score are not flagged."""
    hit = flags.select(key, F.col(flag).alias("_flag"))
    return df.join(hit, key, "left").withColumn(flag, F.coalesce("_flag", F.lit(0))).drop("_flag")


def merge_counts(left: DataFrame, right: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Full outer join of two counts per key; a missing side counts zero."""
    both = left.join(right, key, "full_outer")
    return both.select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, default: str) -> DataFrame:
    """Left join of one description column with a default for unknown codes."""
    side = dim.select(F.col(dim_key).alias("_key"), F.col(value).alias("_value"))
    out = df.join(side, F.col(key) == F.col("_key"), "left")
    return out.withColumn(value, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def zero_fill(
    counts: DataFrame,
    domain: DataFrame,
    key: str,
    second: str,
    values: Sequence[object],
    fill: Mapping[str, object],
) -> DataFrame:
    """Every key of the domain with every one of ``values``, absent pairs filled.

    Only distinct keys are expanded, each by the short fixed list ``values``; rows of the
    fact table are never crossed.
    """
    grid = domain.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(
        second, F.explode(F.array(*[F.lit(v) for v in values]))
    )
    return grid.join(counts, [key, second], "left").fillna(dict(fill))


# --- time bands -------------------------------------------------------------------------


def band_pairs(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    minutes: int,
    form: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All pairs with equal key and ``left_ts <= right_ts <= left_ts + minutes``.

    Time is cut into cells as long as the band; a left row visits its own cell and the
    next one. The equi-join on (key, cell) therefore reads a busy key in many pieces and
    tests about two candidate pairs per result; a cell that is hot by itself is split by
    the adaptive skew join. The two frames must not share
    column names except ``key``. Times are compared as ``_left_us`` and ``_right_us``, microseconds
    made once per row, which stay as columns; ``form`` then gives the other columns their final types.
    """
    own = time_cell(left_ts, minutes)
    a = left.withColumns({"_cell": F.explode(F.array(own, own + 1)), "_left_us": epoch_micros(left_ts)})
    b = right.withColumns({"_cell": time_cell(right_ts, minutes), "_right_us": epoch_micros(right_ts)})
    if form is not None:
        a, b = form(a), form(b)
    gap = F.col("_right_us") - F.col("_left_us")
    return a.join(b, [key, "_cell"]).filter((gap >= 0) & (gap <= minutes * 60_000_000)).drop("_cell")


def instant_totals(df: DataFrame, key: str, ts: str, measures: Mapping[str, Column]) -> DataFrame:
    """Events summed per key and instant, computed once: the input of ``band_totals``.

    Measures must be integers or decimals, so that differences of running sums are exact.
    """
    return materialize(df.groupBy(key, ts).agg(*[F.sum(c).alias(n) for n, c in measures.items()]))


def band_totals(
    probes: DataFrame,
    events: DataFrame,
    key: str,
    at: str,
    event_ts: str,
    lower: int,
    upper: int,
) -> DataFrame:
    """Totals of ``instant_totals`` events in ``[at + lower, at + upper]`` minutes per (key, at).

    The pairs are never formed. Every distinct probe adds an opening and a closing mark;
    running sums per key in time order make a probe's total the difference of its two
    marks. Cost grows with rows, not with pairs, and a hot key is cut into slices. The
    first measure has to count the events. ``last_ts`` is the latest event in the band.
    """
    names = [c for c in events.columns if c not in (key, event_ts)]
    kinds = dict(events.dtypes)
    no_time = F.lit(None).cast("timestamp_ntz")
    marks = probes.select(F.col(key).alias("_key"), F.col(at).alias("_at")).distinct()
    summed = events.select(
        F.col(key).alias("_key"), F.col(event_ts).alias("_t"), F.lit(1).alias("_kind"), no_time.alias("_at"),
        *names, F.col(event_ts).alias("last_ts"),
    )

    def mark(kind: int, minutes: int) -> DataFrame:
        moved = F.col("_at") + F.make_dt_interval(mins=F.lit(minutes))
        return marks.select(
            "_key", moved.alias("_t"), F.lit(kind).alias("_kind"), "_at",
            *[F.lit(0).cast(kinds[n]).alias(n) for n in names], no_time.alias("last_ts"),
        )

    points = summed.unionByName(mark(0, lower)).unionByName(mark(2, upper))
    swept = running(points, ["_t", "_kind"], sums=names, maxes=["last_ts"], keys=["_key"])
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    totals = (
        swept.filter(F.col("_kind") != 1)
        .groupBy("_key", "_at")
        .agg(
            *[F.sum(sign * F.col(f"{n}_run")).alias(n) for n in names],
            F.max(F.when(F.col("_kind") == 2, F.col("last_ts_run"))).alias("last_ts"),
        )
    )
    return totals.select(
        F.col("_key").alias(key), F.col("_at").alias(at), *names,
        F.when(F.col(names[0]) > 0, F.col("last_ts")).alias("last_ts"),
    )
