"""Order-dependent operators that never put a whole table or key into one task.

``running`` is the base: range-partition by key and order, so that a hot key is cut into
many slices, total each slice, carry the totals forward, and finish inside the slices.
Exact quantiles and exact first-k splits are built on it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylens.functions import scalars as S
from delaylens.operators.radix import radix_quantiles
from delaylens.session import materialize


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def running(
    df: DataFrame,
    order_by: Sequence[str | Column],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    keys: Sequence[str] = (),
    suffix: str = "_run",
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running sums and maxima per key in the given order.

    ``order_by`` has to order the rows of a key completely for row-exact results. The
    slice numbers are fixed by materialising them, because the totals and the rows must
    see the same slices.
    """
    keys, order = list(keys), [F.col(c) if isinstance(c, str) else c for c in order_by]
    key_cols = [F.col(k) for k in keys]
    ranged = (
        df.repartitionByRange(slices, *key_cols, *order)
        if slices
        else df.repartitionByRange(*key_cols, *order)
    )
    sliced = materialize(ranged.withColumn("_slice", F.spark_partition_id()))

    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(c).alias(f"_t_{c}") for c in sums], *[F.max(c).alias(f"_t_{c}") for c in maxes]
    )
    # One row per key and slice: the only unsliced window runs over these few rows.
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k_slice"),
        *[F.sum(f"_t_{c}").over(ahead).alias(f"_o_{c}") for c in sums],
        *[F.max(f"_t_{c}").over(ahead).alias(f"_o_{c}") for c in maxes],
    )
    match = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        match = match & _same(F.col(k), F.col(f"_k_{k}"))
    joined = sliced.join(offsets, match, "left")

    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = {}
    for c in sums:
        part = F.sum(c).over(inside)
        out[f"{c}{suffix}"] = F.when(F.col(f"_o_{c}").isNull(), part).otherwise(
            F.coalesce(part + F.col(f"_o_{c}"), F.col(f"_o_{c}"))
        )
    for c in maxes:
        out[f"{c}{suffix}"] = F.greatest(F.max(c).over(inside), F.col(f"_o_{c}"))
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def histogram(
    df: DataFrame, value: str, keys: Sequence[str] = (), extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows per key and distinct value as (keys, _v, _n), computed once.

    Combines on the map side and spreads a hot key over its values. ``extra`` adds further
    aggregates to the same pass; whatever can be merged again need not be scanned for.
    """
    more = [c.alias(n) for n, c in (extra or {}).items()]
    grouped = df.groupBy(*keys, S.nan_to_null(F.col(value).cast("double")).alias("_v"))
    return materialize(grouped.agg(F.count("*").alias("_n"), *more))


def histogram_quantiles(
    hist: DataFrame, probs: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Quantiles with linear interpolation per key from a ``histogram``.

    The histogram is ranked with ``running`` whatever its size, so no task holds a key.
    """
    keys = list(keys)
    names, ranks = list(probs), [float(p) for p in probs.values()]
    hist = hist.filter(F.col("_v").isNotNull())
    ranked = running(hist.select(*keys, "_v", "_n"), ["_v"], sums=["_n"], keys=keys)
    sizes = hist.groupBy(*[F.col(k).alias(f"_s_{k}") for k in keys]).agg(F.sum("_n").alias("_size"))
    if keys:
        match = F.lit(True)
        for k in keys:
            match = match & _same(F.col(k), F.col(f"_s_{k}"))
        ranked = ranked.join(sizes, match)
    else:
        ranked = ranked.withColumn("_size", F.lit(sizes.first()["_size"]))
    first, past = F.col("_n_run") - F.col("_n"), F.col("_n_run")
    picks = []
    for i, p in enumerate(ranks):
        at = (F.col("_size") - 1) * F.lit(p)
        for part, spot in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= spot) & (spot < past), F.col("_v"))).alias(f"_{part}{i}"))
    got = ranked.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for i, (name, p) in enumerate(zip(names, ranks)):
        at = (F.col("_size") - 1) * F.lit(p)
        weight, lo, hi = at - F.floor(at), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * weight).alias(name))
    return got.select(*keys, *out)


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    approx: bool = False,
    store: bool = True,
) -> DataFrame:
    """Quantiles per key; ``probs`` maps output names to ranks.

    ``approx`` trades exactness for a bounded sketch per key. Otherwise ranks are found by radix
    selection; where a ``histogram`` is at hand for other figures, take ``histogram_quantiles``.
    ``store=False`` is for input that is cheap to read again, see ``radix_quantiles``.
    """
    if approx:
        names, ranks = list(probs), [float(p) for p in probs.values()]
        kept = df.filter(F.col(value).isNotNull())
        got = kept.groupBy(*keys).agg(F.percentile_approx(value, ranks, 10_000).alias("_q"))
        return got.select(*keys, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return radix_quantiles(df, value, probs, keys, store)


def first_k(
    df: DataFrame,
    take: Callable[[Column], Column],
    coarse: str,
    fine: Sequence[str | Column],
    flag: str = "_first",
    key: str | None = None,
) -> DataFrame:
    """Mark exactly the first ``take(rows)`` rows in the order (coarse, fine) with 1.

    With ``key`` every class is cut by itself, however many there are. Only the counts per
    coarse value are ranked; rows at the one value where a cut falls are ranked among
    themselves, all others are decided by a comparison. Cuts are joined as columns of the
    data's own types, so no session zone enters.
    """
    keys = [key] if key else []
    counts = materialize(df.groupBy(*keys, coarse).agg(F.count("*").alias("_n")))
    named = [F.col(k).alias("_class") for k in keys] or [F.lit(0).alias("_class")]
    sizes = counts.groupBy(*named).agg(F.sum("_n").alias("_size"))
    wanted = sizes.select("_class", F.least(F.greatest(take(F.col("_size")), F.lit(0)), F.col("_size")).alias("_k"))
    ranked = running(counts, [coarse], sums=["_n"], keys=keys)
    own = F.col(key) if key else F.lit(0)
    cuts = (
        ranked.join(wanted, _same(own, F.col("_class")))
        .filter((F.col("_n_run") >= F.col("_k")) & (F.col("_n_run") - F.col("_n") < F.col("_k")))
        .select(
            "_class", F.col(coarse).alias("_edge"), (F.col("_k") - F.col("_n_run") + F.col("_n")).alias("_rest"),
            F.col("_n").alias("_at_edge"),
        )
    )
    cuts = materialize(cuts)  # one row per class
    placed = df.join(cuts, _same(own, F.col("_class")), "left")
    on_edge = F.col("_rest").isNotNull() & _same(F.col(coarse), F.col("_edge"))
    lower = F.coalesce(F.col(coarse) < F.col("_edge"), F.col(coarse).isNull() & F.col("_edge").isNotNull())
    split = on_edge & (F.col("_rest") < F.col("_at_edge"))
    known = placed.filter(~split).withColumn(flag, (F.col("_rest").isNotNull() & (lower | on_edge)).cast("int"))
    if cuts.filter(F.col("_rest") < F.col("_at_edge")).isEmpty():
        return known.select(*df.columns, flag)
    tied = placed.filter(split).withColumn("_one", F.lit(1))
    marked = running(tied, fine, sums=["_one"], keys=keys).withColumn(flag, (F.col("_one_run") <= F.col("_rest")).cast("int"))
    return known.select(*df.columns, flag).unionByName(marked.select(*df.columns, flag))


def top_k(df: DataFrame, metric: str, k: int, *tie_break: str, ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) metric; nulls last, ties by key."""
    by = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(by, *[F.col(c).asc() for c in tie_break]).limit(k)
