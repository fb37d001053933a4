"""Categories as target means of earlier rows only, and the state that scores new rows.

A mean over all training rows contains the row's own label, so a model can read labels off rare keys.
Here a training row sees only what came before it; a row to be scored sees the whole training table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.operators.radix import bounded
from delaylens.operators.ripple import EXACT_HISTORY, OVERALL, ROW, earlier_sums, numbered
from delaylens.session import materialize

#: Rows that the mean over all rows counts for beside a category's own.
WEIGHT = 10.0


def _smoothed(total: Column, rows: Column, prior: Column, weight: float) -> Column:
    top = F.coalesce(total.cast("double"), F.lit(0.0)) + prior * weight
    return F.try_divide(top, F.coalesce(rows, F.lit(0)) + F.lit(weight))


def _mean(total: Column, rows: Column) -> Column:
    """Mean so far, 0 before the first row."""
    return F.when(rows > 0, total.cast("double") / rows).otherwise(F.lit(0.0))


def add_ordered_means(df: DataFrame, label: str, categories: Sequence[str], weight: float = WEIGHT) -> DataFrame:
    """Add ``<category>_mean``: the label's mean over earlier rows of the category, drawn to that of all
    earlier rows by ``weight`` rows.

    Order is (subway_timestamp, incident_id, row), as in the history features, and all categories come
    from one sweep. A null category is a category of its own, a null label counts as 0, the first row
    gets 0. Columns of these names are replaced.
    """
    rows = numbered(df)
    kinds = {f"c{i}": c for i, c in enumerate(categories)} | {OVERALL: None}
    seen = earlier_sums(rows, kinds, {"label": label})
    prior = _mean(F.col(f"_{OVERALL}_label"), F.col(f"_{OVERALL}_one"))
    made = {
        f"{c}_mean": _smoothed(F.col(f"_c{i}_label"), F.col(f"_c{i}_one"), prior, weight) for i, c in enumerate(categories)
    }
    kept = [c for c in df.columns if c != ROW and c not in made]
    return rows.join(seen, ROW).select(*kept, *[v.alias(n) for n, v in made.items()])


def target_state(df: DataFrame, label: str, categories: Sequence[str]) -> DataFrame:
    """Rows and label sum per category and value, and of all rows, from one scan: what scoring needs.

    The result can be written as a table beside the model.
    """
    value = F.coalesce(F.col(label).cast(EXACT_HISTORY), F.lit(0)).cast(EXACT_HISTORY)
    named = [F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("key")) for c in categories]
    overall = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("key"))
    stacked = df.select(value.alias("_value"), F.inline(F.array(*named, overall)))
    return materialize(stacked.groupBy("category", "key").agg(F.count("*").alias("rows"), F.sum("_value").alias("total")))


def score_means(df: DataFrame, state: DataFrame, categories: Sequence[str], weight: float = WEIGHT) -> DataFrame:
    """Add ``<category>_mean`` from a ``target_state``; an unseen value gets the mean of all rows (0 if none)."""
    one = state.filter(F.col("category").isNull()).agg(F.sum("total").alias("t"), F.sum("rows").alias("n")).first()
    prior = F.lit(float(one["t"]) / one["n"] if one["n"] else 0.0)
    done = df.drop(*[f"{c}_mean" for c in categories])
    plain = done.columns
    for i, c in enumerate(categories):
        part = state.filter(F.col("category") == c).select(
            F.col("key").alias(f"_k{i}"), F.col("rows").alias(f"_n{i}"), F.col("total").alias(f"_t{i}")
        )
        done = done.join(bounded(part, [f"_k{i}"]), F.col(c).cast("string").eqNullSafe(F.col(f"_k{i}")), "left")
    made = [_smoothed(F.col(f"_t{i}"), F.col(f"_n{i}"), prior, weight).alias(f"{c}_mean") for i, c in enumerate(categories)]
    return done.select(*plain, *made)
