"""Metrics as aggregations: nothing is collected, ties are handled exactly.

Curve metrics first reduce the rows to one per distinct score and then use ``running``,
so neither sorting nor accumulation happens in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.operators.ordered import running, top_k

EPSILON = 2.220446049250313e-16  # double precision machine epsilon


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("bigint")), F.lit(0))


def _score_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative positives and negatives by descending score, one row per score."""
    hist = df.groupBy(F.col(score).alias("score")).agg(
        _count_if(F.col(label) == 1).alias("pos"), _count_if(F.col(label) == 0).alias("neg")
    )
    return running(hist, [F.col("score").desc()], sums=["pos", "neg"])


def _area() -> Column:
    """Share of positive/negative pairs in the right order, ties counting half."""
    above = F.col("pos_run") - F.col("pos")
    wins = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    # The last cumulative counts are the totals.
    return F.try_divide(wins, F.max("pos_run").cast("double") * F.max("neg_run").cast("double")).alias("roc_auc")


def _step_precision() -> Column:
    """Recall gained at each score times the precision there."""
    precision = F.col("pos_run") / (F.col("pos_run") + F.col("neg_run"))
    return F.try_divide(F.sum(F.col("pos") * precision), F.max("pos_run")).alias("average_precision")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return _score_steps(df, label, score).agg(_area())


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Step form, not interpolated."""
    return _score_steps(df, label, score).agg(_step_precision())


def ranking(df: DataFrame, label: str, score: str) -> DataFrame:
    """AUC and average precision from one pass."""
    return _score_steps(df, label, score).agg(_area(), _step_precision())


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One point per distinct score; the point (0, 0) is implied."""
    steps = _score_steps(df, label, score)
    size = steps.agg(F.max("pos_run").alias("p"), F.max("neg_run").alias("n")).first()
    return steps.select(
        F.col("score").alias("threshold"),
        F.try_divide("neg_run", F.lit(size["n"]).cast("bigint")).alias("fpr"),
        F.try_divide("pos_run", F.lit(size["p"]).cast("bigint")).alias("tpr"),
    )


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """tn, fp, fn, tp with precision, recall and F1; an empty denominator gives 0."""
    y, z = F.col(label), F.col(pred)
    cells = df.agg(
        _count_if((y == 0) & (z == 0)).alias("tn"), _count_if((y == 0) & (z == 1)).alias("fp"),
        _count_if((y == 1) & (z == 0)).alias("fn"), _count_if((y == 1) & (z == 1)).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class, accuracy, macro and weighted rows: precision, recall, F1, support."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("z")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(0)
    # At most classes x classes rows from here on.
    as_label = pairs.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    as_pred = pairs.groupBy(F.col("z").alias("c")).agg(F.sum("n").alias("predicted"))
    both = as_label.join(as_pred, "c", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    per = both.select(
        F.col("c").cast("string").alias("class"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "tp",
    )
    figures = ("precision", "recall", "f1")
    every = F.sum("support").alias("support")
    accuracy = _ratio(F.sum("tp"), F.sum("support"))
    weighted = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    rows = [
        per.drop("tp"),
        per.agg(F.lit("accuracy").alias("class"), *[accuracy.alias(c) for c in figures], every),
        per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in figures], every),
        per.agg(F.lit("weighted avg").alias("class"), *[weighted(c).alias(c) for c in figures], every),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def regression(df: DataFrame, label: str, pred: str, *groups: str) -> DataFrame:
    """MAE, RMSE and R2 in one pass."""
    y, error = F.col(label), F.col(label) - F.col(pred)
    squared = F.sum(error * error)
    return df.groupBy(*groups).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(squared, F.var_pop(y) * F.count(y))).alias("r2"),
        F.count("*").alias("rows"),
    )


def mape(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Mean absolute percentage error; a zero target divides by machine epsilon, and a
    second figure leaves zero targets out."""
    y, error = F.abs(F.col(label)), F.abs(F.col(label) - F.col(pred))
    return df.agg(
        F.avg(error / F.greatest(y, F.lit(EPSILON))).alias("mape"),
        F.avg(F.when(y > 0, error / y)).alias("mape_nonzero"),
    )


def pinball(df: DataFrame, label: str, pred: str, alpha: float = 0.9) -> DataFrame:
    """Quantile loss and the share of targets at or below the prediction."""
    gap = F.col(label) - F.col(pred)
    return df.agg(
        F.avg(F.greatest(alpha * gap, (alpha - 1) * gap)).alias("pinball_loss"),
        F.avg((F.col(label) <= F.col(pred)).cast("int")).alias("coverage"),
    )


def sweep_values(low: float = 0.1, high: float = 0.8, steps: int = 36) -> list[float]:
    """Equally spaced thresholds, both ends included."""
    width = (high - low) / (steps - 1)
    return [*(low + i * width for i in range(steps - 1)), high]


def threshold_scores(
    df: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """F1 at every threshold (predict 1 from the threshold up).

    A row is reduced to the number of thresholds its score reaches, so the data are read
    once and one row per number and class is left.
    """
    grid = sorted(thresholds or sweep_values())
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    hist = df.groupBy(reached.alias("reached")).agg(
        _count_if(F.col(label) == 1).alias("pos"), _count_if(F.col(label) == 0).alias("neg")
    )
    marks = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    # At most len(grid) + 1 rows, each listed under every threshold.
    spread = hist.withColumn("m", F.explode(marks))
    hit = F.col("reached") >= F.col("m.i")
    tp, fp = F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum(F.when(hit, F.col("neg")).otherwise(0))
    positives = F.sum("pos")
    return spread.groupBy(F.col("m.threshold").alias("threshold")).agg(
        _ratio(2 * tp, tp + fp + positives).alias("f1")
    )


def best_threshold(df: DataFrame, label: str, score: str, thresholds=None) -> DataFrame:
    """The threshold of the highest F1, the lowest one on a tie."""
    return top_k(threshold_scores(df, label, score, thresholds), "f1", 1, "threshold")


def zero_baseline(df: DataFrame, target: str, split: str, labels: Sequence[str]) -> DataFrame:
    """Error of always predicting zero, and label rates, per split."""
    return df.groupBy(split).agg(
        F.count("*").alias("incidents"),
        F.avg(F.abs(target)).alias("baseline_mae"),
        F.sqrt(F.avg(F.col(target) * F.col(target))).alias("baseline_rmse"),
        *[F.avg(c).alias(f"{c}_rate") for c in labels],
    )
