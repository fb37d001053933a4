"""A mix of sources at target weights, fitted word for word.

Documents are counted by source and exact size. Per source a bounded knapsack over these counts says
how many documents of each size the mix takes; which ones is a seeded order of the documents of a
size. Texts are read once, for their sizes; after that only narrow rows and counts move.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.tables import stored, table
from delaylens.operators.ordered import running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = 12
#: Words of a budget that are left to the dynamic program, besides one document.
RESERVE = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most its count) have the largest sum up to ``budget``.

    A sum becomes reachable at one size and stays so; ``via`` keeps the place of that size, so that the way
    back needs memory for the budget only. Sizes are positive and distinct.
    """
    taken = np.zeros(len(sizes), np.int64)
    none = len(sizes) + 1
    via = np.full(budget + 1, none, np.int64)
    via[0] = 0
    reached = via < none
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist()), 1):
        if reached[budget]:
            break
        left, step, now = min(count, budget // size), 1, reached.copy()
        while left > 0:
            step = min(step, left)
            now[step * size :] |= now[: len(now) - step * size].copy()
            left, step = left - step, step * 2
        via[now & ~reached] = i
        reached = now
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i = int(via[at])
        at -= int(sizes[i - 1])
        taken[i - 1] += 1
        while via[at] >= i:
            at -= int(sizes[i - 1])
            taken[i - 1] += 1
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each size take ``budget`` words, or as near to it as the sizes allow.

    From the largest size down, each takes what brings the words so far nearest to their share of the
    budget, so that the mix keeps the sizes of its source and small ones make up for large ones. Then
    the smallest are given back until ``reserve`` words are free, and the dynamic program fits those.
    """
    taken = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes > 0)
    some = some[np.argsort(-sizes[some], kind="stable")]
    size, count = sizes[some].tolist(), counts[some].tolist()
    total = sum(s * n for s, n in zip(size, count))
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        taken[some] = count
        return taken
    part, used, seen = [], 0, 0
    for s, n in zip(size, count):
        seen += s * n
        wanted = budget * seen // total - used
        part.append(min(n, max(0, (2 * wanted + s) // (2 * s))))
        used += part[-1] * s
    left = budget - used
    for i in reversed(range(len(size))):
        if left >= reserve:
            break
        back = min(part[i], -(-(reserve - left) // size[i]))
        part[i] -= back
        left += back * size[i]
    if left > 0:
        usable = [i for i in reversed(range(len(size))) if count[i] > part[i] and size[i] <= left]
        more = knapsack(np.array([size[i] for i in usable], np.int64), np.array([count[i] - part[i] for i in usable], np.int64), left)
        for i, n in zip(usable, more.tolist()):
            part[i] += n
    taken[some] = part
    return taken


def _targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for all sources (source, source_size), by one sort.

    A source stops at ``most`` times its size. In the order of stop by weight, a source stops if the budget
    left by those before it, shared by weight, gives it more.
    """
    ranked = running(sources.withColumn("one", F.lit(1)), ["source"], sums=["one"])
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), ((F.col("one_run") - 1) % len(weights) + 1).cast("int"))
    named = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).cast("double").alias("stop"))
    named = stored(named.withColumn("ratio", F.col("stop") / F.col("weight")), "mix-sources")
    total = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, all_weight = share * (total["size"] or 0), total["weight"] or 0
    summed = running(named, ["ratio", "source"], sums=["stop", "weight"])
    before = budget - (F.col("stop_run") - F.col("stop"))
    weight_left = F.lit(all_weight) - (F.col("weight_run") - F.col("weight"))
    judged = stored(summed.select("source", "source_size", "weight", "stop", (F.col("ratio") * weight_left < before).alias("full")), "mix-sources")
    full = judged.where("full").agg(F.sum("stop").alias("stop"), F.sum("weight").alias("weight")).first()
    free = F.lit(budget - (full["stop"] or 0.0)) * F.col("weight") / F.lit(float(all_weight - (full["weight"] or 0)))
    return judged.select("source", "source_size", F.when(F.col("full"), F.col("stop")).otherwise(F.least(free, "stop")).alias("target"))


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    """Rows are the sizes of one source: whole passes over it and, of each size, documents taken once more."""
    group = group.sort_values("size")
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = int(target // total) if total else 0
    budget = int(np.floor(target - passes * total + 0.5)) if total else 0
    more = fit(group["size"].to_numpy(), group["n"].to_numpy(), budget)
    return group[["source", "size", "source_size", "target"]].assign(passes=passes, more=more)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    size=words,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Sources in the order of their code points, null last, have the ``weights`` in turn. They share ``share``
    times all sizes by weight; none gets more than ``most`` times its own, the excess goes to the others.
    A document is taken 0 to ``most`` times, whole: once per whole pass over its source that the target
    allows, and once more if it is among the first of its size, in an order by a seeded hash of doc_id. A
    source's taken words are its target, rounded, or as near as the sizes of its smallest documents allow.

    A null text has size 0 and is never taken, like one without a word. A null source is a source, a null
    doc_id an id. Repeated rows are documents of their own; of those with one id it doesn't matter which is
    taken. Rows of one source with a size have one hash order, range-sorted, so that no task holds them
    all. A source of N words has at most sqrt(2 N) sizes, which one task fits. An empty table gives an empty result.
    """
    assert share < most, "the sources can't fill the mix"
    name = docs["source"].cast("string")
    rows = stored(
        docs.select(
            docs["doc_id"].alias("doc_id"), F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name)).alias("source"),
            size(docs["text"].cast("string")).alias("size"), F.xxhash64(docs["doc_id"], F.lit(seed)).alias("place"),
            F.monotonically_increasing_id().alias("row"),  # only parts equal ids
        ),
        "mix-sizes",
    )
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = _targets(sources, weights, share, most)
    plan = counts.join(targets, "source").groupBy("source").applyInPandas(
        _fit_source, "source string, size long, source_size long, target double, passes long, more long"
    )
    # The plan's row of each size comes first in it and hands its numbers on as running maxima.
    given = ["source_size", "target", "passes", "more"]
    kinds = {"source_size": "bigint", "target": "double", "passes": "bigint", "more": "bigint"}
    lead = plan.select(
        "source", "size", *given, F.lit(0).alias("one"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"),
        F.lit(None).cast("bigint").alias("place"), F.lit(-1).cast("bigint").alias("row"),
    )
    each = rows.select("*", F.lit(1).alias("one"), *[F.lit(None).cast(kinds[c]).alias(c) for c in given])
    ranked = running(lead.unionByName(each), ["one", "place", "doc_id", "row"], sums=["one"], maxes=given, keys=["source", "size"])
    again = (F.col("one_run") <= F.col("more_run")).cast("bigint")
    return ranked.where("one = 1").select(
        "doc_id", "size", F.col("source_size_run").alias("source_size"), F.col("target_run").alias("target"),
        (F.col("size") * (F.col("passes_run") + again)).alias("taken"),
    )


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = {}  # the knapsack can't be said in SQL
QUERIES = {"op12_source_mix": op12_source_mix}
