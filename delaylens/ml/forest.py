"""A random forest of regression trees, each grown in a task of its own and packed into flat arrays.

Bootstrap draws are spread over the trees by hash, so that a row meets a tree a Poisson number of
times; trees then grow side by side in one Spark job, level by level over binned features. The
packed forest is a handful of arrays: children of a node lie next to each other and a leaf is its
own child, so scoring is the same gather for all rows and trees until the deepest leaf.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.operators.sampling import UNIT, row_hash, uniform

# Task functions travel with their code: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows a tree draws at most, on average; a table with fewer gives each tree as many as it has.
ROWS_PER_TREE = 1 << 14
BINS = 255
#: Rows that bin edges are taken from.
SAMPLE = 1 << 16
#: Bytes of a packed forest that may be sent to the tasks. Trees have at most two nodes a drawn row.
MOST_BYTES = 512 << 20
#: Row and tree pairs scored at once.
BLOCK = 1 << 17
TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, child array<int>, value array<double>, depth int, gain array<double>"


@dataclass(frozen=True)
class Forest:
    """Trees one after another; ``child`` is the left child, the right one follows it."""

    features: tuple[str, ...]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int
    gain: np.ndarray

    def sent(self, df: DataFrame):
        """Broadcast as plain arrays: ``Forest(*sent.value)`` needs no package on the workers."""
        return df.sparkSession.sparkContext.broadcast(tuple(getattr(self, f.name) for f in fields(self)))

    @property
    def bytes(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.threshold, self.child, self.value))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of ``x`` reaches in each tree. Missing values go left."""
        n, trees = len(x), len(self.roots)
        flat, row = np.ascontiguousarray(x).ravel(), np.repeat(np.arange(n) * x.shape[1], trees)
        feature, child = self.feature.astype(np.intp), self.child.astype(np.intp)
        at, spot = np.tile(self.roots.astype(np.intp), n), np.empty(n * trees, np.intp)
        value, edge = np.empty(n * trees), np.empty(n * trees)
        for _ in range(self.depth):
            # All indices are in range: "clip" only spares numpy a copy of its output.
            np.add(np.take(feature, at, out=spot, mode="clip"), row, out=spot)
            above = np.take(flat, spot, out=value, mode="clip") > np.take(self.threshold, at, out=edge, mode="clip")
            np.add(np.take(child, at, out=spot, mode="clip"), above, out=at)
        return at.reshape(n, trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        step = max(1, BLOCK // len(self.roots))
        parts = [self.value[self.leaves(x[i : i + step])].mean(1) for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add the mean of all trees; rows stay where they are."""
        shared = self.sent(df)

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(Forest(*shared.value).predict(np.column_stack([c.to_numpy(float) for c in columns])))

        return df.withColumn(name, score(*[F.col(c).cast("double") for c in self.features]))

    def importances(self) -> list[tuple[str, float]]:
        """Share of each feature in the decrease of squared error, averaged over the trees."""
        return list(zip(self.features, self.gain.tolist()))


def grow(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, edges: list[np.ndarray], depth: int | None, min_leaf: int,
    bins: list[np.ndarray] | None = None,
) -> dict[str, list]:
    """One tree by least squares. All nodes of a level are split at once from sums per node and bin.

    ``bins`` are the places of the values of each feature among its edges, if they are known already.
    """
    n, width = len(y), max((len(e) for e in edges), default=0) + 1
    if bins is None:
        bins = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    table = np.stack(bins) if bins else np.zeros((0, n), np.intp)
    feature, threshold, child, value, gains = [0], [np.inf], [0], [0.0], np.zeros(len(edges))
    node = np.zeros(n, np.int64)  # of the active rows, in the whole tree
    rows, level = np.arange(n), 0
    while len(rows):
        there = np.bincount(node) > 0
        ids, local = np.flatnonzero(there), (np.cumsum(there) - 1)[node]
        k, wr, yr = len(ids), w[rows], y[rows]
        sw, sy = np.bincount(local, wr, k), np.bincount(local, wr * yr, k)
        mean = sy / sw
        for i, m in zip(ids.tolist(), mean.tolist()):
            value[i] = m
        if depth is not None and level >= depth:
            break
        spread = np.bincount(local, wr * (yr - mean[local]) ** 2, k)
        best, cut, by = 1e-9 * np.maximum(spread, 1e-12), np.zeros(k, np.int64), np.full(k, -1)
        ends = np.cumsum(np.bincount(local, minlength=k))
        moved, first = wr * (yr - mean[local]), local * width
        owner = np.repeat(np.arange(k), np.diff(ends, prepend=0))
        for f in range(len(edges)):
            # Rows by node and bin: the sums to the left of each place inside a node where the bin changes.
            key = first + table[f][rows]
            order = np.argsort(key.astype(np.uint16) if k * width <= 1 << 16 else key, kind="stable")  # short ones faster
            key = key[order]
            at = np.flatnonzero(key[1:] != key[:-1])
            at = at[owner[at] == owner[at + 1]]
            if not len(at):
                continue
            own = owner[at]
            past_w, past_y = np.cumsum(wr[order]), np.cumsum(moved[order])
            left_w = past_w[at] - np.append(0.0, past_w[ends[:-1] - 1])[own]
            left_y = past_y[at] - np.append(0.0, past_y[ends[:-1] - 1])[own]
            right_w = sw[own] - left_w
            with np.errstate(divide="ignore", invalid="ignore"):
                # Sums are around the node's mean.
                gain = np.where((left_w >= min_leaf) & (right_w >= min_leaf), left_y**2 * (1 / left_w + 1 / right_w), -1.0)
            group = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            top, spot = np.full(k, -1.0), np.zeros(k, np.intp)
            top[own[group]] = np.maximum.reduceat(gain, group)
            spot[own[group]] = np.minimum.reduceat(np.where(gain == top[own], np.arange(len(gain)), len(gain)), group)
            better = top > best * (1 + 1e-12)
            best[better], cut[better], by[better] = top[better], key[at[spot[better]]] % width, f
        split = by >= 0
        for j in np.flatnonzero(split).tolist():
            i, f = int(ids[j]), int(by[j])
            feature[i], threshold[i], child[i] = f, float(edges[f][cut[j]]), len(feature)
            gains[f] += best[j]
            for _ in range(2):
                feature.append(0)
                threshold.append(np.inf)
                child.append(len(feature) - 1)
                value.append(0.0)
        keep = split[local]
        rows, local = rows[keep], local[keep]
        right = table[by[local], rows] > cut[local]
        node = np.array(child, np.int64)[ids][local] + right
        level += 1
    total = gains.sum()
    return {
        "feature": feature, "threshold": threshold, "child": child, "value": value, "depth": level,
        "gain": (gains / total if total > 0 else gains).tolist(),
    }


def _poisson_steps(rate: float) -> list[float]:
    """Chances of at most 0, 1, 2, ... draws, up to where the rest no longer shows."""
    steps, term = [], math.exp(-rate)
    total = k = 0
    while total < 1 - 1e-13 and k < rate + 20 * math.sqrt(rate) + 20:
        total += term
        steps.append(min(total, 1.0))
        k += 1
        term *= rate / k
    return steps


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str] = (),
    trees: int = 300,
    depth: int | None = None,
    min_leaf: int = 2,
    seed: int = 42,
    rows_per_tree: int = ROWS_PER_TREE,
) -> Forest:
    """Grow ``trees`` trees over all rows of ``train`` with complete features and label.

    A tree draws as many rows as there are, with replacement, but at most ``rows_per_tree`` on average: the
    forest as a whole draws ``trees`` times that. Draws depend on ``keys`` (default: features and label) and
    seed only, so a lost task draws the same. Without rows the trees predict 0.
    """
    features = list(features)
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    named = train.select(*x, F.col(label).cast("double").alias("_y"), row_hash([*(keys or [*features, label])], seed).alias("_key"))
    known = named.dropna(subset=[c for c in named.columns if c != "_key"])
    names = [f"_x{i}" for i in range(len(features))]
    n = known.count()
    # Bin edges from rows picked by hash: all of them up to SAMPLE, else about as many.
    seen = known.where(uniform(["_key"], seed + 3) < min(1.0, SAMPLE / max(n, 1))).select(*names).toPandas().to_numpy(float)
    cuts = np.arange(1, BINS) / BINS
    edges = [np.unique(np.quantile(seen[:, f], cuts, method="inverted_cdf")) if len(seen) else np.zeros(0) for f in range(len(names))]
    share = min(1.0, rows_per_tree / max(n, 1))

    # A row's draws over all trees are Poisson; each goes to a tree by hash, so a tree's are too.
    many = F.array(*[F.lit(s) for s in _poisson_steps(trees * share)])
    draws = F.size(F.filter(many, lambda s: s < uniform(["_key"], seed + 1)))
    drawn = (
        known.withColumn("_draws", draws).where("_draws > 0")
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_draws"))))
        .withColumn("tree", F.pmod(F.xxhash64("_key", "_i", F.lit(seed + 2)), F.lit(trees)).cast("int"))
        .drop("_draws", "_i").repartition(trees, "tree")  # growing costs far more than moving: a task per tree or so
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", *names, "_y"])
        number = int(pdf["tree"].iloc[0])
        columns = pdf[["_key", *names, "_y"]].to_numpy(float)
        first = np.append(True, (columns[1:] != columns[:-1]).any(1))  # equal draws become one weighted row
        weight = np.diff(np.append(np.flatnonzero(first), len(columns))).astype(float)
        tree = grow(columns[first, 1:-1], columns[first, -1], weight, edges, depth, min_leaf)
        return pd.DataFrame([{"tree": number, **tree}])

    grown = drawn.groupBy("tree").applyInPandas(one, TREE_SCHEMA).toPandas().sort_values("tree")
    if not len(grown):
        grown = pd.DataFrame([{"tree": 0, **grow(np.zeros((1, len(features))), np.zeros(1), np.ones(1), [], depth, min_leaf)}])
    return pack(tuple(features), grown)


def pack(features: tuple[str, ...], grown: pd.DataFrame) -> Forest:
    """One flat forest of the trees' arrays; its size is checked, since it is sent to all tasks."""
    sizes = grown["feature"].map(len).to_numpy()
    roots = np.cumsum(sizes) - sizes
    child = np.concatenate([np.asarray(c, np.int64) + r for c, r in zip(grown["child"], roots)]).astype(np.int32)
    gains = np.stack([np.resize(np.asarray(g, float), len(features)) if len(g) else np.zeros(len(features)) for g in grown["gain"]])
    forest = Forest(
        features, roots.astype(np.int32), np.concatenate([np.asarray(f, np.int16) for f in grown["feature"]]),
        np.concatenate([np.asarray(t, float) for t in grown["threshold"]]), child,
        np.concatenate([np.asarray(v, float) for v in grown["value"]]), int(grown["depth"].max()), gains.mean(0),
    )
    if forest.bytes > MOST_BYTES:
        raise ValueError(f"a forest of {forest.bytes} bytes is too large to send; draw fewer rows per tree")
    return forest
