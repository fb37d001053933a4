"""Samples and splits. Choice is by a seeded hash of the row, so a re-run or a lost
executor picks the same rows; exact sizes come from ``first_k``, never from one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylens.operators.ordered import first_k

UNIT = 1 << 53


def row_hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def uniform(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the row's keys and the seed only."""
    return F.pmod(row_hash(keys, seed), F.lit(UNIT)) / F.lit(float(UNIT))


def _by_hash(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Rows with their hash and its leading bits, which serve as the coarse order.

    Nothing is stored: the hash depends on the row alone, so every reading sees the same order.
    """
    hashed = df.withColumn("_hash", row_hash(keys, seed))
    return hashed.withColumn("_cell", F.shiftright(F.col("_hash"), 44))


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement."""
    picked = first_k(_by_hash(df, keys, seed), lambda rows: F.least(F.lit(n), rows), "_cell", ["_hash", *keys])
    return picked.filter(F.col("_first") == 1).drop("_hash", "_cell", "_first")


def random_split(df: DataFrame, test_share: float, keys: Sequence[str], seed: int = 42):
    """Train and test rows by hash; sizes are right in expectation, no shuffle."""
    u = uniform(keys, seed)
    return df.filter(u >= test_share), df.filter(u < test_share)


def stratified_split(
    df: DataFrame,
    label: str,
    test_share: float,
    keys: Sequence[str],
    seed: int = 42,
    exact: bool = True,
) -> DataFrame:
    """Add ``is_test`` with the same test share in every class.

    The exact form ranks each class by hash and takes its rounded share; the other one
    compares the hash with the share and needs no shuffle.
    """
    if not exact:
        return df.withColumn("is_test", (uniform(keys, seed) < test_share).cast("int"))
    cut = first_k(
        _by_hash(df, keys, seed), lambda rows: F.bround(rows * test_share).cast("bigint"), "_cell", ["_hash", *keys],
        flag="is_test", key=label,
    )
    return cut.drop("_hash", "_cell")


def temporal_split(df: DataFrame, share: float, ts: str, tie_break: Sequence[str]) -> DataFrame:
    """Add ``is_train`` = 1 for the first ``int(rows * share)`` rows in time order."""
    return first_k(df, lambda rows: F.floor(rows * share), ts, [ts, *tie_break], flag="is_train")
