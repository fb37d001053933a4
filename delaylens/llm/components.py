"""Connected components of a link table by alternating large and small stars.

Every step is a minimum per node and a join, so a node with a third of all links is
aggregated before the shuffle and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylens.llm.tables import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (a > b) edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = (
        both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    )
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low, "a")
    small = joined.select("a", F.col("m").alias("b")).unionByName(
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return small.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node, a number or a string, that each linked node can reach.

    Nodes without a link to another node don't appear. Null ends and self-links are ignored,
    repeated links count once. Stops when a round changes nothing.
    """
    x, y = F.col(a), F.col(b)
    edges = stored(
        links.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct(),
        "links",
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while True:
        edges = stored(_stars(edges), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
