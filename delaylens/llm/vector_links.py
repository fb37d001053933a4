"""Near-duplicate embeddings by an inverted multi-index.

Each vector is halved and each half has its own codebook; a pair of codes is a cell of the
product grid. A vector visits the cells nearest to it, in the order of the two halves' summed
distances, as many as calibration found necessary for the target recall, and every visit is
verified by the exact cosine. Counts and local components leave a cell, never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.components import components
from delaylens.llm.tables import share_by_hash, stored, table

#: Bound of the sample that codebooks and the number of visits are fitted on, per vector length.
SAMPLE = 8_192
#: Vectors that a cell should hold on average: codebooks grow with the square root of the table.
PER_CELL = 64
MOST_CODES = 256
TARGET_RECALL = 0.995
MOST_VISITS = 256
#: Homes and visitors that meet in one task; fuller cells are split into tiles of this size.
TILE = 2_048


@dataclass(frozen=True)
class Index:
    """Codebooks for one vector length, and the visits that reach the target recall."""

    half: int
    left: np.ndarray
    right: np.ndarray
    visits: int

    def nearest(self, unit: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each vector, nearest first (multi-sequence order).

        With both halves' codes sorted by distance, the cell at places (i, j) has at least
        (i + 1) * (j + 1) - 1 cells before it, so only few places can be among the first.
        """
        k = len(self.left)
        visits = min(visits, k * k)
        i, j = np.divmod(np.arange(k * k), k)
        able = (i + 1) * (j + 1) <= visits
        i, j = i[able], j[able]
        d = [((x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)) for x, book in
             ((unit[:, : self.half], self.left), (unit[:, self.half :], self.right))]
        by = [np.argsort(x, 1, kind="stable") for x in d]
        total = np.take_along_axis(d[0], by[0], 1)[:, i] + np.take_along_axis(d[1], by[1], 1)[:, j]
        first = np.argsort(total, 1, kind="stable")[:, :visits]
        return np.take_along_axis(by[0], i[first], 1) * k + np.take_along_axis(by[1], j[first], 1)


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Plain k-means; an empty cluster keeps its old centre."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(12):
        code = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, 1)
        n = np.bincount(code, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, code, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def fit(sample: np.ndarray, rows: int, threshold: float, seed: int = 5) -> Index:
    """Codebooks from the sample, and visits calibrated on neighbours planted at and above the threshold.

    A planted neighbour counts as found if either of the two visits the other's cell.
    """
    k = int(np.clip(np.sqrt(rows / PER_CELL), 1, MOST_CODES))
    half = sample.shape[1] // 2
    index = Index(half, _codebook(sample[:, :half], k, seed), _codebook(sample[:, half:], k, seed + 1), MOST_VISITS)
    rng = np.random.default_rng(seed + 2)
    a = sample[rng.choice(len(sample), min(1024, len(sample)), replace=False)]
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(1)[:, None] * a
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    cos = rng.uniform(threshold, min(1.0, threshold + 0.05), len(a))[:, None]
    b = cos * a + np.sqrt(1 - cos**2) * noise
    to, back = index.nearest(a, MOST_VISITS), index.nearest(b, MOST_VISITS)
    rank = lambda seen, home: np.where((seen == home[:, None]).any(1), (seen == home[:, None]).argmax(1), 10**9)
    needed = np.minimum(rank(to, back[:, 0]), rank(back, to[:, 0])) + 1
    visits = int(np.clip(np.quantile(needed, TARGET_RECALL, method="higher"), 1, MOST_VISITS))
    return Index(half, index.left, index.right, min(MOST_VISITS, visits + 2))


def _usable(col: str):
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(col, lambda x: x != 0)


def _units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each vector length in a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1)[:, None]  # squares neither overflow nor vanish
        out.append((rows, x / np.sqrt((x**2).sum(1))[:, None]))
    return out


def _visits(vectors: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """rep, copies, unit vector, home cell and visited cells (home first)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            packed, cells = [None] * n, [None] * n
            for rows, unit in _units(batch.column(2)):
                index = indexes[unit.shape[1]]
                for at in range(0, len(rows), 512):
                    near = index.nearest(unit[at : at + 512], index.visits).astype(np.int64) + (unit.shape[1] << 32)
                    for r, u, c in zip(rows[at : at + 512], unit[at : at + 512], near):
                        packed[r], cells[r] = u.tobytes(), c
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(cells, pa.list_(pa.int64()))],
                names=["rep", "copies", "unit", "cells"],
            )

    return vectors.mapInArrow(run, "rep long, copies long, unit binary, cells array<long>")


def _tiles(visits: DataFrame) -> DataFrame:
    """Rows of each tile of a cell: homes (side true) and visitors, both split by hash.

    Sizes of cells that exceed a tile are joined in; a visit to a cell without homes is dropped.
    """
    homes = visits.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("homes"))
    guests = visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("guests"))
    split = homes.join(guests, "cell").select(
        "cell", F.ceil(F.col("homes") / TILE).cast("int").alias("h"), F.ceil(F.col("guests") / TILE).cast("int").alias("g")
    )
    split = stored(split, "cells")
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    home = visits.withColumn("cell", F.col("cells")[0]).join(split, "cell").select(
        "cell", part(F.col("h")).alias("h"), every(F.col("g")).alias("g"), F.lit(True).alias("side"), "rep", "copies", "unit", "cells"
    )
    guest = visits.select("*", F.explode("cells").alias("cell")).join(split, "cell").select(
        "cell", every(F.col("h")).alias("h"), part(F.col("g")).alias("g"), F.lit(False).alias("side"), "rep", "copies", "unit",
        F.slice("cells", 1, 1).alias("cells"),
    )
    return home.unionByName(guest)


def _meet(threshold: float):
    def meet(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy(zero_copy_only=False)
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        unit = np.stack([np.frombuffer(u, np.float64) for u in rows.column("unit").to_pylist()])
        cells = rows.column("cells").to_pylist()
        homes, guests = np.flatnonzero(side), np.flatnonzero(~side)
        empty = {"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "low": pa.array([], pa.int64())}
        if not len(homes) or not len(guests):
            return pa.table(empty)
        cos = unit[guests] @ unit[homes].T
        near = (cos >= threshold) & (ids[guests][:, None] != ids[homes][None, :])
        g, h = np.nonzero(near)
        # If each visits the other's cell the link is seen twice; it counts where the guest's id is smaller.
        visited = [set(cells[i]) for i in homes]
        own = [cells[i][0] for i in guests]
        counted = np.fromiter((own[x] not in visited[y] or ids[guests[x]] < ids[homes[y]] for x, y in zip(g, h)), bool, len(g))
        g, h = g[counted], h[counted]
        if not len(g):
            return pa.table(empty)
        known, place = np.unique(ids, return_inverse=True)
        a, b = place[guests[g]], place[homes[h]]
        links = np.bincount(a, copies[homes[h]], len(known)) + np.bincount(b, copies[guests[g]], len(known))
        label = np.arange(len(known))
        while True:
            low, before = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        hit = np.flatnonzero(links)
        return pa.table({"rep": known[hit], "links": links[hit].astype(np.int64), "low": known[label[hit]]})

    return meet


def vector_groups(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one point with a weight. Vectors that are null, empty or zero, or hold a
    null or non-finite component, and vectors of another length, don't link. Repeated rows link
    with each other like copies. Null ids are counted as neighbours under no component of their
    own. An empty table gives an empty result.
    """
    v = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    # The digest of the components names a vector; 128 bits, so different vectors differ.
    v = v.select("vec_id", "v", F.when(_usable("v"), F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ","))).alias("h"))
    points = stored(
        v.where("h IS NOT NULL AND vec_id IS NOT NULL").groupBy("h")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "points"
    )
    sizes = {r.d: r.n for r in points.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    indexes = {}
    for d, n in sizes.items():  # one round per vector length
        near = points.where(F.size("v") == d).where(share_by_hash("rep", n, SAMPLE))
        rows = near.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()
        (_, sample), = _units(rows.column(0).combine_chunks())
        indexes[d] = fit(sample, n, threshold)
    visits = stored(_visits(points.select("rep", "copies", "v"), indexes), "visits")
    met = stored(
        _tiles(visits).groupBy("cell", "h", "g").applyInArrow(_meet(threshold), "rep long, links long, low long"), "met"
    )
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(met, "rep", "low").select(F.col("node").alias("rep"), "component")
    per_point = points.select("h", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return v.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("h")).alias("h")).join(per_point, "h", "left").select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


SQL = {}
QUERIES = {"op3_vector_links": op3_vector_links}
