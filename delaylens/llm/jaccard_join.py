"""Documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The method is a count-vector R-tree. Each set's shingles are hashed into groups, 64 of them and
twice as many for every doubling of the set beyond 1,024, and the counts of the groups are a
point; groups of neighbouring hashes add up to those of a coarser point. Points are packed into leaves with a bounding box, and the
overlap of two sets is at most the sum over the groups of the smaller count, for two boxes as
for two points. Pairs that pass this bound are verified on the sets.

On its own such a tree doesn't prune texts of like length, because random counts look alike in
so many dimensions, so it is grown inside blocks that no link can leave: linked sets share one of
their ``n - ceil(0.8 n) + 1`` first shingles in any common order, and the points that share one
and pass the bound belong to one block. The order puts shingles that many documents share last,
so that a common passage joins nothing. Neither order nor tiles nor leaves change the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylens.llm.components import components
from delaylens.llm.shingles import mix, shingle_sets
from delaylens.llm.tables import stored, table, texts

GROUPS, SET_SIZE, LEVELS = 64, 1_024, 8
#: Rows and shingles that one leaf of the tree should hold; two leaves meet in one task.
LEAF_ROWS, LEAF_SHINGLES = 2_048, 3_000_000
#: Points sharing a first shingle are compared in tiles of so many.
TILE = 512
#: Common shingles that are put last. A bound on memory: it shifts cost, never the result.
COMMON = 65_536
#: Overlaps are counted by matrix product over so many shingles at a time.
COLUMNS = 2_048


def _common_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, rarest first; counted in each task, summed over all."""

    def local(batches):
        pool, size = [], 0

        def emit():
            if not pool:
                return None
            values, n = np.unique(np.concatenate(pool), return_counts=True)
            often = n >= 4
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["h", "n"]
            )

        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                pool.append(s)
                size += len(s)
                if size >= 8_000_000:
                    yield emit()
                    pool, size = [], 0
        if pool:
            yield emit()

    counted = docs.select("text").mapInArrow(local, "h long, n long")
    top = counted.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON)
    return np.array([r.h for r in reversed(top.collect())], np.int64).view(np.uint64)


def _profiles(docs: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, its first shingles in the common order, its group counts."""
    by_hash = np.argsort(common)
    hashes = common[by_hash]

    def profile(batches):
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                need = n - -(-percent * n // 100) + 1 if n else 0
                rank = np.zeros(n, np.int64)
                if n and len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    rank = np.where(hashes[at] == s, by_hash[at] + 1, 0)
                first = s[np.argsort(rank, kind="stable")[:need]] if rank.any() else s[:need]
                digest = np.array([s.sum(), mix(s + np.uint64(1)).sum()], np.uint64)
                rows.append((n, digest.tobytes(), first.view(np.int64), _counts(s, int(_level(n)))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "digest", "first", "counts"],
            )

    schema = "doc_id long, n long, digest binary, first array<long>, counts array<int>"
    return docs.select("doc_id", "text").mapInArrow(profile, schema)


def _level(n: np.ndarray) -> np.ndarray:
    """How often the 64 groups are doubled for a set of this size."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / SET_SIZE)), 0, LEVELS).astype(np.int64)


def _counts(s: np.ndarray, level: int) -> np.ndarray:
    return np.bincount((s >> np.uint64(58 - level)).astype(np.int64), minlength=GROUPS << level)


def _star(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked places (i, j) of ascending ids: each id and the smallest one it reaches, where that is another."""
    label = np.arange(len(ids))
    while len(i):
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label < np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _bound(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be linked: overlap <= summed minima, and it must be p / (100 + p) of both sizes."""
    most = np.zeros((len(a), len(b)), np.int64)
    box = np.minimum(a.max(0), b.max(0)).sum()
    if box * (100 + percent) < (na.min() + nb.min()) * percent:
        return most > 0
    if most.size * a.shape[1] <= 1 << 18:  # one operation for the many small tiles
        most = np.minimum(a[:, None, :], b[None, :, :]).sum(2)
    else:
        for g in range(a.shape[1]):
            most += np.minimum(a[:, g][:, None], b[:, g][None, :])
    return most * (100 + percent) >= (na[:, None] + nb[None, :]) * percent


def _near_pairs(n: np.ndarray, counts: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one tile that pass the bound.

    Sets that differ by two levels differ in size by more than a link allows; those of
    neighbouring levels meet in the coarser one's groups.
    """
    level, out = _level(n), []
    for k in np.unique(level):
        own, under = np.flatnonzero(level == k), np.flatnonzero(level == k - 1)
        mine = np.stack([counts[i] for i in own]).astype(np.int64)
        i, j = np.nonzero(np.triu(_bound(mine, n[own], mine, n[own], percent), 1))
        out.append((own[i], own[j]))
        if len(under):
            coarse = mine.reshape(len(own), -1, 2).sum(2)
            i, j = np.nonzero(_bound(coarse, n[own], np.stack([counts[i] for i in under]).astype(np.int64), n[under], percent))
            out.append((own[i], under[j]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _near(percent: int):
    """Of the points of one tile, those that the bound lets be linked: (doc_id, low)."""

    def near(batches):
        for batch in batches:
            a, b = [], []
            points = batch.column(0)
            limits = points.offsets.to_numpy()
            flat = points.flatten()
            every_id, every_n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            vectors = flat.field(2)
            edge = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            every = vectors.flatten().to_numpy()
            limits = limits - limits[0]
            for lo, hi in zip(limits[:-1], limits[1:]):
                order = lo + np.argsort(every_id[lo:hi], kind="stable")
                i, j = _near_pairs(every_n[order], [every[edge[k] : edge[k + 1]] for k in order], percent)
                x, y = _star(every_id[order], i, j)
                a.append(x), b.append(y)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], names=["doc_id", "low"]
            )

    return near


def _plausible(points: DataFrame, percent: int) -> DataFrame:
    """Star-shaped links between points that share a first shingle and pass the bound.

    A shingle's points are dealt to tiles by hash and every two tiles meet, so that no task
    holds them all; what leaves is at most one link per point and tile.
    """
    first = points.select("doc_id", F.explode("first").alias("h"))
    buckets = first.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = first.join(buckets, "h").select("h", "doc_id", F.ceil(F.col("c") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    tiled = shared.select("h", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"), "doc_id")
    together = tiled.groupBy("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.sort_array(F.collect_set("doc_id")).alias("ids")
    )
    # Copies share many first shingles: the same points are compared once, and only then need their counts.
    once = together.where(F.size("ids") > 1).select("ids").distinct()
    seats = once.select(F.xxhash64("ids").alias("k1"), F.xxhash64("ids", F.lit(1)).alias("k2"), F.explode("ids").alias("doc_id"))
    met = seats.join(points.select("doc_id", "n", "counts"), "doc_id").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("doc_id", "n", "counts")).alias("points")
    )
    return met.where(F.size("points") > 1).select("points").mapInArrow(_near(percent), "doc_id long, low long").distinct()


def _leaves(members: DataFrame) -> DataFrame:
    """Pack each block's points into leaves: (block, leaf) by size, then by half the groups' sum.

    The key ends with random bits, so that equal points can be cut too and no leaf grows.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)
    width = (F.size("counts") / GROUPS).cast("int")
    folded = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda i: total(F.slice("counts", i * width + 1, width)))
    half = total(F.slice("counts", F.lit(1), width * (GROUPS // 2)))
    keyed = members.withColumn(
        "key",
        F.least("n", F.lit((1 << 22) - 1)) * F.lit(1 << 40)
        + F.least(half, F.lit((1 << 22) - 1)) * F.lit(1 << 18)
        + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 18)),
    ).withColumn("counts", folded)
    size = keyed.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    wanted = F.ceil(F.greatest(F.col("rows") / LEAF_ROWS, F.col("shingles") / LEAF_SHINGLES))
    size = size.select("block", wanted.cast("int").alias("leaves")).where("leaves > 1")
    # Cut points of every block that needs more than one leaf, from a mergeable sketch of all its keys.
    cuts = (
        keyed.join(size, "block")
        .groupBy("block")
        .agg(F.percentile_approx("key", [i / 64 for i in range(1, 64)], 10_000).alias("p"), F.first("leaves").alias("leaves"))
    )
    part = F.size(F.filter("p", lambda c: c < F.col("key")))  # 0 .. 63
    fine = F.when(
        F.col("leaves") <= 64, F.floor(part * F.col("leaves") / 64)
    ).otherwise(part * F.ceil(F.col("leaves") / 64) + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.ceil(F.col("leaves") / 64)))
    return keyed.join(cuts, "block", "left").select(
        "doc_id", "n", "counts", "block", F.coalesce(fine, F.lit(0)).cast("bigint").alias("leaf")
    )


def _leaf_pairs(points: DataFrame, percent: int) -> DataFrame:
    """Pairs of leaves of one block, each with itself too, whose boxes allow a link."""
    high = F.array(*[F.max(F.col("counts")[i]) for i in range(GROUPS)]).alias("high")
    boxes = stored(points.groupBy("block", "leaf").agg(F.min("n").alias("least"), high), "boxes")
    a = boxes.select("block", F.col("leaf").alias("a"), F.col("least").alias("na"), F.col("high").alias("ha"))
    b = boxes.select("block", F.col("leaf").alias("b"), F.col("least").alias("nb"), F.col("high").alias("hb"))
    bound = F.aggregate(
        F.zip_with("ha", "hb", lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    # overlap >= p / (100 + p) * (na + nb) is the same as Jaccard >= p / 100
    return a.join(b, "block").where(F.col("a") <= F.col("b")).where(
        (F.col("a") == F.col("b")) | (bound * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    ).select("block", "a", "b")


def _verify(percent: int):
    def verify(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        side = table.column("left").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        order = np.argsort(ids, kind="stable")
        ids, side, sets = ids[order], side[order], [sets[i] for i in order]
        n = np.array([len(s) for s in sets], np.int64)
        if not side.any() or len(ids) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        same = bool(side.all())
        left = np.arange(len(ids)) if same else np.flatnonzero(side)
        right = left if same else np.flatnonzero(~side)
        level = int(_level(n).min())
        counts = np.stack([_counts(s, level) for s in sets])
        near = _bound(counts[left], n[left], counts[right], n[right], percent)
        if same:
            near &= ~np.eye(len(left), dtype=bool)
        left, right, near = left[near.any(1)], right[near.any(0)], near[near.any(1)][:, near.any(0)]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            used = np.unique(np.concatenate([left, right]))
            values, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
            row = np.repeat(used, n[used])
            often = np.bincount(column, minlength=len(values)) > 1
            renumber = np.cumsum(often) - 1
            row, column = row[often[column]], renumber[column[often[column]]]
            by = np.argsort(column, kind="stable")
            row, column = row[by], column[by]
            overlap = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2**24 are exact
            for start in range(0, int(often.sum()), COLUMNS):
                lo, hi = np.searchsorted(column, [start, start + COLUMNS])
                hit = np.zeros((len(ids), COLUMNS), np.float32)
                hit[row[lo:hi], column[lo:hi] - start] = 1
                overlap += hit[left] @ hit[right].T
            inter = overlap.astype(np.int64)
            union = n[left][:, None] + n[right][None, :] - inter
            linked = near & (100 * inter >= percent * union)
            i, j = np.nonzero(linked)
            a, b = _star(ids, left[i], right[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return verify


def _sets(batches):
    for batch in batches:
        packed = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "shingles"])


def jaccard_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Equal sets are one point, whatever their number. Null and wordless texts have an empty set
    and link with nothing. Repeated rows each give a row. A row with a null doc_id makes no links
    and has the component of its copies, if any, else null. An empty table gives an empty result.
    Long texts are hashed in pieces that keep all words.
    """
    d = texts(docs)
    profiles = stored(_profiles(d, _common_shingles(d), percent), "profiles")
    filled = profiles.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # One row per distinct set, under its smallest id.
    points = filled.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")
    points = points.select("doc_id", "n", "first", "counts")
    blocks = components(_plausible(points, percent), "doc_id", "low")
    blocks = stored(blocks.select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "blocks")
    leaves = stored(_leaves(points.select("doc_id", "n", "counts").join(blocks, "doc_id")), "leaves")
    pairs = stored(_leaf_pairs(leaves, percent), "leaf-pairs")
    in_block = d.join(blocks.select("doc_id"), "doc_id", "left_semi")
    sets = in_block.mapInArrow(_sets, "doc_id long, shingles binary").join(leaves.select("doc_id", "block", "leaf"), "doc_id")
    seat = pairs.select("block", F.col("a").alias("leaf"), "a", "b", F.lit(True).alias("left")).unionByName(
        pairs.where("a < b").select("block", F.col("b").alias("leaf"), "a", "b", F.lit(False).alias("left"))
    )
    meeting = sets.join(seat, ["block", "leaf"]).select("block", "a", "b", "doc_id", "shingles", "left")
    links = meeting.groupBy("block", "a", "b").applyInArrow(_verify(percent), "a long, b long")
    linked = components(links)
    own = profiles.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    return own.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group of near copies, with all columns.

    Rows are judged one by one: rows with one id and unlike texts are documents of their own, and of rows
    with equal ids in a group one stays. A null id counts as the largest. Where ids are null or
    repeated, rows are numbered in a stored copy first, else the ids tell them apart.
    """
    id_ = F.col("doc_id").cast("bigint")
    several = docs.select(id_.alias("doc_id")).groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if several.isEmpty():
        kept = jaccard_groups(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    rows = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("n")), "numbered")
    groups = jaccard_groups(rows.select(F.col("n").alias("doc_id"), F.col("row")["text"].alias("text")))
    named = groups.select(F.col("doc_id").alias("n"), "component_id").join(rows.select("n", F.col("row")["doc_id"].cast("bigint").alias("id")), "n")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("n").alias("n")))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first")["n"].alias("n"))
    return rows.join(kept, "n", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = {
    "op10_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
            FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        rare AS (
            SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS k
            FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM items)),
        front AS (SELECT doc_id, n, x FROM rare WHERE k <= n - ceil(0.8 * n) + 1),
        pairs AS (
            SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM front p JOIN front q USING (x)
            WHERE p.doc_id < q.doc_id AND 10 * least(p.n, q.n) >= 8 * greatest(p.n, q.n)),
        links AS (
            SELECT a, b FROM (
                SELECT a, b, len(list_intersect(p.s, q.s)) AS i, len(p.s) + len(q.s) AS t
                FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b)
            WHERE 100 * i >= 80 * (t - i)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id
        FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY ALL"""
}
QUERIES = {"op10_jaccard_join": op10_jaccard_join}
