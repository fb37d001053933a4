"""A Merkle manifest of a table: a tree per group of rows, and a tree over the groups' roots.

Nodes of a level are a row each, found at the place of their first leaf. Lag and lead columns with
the level's fixed offset, masked by a node's slot in its run and by the length of the run, bring its
siblings; the first child of a run hashes the parent. Windows span blocks of ``arity ** levels``
leaves, never a group: the roots of blocks are the leaves of the next, far smaller tier.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaylens.llm.tables import crc32_of_id, stored, table
from delaylens.operators.ordered import running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
#: Levels folded inside one window partition: 4,096 leaves of a binary tree.
LEVELS = 12


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(col: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = col.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path lead to: at each level the node takes its slot among its siblings."""

    def up(node: Column, step: Column) -> Column:
        before = step["slot"] * HEX
        siblings = step["siblings"]
        return digest(F.substring(siblings, F.lit(1), before), node, F.substring(siblings, before + 1, F.length(siblings)))

    return F.aggregate(path, leaf, up)


def _places(nodes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, int]:
    """``nodes`` with ``p``, the place of a row in its key from 0, and ``n``, the rows of the key; the largest ``n``."""
    placed = running(nodes.withColumn("one", F.lit(1)), order, sums=["one"], keys=keys)
    placed = placed.withColumn("p", F.col("one_run") - 1).drop("one", "one_run")
    counts = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 1
    return placed.join(counts, list(keys)) if keys else placed.withColumn("n", F.lit(most)), most


def _tier(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Fold the blocks of ``nodes`` (g, p, n, h and others): adds ``path`` inside the block and its root ``top``.

    A level counts only while its group has several nodes, so that a lone node stays as it is.
    """
    by_place = Window.partitionBy("g", "block").orderBy("p")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p, n = F.col("p"), F.col("n")
    df = nodes.withColumn("block", F.expr(f"p div {arity**levels}")).withColumn("h0", F.col("h"))
    steps = []
    for level in range(levels):
        width = arity**level
        slot, node = F.expr(f"p div {width} % {arity}"), F.col(f"h{level}")
        ahead, back = [f"ahead{d}" for d in range(1, arity)], [f"back{d}" for d in range(1, arity)]
        df = df.withColumns(
            {c: F.lead(node, (d + 1) * width).over(by_place) for d, c in enumerate(ahead)}
            | {c: F.lag(node, (d + 1) * width).over(by_place) for d, c in enumerate(back)}
        )
        # A slot has as many siblings behind it as its number, and ahead what the run has left.
        left = [F.when(slot > d, F.col(c)) for d, c in enumerate(back)][::-1]
        right = [F.when(slot < arity - 1 - d, F.col(c)) for d, c in enumerate(ahead)]
        df = df.withColumns({
            f"s{level}": F.when((p % width == 0) & (n > width), F.concat_ws("", *left, *right)),
            f"h{level + 1}": F.when(
                p % (width * arity) == 0, F.when(n > width, digest(node, F.concat_ws("", *ahead))).otherwise(node)
            ),
        }).drop(*ahead, *back)
        steps.append((width, slot, f"s{level}"))
    # The ancestor of a row is the latest node of the level at or before it.
    df = df.withColumns(
        {s: F.last(s, ignorenulls=True).over(so_far) for _, _, s in steps} | {"top": F.first(f"h{levels}").over(so_far)}
    )
    path = F.array(*[
        F.when(n > width, F.struct(slot.cast("int").alias("slot"), F.col(s).alias("siblings"))) for width, slot, s in steps
    ])
    return df.select(*nodes.columns, "block", "top", F.filter(path, lambda step: step.isNotNull()).alias("path"))


def _paths(nodes: DataFrame, most: int, arity: int, levels: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes``, at most ``most`` in a group, with ``path`` and the columns of ``crown``, which gets the groups' roots (g, p = 0, h).

    The roots of all blocks are stored and are the nodes of the next tier, until each group is one
    block. Paths from above are joined by block, so no join key has more rows than a block.
    """
    levels = next((i for i in range(1, levels) if arity**i >= most), levels)
    width = arity**levels
    tier = _tier(nodes, arity, levels)
    roots = stored(
        tier.where(F.col("p") % width == 0).select(
            "g", F.col("block").alias("p"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("h")
        ),
        "merkle-roots",
    )
    if most > width:
        above = _paths(roots, -(-most // width), arity, levels, crown).drop("n", "h")
    else:
        above = crown(roots.select("g", "p", "h"))
    named = above.withColumnsRenamed({"p": "block", "path": "rest"})
    more = [c for c in named.columns if c not in ("g", "block", "rest")]
    return tier.join(named, ["g", "block"]).select(*nodes.columns, *more, F.concat("path", "rest").alias("path"))


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    arity: int = 2,
    levels: int = LEVELS,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, path, and the columns of ``carry``.

    A leaf is the SHA-256 of the fields' encodings. In a group leaves ascend by ``order`` (null first,
    rows with one value by leaf); every ``arity`` consecutive nodes, fewer in the last run, become the
    digest of their hex texts until one is left, the subroot. Subroots in the order of their groups
    (null first, UTF-8 bytewise) likewise become the root. ``path`` holds the row's slot and its
    siblings' digests for each level from leaf to root; ``folded(path, leaf)`` gives the root back.

    Nulls are encoded as ``-``, which no value is. Equal rows are leaves of their own, interchangeable in
    the tree. A lone leaf is its group's subroot; with one group the subroot is the root, and paths may be
    empty. Texts are hashed whole, once, in the scan. An empty table gives an empty result.
    """
    name = docs[group].cast("string")
    leaves = stored(
        docs.select(
            docs[order].alias("id"),
            F.when(name.isNull(), "0").otherwise(F.concat(F.lit("1"), name)).alias("g"),
            digest(*[field(docs[c]) for c in fields]).alias("h"),
            *[c.alias(f"with_{k}") for k, c in (carry or {}).items()],
            F.monotonically_increasing_id().alias("row"),  # only keeps equal rows from sharing one slice
        ),
        "merkle-leaves",
    )

    def root(groups: DataFrame) -> DataFrame:
        return groups.select("g", "p", F.col("h").alias("root"), F.array().cast("array<struct<slot:int,siblings:string>>").alias("path"))

    def crown(groups: DataFrame) -> DataFrame:
        nodes, most = _places(groups.select("g", "h"), [], ["g"])
        nodes = nodes.withColumnRenamed("g", "name").withColumn("g", F.lit(""))
        return _paths(nodes, most, arity, levels, root).select(
            F.col("name").alias("g"), F.lit(0).cast("bigint").alias("p"), F.col("h").alias("subroot"), "root", "path"
        )

    nodes, most = _places(leaves, ["g"], ["id", "h", "row"])
    return _paths(nodes, most, arity, levels, crown).select(
        F.col("id").alias(order), F.col("h").alias("leaf"), "subroot", "root", "path",
        *[F.col(f"with_{k}").alias(k) for k in carry or {}],
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, and which rows still lead to the root after some were tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(crc32_of_id(F.col("doc_id")) % 7 == 0, F.lit(False))
    now = digest(*[field(F.col(c) + tampered.cast("int") if c == "n_chars" else F.col(c)) for c in FIELDS])
    found = merkle_manifest(docs, carry={"now": now})
    return found.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join(F.col("path.siblings"), ""), 256).alias("proof_sha256"),
        folded(F.col("path"), F.col("now")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of a short ASCII text, bit by bit, as DuckDB SQL.
CRC32 = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, c: list_reduce([xor(crc, c)] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, i:
        xor(x >> 1, 3988292384 * (x & 1)))))"""

SQL = {
    "op13_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT *, CASE WHEN """ + CRC32.format("doc_id::VARCHAR") + """ % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed
            FROM documents),
        f AS (
            SELECT doc_id, lang, n_chars, changed,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM d),
        leaves AS (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
                sha256(head || coalesce(strlen(changed::VARCHAR) || ':' || changed::VARCHAR, '-') || tail) AS now
            FROM f),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
        low AS (
            SELECT lang, 0 AS level, p, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
            UNION ALL
            SELECT lang, level + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2
            FROM low WHERE n > 1 GROUP BY lang, level, p // 2),
        subroots AS (
            SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p FROM low WHERE n = 1),
        high AS (
            SELECT 0 AS level, p, subroot AS h, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT level + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2
            FROM high WHERE n > 1 GROUP BY level, p // 2),
        folds AS (
            SELECT doc_id, lang, leaf, p, 0 AS level, false AS up, now AS acc, '' AS proof FROM placed
            UNION ALL
            SELECT f.doc_id, f.lang, f.leaf, f.p // 2, f.level + 1, false,
                sha256(CASE WHEN f.p % 2 = 0 THEN f.acc || coalesce(s.h, '') ELSE s.h || f.acc END), f.proof || coalesce(s.h, '')
            FROM folds f JOIN low o ON o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.p = f.p AND o.n > 1
            LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.p = xor(f.p, 1)),
        risen AS (
            SELECT f.doc_id, f.lang, f.leaf, f.acc, f.proof, r.subroot, r.p
            FROM folds f JOIN low o ON o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.p = f.p AND o.n = 1
            JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang),
        ends AS (
            SELECT doc_id, leaf, subroot, p, 0 AS level, acc, proof FROM risen
            UNION ALL
            SELECT e.doc_id, e.leaf, e.subroot, e.p // 2, e.level + 1,
                sha256(CASE WHEN e.p % 2 = 0 THEN e.acc || coalesce(s.h, '') ELSE s.h || e.acc END), e.proof || coalesce(s.h, '')
            FROM ends e JOIN high o ON o.level = e.level AND o.p = e.p AND o.n > 1
            LEFT JOIN high s ON s.level = e.level AND s.p = xor(e.p, 1))
        SELECT e.doc_id, e.leaf, e.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = r.h AS verified
        FROM ends e JOIN high o ON o.level = e.level AND o.p = e.p AND o.n = 1 CROSS JOIN (SELECT h FROM high WHERE n = 1) r"""
}
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
