"""Repair of damaged conversations: faults per row, and the cheapest edits that the role grammar allows.

Rows are range-sorted by conversation, turn and content, so a conversation of any size is cut into
slices like the rest. Conversations inside one slice are repaired where they lie. The first and last
of each slice, and those over ``BUFFER`` characters, are stored and put together: what two slices have
in common is found by key, a row becomes one letter, the letters of a conversation (as long as its
audit, which is one cell of the result) are parsed, and a last sorted pass hashes the texts in order,
a batch in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaylens.llm.merkle import CRC32
from delaylens.llm.role_grammar import BLANK, DUPLICATE, SOUND, TRUNCATED, Line, Repairer, code, faults
from delaylens.llm.tables import stored, table

BLANKS = " \t\n\x0b\x0c\r"
#: Characters of one conversation that a task holds before it stores them instead.
BUFFER = 1 << 22
#: Rows and characters of an Arrow batch that a task gives back.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 23
HEAD = 64
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DONE = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
PART = pa.schema([
    ("slice", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.large_string()),
    ("sha", pa.string()), ("code", pa.string()), ("fresh", pa.bool_()),
])
SCANNED = pa.schema([*DONE, *PART])
DONE_SQL = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
SCANNED_SQL = DONE_SQL + ", slice long, seq long, turn long, role string, text string, sha string, code string, fresh boolean"


class _Out:
    """Collects rows and gives them back as batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: tuple, chars: int = 0) -> None:
        self.rows.append(row)
        self.chars += chars

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS or self.chars >= BATCH_CHARS

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.schema]
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.chars = [], 0
        return made


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _gaps(turns: list[int]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a slice in order: conversations inside it are repaired, those at its ends given back row by row."""
    from pyspark import TaskContext

    here, repairer, out = TaskContext.get().partitionId(), Repairer(), _Out(SCANNED)
    as_duplicate = {code(i, f): code(i, DUPLICATE) for i in range(4) for f in (SOUND, TRUNCATED)}
    nothing, no_part = (None,) * (len(DONE) - 1), (None,) * len(PART)

    def finish(conv, rows):
        present = [r for r in rows if r[4] is not None]
        codes = "".join(r[4] for r in present)
        cost, audit = repairer.repair(codes)
        line = Line(audit)
        text = [part for _, role, body, _, _, _ in present for part in line.row(role, body)] + list(line.inserted())
        digest = hashlib.sha256("\n".join(text).encode()).hexdigest()
        out.add((conv, _gaps([r[0] for r in present]), *faults(codes), cost, audit, digest, *no_part))

    conv, rows, held, whole, seq, seen = None, [], 0, False, 0, set()

    def give_back():
        nonlocal seq, rows, held
        for turn, role, text, sha, letter, fresh in rows:
            out.add((conv, *nothing, here, seq, turn, role, text, sha, letter, fresh), len(text))
            seq += 1
            if out.full():
                yield out.batch()
        rows, held = [], 0

    for at, (key, turn, role, text, sha, letter) in enumerate(_rows(batches)):
        if at and key != conv:
            if whole:
                finish(conv, rows)
                rows, held = [], 0
            else:
                yield from give_back()
            seq, seen, whole = 0, set(), True
        conv = key
        fresh = False
        if letter in as_duplicate:
            fresh = (role, sha) not in seen
            seen.add((role, sha))
            letter = letter if fresh else as_duplicate[letter]
        rows.append((turn, role, text, sha, letter, fresh))
        held += len(text)
        if held > BUFFER:
            whole = False
        if not whole and (held > BATCH_CHARS or len(rows) >= BATCH_ROWS):
            yield from give_back()
        if out.full():
            yield out.batch()
    yield from give_back()
    yield out.batch()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairer, out = Repairer(), _Out(pa.schema([*list(DONE)[:-1]]))
    for conv, gaps, codes in _rows(batches):
        cost, audit = repairer.repair(codes)
        out.add((conv, gaps, *faults(codes), cost, audit), len(audit))
        if out.full():
            yield out.batch()
    yield out.batch()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation first its parsed row, then its rows in order; only the hash state is kept."""
    out, line, head, digest, first = _Out(DONE), None, None, None, True

    def put(lines):
        nonlocal first
        for text in lines:
            digest.update(("" if first else "\n").encode() + text.encode())
            first = False

    def close():
        if line is not None:
            put(line.inserted())
            out.add((*head, digest.hexdigest()), len(head[-1]))

    for row in _rows(batches):
        *parsed, audit, role, text = row
        if audit is not None:
            close()
            head, line, digest, first = (*parsed, audit), Line(audit), hashlib.sha256(), True
        else:
            put(line.row(role, text))
        if out.full():
            yield out.batch()
    close()
    yield out.batch()


def coded(role: Column, text: Column) -> Column:
    """The letter of a row that isn't a duplicate: initial and fault."""
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    initial = F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)
    return F.char((F.lit(97) + 4 * initial + fault).cast("bigint"))


def repair_conversations(turns: DataFrame, absent: Column | None = None) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text).

    gaps, blank, duplicate, truncated, illegal: faults found; cost and audit: the cheapest edits (K keep,
    R rerole, D delete, I insert) after which the initials of the roles read ``(s?(ua)+)?``, of equally
    cheap ones the least in ASCII; repaired_sha256 over the repaired ``role:text`` lines. Rows for which
    ``absent`` holds only say that the conversation exists.

    A null role or text is one space, so such a row is blank
    or has a role that can't be kept, like an empty role or any other initial. Rows follow turn, null first; rows of one turn
    follow role, the first 64 characters of text and its SHA-256. Repeated rows are duplicates. All
    rows without a conv_id are one conversation. A conversation without rows has zeros, an empty audit
    and the hash of the empty text. Texts are hashed whole. An empty table gives an empty result.
    """
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    role, text = (F.coalesce(turns[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    narrow = turns.select(
        turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"),
        F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"),
    )
    letters = narrow.select(
        "conv_id", "turn", "role", "text", F.sha2("text", 256).alias("sha"),
        F.when(~F.col("gone"), coded(F.col("role"), F.col("text"))).alias("code"),
        F.left("text", F.lit(HEAD)).alias("head"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "head", "sha", "row"]  # row only parts equal rows
    ranged = letters.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "row")
    scanned = stored(ranged.mapInArrow(_scan, SCANNED_SQL), "conversations")
    done = scanned.where(F.col("slice").isNull()).select(DONE.names)
    parts = scanned.where(F.col("slice").isNotNull())

    again = Window.partitionBy("conv_id", "role", "sha").orderBy("slice", "seq")
    place = ["conv_id", "slice", "seq"]
    first = parts.where("fresh").select(*place, "code", F.row_number().over(again).alias("nth"))
    twice = F.when(F.col("nth") == 1, F.col("code")).otherwise(F.translate("code", "adehilmp", "ccggkkoo"))
    known = first.select(*place, twice.alias("code")).unionByName(parts.where("NOT fresh").select(*place, "code"))

    def joined(pairs: str, letters: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pairs, letters))), lambda x: x[letters]), "")

    by_slice = known.groupBy("conv_id", "slice").agg(joined("seq", "code").alias("codes"))
    codes = by_slice.groupBy("conv_id").agg(joined("slice", "codes").alias("codes"))
    here = F.when(F.col("code").isNotNull(), F.col("turn"))
    spans = parts.groupBy(F.col("conv_id").alias("c")).agg(
        F.coalesce(F.max(here) - F.min(here) + 1 - F.count_distinct(here), F.lit(0)).alias("gaps")
    )
    parsed = (
        codes.join(spans, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "codes")
        .mapInArrow(_parse, DONE_SQL.rsplit(",", 1)[0])
    )
    nulls = [F.lit(None).cast("bigint").alias(c) for c in COUNTS]
    stream = parsed.select("*", *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], *[F.lit(-1).cast("bigint").alias(c) for c in ("slice", "seq")])
    stream = stream.unionByName(parts.where("code IS NOT NULL").select(
        "conv_id", *nulls, F.lit(None).cast("string").alias("audit"), "role", "text", "slice", "seq"
    ))
    hashed = stream.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "seq").drop("slice", "seq")
    return done.unionByName(hashed.mapInArrow(_hash, DONE_SQL))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """``turns`` damaged by a hash of conversation and turn, and which rows are dropped."""
    def spaced(name: str) -> Column:
        return F.coalesce(turns[name].cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    marked = turns.select(
        turns["conv_id"], turns["turn"], F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return marked, F.col("dropped")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(*damaged(table(spark, sf_dir, "conversations")))


SQL = {
    "op11_conversation_repair": """
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
            FROM conversations),
        kinds AS (SELECT *, """ + CRC32.format("name") + """ % 20 AS kind FROM raw),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM kinds, range(2) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS pos,
                rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS body, left(role, 1) AS i
            FROM damaged),
        seen AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
                lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS before
            FROM placed),
        faulty AS (
            SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM seen),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faulty GROUP BY conv_id),
        -- States: 0 nothing yet, 1 system, 2 user, 3 assistant last. Inserts: k roles lead from one to another.
        inserts(from_s, k, to_s, lines) AS (VALUES
            (0, 0, 0, ''), (0, 1, 2, E'user:\\n'), (0, 2, 3, E'user:\\nassistant:\\n'), (1, 0, 1, ''), (1, 1, 2, E'user:\\n'),
            (1, 2, 3, E'user:\\nassistant:\\n'), (2, 0, 2, ''), (2, 1, 3, E'assistant:\\n'), (2, 2, 2, E'assistant:\\nuser:\\n'),
            (3, 0, 3, ''), (3, 1, 2, E'user:\\n'), (3, 2, 3, E'user:\\nassistant:\\n')),
        edits(edit, i, from_s, to_s, cost) AS (VALUES
            ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
            ('D', NULL, 0, 0, 2), ('D', NULL, 1, 1, 2), ('D', NULL, 2, 2, 2), ('D', NULL, 3, 3, 2),
            ('R', NULL, 0, 2, 1), ('R', NULL, 1, 2, 1), ('R', NULL, 3, 2, 1), ('R', NULL, 2, 3, 1)),
        walk AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM conversations
            UNION ALL
            SELECT w.conv_id, w.pos + 1, e.to_s, min({
                'cost': w.best.cost + 5 * i.k + e.cost + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END,
                'audit': w.best.audit || repeat('I', i.k) || e.edit,
                'lines': w.best.lines || i.lines || CASE e.edit WHEN 'K' THEN f.role || ':' || f.text || E'\\n'
                    WHEN 'R' THEN CASE e.to_s WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text || E'\\n' ELSE '' END})
            FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
            JOIN inserts i ON i.from_s = w.s
            JOIN edits e ON e.from_s = i.to_s AND (e.edit <> 'K' OR e.i = f.i) AND (e.edit = 'D' OR f.fault IN ('', 'truncated'))
            GROUP BY w.conv_id, w.pos + 1, e.to_s),
        ends AS (
            SELECT w.conv_id, min({'cost': w.best.cost + 5 * i.k, 'audit': w.best.audit || repeat('I', i.k), 'lines': w.best.lines || i.lines}) AS best
            FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts i ON i.from_s = w.s
            WHERE w.pos = coalesce(c.n, 0) AND i.to_s IN (0, 3) GROUP BY w.conv_id)
        SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
            coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit,
            sha256(left(e.best.lines, length(e.best.lines) - 1)) AS repaired_sha256
        FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""
}
QUERIES = {"op11_conversation_repair": op11_conversation_repair}
