import hashlib
import heapq
import itertools
import random

import pytest

import __spark_entry__ as entry
from delaylens.llm import conversations
from delaylens.llm.conversations import COUNTS, repair_conversations
from delaylens.llm.role_grammar import Repairer, Table, code
from tests.conftest import SMALL
from tests.harness import differences

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def legal(roles):
    rest = roles[1:] if roles.startswith("s") else roles
    return roles == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def cheapest(rows):
    """Uniform-cost search over (rows used, initials so far) for rows of (initial, fault); no tables, no merging of roles."""
    heap, best = [(0, "", 0, "")], None
    longest = len(rows) + 4
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if best is not None and (cost, audit) >= best:
            continue
        if at == len(rows) and legal(roles):
            best = (cost, audit)
            continue
        if len(roles) < longest:
            for new in "ua":
                if legal_start(roles + new):
                    heapq.heappush(heap, (cost + 5, audit + "I", at, roles + new))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for edit, new, price in [("K", initial, 0), ("R", "u", 1), ("R", "a", 1)]:
                    if new and legal_start(roles + new):
                        heapq.heappush(heap, (cost + more + price, audit + edit, at + 1, roles + new))
    return best


def legal_start(roles):
    rest = roles[1:] if roles.startswith("s") else roles
    return rest == ("ua" * len(rest))[: len(rest)]


FAULTS = ["", "blank", "duplicate", "truncated"]


def test_table_has_one_stack_per_top():
    """Equal tops have equal stacks, so a merge by minimum loses nothing."""
    table, seen, todo = Table(), {}, [(0, None)]
    while todo:
        stack = todo.pop()
        assert seen.setdefault(stack[0], stack) == stack
        for token in "sua":
            todo += [s for s in table.shifted(stack, token) if s[0] not in seen or s != seen[s[0]]]
    for n in range(6):
        for roles in map("".join, itertools.product("sua", repeat=n)):
            stacks = [(0, None)]
            for r in roles:
                stacks = [s for stack in stacks for s in table.shifted(stack, r)]
            assert any(table.accepts(s) for s in stacks) == legal(roles)


def test_repairs_like_full_search():
    repairer, draw = Repairer(), random.Random(5)
    cases = [[(i, f)] for i in "suax" for f in FAULTS]
    cases += [[(draw.choice("suaax"), draw.choice(["", "", *FAULTS])) for _ in range(draw.randint(0, 7))] for _ in range(600)]
    for rows in cases:
        codes = "".join(code("suax".index(i), FAULTS.index(f)) for i, f in rows)
        assert repairer.repair(codes) == cheapest(rows), rows


def test_long_conversations_need_few_frontiers():
    repairer, draw = Repairer(), random.Random(6)
    for _ in range(20):
        repairer.repair("".join(code(draw.randrange(4), draw.randrange(4)) for _ in range(3000)))
    assert len(repairer.fronts) < 5000


def brute(rows):
    """Plain Python over whole conversations, with the full search."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in members:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role[:1], fault))
        cost, audit = cheapest(marked)
        lines, last, at = [], "", 0
        for letter in audit:
            due = "a" if last == "u" else "u"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[due])
                last = due
                continue
            _, role, text = members[at]
            at += 1
            if letter == "K":
                lines.append(f"{role}:{text}")
                last = role[:1]
            elif letter == "R":
                lines.append({"u": "user:", "a": "assistant:"}[due] + text)
                last = due
        turns = {t for t, _, _ in members if t is not None}
        pairs = zip(marked, marked[1:])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[sum(f == kind for _, f in marked) for kind in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(df):
    got = df.collect()
    named = {r.conv_id: tuple(r[c] for c in [*COUNTS, "audit", "repaired_sha256"]) for r in got}
    assert len(named) == len(got)
    return named


def test_same_as_sql(spark, con):
    name = "op11_conversation_repair"
    assert differences(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) == []


@pytest.fixture(scope="module")
def mixed():
    """Nulls in every column, ties, repeats, odd roles, one conversation with a third of all rows."""
    draw = random.Random(7)
    texts = [None, "", " \n", "a.", "b", "c!", "Is it? ", "long " * 30 + "x.", "long " * 30 + "y."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ugly"]
    rows = [(draw.choice([None, 1, 2, 3, *range(10, 30)]), draw.choice([None, 1, 1, 2, 5, 9]), draw.choice(roles), draw.choice(texts)) for _ in range(120)]
    return rows + [(3, i // 2, "user" if i % 3 else "assistant", f"t{i % 7}.") for i in range(12)]


@pytest.mark.parametrize("buffer", [1 << 22, 40])
def test_any_rows(spark, mixed, buffer, monkeypatch):
    monkeypatch.setattr(conversations, "BUFFER", buffer)
    short = [r for r in mixed if r[0] not in (None, 1, 2)] + [r for r in mixed if r[0] in (None, 1, 2)][:16]
    assert found(repair_conversations(spark.createDataFrame(short, TURNS).repartition(3))) == brute(short)


def test_a_conversation_over_many_slices(spark):
    rows = [(5, i, "user" if i % 2 else "assistant", f"text {i % 90}.") for i in range(400)] + [(4, 0, "user", "a."), (6, 0, "user", "b.")]
    got = found(repair_conversations(spark.createDataFrame(rows, TURNS)))
    assert got[5][2] == 310 and len(got[5][6].replace("I", "")) == 400
    codes = "".join(code(1 if i % 2 else 2, 0 if i < 90 else 2) for i in range(400))
    assert got[5][5:7] == Repairer().repair(codes)
    assert got[4] == (0, 0, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())


def test_absent_and_empty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "user", "a.")], TURNS)
    got = found(repair_conversations(df, absent=F.col("conv_id") == 1))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_conversations(df.where("false")).count() == 0


def test_other_columns_do_not_clash(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b" * 200_000 + ".")]
    df = spark.createDataFrame(rows, TURNS)
    for name in ("sha", "code", "slice", "seq", "head", "row", "gone", "fresh", "audit", "cost"):
        df = df.withColumn(name, F.lit(name))
    assert found(repair_conversations(df)) == brute(rows)
