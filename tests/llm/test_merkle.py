import hashlib
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm.merkle import folded, merkle_manifest
from tests.conftest import SMALL
from tests.harness import differences
from tests.llm.conftest import DOCS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    values = [None if row[c] is None else str(row[c]) for c in FIELDS]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def brute(rows, arity):
    """(doc_id, leaf, subroot, root, siblings joined) of each row by folding whole levels in memory."""

    def tree(nodes):
        paths = [[] for _ in nodes]
        level, owner = nodes, [[i] for i in range(len(nodes))]
        while len(level) > 1:
            up, up_owner = [], []
            for at in range(0, len(level), arity):
                run = level[at:at + arity]
                for slot in range(len(run)):
                    for i in owner[at + slot]:
                        paths[i].append((slot, "".join(h for j, h in enumerate(run) if j != slot)))
                up.append(sha(*run))
                up_owner.append([i for o in owner[at:at + arity] for i in o])
            level, owner = up, up_owner
        return (level or [None])[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inside = {}
    for g in names:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        inside[g] = (members, *tree([leaf_of(r) for r in members]))
    root, above = tree([inside[g][1] for g in names])
    out = []
    for g, up in zip(names, above):
        members, subroot, paths = inside[g]
        out += [(r["doc_id"], leaf_of(r), subroot, root, tuple(path + up)) for r, path in zip(members, paths)]
    return sorted(out, key=str)


def spark_rows(df, **options):
    found = merkle_manifest(df, **options).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.slot, s.siblings) for s in r.path)) for r in found), key=str)


def test_same_as_sql(spark, con):
    df = entry.queries()["op13_merkle_manifest"](spark, SMALL).withColumn("verified", F.col("verified").cast("string"))
    sql = f"SELECT * REPLACE (CAST(verified AS VARCHAR) AS verified) FROM ({entry.oracle_sql()['op13_merkle_manifest']})"
    assert differences(df, con, sql) == []


@pytest.mark.parametrize("arity,levels", [(2, 3), (3, 2)])
def test_tiers_and_runs_like_brute_force(spark, arity, levels):
    rows = [(i, f"t{i}", ("en", "de", None, "fr", "é")[0 if i % 3 else i % 5], "s", i) for i in range(71)]
    df = spark.createDataFrame(rows, DOCS)
    assert spark_rows(df, arity=arity, levels=levels) == brute([r.asDict() for r in df.collect()], arity)


value = st.sampled_from([None, "", "a", "-", "é"])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 30, -4]), value, value, value, st.sampled_from([None, 0, 7])), max_size=14))
def test_any_rows(spark, rows):
    """Nulls in every column, repeated ids and equal rows, no rows at all."""
    df = spark.createDataFrame(rows, DOCS)
    assert spark_rows(df, levels=2) == brute([r.asDict() for r in df.collect()], 2)


def test_lone_leaf_and_empty(documents):
    only = merkle_manifest(documents([(1, "x")])).first()
    assert only.leaf == only.subroot == only.root and only.path == []
    assert merkle_manifest(documents([])).count() == 0


def test_long_text_and_clashing_columns(documents):
    df = documents([(1, "y" * 300_000), (2, "z")])
    for name in ("h", "p", "n", "g", "id", "row", "path", "one", "block", "with_now"):
        df = df.withColumn(name, F.lit(name))
    assert [r[:4] for r in spark_rows(df)] == [r[:4] for r in brute([r.asDict() for r in df.select(*FIELDS).collect()], 2)]


def test_tampered_rows_alone_fail(spark, stored_documents):
    folder = stored_documents([(i, f"text {i}", "en" if i % 4 else "de") for i in range(40)] + [(None, "no id")])
    got = entry.queries()["op13_merkle_manifest"](spark, folder).collect()
    changed = {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert changed and {r.doc_id for r in got if not r.verified} == changed


def test_path_proves_the_leaf(documents):
    found = merkle_manifest(documents([(i, f"t{i}") for i in range(13)]), levels=2)
    assert found.where(folded(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0
    assert found.where(folded(F.col("path"), F.sha2("leaf", 256)) == F.col("root")).count() == 0
