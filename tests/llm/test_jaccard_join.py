import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm import jaccard_join, shingles
from tests.conftest import SMALL
from tests.harness import differences


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_set(text):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute_force(rows):
    sets = {i: plain_set(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1:]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 80 * either:
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i)) for i in ids}


def result(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()}


def family(seed, size, edits, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        yield " ".join(copy)


def test_same_as_sql(spark, con):
    assert differences(entry.queries()["op10_jaccard_join"](spark, SMALL), con, entry.oracle_sql()["op10_jaccard_join"]) == []


@pytest.mark.parametrize("leaf", [512, 5])
def test_same_as_brute_force(documents, monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF_ROWS", leaf)
    line = " ".join(f"common{i}" for i in range(30))
    texts = [*family(1, 60, 6), *family(2, 30, 9), *(line + "\n" + t for t in family(3, 40, 5, 40))]
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    assert result(jaccard_join.jaccard_groups(documents(rows))) == brute_force(rows)


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a  B\n"), (6, "a b c"), (7, "é É"), (8, "é é"), (9, "a b c d e")]
    rows += [(10, "long " + " ".join(f"t{i}" for i in range(400_000))), (11, " ".join(f"t{i}" for i in range(400_000)))]
    df = documents(rows).withColumn("n", F.lit(1)).withColumn("block", F.lit("x")).withColumn("digest", F.lit("d"))
    assert result(jaccard_join.jaccard_groups(df)) == brute_force(rows)
    assert jaccard_join.jaccard_groups(documents([])).count() == 0
    again = jaccard_join.jaccard_groups(documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]))
    assert sorted(r.component_id for r in again.collect()) == [1, 1, 1]


def test_threshold_is_inclusive(documents):
    # 9 and 8 shingles, 8 in common, and 10 and 8: 8/9 and 8/10 link; 7 of 9 does not
    w = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(w[:14])), (2, " ".join(w[:12])), (3, " ".join(w[2:14] + ["y"]))]
    assert result(jaccard_join.jaccard_groups(documents(rows))) == brute_force(rows)
    assert {r[2] for r in brute_force(rows[:2])} == {1}


def test_hashes_agree_across_pieces(monkeypatch):
    text = " ".join(f"Word{i % 977}" for i in range(5000)) + "\n\x0bend"
    whole = next(shingles.shingle_sets(pa.array([text])))
    assert len(whole) == len(plain_set(text))
    monkeypatch.setattr(shingles, "PIECE", 1000)
    pieces = next(shingles.shingle_sets(pa.array([text])))
    assert np.array_equal(whole, pieces)


def test_one_document_of_each_group_stays(documents):
    rows = [(i, t) for i, t in enumerate(family(5, 20, 1))] + [(100, "alone")]
    df = documents(rows)
    kept = jaccard_join.one_of_each_group(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_force(rows)}
