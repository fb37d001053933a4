import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm.mixing import fit, knapsack, mix_sources
from tests.conftest import SMALL
from tests.llm.conftest import DOCS


def sums(sizes, counts):
    return {sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(c + 1) for c in counts])}


def test_knapsack_like_all_choices():
    draw = random.Random(1)
    for _ in range(200):
        sizes = draw.sample(range(1, 14), draw.randint(0, 4))
        counts = [draw.randint(1, 4) for _ in sizes]
        budget = draw.randint(0, 60)
        got = knapsack(np.array(sizes, np.int64), np.array(counts, np.int64), budget)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        assert int((got * sizes).sum()) == max(s for s in sums(sizes, counts) if s <= budget)


def test_fit_is_exact_and_keeps_the_sizes():
    draw = np.random.default_rng(2)
    sizes = np.arange(0, 3000, 7)
    counts = draw.integers(1, 50, len(sizes))
    total = int((sizes * counts).sum())
    for budget in (0, 7 * 11, total // 3 // 7 * 7, total - 7, total, total + 5):
        got = fit(sizes, counts, budget)
        assert (got <= counts).all() and (got >= 0).all()
        assert int((got * sizes).sum()) == min(budget, total)
    got = fit(sizes, counts, total // 2 // 7 * 7)
    assert np.abs(got[1:] - counts[1:] / 2).mean() < 2


def test_fit_with_sizes_beyond_the_reserve():
    sizes, counts = np.array([50_000, 70_001, 1_000_003]), np.array([9, 9, 2])
    for budget in (1, 50_000, 120_001, 1_200_000, 2_000_007, 3_000_000):
        got = fit(sizes, counts, budget)
        near = min(abs(s - budget) for s in sums(sizes.tolist(), counts.tolist()))
        assert (got <= counts).all() and abs(int((got * sizes).sum()) - budget) <= max(near, 50_000)


def targets(total, share=1.5, most=2, weights=(3, 1, 2)):
    """Reshare the excess until no source is above its stop."""
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        free = [s for s in names if s not in full]
        left = share * sum(total.values()) - sum(most * total[s] for s in full)
        got = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} | {s: float(most * total[s]) for s in full}
        over = {s for s in free if got[s] > most * total[s]}
        if not over:
            return got
        full |= over


def check(rows, got):
    """rows: (doc_id, text, source)."""
    size = {}
    for doc, text, source in rows:
        size.setdefault((doc, source), []).append(len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    total, by_id = {}, {}
    for (doc, source), found in size.items():
        total[source] = total.get(source, 0) + sum(found)
        by_id.setdefault(doc, []).extend((s, total, source) for s in found)
    want = targets(total)
    assert len(got) == len(rows)
    taken, sizes_of = dict.fromkeys(total, 0), {}
    source_of = {doc: source for doc, _, source in rows}
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == total[source] and r.target == pytest.approx(want[source], rel=1e-12, abs=1e-9)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source] += r.taken
        sizes_of.setdefault(source, []).append((r["size"], r.taken))
    for source, words in taken.items():
        smallest_left = min((s for s, t in sizes_of[source] if 0 < s and t < 2 * s), default=0)
        assert words == pytest.approx(want[source], abs=max(0.51, smallest_left)), source
    return taken, want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = entry.queries()["op12_source_mix"](spark, SMALL).collect()
    check(rows, got)
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_nulls_repeats_and_a_hot_source(spark):
    draw = random.Random(3)
    rows = [(i, " ".join("x" * draw.randint(0, 9)), "a") for i in range(60)]
    rows += [(None, "one two", None), (None, "one two", None), (100, None, None), (101, " \n ", "b"), (102, "w\x0bw\x1fw é é", "b")]
    rows += [(200, "same text", "c")] * 41 + [(201, "y " * 50_000, "d"), (202, "", "e"), (203, "y " * 10, "d")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    got = mix_sources(df).collect()
    check(rows, got)
    assert {r["size"] for r in got if r.doc_id == 102} == {3}
    assert sum(r.doc_id == 200 for r in got) == 41


def test_seeded_order_within_a_size(spark):
    rows = [(i, "a b c", "en", "s", 0) for i in range(50)] + [(99, "a b", "en", "t", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.taken for r in mix_sources(df, seed=4).collect()}
    order = [r.doc_id for r in df.where("doc_id < 99").orderBy(F.xxhash64("doc_id", F.lit(4))).collect()]
    cut = [got[i] for i in order]
    assert cut == sorted(cut, reverse=True) and len(set(cut)) == 2
    assert got != {r.doc_id: r.taken for r in mix_sources(df, seed=5).collect()}


def test_empty_wordless_and_clashing_names(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mix_sources(empty).count() == 0
    blank = spark.createDataFrame([(1, " ", "en", "s", 0), (2, None, "en", None, 0)], DOCS)
    assert [tuple(r)[1:] for r in mix_sources(blank).collect()] == [(0, 0, 0.0, 0)] * 2
    df = spark.createDataFrame([(1, "a b c", "en", "s", 0)], DOCS)
    for name in ("size", "target", "taken", "n", "row", "one", "place", "passes", "more"):
        df = df.withColumn(name, F.lit(name))
    assert mix_sources(df).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert mix_sources(df).first()["size"] == 3
