import numpy as np
import pytest
from pyspark.sql import functions as F

from delaylens.llm import vector_links

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute_force(rows, threshold=0.9):
    x = {}
    for i, v in rows:
        a = None if v is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        x.setdefault(i, a if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    ids = sorted(x)
    links, root = {i: set() for i in ids}, {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, a in enumerate(ids):
        for b in ids[p + 1:]:
            u, w = x[a], x[b]
            if u is None or w is None or len(u) != len(w):
                continue
            if u @ w / np.sqrt(u @ u) / np.sqrt(w @ w) >= threshold:
                links[a].add(b), links[b].add(a)
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(links[i]), find(i)) for i in ids}


def clusters(seed, n, dims=32, noise=0.35, families=25):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((families, dims))
    family = np.minimum(rng.geometric(0.15, n) - 1, families - 1)
    return [(int(i * 3), v) for i, v in enumerate(centre[family] + noise * rng.random((n, 1)) * rng.standard_normal((n, dims)))]


@pytest.mark.parametrize("tile", [2048, 40])
def test_links_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_links, "TILE", tile)
    monkeypatch.setattr(vector_links, "PER_CELL", 8)
    rows = clusters(1, 900)
    want = brute_force(rows)
    got = {r.vec_id: r for r in vector_links.vector_groups(table(spark, rows)).collect()}
    assert set(got) == set(want)
    found, all_links = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert 0.97 * all_links <= found <= all_links
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) > 0.97 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_random_vectors_at_the_threshold(spark):
    """Planted neighbours just above the cosine, without clusters: at least nine in ten are found."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((600, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cos = rng.uniform(0.902, 0.93, 600)[:, None]
    rows = [(i, v) for i, v in enumerate(np.vstack([a, cos * a + np.sqrt(1 - cos**2) * b]))]
    got = {r.vec_id: r.n_links for r in vector_links.vector_groups(table(spark, rows)).collect()}
    assert sum(got[i] >= 1 for i in range(600)) >= 0.95 * 600


def test_edge_cases(spark):
    rows = [(5, [1, 0, 0]), (2, [2, 0, 0]), (9, [1, 0, 0]), (1, [0, 0, 0]), (3, None), (4, [1, None, 0]), (6, [float("nan"), 1, 0]),
            (7, [float("inf"), 1, 0]), (8, [1, 0]), (10, []), (11, [0, 1e-30, 0]), (12, [0, 1e30, 0]), (13, [-1, 0, 0])]
    df = table(spark, rows).withColumn("cells", F.lit(1)).withColumn("rep", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.vector_groups(df).collect()}
    assert got == brute_force(rows)
    assert vector_links.vector_groups(table(spark, [])).count() == 0
    twice = vector_links.vector_groups(table(spark, [(1, [1, 2]), (1, [1, 2]), (None, [1, 2])])).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in twice) == [(0, 0), (1, 1), (1, 1)]


def test_whole_table(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in entry.queries()["op3_vector_links"](spark, folder).collect()}
    assert got == brute_force(rows)
