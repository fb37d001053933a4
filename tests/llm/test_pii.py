import hashlib
import random
import re
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from delaylens.llm import pii
from tests.conftest import SMALL

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PLAIN.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in found[k])
    return [len(found[k]) for k in PLAIN], hashlib.sha256(joined.encode()).hexdigest(), joined


def check(rows, result):
    got = {r.doc_id: r for r in result.collect()}
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        counts, sha, joined = base(text)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (text[:200], r)
        assert r.base_sha256 == sha, (text[:200], r, joined)
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
    return got


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(rows, entry.queries()["op7_pii"](spark, SMALL))


def test_random_strings(documents):
    rng = random.Random(3)
    alphabet = list("0123456789" * 3 + "...--  +()@@ab_é\n") + ["4111111111111111", "5500 0000 0000 0004", "1.2.3.4", "a@b.c", "+49 30"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(120)))) for i in range(1500)]
    check(rows, pii.personal_data(documents(rows)))


def test_edge_cases(documents):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (4, "1" * 50_000), (5, "a." * 50_000 + "@"), (6, "é😀 x@y.z +1 (234) 567-8901"),
            (7, "a@b" + ".c" * 20_000), (8, "1 " * 30_000), (9, "a@b.c_d@e.f"), (10, "0000255.1.2.3 256.1.1.1"), (11, "a@b.c " * 2000)]
    df = documents(rows).withColumn("spans", F.lit(1)).withColumn("email", F.lit("e")).withColumn("n_ip", F.lit(0))
    check(rows, pii.personal_data(df))
    assert pii.personal_data(documents([])).count() == 0
    assert pii.personal_data(documents([(1, "a@b.c"), (1, "a@b.c")])).count() == 2


def test_loose_spans_follow_the_votes(documents):
    rows = [(i, f"call (212) 555-01{i:02d} now, or mail me: jane.doe{i} (at) mail.example (dot) com today") for i in range(40)]
    rows += [(100 + i, f"mail me at x{i}@example.com or call +1 (212) 555-01{i:02d}.") for i in range(40)]
    got = check(rows, pii.personal_data(documents(rows)))
    assert all("phone:5:19" in got[i].spans for i in range(40))


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    noisy = lambda p: np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1
    rates = np.array([0.95, 0.9, 0.55])
    votes = np.stack([noisy(p) for p in rates], 1)
    patterns, index, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, answer = pii.reliabilities(patterns.astype(float), n)
    # Without truth the two good labelers are hard to tell apart: where they disagree, about half is right.
    reach, spread = rates[:2].prod() + (1 - rates[:2].prod() - (1 - rates[:2]).prod()) / 2, 3 * (0.25 / 4000) ** 0.5
    assert ((post[index.ravel()] > 0.5) == truth).mean() > reach - spread
    hit = answer[1, :, 2]
    assert np.abs(hit - rates).max() < 0.05
    assert hit[0] > hit[1] > hit[2]
    rows = [SimpleNamespace(kind="ip", votes=[1, 1, 0, 0, 0, 0], n=9)]
    assert pii.train(rows)["email"][0] < 0 < sum(pii.train(rows)["ip"])


def test_masking_keeps_documents(documents):
    rows = [(1, "é write a.b@c.de, or +1 (234) 567-8901!"), (2, "clean"), (3, None), (4, "4111111111111111")]
    out = pii.masked(documents(rows))
    assert out.columns == documents(rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é write <email>, or <phone>!", 2: "clean", 3: None, 4: "<card>"}
