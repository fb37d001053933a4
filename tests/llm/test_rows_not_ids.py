"""Pipeline stages judge rows, not ids: null ids, repeated ids and columns of the stages' own names."""

from pyspark.sql import functions as F

from delaylens.llm.jaccard_join import one_of_each_group
from delaylens.llm.pii import masked

WORDS = " ".join(f"word{i}" for i in range(60))


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_masking_follows_the_row(documents):
    rows = [(None, "no id, mail a@b.org"), (None, "plain"), (1, "plain text xx y@z.org"), (1, "another row with the same id"), (2, None), (3, "")]
    df = documents(rows)
    for name in ("_spans", "spans", "row", "email", "all_email"):
        df = df.withColumn(name, F.lit(name))
    got = masked(df)
    assert got.columns == df.columns
    assert rows_of(got) == sorted([
        (None, "no id, mail <email>"), (None, "plain"), (1, "plain text xx <email>"), (1, "another row with the same id"), (2, None), (3, "")
    ], key=str)
    assert {tuple(r[5:]) for r in got.collect()} == {("_spans", "spans", "row", "email", "all_email")}


def test_near_copies_with_null_and_repeated_ids(documents):
    near, other, third = WORDS + " end", "quite " + " ".join(f"other{i}" for i in range(40)), " ".join(f"third{i}" for i in range(40))
    rows = [(None, WORDS), (4, near), (4, other), (None, third), (5, other + " more"), (7, "short"), (7, "short"), (8, None), (None, "")]
    df = documents(rows).withColumn("n", F.lit("n")).withColumn("row", F.lit("row"))
    got = one_of_each_group(df)
    assert got.columns == df.columns
    assert rows_of(got) == sorted([(4, near), (4, other), (None, third), (7, "short"), (8, None), (None, "")], key=str)


def test_near_copies_with_plain_ids(documents):
    rows = [(2, WORDS), (1, WORDS + " end"), (3, "apart"), (4, None)]
    assert rows_of(one_of_each_group(documents(rows))) == sorted([(1, WORDS + " end"), (3, "apart"), (4, None)], key=str)
