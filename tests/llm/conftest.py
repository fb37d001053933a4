import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def stored_documents(documents, tmp_path):
    """The same, written to a folder that a query can read; gives the folder."""

    def build(rows):
        documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return build
