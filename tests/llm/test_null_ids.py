from delaylens.llm.exact_dedup import distinct_documents
from delaylens.llm.language import with_known_language


def test_exact_dedup_keeps_null_ids_without_another(documents):
    rows = [(None, "alone"), (1, "a"), (None, "a"), (2, "b"), (2, "c"), (3, "b")]
    got = distinct_documents(documents(rows), "max").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, "alone"), (1, "a"), (2, "c"), (3, "b")], key=str)


def test_language_judges_null_ids_by_their_text(documents):
    rows = [(None, "some text", "xx"), (None, "12", "xx"), (1, "more text", "xx"), (1, "34", "xx")]
    got = with_known_language(documents(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, "some text"), (1, "more text")], key=str)
