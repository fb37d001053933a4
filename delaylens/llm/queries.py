"""All queries of this package and their check SQL."""

from __future__ import annotations

from delaylens.llm import (
    conversations, exact_dedup, html_text, jaccard_join, language, merkle, mixing, packing, pieces, pii, token_files, url_rules, vector_links,
)

MODULES = (
    conversations, exact_dedup, html_text, jaccard_join, language, merkle, mixing, packing, pieces, pii, token_files, url_rules, vector_links,
)

QUERIES = {name: plan for module in MODULES for name, plan in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
