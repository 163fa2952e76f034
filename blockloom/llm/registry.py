"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, conversations, exact_dedup, langid, licenses, mixing, near_dedup, periodic, pii, spotsigs, token_counts, toxicity, url_filter

MODULES = (bpe, token_counts, toxicity, langid, url_filter, licenses, mixing, near_dedup, spotsigs, exact_dedup, periodic, pii, conversations)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
