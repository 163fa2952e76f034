"""All queries of the library outside the llm subpackage, with their oracle SQL."""

from __future__ import annotations

from . import detection_queries, editor_queries, event_queries, latex_queries, markup_queries, relational_queries, source_queries, stream_queries, text_queries

MODULES = (event_queries, relational_queries, text_queries, markup_queries, stream_queries, editor_queries, latex_queries, detection_queries, source_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "event_top_types"
