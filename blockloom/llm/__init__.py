"""Training-data operators: tokenizing, scoring, filtering, deduplication and mixing of text corpora.

Nothing outside this subpackage imports it. ``registry`` gathers its queries and their SQL.
"""
