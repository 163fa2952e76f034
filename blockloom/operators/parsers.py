"""Markup to rows. Documents become lines, and windows over the lines carry what a parser keeps as state.

All take a frame with a document key and a text, and return a row per element in order (pos). Only
BibTeX, whose values nest braces, takes Python, one entry at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences
from .latex import elements


def document_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), line; carriage returns before line ends are dropped."""
    return docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line"))


def _grouped(rows: DataFrame, key: str, starts: Column, *kept: str) -> DataFrame:
    """Rows from a start up to the next become one: pos, the kept columns of the first row, text of all lines."""
    marked = sequences.runs(rows, [key], "pos", starts, "_run")
    listed = F.array_sort(F.collect_list(F.struct("pos", "body")))
    first = [F.min_by(c, "pos").alias(c) for c in kept]
    return marked.groupBy(key, "_run").agg(F.min("pos").alias("pos"), *first, F.array_join(F.transform(listed, lambda s: s["body"]), "\n").alias("text")).drop("_run")


def markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, kind, level, text: headings, paragraphs (a line each), lists, quotes, tables, code, math, rules.

    Fenced code and math run from their opening to their closing line, or to the end of the text.
    """
    rows = document_lines(docs, key, text)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence, math = F.col("line").rlike(r"^\s*```"), F.trim("line") == "$$"
    rows = rows.withColumn("_fence", fence).withColumn("_in_code", F.sum(F.col("_fence").cast("int")).over(order) % 2 == 1)
    rows = rows.withColumn("_math", math & ~F.col("_in_code") & ~F.col("_fence")).withColumn("_in_math", F.sum(F.col("_math").cast("int")).over(order) % 2 == 1)
    line = F.col("line")
    hashes = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    kind = (
        F.when(F.col("_fence") | F.col("_in_code"), "code").when(F.col("_math") | F.col("_in_math"), "equation")
        .when(line.rlike(r"^\s*$"), "blank").when(hashes > 0, "heading").when(line.rlike(r"^\s*([-*_])(\s*\1){2,}\s*$"), "rule")
        .when(line.rlike(r"^\s*\|.*\|\s*$"), "table").when(line.rlike(r"^\s*([-*+]|[0-9]+[.)])\s+"), "list").when(line.rlike(r"^\s*>"), "quote").otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", hashes))
    body = (
        F.when(F.col("kind") == "heading", F.regexp_replace(line, r"^#{1,6}\s+|\s+#*\s*$", ""))
        .when(F.col("kind") == "list", F.regexp_replace(line, r"^\s*([-*+]|[0-9]+[.)])\s+", ""))
        .when(F.col("kind") == "quote", F.regexp_replace(line, r"^\s*>\s?", "")).otherwise(line)
    )
    previous = F.lag("kind").over(Window.partitionBy(key).orderBy("pos"))
    opens = (F.col("_fence") & F.col("_in_code")) | (F.col("_math") & F.col("_in_math"))
    rows = rows.withColumn("body", body).withColumn("_start", opens | (previous != F.col("kind")) | F.col("kind").isin("heading", "paragraph", "rule"))
    rows = rows.withColumn("body", F.when(F.col("_fence") | F.col("_math"), F.lit(None)).otherwise(F.col("body")))
    return _grouped(rows, key, F.col("_start"), "kind", "level").where(F.col("kind") != "blank").select(key, "pos", "kind", "level", "text")


def lml(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, kind, attributes (map), text: blocks that an @name[attributes] line opens; text before the first is a paragraph.

    Attributes are k=v, "k"="quoted", or flags (true). The body's indent is dropped and soft line ends stay line ends.
    """
    rows = document_lines(docs, key, text)
    opening = r"^@([A-Za-z][A-Za-z0-9_-]*)\s*(?:\[([^\]]*)\])?\s*(.*)$"
    opens = F.col("line").rlike(opening)
    body = F.when(opens, F.nullif(F.regexp_extract("line", opening, 3), F.lit(""))).otherwise(F.trim("line"))
    rows = rows.select(key, "pos", "line", opens.alias("_opens"), F.when(opens, F.lower(F.regexp_extract("line", opening, 1))).otherwise("paragraph").alias("kind"), F.when(opens, F.regexp_extract("line", opening, 2)).alias("raw"), body.alias("body"))
    found = _grouped(rows, key, F.col("_opens"), "kind", "raw").withColumn("text", F.regexp_replace("text", r"^\n+|\n+$", ""))
    parts = F.regexp_extract_all("raw", F.lit(r'([A-Za-z_][\w-]*(?:\s*=\s*(?:"[^"]*"|[^,\s"]+))?)'), F.lit(1))
    entry = lambda x: F.struct(F.trim(F.split(x, "=").getItem(0)).alias("key"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(F.regexp_extract(x, r"=\s*(.*)$", 1), '^"|"$', "")).otherwise("true").alias("value"))
    attributes = F.map_from_entries(F.array_distinct(F.transform(F.coalesce(parts, F.array().cast("array<string>")), entry)))
    return found.where((F.col("kind") != "paragraph") | (F.col("text") != "")).select(key, "pos", "kind", attributes.alias("attributes"), "text")


def latex(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, kind, level, text: the elements of latex.elements(), an environment under its own name."""
    found = elements(docs, key, text)
    kind = F.when(F.col("kind").isin("heading", "paragraph", "equation"), F.col("kind")).otherwise(F.col("name"))
    return found.select(key, "pos", kind.alias("kind"), "level", "text")


def _braced(text: str, at: int) -> int:
    """End of the group that opens at text[at]; the text's end if it never closes. A backslash escapes the next character."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] in "{}":
            depth += 1 if text[i] == "{" else -1
            if depth == 0:
                return i
        i += 1
    return len(text)


def _fields(body: str) -> dict[str, str]:
    """name = {value}, "value" or a bare word; names in lower case, white space of values collapsed."""
    out, i = {}, 0
    while (eq := body.find("=", i)) >= 0:
        name = body[i:eq].strip(" ,\n\t\r").lower()
        i = eq + 1
        while i < len(body) and body[i].isspace():
            i += 1
        if i < len(body) and body[i] == "{":
            end = _braced(body, i)
            value = body[i + 1 : end]
        elif i < len(body) and body[i] == '"':
            end = body.find('"', i + 1)
            end = len(body) if end < 0 else end
            value = body[i + 1 : end]
        else:
            end = body.find(",", i)
            end = len(body) if end < 0 else end
            value = body[i:end]
        if name:
            out[name] = " ".join(value.split())
        comma = body.find(",", end)
        i = len(body) if comma < 0 else comma + 1
    return out


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(key, type, fields) of every entry; comment lines, strings, preambles and comments are skipped."""
    text = "\n".join(line for line in (text or "").split("\n") if not line.lstrip().startswith("%"))
    at = text.find("@")
    while at >= 0:
        brace = text.find("{", at)
        if brace < 0:
            return
        kind, end = text[at + 1 : brace].strip().lower(), _braced(text, brace)
        key, _, rest = text[brace + 1 : end].partition(",")
        if kind.isalpha() and kind not in ("string", "preamble", "comment") and key.strip():
            yield key.strip(), kind, _fields(rest)
        at = text.find("@", end)


def bibtex(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, cite_key, entry_type, fields (map): a row per entry."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *entry) for k, t in zip(batch[key], batch[text], strict=True) for entry in bibtex_entries(t)]
            yield pd.DataFrame(rows, columns=[key, "cite_key", "entry_type", "fields"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(parse, f"{key} {kind}, cite_key string, entry_type string, fields map<string,string>")
