"""Paragraphs made from orders, told apart by the rules of operators.detection; the SQL keeps the sections by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detection
from ..sources.tables import Tables
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL

#: A paragraph for every rule: text, other columns, rule outside of sections, what it makes there, the section that it opens.
_KINDS = (
    ("after", {"page_break": True}, "pagebreak", "pageBreak||;paragraph|after|", None), ("Methods", {"style": "Heading2"}, "heading.style", "heading|Methods|2", "methods"), ("ABSTRACT:", {"style": "Title"}, "abstract.title-style", "", "abstract"),
    ("My title", {"style": "Subtitle"}, "title-subtitle.other", "title|My title|", None), ("Custom", {"style": "ChapterStyle3"}, "heading.custom", "heading|Custom|3", "body"), ("3 Literaturverzeichnis", {"outline": 2}, "heading.outline", "heading|3 Literaturverzeichnis|2", "references"),
    (" 2.1 Some part", {}, "heading.numbered", "heading|2.1 Some part|2", "body"), ("ALL CAPS", {}, "heading.formatting", "heading|ALL CAPS|1", "body"), ("IV. roman", {}, "heading.formatting", "heading|IV. roman|1", "body"), ("Bold line", {"bold": True}, "heading.formatting", "heading|Bold line|2", "body"),
    ("an item", {"numbered": True}, "list", "listItem|an item|", None), ("• a bullet", {}, "list.manual-bullet", "listItem|a bullet|", None), ("", {"math": True}, "equation", "equation||", None), ("short", {"style": "MySummary"}, "abstract.style", "abstract|short|", None),
    ("plain words here.", {}, "paragraph", "paragraph|plain words here.|", None), ("[3] Doe, J. Title.", {}, "paragraph", "paragraph|[3] Doe, J. Title.|", None), ("text of it", {"style": "Lemma1"}, "theorem.style", "theorem|text of it|", None), ("Theorem 2 (X): all is well.", {}, "theorem.content", "theorem|all is well.|", None),
    ("quoted", {"style": "IntenseQuote"}, "blockquote.style", "blockquote|quoted|", None), ("indented words.", {"indent": 800, "italic": True}, "blockquote.indent", "blockquote|indented words.|", None), ("bordered words.", {"border": True}, "blockquote.border", "blockquote|bordered words.|", None),
    ("x = 1;", {"style": "SourceCode"}, "code.style", "code|x = 1;|", None), ("y = 2;", {"font": "menlo"}, "code.font", "code|y = 2;|", None), ("z = 3;", {"shading": "EEEEEE"}, "code.shading", "code|z = 3;|", None), ("", {"drawing": True}, "image", "figure||", None), (" ", {}, "paragraph", "", None),
)


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@catalog.query(f"""
    WITH p AS (SELECT o_custkey, o_orderkey, (o_orderkey // 3) % {len(_KINDS)} AS i FROM orders),
    q AS (SELECT *, ({_sql_list([k[0] for k in _KINDS])})[i + 1] AS text, ({_sql_list([k[2] for k in _KINDS])})[i + 1] AS own, ({_sql_list([k[3] for k in _KINDS])})[i + 1] AS makes, ({_sql_list([k[4] for k in _KINDS])})[i + 1] AS opens FROM p),
    s AS (SELECT *, (SELECT arg_max(b.opens, b.o_orderkey) FROM q b WHERE b.o_custkey = q.o_custkey AND b.o_orderkey < q.o_orderkey AND b.opens IS NOT NULL) AS last,
                 (SELECT max(b.o_orderkey) FROM q b WHERE b.o_custkey = q.o_custkey AND b.o_orderkey < q.o_orderkey AND b.opens IS NOT NULL) AS last_at,
                 (SELECT max(b.o_orderkey) FROM q b WHERE b.o_custkey = q.o_custkey AND b.o_orderkey < q.o_orderkey AND b.i IN (3, 10, 11)) AS ended FROM q),
    t AS (SELECT *, CASE WHEN last IS NULL OR (last = 'abstract' AND ended > last_at) THEN 'body' ELSE last END AS section FROM s)
    SELECT o_custkey, o_orderkey, section,
           CASE WHEN section = 'abstract' AND i BETWEEN 14 AND 23 THEN 'abstract.section' WHEN section = 'references' AND i = 15 THEN 'bibliography.section' ELSE own END AS rule,
           concat_ws(',', CASE WHEN i >= 11 AND i <> 12 THEN 'heading.formatting' END, CASE WHEN i > 23 AND section = 'abstract' THEN 'abstract.section' END) AS passed,
           CASE WHEN section = 'abstract' AND i BETWEEN 14 AND 23 THEN 'abstract|' || text || '|' WHEN section = 'references' AND i = 15 THEN 'bibliographyEntry|Doe, J. Title.|' ELSE makes END AS elements FROM t""")
def detected_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs by the rule that wins, with the rules that let them pass, in the section that the headings above have opened."""
    fields = [c for c in detection.PARAGRAPH]
    kinds = F.array(*(F.struct(*(F.lit(text if c == "text" else more.get(c)).cast(detection.PARAGRAPH[c]).alias(c) for c in fields)) for text, more, *_ in _KINDS))
    rows = t.orders.select("o_custkey", "o_orderkey", F.inline(F.array(F.get(kinds, (F.floor(F.col("o_orderkey") / 3) % len(_KINDS)).cast("int")))))
    found = detection.detect(rows, "o_custkey", "o_orderkey")
    line = lambda e: F.concat_ws("|", F.coalesce(e["kind"], F.lit("")), F.coalesce(e["text"], F.lit("")), F.coalesce(e["level"].cast("string"), F.lit("")))
    return found.select("o_custkey", "o_orderkey", "section", "rule", F.array_join("passed", ",").alias("passed"), F.array_join(F.transform("elements", line), ";").alias("elements"))
