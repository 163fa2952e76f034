"""LaTeX made from tables and read back; the SQL says from the tables what has to be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import latex
from ..sources.tables import Tables, spread
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL


def _text(*parts: str | Column) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def order_documents(t: Tables) -> DataFrame:
    """o_orderkey, body: a heading, nested lists (as deep as the order's key says, its lines innermost), a float with a table, code, and text."""
    line = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), "l_suppkey")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    key, depth = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 9).cast("int")
    items = F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,q:bigint,l_suppkey:bigint>>")), lambda x: _text("\\item part {", x["l_partkey"].cast("string"), "} of \\textbf{", x["q"].cast("string"), "}\n")), "")
    body = _text(
        "\\documentclass{article}\n\\newcommand{\\x}{y}\n\\begin{document}\n\\section[short]{Order {\\texttt{", key, "}} of ", F.col("o_orderstatus"), "}\n% a note \\section{none}\nFirst \\verb|\\section{", key, "}| text.\n\nSecond \\{ 5\\% text.\n",
        "\\begin{center}\\begin{minipage}[t]{0.5\\textwidth}\\begin{itemize}\n", F.repeat(F.lit("\\item deep \\begin{enumerate} "), depth), "\\item lines ", F.col("o_orderpriority"), "\n\\begin{description}\n\\item last\n", items, "\\end{description}\n",
        F.repeat(F.lit("\\end{enumerate} back "), depth), "\\end{itemize}\\end{minipage}\\end{center}\n",
        "\\begin{figure*}[h]\n\\includegraphics{a.png}\\caption{Of \\emph{", key, " {x}}}\\label{fig:", key, "}\n\\begin{tabular}{l@{\\hspace{1cm}}r}a & b\\end{tabular}\\end{figure*}\n",
        "\\begin{verbatim}\n\\begin{itemize} ", key, " \\section{q}\n\\end{verbatim}\n\\[ ", key, " \\begin{aligned}z\\end{aligned} \\]$$", key, "$$\n\\begin{odd}\\begin{even}e\\end{even}\\end{odd}\\end{quote}tail\n\\end{document}\nnot read",
    )
    orders = spread(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", body.alias("body"))


@catalog.query(r"""
    WITH k AS (SELECT o_orderkey, o_orderkey::VARCHAR AS s, o_orderkey % 9 AS d, o_orderstatus, o_orderpriority FROM orders),
    l AS (SELECT l_orderkey, list('part {' || l_partkey || '} of \textbf{' || l_quantity::BIGINT || '}' ORDER BY l_linenumber, l_partkey, l_quantity::BIGINT, l_suppkey) AS lines FROM lineitem GROUP BY 1),
    i AS (SELECT o_orderkey, list_concat(list_transform(range(d), lambda x: (x + 1) || ':deep  back'), [(d + 1) || ':lines ' || o_orderpriority], [(d + 2) || ':last'], list_transform(coalesce(lines, []), lambda x: (d + 2) || ':' || x)) AS items
          FROM k LEFT JOIN l ON l_orderkey = o_orderkey),
    e AS (
        SELECT o_orderkey, 0 AS pos, 'heading' AS kind, NULL AS name, 1 AS level, 'Order {\texttt{' || s || '}} of ' || o_orderstatus AS text, NULL AS caption, NULL AS label FROM k UNION ALL
        SELECT o_orderkey, 1, 'paragraph', NULL, NULL, 'First \verb|\section{' || s || '}| text.', NULL, NULL FROM k UNION ALL
        SELECT o_orderkey, 2, 'paragraph', NULL, NULL, 'Second \{ 5\% text.', NULL, NULL FROM k UNION ALL
        SELECT o_orderkey, 3, 'list', 'itemize', NULL, NULL, NULL, NULL FROM k UNION ALL
        SELECT o_orderkey, 4, 'figure', 'figure', NULL, '\includegraphics{a.png}\caption{Of \emph{' || s || ' {x}}}\label{fig:' || s || '}' || chr(10) || '\begin{tabular}{l@{\hspace{1cm}}r}a & b\end{tabular}', 'Of \emph{' || s || ' {x}}', 'fig:' || s FROM k UNION ALL
        SELECT o_orderkey, 5, 'code', 'verbatim', NULL, '\begin{itemize} ' || s || ' \section{q}', NULL, NULL FROM k UNION ALL
        SELECT o_orderkey, 6, 'equation', '[', NULL, s || ' \begin{aligned}z\end{aligned}', NULL, NULL FROM k UNION ALL
        SELECT o_orderkey, 7, 'equation', '$$', NULL, s, NULL, NULL FROM k UNION ALL
        SELECT o_orderkey, 8, 'embed', 'odd', NULL, '\begin{even}e\end{even}', NULL, NULL FROM k UNION ALL
        SELECT o_orderkey, 9, 'paragraph', NULL, NULL, '\end{quote}tail', NULL, NULL FROM k)
    SELECT e.*, CASE WHEN kind = 'list' THEN array_to_string(items, '|') END AS items FROM e JOIN i USING (o_orderkey)""")
def latex_nested(t: Tables) -> DataFrame:
    """Elements of documents with lists in lists, tables in floats, verbatim text and stray ends."""
    found = latex.elements(order_documents(t), "o_orderkey", "body")
    items = F.array_join(F.transform("items", lambda x: F.concat(x["depth"].cast("string"), F.lit(":"), x["text"])), "|")
    return found.select("o_orderkey", "pos", "kind", "name", "level", F.when(F.col("kind") != "list", F.col("text")).alias("text"), "caption", "label", items.alias("items"))


@catalog.query(r"""
    SELECT o_orderkey, 'A' || o_orderkey || ' E' || o_orderpriority || ' M N B t' || o_orderstatus || ' \ifmine u\else v\fi Z' || repeat(' ', o_orderkey % 40) || o_orderkey || ' \iff `\fi ' || o_orderkey || '`' AS text FROM orders""")
def latex_branches(t: Tables) -> DataFrame:
    """Conditionals in conditionals, some forty deep, give way to the branch that pdfTeX compiles; inline verbatim hides what it holds."""
    key, depth = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 40).cast("int")
    text = _text(
        "A", key, "\\ifxetex X\\ifpdftex P\\else Q\\fi Y\\else E", F.col("o_orderpriority"), "\\ifluatex L\\else M\\fi N\\fi B\\iftrue t", F.col("o_orderstatus"), "\\else f\\fi\\iffalse g\\fi \\ifmine u\\else v\\fi Z",
        F.repeat(F.lit("\\ifluatex lost \\iftrue too\\fi\\else "), depth), key, F.repeat(F.lit("\\fi"), depth), " \\iff \\verb", F.get(F.array(*map(F.lit, "|+!")), (F.col("o_orderkey") % 3).cast("int")), "\\fi ", key, F.get(F.array(*map(F.lit, "|+!")), (F.col("o_orderkey") % 3).cast("int")),
    )
    orders = spread(t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")
    out = latex.branches(orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    return out.select("o_orderkey", latex.inline_code(F.col("text")).alias("text"))


_SPANS = r"""
    SELECT c_custkey, 'é Dear ' || c_mktsegment || ' ' || c_name || ' 5% see' AS plain,
           array_to_string(list_concat(list_transform(range(c_custkey % 12 + 1), lambda x: '7:' || (length(c_mktsegment) + 1 + length(c_name)) || ':bold'), [(8 + length(c_mktsegment)) || ':' || length(c_name) || ':italic', (12 + length(c_mktsegment) + length(c_name)) || ':3:monospace']), ',') AS spans
    FROM customer"""


@catalog.query(_SPANS)
def latex_spans(t: Tables) -> DataFrame:
    """Offsets of nested marks in the plain text, through up to twelve levels; dropped commands and comments count nothing."""
    depth = (F.col("c_custkey") % 12 + 1).cast("int")
    text = _text("é Dear ", F.repeat(F.lit("\\textbf{"), depth), F.col("c_mktsegment"), "\\label{a{b}} \\emph {\\keep{", F.col("c_name"), "}}", F.repeat(F.lit("}"), depth), "\\vspace{2mm} 5\\% \\texttt{see}% \\emph{no}")
    found = latex.plain_spans(spread(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", text.alias("text")), "c_custkey", "text", unwrap=("keep",), drop=("label", "vspace"))
    return found.select("c_custkey", "plain", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["length"], s["type"])), ",").alias("spans"))


@catalog.query(r"""
    WITH o AS (SELECT o_custkey, o_orderkey % 5 AS label, o_orderkey FROM orders WHERE o_orderkey % 7 <> 3)
    SELECT o_custkey, label::VARCHAR AS label, arg_max(o_orderkey % 900 + 1, o_orderkey)::INT AS page FROM o GROUP BY 1, 2""")
def page_numbers(t: Tables) -> DataFrame:
    """Pages of blocks from auxiliary files: nested titles, roman pages, other labels, and labels defined again."""
    page = lambda key: F.when(key % 7 == 3, "iv").otherwise((key % 900 + 1).cast("string"))
    entry = lambda key: _text("\\relax \n\\newlabel{sec:", key.cast("string"), "}{{9}{99}}\n\\newlabel{blk-", (key % 5).cast("string"), "}{{1.", key.cast("string"), "{a}}{", page(key), "}{Of \\{ {\\bf x} {y}}{figure.1}{}}\n\\@writefile{toc}{\\contentsline {section}{\\numberline {1}T}{7}{}}\n")
    # the keys are gathered, and become texts in the row of their file
    files = spread(t.orders.select("o_custkey", "o_orderkey"), "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    files = files.select("o_custkey", F.array_join(F.transform("keys", entry), "").alias("aux"))
    return latex.page_map(files, "o_custkey", "aux")
