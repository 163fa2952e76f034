"""Queries that parse markup into elements and render blocks to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import blocks, emit, findings, parsers, relational
from ..sources.tables import Tables
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL

_KIND_SQL = "CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'paragraph' ELSE 'code' END"


def typed_blocks(t: Tables) -> DataFrame:
    """Turns as blocks: system turns are headings, users' are paragraphs, the assistant's are code."""
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "paragraph").otherwise("code")
    rows = t.conversations.select("conv_id", "turn", kind.alias("kind"), "text")
    return rows.withColumn("content", blocks.content_of(F.col("kind"), F.col("text")))


@catalog.query(f"""
    SELECT conv_id, string_agg(CASE kind WHEN 'heading' THEN '## ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS body
    FROM (SELECT conv_id, turn, {_KIND_SQL} AS kind, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id""")
def conv_to_markdown(t: Tables) -> DataFrame:
    return emit.documents_to("markdown", typed_blocks(t), ["conv_id"], "turn", "kind", "content")


@catalog.query(f"""
    SELECT conv_id, string_agg(CASE kind WHEN 'heading' THEN '== ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) || chr(10) ORDER BY turn) AS body
    FROM (SELECT conv_id, turn, {_KIND_SQL} AS kind, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id""")
def conv_to_typst(t: Tables) -> DataFrame:
    return emit.documents_to("typst", typed_blocks(t), ["conv_id"], "turn", "kind", "content")


@catalog.query(f"""
    SELECT conv_id, string_agg(CASE kind WHEN 'heading' THEN '@heading[level=2]' || chr(10) || '  ' || text ELSE '@' || kind || chr(10) || '  ' || replace(text, chr(10), chr(10) || '  ') END, chr(10) || chr(10) ORDER BY turn) AS body
    FROM (SELECT conv_id, turn, {_KIND_SQL} AS kind, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id""")
def conv_to_lml(t: Tables) -> DataFrame:
    return emit.documents_to("lml", typed_blocks(t), ["conv_id"], "turn", "kind", "content")


#: Inline marks in SQL: text that stands alone within code or emphasis has no marks in the tables, so the order of the rules is all that counts.
_HTML_SQL = r"""replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_INLINE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '`([^`]+)`', '{1}', 'g'), '\*\*([^*]+)\*\*', '{2}', 'g'), '\*([^*]+)\*', '{3}', 'g'), '\[([^\]]+)\]\(([^)\s]+)\)', '{4}', 'g')"""


@catalog.query(f"""
    SELECT conv_id, string_agg(CASE kind WHEN 'heading' THEN '<h2>' || inline || '</h2>' WHEN 'code' THEN '<pre><code>' || escaped || '</code></pre>' ELSE '<p>' || inline || '</p>' END, chr(10) || chr(10) ORDER BY turn) AS body
    FROM (SELECT *, regexp_replace({_INLINE_SQL.format("escaped", "<code>\\1</code>", "<strong>\\1</strong>", "<em>\\1</em>", '<a href="\\2">\\1</a>')}, '~~([^~]+)~~', '<del>\\1</del>', 'g') AS inline
    FROM (SELECT conv_id, turn, {_KIND_SQL} AS kind, {_HTML_SQL.format("coalesce(text, '')")} AS escaped FROM conversations)) GROUP BY conv_id""")
def conv_to_html(t: Tables) -> DataFrame:
    return emit.documents_to("html", typed_blocks(t), ["conv_id"], "turn", "kind", "content")


_LATEX_INLINE_SQL = _INLINE_SQL.format("regexp_replace(coalesce(text, ''), '([#%&_])', '\\\\\\1', 'g')", "\\\\texttt{\\1}", "\\\\textbf{\\1}", "\\\\textit{\\1}", "\\\\href{\\2}{\\1}")
_LATEX_SQL = f"""
    SELECT conv_id, '\\documentclass{{article}}' || chr(10) || '\\usepackage{{amsmath}}' || chr(10) || '\\usepackage{{graphicx}}' || chr(10) || '\\usepackage{{hyperref}}' || chr(10) || '\\title{{Conversation ' || conv_id || '}}' || chr(10)
        || '\\begin{{document}}' || chr(10) || '\\maketitle' || chr(10) || string_agg(CASE kind WHEN 'heading' THEN '\\subsection{{' || inline || '}}' WHEN 'code' THEN '\\begin{{verbatim}}' || chr(10) || text || chr(10) || '\\end{{verbatim}}' ELSE inline END, chr(10) || chr(10) ORDER BY turn)
        || chr(10) || '\\end{{document}}' || chr(10) AS body
    FROM (SELECT conv_id, turn, {_KIND_SQL} AS kind, coalesce(text, '') AS text, {_LATEX_INLINE_SQL} AS inline FROM conversations) GROUP BY conv_id"""


@catalog.query(_LATEX_SQL)
def conv_to_latex(t: Tables) -> DataFrame:
    body = emit.documents_to("latex", typed_blocks(t), ["conv_id"], "turn", "kind", "content")
    return body.select("conv_id", emit.latex_document(F.col("body"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))).alias("body"))


@catalog.query(f"""
    SELECT conv_id, kind, count(*) AS n FROM (SELECT conv_id, {_KIND_SQL} AS kind FROM conversations WHERE role <> 'user') GROUP BY 1, 2""")
def markdown_round_trip(t: Tables) -> DataFrame:
    """Rendered to markdown and parsed again: every heading and code block is found."""
    found = parsers.markdown(conv_to_markdown(t), "conv_id", "body")
    return found.where(F.col("kind").isin("heading", "code")).groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@catalog.query(f"""
    SELECT conv_id, kind, count(*) AS n FROM (SELECT conv_id, {_KIND_SQL} AS kind FROM conversations) GROUP BY 1, 2""")
def lml_round_trip(t: Tables) -> DataFrame:
    return parsers.lml(conv_to_lml(t), "conv_id", "body").groupBy("conv_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@catalog.query(rf"""
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS pos, CASE kind WHEN 'code' THEN 'verbatim' ELSE kind END AS kind, CASE kind WHEN 'heading' THEN 2 END AS level, x AS text FROM (
        SELECT conv_id, turn, kind, CASE WHEN kind = 'paragraph' THEN regexp_replace(trim(p, chr(10) || chr(9) || ' '), '[ \t]+\n', chr(10), 'g') WHEN kind = 'heading' THEN trim(p) ELSE p END AS x, part FROM (
            SELECT conv_id, turn, kind, unnest(parts) AS p, generate_subscripts(parts, 1) AS part FROM (
                SELECT conv_id, turn, kind, CASE kind WHEN 'paragraph' THEN regexp_split_to_array(inline, '\n[ \t]*\n\s*') WHEN 'heading' THEN [inline] ELSE [text] END AS parts FROM (
                    SELECT conv_id, turn, {_KIND_SQL} AS kind, coalesce(text, '') AS text, {_LATEX_INLINE_SQL} AS inline FROM conversations))))
    WHERE kind <> 'paragraph' OR regexp_matches(x, '\S')""")
def latex_elements(t: Tables) -> DataFrame:
    return parsers.latex(conv_to_latex(t), "conv_id", "body")


@catalog.query(r"""
    SELECT page_id, cell_row, count(*) AS n_cells, count(*) FILTER (starts_with(lower(c), '<th')) AS n_headers FROM (
        SELECT page_id, unnest(range(len(r))) AS cell_row, unnest(list_transform(r, lambda x: regexp_extract_all(x, '(?is)<t[dh]\b[^>]*>.*?</t[dh]>'))) AS cells FROM (SELECT page_id, regexp_extract_all(html, '(?is)<tr\b[^>]*>(.*?)</tr>', 1) AS r FROM pages)) , unnest(cells) AS u(c) GROUP BY 1, 2""")
def page_tables(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.posexplode(markup.html_tables(F.col("html"))).alias("cell_row", "cells")).select("page_id", F.col("cell_row").cast("long").alias("cell_row"), F.explode("cells").alias("c"))
    return rows.groupBy("page_id", "cell_row").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if("c.header").alias("n_headers"))


def references(t: Tables) -> DataFrame:
    """Bibliographies of eight suppliers each: an entry for every one."""
    name = F.concat(F.lit("Author"), F.col("s_suppkey").cast("string"))
    fields = F.create_map(
        F.lit("author"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(name, F.lit(", Jo Ann and Roe, Max"))).otherwise(F.concat(F.lit("Li "), name)), F.lit("title"), F.concat(F.lit("On "), F.col("s_name")),
        F.lit("year"), (1950 + F.col("s_suppkey") % 70).cast("string"), F.lit("journal"), F.lit("Journal of Parts"), F.lit("volume"), (F.col("s_suppkey") % 30).cast("string"), F.lit("pages"), F.lit("1--9"),
    )
    return t.supplier.select(F.floor(F.col("s_suppkey") / 8).alias("list"), "s_suppkey", fields.alias("fields"))


@catalog.query("""
    SELECT list, string_agg(c, chr(10) || chr(10) ORDER BY c) AS bibliography FROM (SELECT s_suppkey // 8 AS list, CASE WHEN s_suppkey % 2 = 0 THEN 'Author' || s_suppkey || ', J. A., & Roe, M.' ELSE 'Author' || s_suppkey || ', L.' END
        || ' (' || (1950 + s_suppkey % 70) || '). On ' || s_name || '. Journal of Parts, ' || (s_suppkey % 30) || ', 1–9.' AS c FROM supplier) GROUP BY list""")
def bibliography_apa(t: Tables) -> DataFrame:
    return emit.bibliography(references(t), ["list"], "apa")


@catalog.query("""
    SELECT list, string_agg(c, chr(10) || chr(10) ORDER BY c) AS bibliography FROM (SELECT s_suppkey // 8 AS list, CASE WHEN s_suppkey % 2 = 0 THEN 'J. A. Author' || s_suppkey || ', and M. Roe' ELSE 'L. Author' || s_suppkey END
        || ', "On ' || s_name || '," Journal of Parts, vol. ' || (s_suppkey % 30) || ', pp. 1–9, ' || (1950 + s_suppkey % 70) || '.' AS c FROM supplier) GROUP BY list""")
def bibliography_ieee(t: Tables) -> DataFrame:
    return emit.bibliography(references(t), ["list"], "ieee")


def cited(t: Tables, style: str) -> DataFrame:
    return references(t).select("s_suppkey", emit.citation(style, F.col("fields")).alias("citation"))


_FULL_SQL = "'Author' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ', Jo Ann, and Max Roe' ELSE ', Li' END"
_YEAR_SQL, _VOLUME_SQL = "(1950 + s_suppkey % 70)", "(s_suppkey % 30)"


@catalog.query(f"""SELECT s_suppkey, {_FULL_SQL} || '. "On ' || s_name || '." Journal of Parts, vol. ' || {_VOLUME_SQL} || ', ' || {_YEAR_SQL} || ', pp. 1–9.' AS citation FROM supplier""")
def cited_mla(t: Tables) -> DataFrame:
    return cited(t, "mla")


@catalog.query(f"""SELECT s_suppkey, {_FULL_SQL} || '. "On ' || s_name || '." Journal of Parts ' || {_VOLUME_SQL} || ' (' || {_YEAR_SQL} || '): 1–9.' AS citation FROM supplier""")
def cited_chicago(t: Tables) -> DataFrame:
    return cited(t, "chicago")


@catalog.query(f"""SELECT s_suppkey, 'Author' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ', J. A. and Roe, M.' ELSE ', L.' END || ' (' || {_YEAR_SQL} || ') ' || chr(39) || 'On ' || s_name || chr(39) || ', Journal of Parts, ' || {_VOLUME_SQL} || ', pp. 1–9.' AS citation FROM supplier""")
def cited_harvard(t: Tables) -> DataFrame:
    return cited(t, "harvard")


@catalog.query(f"""SELECT s_suppkey, 'Author' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' JA, Roe M' ELSE ' L' END || '. On ' || s_name || '. Journal of Parts. ' || {_YEAR_SQL} || ';' || {_VOLUME_SQL} || ':1–9.' AS citation FROM supplier""")
def cited_vancouver(t: Tables) -> DataFrame:
    return cited(t, "vancouver")


@catalog.query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Author' || s_suppkey || ' & Roe' ELSE 'Author' || s_suppkey END || ' (' || (1950 + s_suppkey % 70) || ')' AS short, 'author' || (1950 + s_suppkey % 70) AS cite_key FROM supplier""")
def short_citations(t: Tables) -> DataFrame:
    return references(t).select("s_suppkey", emit.short_citation(F.col("fields")).alias("short"), emit.cite_key(F.col("fields")).alias("cite_key"))


@catalog.query("""
    SELECT s_suppkey // 8 AS list, 'author' || (1950 + s_suppkey % 70) || '-' || s_suppkey AS cite_key, 'article' AS entry_type, 'On ' || s_name AS title FROM supplier""")
def bibtex_round_trip(t: Tables) -> DataFrame:
    """Entries written as BibTeX and parsed again."""
    rows = references(t).withColumn("key", F.concat(emit.cite_key(F.col("fields")), F.lit("-"), F.col("s_suppkey").cast("string")))
    texts = rows.groupBy("list").agg(F.array_join(F.collect_list(emit.bibtex_text(F.lit("article"), F.col("key"), F.col("fields"))), "\n\n").alias("bib"))
    return parsers.bibtex(texts, "list", "bib").select("list", "cite_key", "entry_type", F.col("fields")["title"].alias("title"))


@catalog.query("""
    SELECT event_type, CASE event_type WHEN 'error' THEN 'missing_file' WHEN 'click' THEN 'undefined_control_sequence' WHEN 'view' THEN 'syntax_error' WHEN 'signup' THEN 'timeout' ELSE 'unknown' END AS category, count(*) AS n,
           count(DISTINCT CASE WHEN event_type IN ('error', 'click') THEN (props::JSON->>'k')::INT END) AS n_lines FROM events GROUP BY 1, 2""")
def compile_errors(t: Tables) -> DataFrame:
    """Logs made from events, classified and counted."""
    k = F.get_json_object("props", "$.k")
    log = F.when(F.col("event_type") == "error", F.concat(F.lit("! LaTeX Error: File `a.sty' not found.\nl."), k, F.lit(" \\usepackage"))).when(F.col("event_type") == "click", F.concat(F.lit("! Undefined control sequence.\nl."), k, F.lit(" \\foo")))
    log = log.when(F.col("event_type") == "view", "! Emergency stop.").when(F.col("event_type") == "signup", "compiler timed out").otherwise("fine")
    found = t.events.select("event_type", markup.compile_error(log).alias("category"), markup.error_line(log).alias("line"))
    return found.groupBy("event_type", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("n_lines"))


@catalog.query(r"""
    WITH k AS (SELECT o_orderkey, o_orderkey::VARCHAR AS s, o_orderpriority AS p FROM orders)
    SELECT o_orderkey, '\textbf{b ' || '\texttt{x*y*\_' || s || '}} 5\% \textit{$a*b*c_' || s || '$} \href{u' || s || '}{\texttt{l[1](2)}} \cmd[o]{*k*}{_} $$m*n*$$ costs $5 and \textit{' || p || '}' AS latex,
           '<strong>b <code>x*y*_' || s || '</code></strong> 5% <em>$a*b*c_' || s || '$</em> <a href="u' || s || '"><code>l[1](2)</code></a> \cmd[o]{<em>k</em>}{_} $$m*n*$$ costs $5 and <em>' || p || '</em>' AS html FROM k""")
def inline_shields(t: Tables) -> DataFrame:
    """Marks around code and formulas, and none inside; commands are written out in LaTeX only."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("**b `x*y*_"), key, F.lit("`** 5% *$a*b*c_"), key, F.lit("$* [`l[1](2)`](u"), key, F.lit(") \\cmd[o]{*k*}{_} $$m*n*$$ costs $5 and *"), F.col("o_orderpriority"), F.lit("*"))
    return t.orders.select("o_orderkey", markup.inline_latex(text).alias("latex"), markup.inline_html(text).alias("html"))


@catalog.query("""
    SELECT o_orderkey, printf('%X', 128512 + o_orderkey % 60) || ' ' || chr(128512 + (o_orderkey % 60)::INT) || ' -,' || printf('%X', 945 + o_orderkey % 24) || ' ' || chr(945 + (o_orderkey % 24)::INT) || ' F' || repeat('o', (o_orderkey % 90)::INT) || ';' AS glyphs FROM orders""")
def missing_glyphs(t: Tables) -> DataFrame:
    """Characters that a font lacks, from logs that are broken every 79 bytes, be it within a character."""
    char = lambda base, n: F.decode(F.unhex(F.lpad(F.hex(base + F.col("o_orderkey") % n), 8, "0")), "UTF-32")
    code = lambda base, n: F.hex(base + F.col("o_orderkey") % n)
    entry = lambda c, u, rest: F.concat(F.lit("Missing character: There is no "), c, F.lit(" (U+"), u, F.lit(")"), rest)
    font = F.concat(F.lit(' in font "F'), F.repeat(F.lit("o"), (F.col("o_orderkey") % 90).cast("int")), F.lit(';"!'))
    greek, face = entry(char(945, 24), code(945, 24), font), entry(char(128512, 60), F.lower(code(128512, 60)), F.lit("!"))
    wrap = lambda x: F.regexp_replace(F.decode(F.encode(x, "UTF-8"), "ISO-8859-1"), "(.{79})", "$1\n")
    log = F.encode(F.concat_ws("\n", F.lit("This is a log"), wrap(greek), wrap(face), F.lit("short line"), wrap(entry(char(945, 24), code(945, 24), F.lit(" in font other!")))), "ISO-8859-1")
    line = lambda g: F.concat_ws(" ", g["code"], g["char"], F.coalesce(g["font"], F.lit("-")))
    return t.orders.select("o_orderkey", F.array_join(F.transform(markup.missing_glyphs(log), line), ",").alias("glyphs"))


#: A log for each message and anchor; {} is a number of the row.
_LOGS = (
    ("! Undefined control sequence.\nl.{} \\macro{} x", "undefined_control_sequence"), ("\n! Undefined control sequence.\nl.{} \\foo", "syntax_error"), ("x\n! Package babel{} Error: y", "package_error"), ("see ! Package babel{} Error: y", "syntax_error"),
    ("LaTeX: Environment box{} undefined.", "undefined_environment"), ("\\begin{a{}} on line 3 ended by \\end{b}", "environment_mismatch"), ("\\begin{a{}} on line 3\nended by \\end{b}", "unknown"), ("! LaTeX FILE `a{}.sty' NOT FOUND", "missing_file"), ("I Cannot Find File {}", "missing_file"),
    ("! Missing $ inserted {}", "math_mode_error"), ("! Extra }, or forgotten $ {}", "math_mode_error"), ("Bad math environment in DISPLAY MATH {}", "math_mode_error"), ("not allowed in Math Mode {}", "math_mode_error"), ("Warning: Citation `k{}' on page 1 undefined", "bibliography_error"),
    ("I found no \\bibdata command {}", "bibliography_error"), ("I found no \\citation commands {}", "bibliography_error"), ("Emergency stop {}", "syntax_error"), ("Fatal error {}", "syntax_error"), ("ok {}\n! odd", "syntax_error"), ("an Error {}", "syntax_error"), ("run TIMED OUT {}", "timeout"), ("citation {} undefined, error", "unknown"),
)


@catalog.query(f"""
    SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN NULL ELSE ([{", ".join(f"'{c}'" for _, c in _LOGS)}])[event_id % {len(_LOGS)} + 1] END AS category,
           CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN NULL ELSE CASE event_id % {len(_LOGS)} WHEN 0 THEN '\\macro' WHEN 2 THEN 'babel' || event_id WHEN 4 THEN 'box' || event_id WHEN 5 THEN 'a' || event_id WHEN 7 THEN 'a' || event_id || '.sty' WHEN 13 THEN 'k' || event_id END END AS token FROM events""")
def compiler_messages(t: Tables) -> DataFrame:
    """Logs with every message that is known, at the places and in the cases where it counts and where it does not."""
    number = F.col("event_id").cast("string")
    log = F.replace(F.get(F.array(*(F.lit(log) for log, _ in _LOGS)), (F.col("event_id") % len(_LOGS)).cast("int")), F.lit("{}"), number)
    log = F.when((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0), " \n").otherwise(log)
    found = t.events.select("event_id", markup.compiler_message(log).alias("m"))
    return found.select("event_id", "m.category", "m.token")


@catalog.query("""
    SELECT conv_id, max(CASE WHEN turn % 5 = 1 THEN 1 ELSE 0 END) AS engine FROM conversations GROUP BY conv_id""")
def document_engine(t: Tables) -> DataFrame:
    """The engine a document needs: the most demanding of its blocks."""
    text = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("\\setmainfont{X} "), F.col("text"))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", markup.engine(text).alias("engine")).groupBy("conv_id").agg(F.max("engine").alias("engine"))


@catalog.query("""
    SELECT conv_id, turn, CASE WHEN contains(lower(text), ' der ') THEN 'german' WHEN contains(lower(text), 'the') THEN 'english' END AS intent FROM conversations""")
def routed_questions(t: Tables) -> DataFrame:
    """A phrase with spaces scores 2, so it outranks one word of a higher priority."""
    route = markup.routed(F.col("text"), [("english", 9, ["the"]), ("german", 1, [" der "])])
    return t.conversations.select("conv_id", "turn", route["intent"].alias("intent"))


@catalog.query("""
    SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM conversations WHERE turn < 2)""")
def cache_misses(t: Tables) -> DataFrame:
    """Blocks whose hash the validation cache does not hold."""
    from ..operators.maintain import missed

    hashed = typed_blocks(t).select("conv_id", "turn", blocks.content_hash(F.col("kind"), F.col("content")).alias("hash"), F.lit(1).alias("rule_version"))
    return missed(hashed, hashed.where(F.col("turn") < 2), ["conv_id", "turn", "hash", "rule_version"]).select("conv_id", "turn")


@catalog.query("""
    SELECT conv_id, turn, 'role' AS "column", role AS old, 'human' AS new FROM conversations WHERE role = 'user'""")
def correction_log(t: Tables) -> DataFrame:
    from ..operators.maintain import corrections

    rows = t.conversations.select(F.struct("conv_id", "turn").alias("k"), "role", "text")
    edited = rows.withColumn("role", F.when(F.col("role") == "user", "human").otherwise(F.col("role")))
    return corrections(rows, edited, "k", ["role", "text"]).select("k.conv_id", "k.turn", "column", "old", "new")


@catalog.query("""
    SELECT s_suppkey, lpad((s_nationkey % 3)::VARCHAR, 4, '0') || '.' || lpad((s_suppkey % 50)::VARCHAR, 4, '0') AS path FROM supplier""")
def materialised_paths(t: Tables) -> DataFrame:
    from ..operators.maintain import with_paths

    parents = t.nation.select((F.col("n_nationkey") % 3).alias("id"), F.lpad((F.col("n_nationkey") % 3).cast("string"), 4, "0").alias("path")).distinct()
    children = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 3).alias("parent_id"), (F.col("s_suppkey") % 50).alias("position"))
    return with_paths(parents, children, "parent_id", "id", "position").select("s_suppkey", "path")


@catalog.query("""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'full' WHEN 1 THEN CASE WHEN n > 0 THEN 'partial' ELSE 'none' END ELSE CASE WHEN n > 0 THEN 'partial' ELSE 'none' END END AS level
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def promoted_levels(t: Tables) -> DataFrame:
    """Levels rise to what was seen and never fall."""
    from ..operators.maintain import promoted

    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "full").otherwise("none").alias("level"))
    seen = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"), F.lit("partial").alias("level"))
    return promoted(rows, seen, "c_custkey", "level", ["none", "partial", "full"])


@catalog.query("""
    SELECT o_custkey, count(*) AS n_live FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY GROUP BY 1""")
def retention_live(t: Tables) -> DataFrame:
    from ..operators.maintain import expired

    newest = t.orders.agg(F.max("o_orderdate")).first()[0]
    return expired(t.orders.select("o_custkey", "o_orderdate"), "o_orderdate", newest, 365)[1].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_live"))


@catalog.query("""
    SELECT count(*) AS affected FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000""")
def bulk_approved(t: Tables) -> DataFrame:
    from ..operators.maintain import bulk_status

    return bulk_status(t.orders, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000), "o_orderstatus", "F")[1]


@catalog.query("""
    SELECT CASE p_size % 5 WHEN 2 THEN 'E_shimmed_trusted' WHEN 0 THEN CASE WHEN p_type = 'PROMO' THEN 'A_truthful' ELSE 'B_lying_full' END WHEN 1 THEN CASE WHEN p_type = 'PROMO' THEN 'A_truthful' ELSE 'B_lying_partial' END
           ELSE CASE WHEN p_type = 'PROMO' THEN 'C_underclaimed' ELSE 'D_honest_unsupported' END END AS bucket, count(*) AS n FROM part GROUP BY 1""")
def coverage_audit(t: Tables) -> DataFrame:
    """Catalog claims against what is handled: here, promo parts."""
    from .relational_queries import level

    return t.part.groupBy(findings.coverage_claim(level(), F.col("p_type") == "PROMO").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@catalog.query("""
    WITH b AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 AS i, row_number() OVER w AS n, lead(o_orderkey % 7) OVER w AS next, count(*) FILTER (o_orderkey % 7 < 2) OVER (PARTITION BY o_custkey) AS heads FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    h AS (SELECT b.*, (SELECT arg_max(x.i, x.o_orderkey) FROM b x WHERE x.o_custkey = b.o_custkey AND x.o_orderkey < b.o_orderkey AND x.i < 2) AS last FROM b)
    SELECT o_custkey, o_orderkey, unnest(list_filter([CASE WHEN i = 3 AND n <= 3 THEN 'info:personal_data' END, CASE WHEN i = 2 AND next IN (2, 3, 6) THEN 'info:paragraph_as_heading' END, CASE WHEN i = 4 AND heads = 0 THEN 'warning:empty_contents' END,
        CASE WHEN i = 1 AND last = 0 THEN 'warning:skipped_level' END, CASE WHEN i = 5 THEN 'info:list_of_one' END], lambda x: x IS NOT NULL)) AS finding FROM h""")
def structure_findings(t: Tables) -> DataFrame:
    """Every rule on a block's place, over blocks that orders stand for."""
    kinds = ("heading", "heading", "paragraph", "paragraph", "tableOfContents", "list", "paragraph")
    contents = ('{"text":"One","level":1}', '{"text":"Four","level":4}', '{"text":"Short Title"}', '{"text":"mail a@b.de now."}', "{}", '{"items":["x"]}', '{"text":"plain text that ends."}')
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % 7).cast("int"))
    found = findings.structure(t.orders.select("o_custkey", "o_orderkey", pick(kinds).alias("kind"), pick(contents).alias("content")), "o_custkey", "o_orderkey", "kind", "content")
    return found.select("o_custkey", "o_orderkey", F.concat_ws(":", "level", "rule").alias("finding"))


@catalog.query(f"""
    SELECT conv_id, turn, 'info' AS level, 'personal_data' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    WHERE n <= 3 AND regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}|linkedin\\.com/|github\\.com/')""")
def personal_data_findings(t: Tables) -> DataFrame:
    found = findings.structure(typed_blocks(t), "conv_id", "turn", "kind", "content")
    return found.where(F.col("rule") == "personal_data")


@catalog.query("""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'error' WHEN 3 THEN 'info' ELSE 'warning' END AS level, CASE s_suppkey % 4 WHEN 0 THEN 'broken_json' WHEN 1 THEN 'figure_without_alt' WHEN 2 THEN 'table_without_headers' ELSE 'empty' END AS rule FROM supplier""")
def accessibility_findings(t: Tables) -> DataFrame:
    """One block a supplier, each with one fault."""
    n = F.col("s_suppkey") % 4
    kind = F.when(n == 1, "image").when(n == 2, "table").otherwise("paragraph")
    content = F.when(n == 0, "{broken").when(n == 1, '{"src":"a","caption":"c"}').when(n == 2, '{"headers":[],"rows":[]}').otherwise('{"text":"  "}')
    return findings.accessibility(t.supplier.select("s_suppkey", kind.alias("kind"), content.alias("content")), ["s_suppkey"], "kind", "content")
