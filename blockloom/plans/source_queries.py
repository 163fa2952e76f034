"""Files and archives made from tables, read back by the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import detection
from ..sources import archives
from ..sources import tables as sources
from ..sources.tables import Tables
from ..streaming import events as stream
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL


def _text(*parts: str | Column) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@catalog.query("SELECT item_id, text || chr(10) AS text FROM benchmark")
def whole_files(t: Tables) -> DataFrame:
    """A file for each text, read whole."""
    path = sources.scratch_folder(t.spark, "texts")
    t.benchmark.select("item_id", "text").write.partitionBy("item_id").text(path)
    found = sources.whole_texts(t.spark, path, "*.txt")
    return found.select(F.regexp_extract("path", r"item_id=([0-9]+)", 1).cast("long").alias("item_id"), "text")


def office_documents(t: Tables) -> DataFrame:
    """path, content: an office document for each conversation, a paragraph for each turn."""
    style = F.when(F.col("turn") % 4 == 0, '<w:pStyle w:val="Heading2"/>').when(F.col("turn") % 4 == 3, '<w:pStyle w:val="IntenseQuote"/>').otherwise("")
    numbered = F.when(F.col("turn") % 4 == 1, '<w:numPr><w:ilvl w:val="0"/></w:numPr>').otherwise("")
    half = F.floor(F.length("text") / 2).cast("int")
    runs = _text("<w:r><w:rPr><w:b/></w:rPr><w:t xml:space=\"preserve\">", _escaped(F.substring("text", F.lit(1), half)), "</w:t></w:r><w:r><w:t>", _escaped(F.substring("text", half + 1, F.length("text"))), "</w:t></w:r>")
    paragraph = _text("<w:p><w:pPr>", style, numbered, "</w:pPr>", runs, "</w:p>")
    body = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", paragraph.alias("p")))), lambda x: x["p"]), "").alias("xml"))
    parts = F.array(F.struct(F.lit("word/document.xml").alias("member"), _text("<w:document><w:body>", F.col("xml"), "</w:body></w:document>").alias("data")), F.struct(F.lit("__MACOSX/word/document.xml").alias("member"), F.lit("junk").alias("data")))
    return archives.packed(body.select(F.col("conv_id").alias("path"), F.inline(parts)))


@catalog.query("""
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE turn % 4 WHEN 0 THEN 'Heading2' WHEN 3 THEN 'IntenseQuote' END AS style, TRUE AS bold, turn % 4 = 1 AS numbered, text FROM conversations""")
def office_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs of zipped office documents, with their styles, numbers and runs."""
    return archives.docx_paragraphs(office_documents(t)).withColumnRenamed("path", "conv_id").withColumn("conv_id", F.col("conv_id").cast("long"))


@catalog.query("""
    SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'heading.style' WHEN 1 THEN 'list' ELSE 'blockquote.style' END AS rule, count(*) AS n FROM conversations WHERE turn % 4 <> 2 GROUP BY 1, 2""")
def office_rules(t: Tables) -> DataFrame:
    """What the rules make of the paragraphs that a style or a number tells."""
    rows = archives.docx_paragraphs(office_documents(t)).drop("bold")
    found = detection.detect(rows, "path", "pos", disabled=["heading.custom", "heading.numbered", "heading.formatting", "list.manual-bullet", "theorem.content"])
    found = found.where(F.col("rule") != "paragraph")
    return found.groupBy(F.col("path").cast("long").alias("conv_id"), "rule").agg(F.count(F.lit(1)).alias("n"))


@catalog.query(r"""
    SELECT c_custkey, '\documentclass{article}' || chr(10) || 'A ' || c_name || chr(10) || 'B ' || c_mktsegment || ' C ' || c_custkey || ' end' || chr(10) AS text FROM customer""")
def project_texts(t: Tables) -> DataFrame:
    """LaTeX projects in archives: the main file with what it includes, two levels deep; a missing file is empty, tools' files do not count."""
    key = F.col("c_custkey").cast("string")
    files = {
        "main.tex": _text("\\documentclass{article}\nA ", F.col("c_name"), "\n\\input{parts/b}\\include{parts/none}\n"), "parts/b.tex": _text("B ", F.col("c_mktsegment"), " \\input{./parts/c.tex} end"), "parts/c.tex": _text("C ", key),
        "old/draft.tex": F.lit("\\documentclass{article} old"), ".git/main.tex": F.lit("\\documentclass{article} no"), "refs.bib": F.lit("@book{x}"), "notes.txt~": F.lit("no"),
    }
    parts = t.customer.select(key.alias("path"), F.inline(F.array(*(F.struct(F.lit(name).alias("member"), data.alias("data")) for name, data in files.items()))))
    path = sources.scratch_folder(t.spark, "projects")
    archives.members(archives.packed(parts)).write.parquet(path)  # read once for every level of inputs
    found = archives.with_inputs(t.spark.read.parquet(path))
    return found.select(F.col("path").cast("long").alias("c_custkey"), "text")


@catalog.query("""
    SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS pos, 'OEBPS/c' || o_orderkey || '.xhtml' AS member, CASE WHEN o_orderkey % 3 > 0 THEN 'Order ' || o_orderkey END AS title,
           CASE WHEN o_orderkey % 3 > 0 THEN 'Order ' || o_orderkey || ' ' ELSE '' END || o_orderpriority || ' & more' AS text FROM orders""")
def book_chapters(t: Tables) -> DataFrame:
    """Chapters of e-books in the order of the spine, which is not the order of the files; a third has no title."""
    key = F.col("o_orderkey").cast("string")
    head = F.when(F.col("o_orderkey") % 3 > 0, _text("<h1>Order ", key, "</h1>")).otherwise("")
    chapters = t.orders.select("o_custkey", "o_orderkey", _text("OEBPS/c", key, ".xhtml").alias("member"), _text("<html><body>", head, "<p>", _escaped(F.col("o_orderpriority")), " &amp; more</p></body></html>").alias("data"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("o_orderkey")).alias("o"), key.alias("k"))))
    join = lambda form: F.array_join(F.transform(items, form), "")
    manifest = join(lambda x: _text('<item id="i', x["k"], '" href="c', x["k"], '.xhtml"/>'))
    spine = join(lambda x: _text('<itemref idref="i', x["k"], '"/>'))
    package = t.orders.groupBy("o_custkey").agg(_text("<package><manifest>", manifest, "</manifest><spine>", spine, "</spine></package>").alias("data")).select("o_custkey", F.lit("OEBPS/content.opf").alias("member"), "data")
    books = archives.packed(chapters.select("o_custkey", "member", "data").unionByName(package).withColumnRenamed("o_custkey", "path"))
    found = archives.epub_chapters(books)
    return found.select(F.col("path").cast("long").alias("o_custkey"), "pos", "member", "title", "text")


@catalog.query("""
    SELECT name, kind, package_slug, count(*) AS n FROM (SELECT trim(event_type) AS name, CASE user_id % 4 WHEN 0 THEN 'command' WHEN 1 THEN 'length' WHEN 2 THEN 'other' END AS kind, nullif(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'amsmath' END, '') AS package_slug,
          event_id % 5 AS s FROM events) WHERE kind IN ('command', 'length') AND s < 4 AND name <> 'view' GROUP BY ALL""")
def cleaned_events(t: Tables) -> DataFrame:
    """Captured events with trimmed names; unknown kinds and sources, and empty names, are dropped."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col(n) % len(values)).cast("int"))
    name = F.when(F.col("event_type") == "view", " ").otherwise(_text("  ", F.col("event_type"), " "))
    rows = t.events.select(name.alias("name"), pick(("command", "length", "other", None), "user_id").alias("kind"), pick((" ", " amsmath", None), "event_id").alias("package_slug"), pick(("panel", "palette", "slash", "package-modal", "elsewhere"), "event_id").alias("source"))
    return stream.cleaned(rows).groupBy("name", "kind", "package_slug").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 70")
def oversized_calls(t: Tables) -> DataFrame:
    """Users whose events of one call are too many to take."""
    return stream.oversized(t.events, "user_id", 70)
