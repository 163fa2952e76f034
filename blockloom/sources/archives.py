"""Zipped sources: LaTeX projects, office documents, e-books. Members become rows; what they hold is read by column functions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import visible_text
from ..operators.relational import first_per_key
from .tables import scratch_folder

#: Members that come from tools rather than authors.
JUNK = r"(^|/)(__MACOSX|\.git|\.DS_Store|Thumbs\.db)(/|$)|/$|~$"
MOST_BYTES = 5 << 20
#: Members that a batch holds at most.
BATCH_ROWS = 5_000


def archives(spark: SparkSession, path: str, suffix: str = "*.zip") -> DataFrame:
    """path, content: a row per archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def members(packed: DataFrame, most_bytes: int = MOST_BYTES, junk: str = JUNK) -> DataFrame:
    """path, member, size, data: a row per member; those over most_bytes have no data, and broken archives no members."""

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except (zipfile.BadZipFile, TypeError):
                    continue
                for i in archive.infolist():
                    data = archive.read(i) if i.file_size <= most_bytes and not i.is_dir() else None
                    rows.append({"path": path, "member": i.filename, "size": i.file_size, "data": data})
                    held += len(data or b"")
                    if len(rows) >= BATCH_ROWS or held >= most_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("data", pa.binary())])
    found = packed.select("path", "content").mapInArrow(unzip, "path string, member string, size long, data binary")
    return found.where(~F.col("member").rlike(junk))


def packed(parts: DataFrame, path: str = "path", member: str = "member", data: str = "data") -> DataFrame:
    """path, content: an archive for each path, of its members (text or binary) in order of names; the reverse of members(). Equal parts make equal bytes.

    An archive is a value of one row, so its members meet in one task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    for part in batch.column(1)[row].as_py():
                        archive.writestr(zipfile.ZipInfo(part["member"], (1980, 1, 1, 0, 0, 0)), part["data"], zipfile.ZIP_DEFLATED)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    rows = parts.select(F.col(path).cast("string").alias("path"), F.col(member).alias("member"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))
    listed = rows.where("path IS NOT NULL AND member IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("member", "data"))).alias("parts"))
    return listed.mapInArrow(pack, "path string, content binary")


def as_text(data: str = "data") -> Column:
    return F.decode(data, "UTF-8")


def kind_of(member: str = "member") -> Column:
    """What a project's file is, by its extension."""
    extension = F.lower(F.regexp_extract(member, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(extension.isin("tex", "ltx"), "latex").when(extension == "bib", "bibliography").when(extension.isin("cls", "sty", "bst"), "style")
        .when(extension.isin("png", "jpg", "jpeg", "pdf", "eps", "svg"), "figure").otherwise("other")
    )


def main_files(project: DataFrame) -> DataFrame:
    """path, member: the LaTeX file to start from: with a document class, best named main, nearest the root, first by name."""
    latex = project.where((kind_of() == "latex") & F.coalesce(as_text().rlike(r"\\documentclass"), F.lit(False)))
    depth = F.size(F.split("member", "/"))
    return first_per_key(latex, ["path"], (~F.lower("member").rlike(r"(^|/)main\.tex$")).cast("int"), depth, F.col("member")).select("path", "member")


def with_inputs(project: DataFrame, depth: int = 10) -> DataFrame:
    """path, text: main files with their \\input and \\include files in place, nested up to depth levels; missing ones are empty."""
    files = project.where(kind_of() == "latex").select("path", F.regexp_replace("member", r"\.tex$", "").alias("name"), as_text().alias("inner"))
    texts = main_files(project).join(project, ["path", "member"]).select("path", as_text().alias("text"))
    call = r"\\(?:input|include)\{([^}]+)\}"
    for _ in range(depth):
        pieces = texts.withColumn("calls", F.regexp_extract_all("text", F.lit(call), F.lit(1))).withColumn("parts", F.split("text", call, -1))
        if not pieces.where(F.size("calls") > 0).limit(1).count():
            break
        each = pieces.select("path", F.posexplode("parts").alias("i", "part"), "calls").withColumn("name", F.regexp_replace(F.get("calls", F.col("i")), r"^\./|\.tex$", ""))
        filled = each.join(files, ["path", "name"], "left").withColumn("s", F.concat("part", F.coalesce("inner", F.lit(""))))
        texts = filled.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "").alias("text"))
    return texts


def _xml_text(x: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def docx_paragraphs(packed: DataFrame) -> DataFrame:
    """path, pos, style, bold, numbered, text: the paragraphs of office documents, in order."""
    body = members(packed).where(F.col("member") == "word/document.xml").select("path", as_text().alias("xml"))
    rows = body.select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0))).alias("pos", "p"))
    runs = F.transform(F.regexp_extract_all("p", F.lit(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>"), F.lit(1)), _xml_text)
    return rows.select(
        "path", "pos", F.nullif(F.regexp_extract("p", r'<w:pStyle w:val="([^"]*)"', 1), F.lit("")).alias("style"), F.col("p").rlike(r"<w:b/>|<w:b w:val=\"(1|true)\"").alias("bold"),
        F.contains("p", F.lit("<w:numPr>")).alias("numbered"), F.array_join(runs, "").alias("text"),
    )


def docx_kind(df_text: Column, style: Column, bold: Column, numbered: Column) -> Column:
    """Kind of a paragraph by rules in priority bands: styles, then numbering, then looks."""
    from ..functions.columns import heading_level
    from ..functions.markup import first_rule

    upper = (df_text == F.upper(df_text)) & df_text.rlike("[A-Z]{3}")
    rules = [
        (0, F.trim(df_text) == "", "blank"), (10, F.lower(style).rlike("^heading ?[1-6]$|^title$"), "heading"), (20, F.lower(style).rlike("quote"), "blockquote"), (30, F.lower(style).rlike("code|verbatim"), "code"),
        (40, F.lower(style).rlike("caption"), "caption"), (100, numbered, "list"), (200, heading_level(df_text).isNotNull(), "heading"), (300, bold & (F.length(df_text) <= 80), "heading"), (310, upper & (F.length(df_text) <= 80), "heading"),
    ]
    return first_rule(rules, "paragraph")


def epub_chapters(packed: DataFrame) -> DataFrame:
    """path, pos, member, title, text: the content documents of e-books in reading order. The archives are unzipped once, into a table that the joins read."""
    unzipped = scratch_folder(packed.sparkSession, "members")
    members(packed).write.parquet(unzipped)
    inside = packed.sparkSession.read.parquet(unzipped)
    package = inside.where(F.col("member").endswith(".opf")).select("path", as_text().alias("opf"), F.regexp_replace("member", "[^/]*$", "").alias("base"))
    spine = package.select("path", "opf", "base", F.posexplode(F.regexp_extract_all("opf", F.lit(r'<itemref[^>]*idref="([^"]+)"'), F.lit(1))).alias("pos", "id"))
    items = package.select("path", F.explode(F.regexp_extract_all("opf", F.lit(r"<item\s[^>]*>"), F.lit(0))).alias("item"))
    items = items.select("path", F.regexp_extract("item", r'\bid="([^"]+)"', 1).alias("id"), F.regexp_extract("item", r'\bhref="([^"]+)"', 1).alias("href"))
    placed = spine.join(items, ["path", "id"]).select("path", "pos", F.concat("base", "href").alias("member"))
    html = as_text()
    return placed.join(inside, ["path", "member"]).select("path", "pos", "member", F.nullif(visible_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit("")).alias("title"), visible_text(html).alias("text"))


def epub_issues(packed: DataFrame) -> DataFrame:
    """path, issue: what a reader would miss: metadata, order, titles, texts for images."""
    inside = members(packed)
    opf = inside.where(F.col("member").endswith(".opf")).select("path", as_text().alias("opf"))
    checks = [("no_title", ~F.col("opf").rlike("<dc:title[^>]*>[^<]")), ("no_language", ~F.col("opf").rlike("<dc:language[^>]*>[^<]")), ("no_author", ~F.col("opf").rlike("<dc:creator[^>]*>[^<]")), ("no_spine", ~F.contains("opf", F.lit("<itemref")))]
    of_package = opf.select("path", F.explode(F.filter(F.array(*(F.when(test, name) for name, test in checks)), lambda x: x.isNotNull())).alias("issue"))
    pages = inside.where(F.col("member").rlike(r"\.x?html?$")).select("path", as_text().alias("html"))
    of_pages = pages.where(F.col("html").rlike(r"(?i)<img(?![^>]*\balt=)[^>]*>")).select("path", F.lit("image_without_text").alias("issue"))
    untitled = epub_chapters(packed).where(F.col("title").isNull()).select("path", F.lit("chapter_without_title").alias("issue"))
    return of_package.union(of_pages).union(untitled).distinct()
