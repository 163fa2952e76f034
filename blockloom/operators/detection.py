"""What the paragraphs of office documents are, by rules in order of priority.

A rule is a condition and what it makes of a paragraph, both Columns. detect() compiles rules to one expression: the first
rule that makes something wins, one that makes null lets the next try, and one that makes an empty list consumes the paragraph.
A trace tells which rule won and which had let it pass. Rules may look at the section that a paragraph stands in; headings above
set it, and since no rule that sets it looks at it, one window between two evaluations takes the place of a walk with state.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import heading_level

#: Columns of a paragraph and their types; what a frame lacks is null.
PARAGRAPH = {
    "text": "string", "style": "string", "style_name": "string", "font": "string", "bold": "boolean", "italic": "boolean", "numbered": "boolean", "math": "boolean", "drawing": "boolean", "page_break": "boolean",
    "shading": "string", "outline": "int", "indent": "int", "border": "boolean",
}
ELEMENTS = "array<struct<kind:string,text:string,level:int>>"
#: Names that styles and fonts contain or are (fixed values).
MONOSPACE = ("Consolas", "Courier New", "Courier", "Monaco", "Menlo", "Lucida Console", "Liberation Mono", "DejaVu Sans Mono", "Source Code Pro", "Fira Code", "JetBrains Mono", "Cascadia Code")
STYLES = {
    "code": ("Code", "Preformatted", "SourceCode", "Listing", "Verbatim"), "abstract": ("Abstract", "Summary", "Résumé", "Zusammenfassung"), "quote": ("Quote", "IntenseQuote", "Blockquote", "Quotation"),
    "theorem": ("Theorem", "Lemma", "Proposition", "Corollary", "Definition", "Proof", "Example", "Remark", "Conjecture"),
}
#: Titles of sections by what they are (fixed values).
SECTIONS = {
    "abstract": ("abstract", "summary", "executive summary", "résumé", "zusammenfassung", "resumen", "sommario", "kurzfassung"),
    "references": ("references", "bibliography", "works cited", "literature cited", "références", "bibliographie", "literaturverzeichnis", "literatur", "referencias", "bibliografía", "riferimenti"),
    "introduction": ("introduction", "einleitung", "einführung", "introducción", "introduzione"),
    "methods": ("methods", "methodology", "materials and methods", "méthodes", "méthodologie", "methoden", "methodik", "métodos", "metodología"),
    "results": ("results", "findings", "résultats", "ergebnisse", "resultados"),
    "conclusion": ("conclusion", "conclusions", "fazit", "schlussfolgerung", "conclusión", "conclusiones"),
    "acknowledgments": ("acknowledgments", "acknowledgements", "remerciements", "danksagung", "agradecimientos"),
}
BODY = "body"


def section_of(heading: Column) -> Column:
    """The kind of section that a heading opens, by its title without number, case and end punctuation; body for others."""
    title = F.regexp_replace(F.lower(F.trim(heading)), r"^(?:[0-9]+(?:\.[0-9]+)*|[ivxlc]+)[.)]?\s+", "")
    known = F.create_map(*(F.lit(x) for kind, titles in SECTIONS.items() for title in titles for x in (title, kind)))
    return F.coalesce(F.try_element_at(known, F.regexp_replace(title, r"[\s:.]+$", "")), F.lit(BODY))


# Conditions: Columns, joined by &, | and ~. A null counts as false.


def holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def style_is(*names: str) -> Column:
    return holds(F.lower("style").isin(*(n.lower() for n in names)))


def style_has(names: Iterable[str]) -> Column:
    return holds(F.lower("style").rlike("|".join(n.lower() for n in names)))


def font_is(names: Iterable[str]) -> Column:
    return holds(F.lower("font").isin(*(n.lower() for n in names)))


def shaded() -> Column:
    return holds((F.col("shading") != "") & ~F.lower("shading").isin("auto", "ffffff"))


def text_is(pattern: str) -> Column:
    return holds(F.col("text").rlike(pattern))


def flag(name: str) -> Column:
    return holds(F.col(name))


def in_section(*names: str) -> Column:
    return holds(F.col("section").isin(*names))


def always() -> Column:
    return F.lit(True)


# What rules make.


def made(kind: str, text: Column | str = "text", level: Column | int | None = None) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    level = level if isinstance(level, Column) else F.lit(level)
    return F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text"), level.cast("int").alias("level"))).cast(ELEMENTS)


def consumed() -> Column:
    return F.array().cast(ELEMENTS)


def if_text(elements: Column) -> Column:
    return F.when(text_is(r"\S"), elements)


@dataclass(frozen=True)
class Rule:
    """when: the condition; makes: ELEMENTS, null to let the next rule try. section: the kind of section that it opens, if any;
    ends_abstract: whether an abstract ends here; looks_back: whether when or makes read the column section.
    """

    id: str
    priority: int
    when: Column
    makes: Column
    section: Column | None = None
    ends_abstract: bool = False
    looks_back: bool = False


def default_rules() -> list[Rule]:
    """Page breaks below 100, headings below 300, lists, equations, sections from 500, meanings from 600, code from 700, images, and paragraphs last."""
    style_level = F.regexp_extract(F.lower(F.coalesce("style_name", "style")), r"^(?:heading|überschrift|titre|título) ?([1-6])$", 1).try_cast("int")
    custom = F.lower(F.coalesce("style_name", "style"))
    number = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif(F.regexp_extract(F.coalesce("style", "style_name"), r"(\d+)\s*$", 1), F.lit("")).try_cast("int"), F.lit(1))))
    looks = F.when(text_is(r"^[IVXLC]{1,2}\.\s+\w"), 1).when(text_is(r"^[IVXLC]{3,}\.\s+\w"), 2).when((F.length("text") <= 50) & (F.col("text") == F.upper("text")) & text_is(r"\p{L}"), 1).when(flag("bold") & (F.length("text") <= 60) & text_is(r"\p{L}") & ~text_is(r"[.;,:]\s*$"), 2)
    is_abstract = section_of(F.col("text")) == "abstract"
    opens = section_of(F.col("text"))
    heading = lambda level: if_text(F.when(is_abstract, consumed()).otherwise(made("heading", level=level)))
    theorem = r"(?is)^(theorem|lemma|proposition|corollary|definition|proof|example|remark|conjecture)\b\s*(?:[0-9]+(?:\.[0-9]+)*)?\s*(?:\(([^)]*)\))?\s*[.:]\s*(.+)$"
    entry = text_is(r"^\s*\[\d+\]") | text_is(r"^\s*\d+\.\s") | text_is(r"^\s*[A-Z][a-z]+.*(?:\(\d{4}\)|,\s*\d{4})") | (holds(F.col("indent") >= 360) & (F.length(F.trim("text")) > 20))
    break_ = F.concat(made("pageBreak", F.lit(None).cast("string")), F.when(text_is(r"\S"), made("paragraph")).otherwise(consumed()))
    return [
        Rule("pagebreak", 10, flag("page_break"), break_),
        Rule("heading.style", 100, style_level.isNotNull(), heading(style_level), opens),
        Rule("abstract.title-style", 105, style_is("Title", "Subtitle") & is_abstract, consumed(), F.lit("abstract")),
        Rule("title-subtitle.other", 106, style_is("Title", "Subtitle"), if_text(made("title")), ends_abstract=True),
        Rule("heading.custom", 110, holds(custom.rlike("title|section|chapter|heading")), if_text(made("heading", level=number)), opens),
        Rule("heading.outline", 120, holds(F.col("outline").between(1, 6)), if_text(made("heading", level=F.col("outline"))), opens),
        Rule("heading.numbered", 125, heading_level(F.col("text")).isNotNull(), made("heading", F.trim("text"), heading_level(F.col("text"))), opens),
        Rule("heading.formatting", 130, ~flag("numbered") & ~flag("math") & holds(F.length("text") <= 200), F.when(looks.isNotNull(), made("heading", level=looks)), opens),
        Rule("list", 300, flag("numbered"), made("listItem"), ends_abstract=True),
        Rule("list.manual-bullet", 320, text_is(r"^\s*[•◦▪●‣–·*-]\s+\S"), made("listItem", F.regexp_replace("text", r"^\s*[•◦▪●‣–·*-]\s+", "")), ends_abstract=True),
        Rule("equation", 400, flag("math"), made("equation")),
        Rule("abstract.style", 500, style_has(STYLES["abstract"]), if_text(made("abstract"))),
        Rule("abstract.section", 510, in_section("abstract"), if_text(made("abstract")), looks_back=True),
        Rule("bibliography.section", 520, in_section("references") & entry, if_text(made("bibliographyEntry", F.regexp_replace(F.trim("text"), r"^\[\d+\]\s*", ""))), looks_back=True),
        Rule("theorem.style", 600, style_has(STYLES["theorem"]), if_text(made("theorem"))),
        Rule("theorem.content", 610, text_is(theorem), made("theorem", F.regexp_extract("text", theorem, 3))),
        Rule("blockquote.style", 620, style_has(STYLES["quote"]), if_text(made("blockquote"))),
        Rule("blockquote.indent", 630, holds(F.col("indent") >= 720) & ~flag("numbered") & flag("italic"), if_text(made("blockquote"))),
        Rule("blockquote.border", 640, flag("border") & ~flag("numbered"), if_text(made("blockquote"))),
        Rule("code.style", 700, style_has(STYLES["code"]), made("code")),
        Rule("code.font", 710, font_is(MONOSPACE), made("code")),
        Rule("code.shading", 720, shaded(), made("code")),
        Rule("image", 800, flag("drawing"), F.when(text_is(r"\S"), F.concat(made("figure", F.lit(None).cast("string")), made("paragraph"))).otherwise(made("figure", F.lit(None).cast("string")))),
        Rule("paragraph", 999, always(), F.when(text_is(r"\S"), made("paragraph")).otherwise(consumed())),
    ]


def _first(rules: list[Rule]) -> Column:
    """struct<id, priority, elements> of the first rule that makes something, else null."""
    results = [F.when(holds(r.when) & r.makes.isNotNull(), F.struct(F.lit(r.id).alias("id"), F.lit(r.priority).alias("priority"), r.makes.alias("elements"))) for r in rules]
    return F.coalesce(*results)


def detect(paragraphs: DataFrame, key: str, order: str, rules: list[Rule] | None = None, custom: Iterable[Rule] = (), disabled: Iterable[str] = ()) -> DataFrame:
    """key, order, section, rule, passed, elements, trace: a row per paragraph.

    rule: the id that won, or none; passed: ids whose condition held before it, but that made nothing; trace: the first 500 characters.
    Rules of equal priority keep their order, custom ones last. A rule that opens sections must come before all that look back.
    """
    off = set(disabled)
    chain = sorted((r for r in [*(default_rules() if rules is None else rules), *custom] if r.id not in off), key=lambda r: r.priority)
    early = chain[: next((k for k, r in enumerate(chain) if r.looks_back), len(chain))]
    if any(r.section is not None or r.ends_abstract for r in chain[len(early) :]):
        raise ValueError("rules that open or end sections must come before rules that look at them")
    rows = paragraphs.select(key, order, *(F.col(c).cast(t).alias(c) if c in paragraphs.columns else F.lit(None).cast(t).alias(c) for c, t in PARAGRAPH.items()))
    won = _first(early)["id"] if early else F.lit(None).cast("string")
    rows = rows.withColumn("_early", won)
    opened = [F.when(F.col("_early") == r.id, r.section) for r in early if r.section is not None]
    ended = F.col("_early").isin([r.id for r in early if r.ends_abstract])
    rows = rows.withColumns({"_opened": F.when(F.coalesce(*opened).isNotNull(), F.struct(order, F.coalesce(*opened).alias("name"))) if opened else F.lit(None).cast("struct<o:int,name:string>"), "_ended": F.when(ended, F.col(order))})
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last, end = F.last("_opened", ignorenulls=True).over(before), F.last("_ended", ignorenulls=True).over(before)
    rows = rows.withColumns({"_last": last, "_end": end})
    over = (F.col("_last")["name"] == "abstract") & holds(F.col("_end") > F.col("_last").getField(order if opened else "o"))
    rows = rows.withColumn("section", F.when(over | F.col("_last").isNull(), BODY).otherwise(F.col("_last")["name"]))
    rows = rows.withColumn("_won", _first(chain))
    place = {r.id: k for k, r in enumerate(chain)}
    rank = F.coalesce(F.create_map(*(F.lit(x) for item in place.items() for x in item))[F.col("_won")["id"]], F.lit(len(chain)))
    passed = F.array_compact(F.array(*(F.when(holds(r.when) & r.makes.isNull() & (F.lit(place[r.id]) < rank), F.lit(r.id)) for r in chain)))
    return rows.select(key, order, "section", F.coalesce(F.col("_won")["id"], F.lit("none")).alias("rule"), passed.alias("passed"), F.coalesce(F.col("_won")["elements"], consumed()).alias("elements"), F.left("text", F.lit(500)).alias("trace"))


def detected_elements(found: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, part, kind, text, level: the elements that rules made."""
    return found.select(key, order, F.posexplode("elements").alias("part", "e")).select(key, order, "part", "e.*")
