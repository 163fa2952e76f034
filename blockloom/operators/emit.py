"""Blocks and bibliographies to text: a rendering per block, joined per document in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import html_escaped, inline_html, inline_latex, latex_escaped
from .blocks import item_texts, text_of

#: Other names of block types (fixed values).
ALIASES = {"quote": "blockquote", "header": "heading", "divider": "pageBreak", "page_break": "pageBreak", "toc": "tableOfContents", "image": "figure"}
FORMATS = ("markdown", "html", "latex", "typst", "lml")


def canonical_type(kind: Column) -> Column:
    named = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(named[F.lower(kind)], kind)


def _level(content: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.get_json_object(content, "$.level").cast("int"), F.lit(1)), F.lit(1)), F.lit(6))


def block_to(form: str, kind: Column, content: Column) -> Column:
    """One block in a format of FORMATS; types without a form of their own are paragraphs."""
    kind, text, level = canonical_type(kind), text_of(content), _level(content)
    items = F.coalesce(item_texts(content), F.array().cast("array<string>"))
    ordered = F.coalesce(F.get_json_object(content, "$.ordered") == "true", F.lit(False))
    caption = F.coalesce(F.get_json_object(content, "$.caption"), F.lit(""))
    source = F.coalesce(F.get_json_object(content, "$.src"), F.lit(""))
    bullets = lambda mark, numbered, show: F.array_join(F.transform(items, lambda x, i: F.concat(F.when(ordered, numbered(i)).otherwise(F.lit(mark)), show(x))), "\n")
    same = lambda x: x
    number = lambda i: F.concat((i + 1).cast("string"), F.lit(". "))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    if form == "markdown":
        rules = {
            "heading": join(F.repeat(F.lit("#"), level), " ", text), "equation": join("$$\n", text, "\n$$"), "code": join("```", F.coalesce(F.get_json_object(content, "$.language"), F.lit("")), "\n", text, "\n```"),
            "list": bullets("- ", number, same), "blockquote": join("> ", F.regexp_replace(text, "\n", "\n> ")), "figure": join("![", caption, "](", source, ")"), "pageBreak": F.lit("---"),
        }
        other = text
    elif form == "html":
        name = join("h", level.cast("string"))
        tag = F.when(ordered, "ol").otherwise("ul")
        rules = {
            "heading": join("<", name, ">", inline_html(text), "</", name, ">"), "equation": join('<div class="equation">', html_escaped(text), "</div>"), "code": join("<pre><code>", html_escaped(text), "</code></pre>"),
            "list": join("<", tag, ">", F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), inline_html(x), F.lit("</li>"))), ""), "</", tag, ">"), "blockquote": join("<blockquote>", inline_html(text), "</blockquote>"),
            "figure": join('<figure><img src="', html_escaped(source), '" alt="', html_escaped(caption), '"><figcaption>', inline_html(caption), "</figcaption></figure>"), "pageBreak": F.lit("<hr>"),
        }
        other = join("<p>", inline_html(text), "</p>")
    elif form == "latex":
        commands = F.array(*map(F.lit, ("section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph")))
        env = F.when(ordered, "enumerate").otherwise("itemize")
        rules = {
            "heading": join("\\", F.get(commands, level - 1), "{", inline_latex(text), "}"), "equation": join("\\[\n", text, "\n\\]"), "code": join("\\begin{verbatim}\n", text, "\n\\end{verbatim}"),
            "list": join("\\begin{", env, "}\n", F.array_join(F.transform(items, lambda x: F.concat(F.lit("\\item "), inline_latex(x))), "\n"), "\n\\end{", env, "}"), "blockquote": join("\\begin{quote}\n", inline_latex(text), "\n\\end{quote}"),
            "figure": join("\\begin{figure}\n\\includegraphics{", source, "}\n\\caption{", inline_latex(caption), "}\n\\end{figure}"), "pageBreak": F.lit("\\newpage"), "tableOfContents": F.lit("\\tableofcontents"),
        }
        other = inline_latex(text)
    elif form == "typst":
        rules = {
            "heading": join(F.repeat(F.lit("="), level), " ", text), "equation": join("$ ", text, " $"), "code": join("```\n", text, "\n```"), "list": bullets("- ", lambda i: F.lit("+ "), same), "blockquote": join("#quote[", text, "]"),
            "figure": join('#figure(image("', source, '"), caption: [', caption, "])"), "pageBreak": F.lit("#pagebreak()"), "tableOfContents": F.lit("#outline()"),
        }
        other = text
    elif form == "lml":
        rules = {"heading": join("@heading[level=", level.cast("string"), "]\n  ", text), "list": join("@list[ordered=", ordered.cast("string"), "]\n", F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), x)), "\n")), "pageBreak": F.lit("@pagebreak")}
        other = join("@", F.lower(kind), "\n  ", F.regexp_replace(text, "\n", "\n  "))
    else:
        raise ValueError(f"unknown format {form}: one of {FORMATS}")
    out = other
    for name, rendered in rules.items():
        out = F.when(kind == name, rendered).otherwise(out)
    return out


def documents_to(form: str, blocks: DataFrame, keys: list[str], order: str, kind: str, content: str) -> DataFrame:
    """keys, body: the rendered blocks of each document in order, with blank lines between."""
    each = blocks.select(*keys, F.struct(F.col(order).alias("o"), block_to(form, F.col(kind), F.col(content)).alias("s")).alias("part"))
    return each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["s"]), "\n\n").alias("body"))


def latex_document(body: Column, title: Column, document_class: str = "article", packages: tuple[str, ...] = ("amsmath", "graphicx", "hyperref")) -> Column:
    preamble = f"\\documentclass{{{document_class}}}\n" + "".join(f"\\usepackage{{{p}}}\n" for p in packages)
    return F.concat(F.lit(preamble + "\\title{"), latex_escaped(title), F.lit("}\n\\begin{document}\n\\maketitle\n"), body, F.lit("\n\\end{document}\n"))


STYLES = ("apa", "mla", "chicago", "ieee", "harvard", "vancouver")


def citation(style: str, fields: Column) -> Column:
    """A bibliography entry (map of BibTeX fields) in a style of STYLES; parts that are missing are left out."""
    get = lambda name: F.nullif(F.trim(fields[name]), F.lit(""))
    part = lambda before, value, after="": F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(""))
    people = F.transform(F.split(F.coalesce(get("author"), F.lit("Unknown")), r"\s+and\s+"), lambda p: F.trim(p))
    last = lambda p: F.when(F.contains(p, F.lit(",")), F.trim(F.split(p, ",").getItem(0))).otherwise(F.regexp_extract(p, r"(\S+)\s*$", 1))
    given = lambda p: F.when(F.contains(p, F.lit(",")), F.trim(F.regexp_extract(p, r",\s*(.*)$", 1))).otherwise(F.trim(F.regexp_replace(p, r"\S+\s*$", "")))
    initials = lambda p, dot: F.array_join(F.transform(F.filter(F.split(given(p), r"[\s.]+"), lambda x: x != ""), lambda x: F.concat(F.left(x, F.lit(1)), F.lit(dot))), " " if dot else "")
    names = {
        "apa": F.transform(people, lambda p: F.concat_ws(", ", last(p), F.nullif(initials(p, "."), F.lit("")))),
        "ieee": F.transform(people, lambda p: F.concat_ws(" ", F.nullif(initials(p, "."), F.lit("")), last(p))),
        "vancouver": F.transform(people, lambda p: F.concat_ws(" ", last(p), F.nullif(initials(p, ""), F.lit("")))),
        "full": F.transform(people, lambda p, i: F.when(i == 0, F.concat_ws(", ", last(p), F.nullif(given(p), F.lit("")))).otherwise(F.concat_ws(" ", F.nullif(given(p), F.lit("")), last(p)))),
    }

    def listed(kind: str, final: str) -> Column:
        n = F.size(names[kind])
        return F.when(n <= 1, F.get(names[kind], F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names[kind], 1, n - 1), ", "), F.lit(final), F.get(names[kind], n - 1)))

    year, title, venue = F.coalesce(get("year"), F.lit("n.d.")), F.coalesce(get("title"), F.lit("Untitled")), F.coalesce(get("journal"), get("booktitle"), get("publisher"))
    volume, number, pages, doi = get("volume"), get("number"), F.replace(get("pages"), F.lit("--"), F.lit("–")), get("doi")
    if style == "apa":
        return F.concat(listed("apa", ", & "), F.lit(" ("), year, F.lit("). "), title, F.lit("."), part(" ", venue), part(", ", volume), part("(", number, ")"), part(", ", pages), F.when(venue.isNotNull(), ".").otherwise(""), part(" https://doi.org/", doi))
    if style == "mla":
        return F.concat(listed("full", ", and "), F.lit('. "'), title, F.lit('."'), part(" ", venue), part(", vol. ", volume), part(", no. ", number), F.lit(", "), year, part(", pp. ", pages), F.lit("."))
    if style == "chicago":
        return F.concat(listed("full", ", and "), F.lit('. "'), title, F.lit('."'), part(" ", venue), part(" ", volume), part(", no. ", number), F.lit(" ("), year, F.lit(")"), part(": ", pages), F.lit("."))
    if style == "ieee":
        return F.concat(listed("ieee", ", and "), F.lit(', "'), title, F.lit(',"'), part(" ", venue), part(", vol. ", volume), part(", no. ", number), part(", pp. ", pages), F.lit(", "), year, F.lit("."))
    if style == "harvard":
        return F.concat(listed("apa", " and "), F.lit(" ("), year, F.lit(") '"), title, F.lit("'"), part(", ", venue), part(", ", volume), part("(", number, ")"), part(", pp. ", pages), F.lit("."))
    if style == "vancouver":
        return F.concat(F.array_join(names["vancouver"], ", "), F.lit(". "), title, F.lit("."), part(" ", venue, "."), F.lit(" "), year, part(";", volume), part("(", number, ")"), part(":", pages), F.lit("."))
    raise ValueError(f"unknown style {style}: one of {STYLES}")


def bibliography(entries: DataFrame, keys: list[str], style: str, fields: str = "fields") -> DataFrame:
    """keys, bibliography: the citations of each document, sorted as text, with blank lines between."""
    each = entries.select(*keys, citation(style, F.col(fields)).alias("c"))
    return each.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("c")), "\n\n").alias("bibliography"))


def short_citation(fields: Column) -> Column:
    """Last name and year: one author, A & B, or A et al."""
    people = F.transform(F.split(F.coalesce(fields["author"], F.lit("Unknown")), r"\s+and\s+"), lambda p: F.when(F.contains(p, F.lit(",")), F.trim(F.split(p, ",").getItem(0))).otherwise(F.regexp_extract(p, r"(\S+)\s*$", 1)))
    n = F.size(people)
    names = F.when(n == 1, F.get(people, F.lit(0))).when(n == 2, F.array_join(people, " & ")).otherwise(F.concat(F.get(people, F.lit(0)), F.lit(" et al.")))
    return F.concat(names, F.lit(" ("), F.coalesce(fields["year"], F.lit("n.d.")), F.lit(")"))


def cite_key(fields: Column) -> Column:
    """First author's last name in lower-case letters, then the year."""
    first = F.get(F.split(F.coalesce(fields["author"], F.lit("unknown")), r"\s+and\s+"), F.lit(0))
    name = F.when(F.contains(first, F.lit(",")), F.split(first, ",").getItem(0)).otherwise(F.regexp_extract(first, r"(\S+)\s*$", 1))
    return F.concat(F.regexp_replace(F.lower(name), "[^a-z]", ""), F.coalesce(fields["year"], F.lit("")))


def bibtex_text(entry_type: Column, key: Column, fields: Column) -> Column:
    """An entry as BibTeX, its fields sorted by name."""
    sorted_fields = F.array_sort(F.map_entries(fields))
    lines = F.array_join(F.transform(sorted_fields, lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), e["value"], F.lit("}"))), ",\n")
    return F.concat(F.lit("@"), entry_type, F.lit("{"), key, F.lit(",\n"), lines, F.lit("\n}"))
