"""Reports on what is wrong with documents: each rule is a predicate, and a report is a row per rule that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import item_texts, text_of
from .emit import canonical_type


def reported(df: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """keys, level, rule: rules are (level, name, predicate); nulls count as false."""
    each = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for level, name, test in rules))
    return df.select(*keys, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("found")).select(*keys, "found.*")


def accessibility(blocks: DataFrame, keys: list[str], kind: str, content: str) -> DataFrame:
    """keys, level, rule: what a reader with assistive software would miss in each block."""
    k, c = F.lower(canonical_type(F.col(kind))), F.col(content)
    blank = lambda path: F.trim(F.coalesce(F.get_json_object(c, path), F.lit(""))) == ""
    broken = F.try_parse_json(c).isNull()
    textual = ~k.isin("figure", "table", "list", "pagebreak", "tableofcontents", "bibliography")
    level = F.get_json_object(c, "$.level").cast("int")
    rules = [
        ("error", "broken_json", broken),
        ("warning", "figure_without_alt", ~broken & (k == "figure") & blank("$.altText") & blank("$.alt")),
        ("info", "figure_without_caption", ~broken & (k == "figure") & blank("$.caption")),
        ("warning", "equation_without_source", ~broken & (k == "equation") & blank("$.latex") & blank("$.source")),
        ("warning", "table_without_headers", ~broken & (k == "table") & F.coalesce(F.json_array_length(F.get_json_object(c, "$.headers")) == 0, F.lit(True))),
        ("warning", "heading_level", ~broken & (k == "heading") & ((level < 1) | (level > 6))),
        ("info", "empty", ~broken & textual & (F.trim(text_of(c)) == "")),
    ]
    return reported(blocks, keys, rules)


def structure(blocks: DataFrame, doc: str, order: str, kind: str, content: str) -> DataFrame:
    """doc, order, level, rule: findings that depend on a block's place among the others.

    Personal data near the start, paragraphs that look like headings, tables of contents without
    headings to list, headings that skip a level, and lists of one item.
    """
    window = Window.partitionBy(doc).orderBy(order)
    whole = Window.partitionBy(doc)
    k = canonical_type(F.col(kind))
    rows = blocks.select(doc, order, k.alias("_k"), text_of(F.col(content)).alias("_t"), F.size(item_texts(F.col(content))).alias("_items"), F.get_json_object(content, "$.level").cast("int").alias("_level"))
    rows = rows.withColumns({
        "_n": F.row_number().over(window), "_next": F.lead("_k").over(window), "_heads": F.sum((F.col("_k") == "heading").cast("int")).over(whole),
        "_last": F.last(F.when(F.col("_k") == "heading", F.col("_level")), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)),
    })
    text = F.col("_t")
    contact = text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|linkedin\.com/|github\.com/")
    looks = (F.length(text).between(3, 60)) & ~text.rlike(r"[.,;:!?]\s*$") & text.rlike("^[A-Z0-9]")
    rules = [
        ("info", "personal_data", (F.col("_n") <= 3) & contact),
        ("info", "paragraph_as_heading", (F.col("_k") == "paragraph") & looks & (F.col("_next") == "paragraph")),
        ("warning", "empty_contents", (F.col("_k") == "tableOfContents") & (F.col("_heads") == 0)),
        ("warning", "skipped_level", (F.col("_k") == "heading") & (F.col("_level") > F.col("_last") + 1)),
        ("info", "list_of_one", F.col("_items") == 1),
    ]
    return reported(rows, [doc, order], rules)


def coverage_claim(level: Column, handled: Column) -> Column:
    """Whether a catalog's claim fits what the parser does: A to E, or Z for levels that are not known (the buckets' names are fixed values)."""
    done = F.coalesce(handled, F.lit(False))
    return (
        F.when(level == "shimmed", "E_shimmed_trusted")
        .when(level.isin("full", "partial") & done, "A_truthful")
        .when(level == "full", "B_lying_full").when(level == "partial", "B_lying_partial")
        .when(level.isin("unsupported", "none") & done, "C_underclaimed")
        .when(level.isin("unsupported", "none"), "D_honest_unsupported").otherwise("Z_unclassified")
    )
