"""Typed blocks with JSON content: building, reading, converting, folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_of(kind: Column, text: Column, level: Column | None = None) -> Column:
    """JSON content of a block of a type that holds a text; unknown types hold it as a paragraph."""
    make = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    return (
        F.when(kind == "heading", make(text=text, level=level if level is not None else F.lit(2)))
        .when(kind == "equation", make(latex=text, mode=F.lit("display")))
        .when(kind == "code", make(language=F.lit(""), code=text))
        .when(kind == "list", F.to_json(F.struct(F.lit(False).alias("ordered"), F.split(text, "\n").alias("items"))))
        .when(kind == "theorem", make(theoremType=F.lit("theorem"), content=text, numbered=F.lit(True)))
        .when(kind == "figure", make(src=F.lit(""), caption=text))
        .when(kind.isin("pageBreak", "tableOfContents", "bibliography"), F.lit("{}"))
        .otherwise(make(text=text))
    )


def text_of(content: Column) -> Column:
    """The first non-empty of text, title, caption, code, latex and name; else list items, else table rows, one a line; else empty."""
    field = lambda name: F.nullif(F.get_json_object(content, f"$.{name}"), F.lit(""))
    items = item_texts(content)
    rows = F.transform(F.from_json(F.get_json_object(content, "$.rows"), "array<array<string>>"), lambda r: F.array_join(F.transform(r, _inner_text), " — "))
    lists = [F.nullif(F.array_join(x, "\n"), F.lit("")) for x in (items, rows)]
    return F.coalesce(*map(field, ("text", "title", "caption", "code", "latex", "name", "content")), *lists, F.lit(""))


def _inner_text(x: Column) -> Column:
    """An item or cell is a string or an object with a text."""
    return F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), x)).otherwise(x)


def item_texts(content: Column, raw: bool = False) -> Column:
    """Texts of a list's items; with raw, items that are objects stay JSON."""
    items = F.from_json(F.get_json_object(content, "$.items"), "array<string>")
    return items if raw else F.transform(items, _inner_text)


def convert(kind: Column, content: Column, target: str, level: int = 2) -> Column:
    """Content for another type, made from the block's text; the same type keeps its content."""
    return F.when(kind == target, content).otherwise(content_of(F.lit(target), text_of(content), F.lit(level)))


def relevel(content: Column, level: int) -> Column:
    """A heading's text with a new level; other keys are dropped."""
    return F.to_json(F.struct(F.get_json_object(content, "$.text").alias("text"), F.lit(level).alias("level")))


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects, the new one's keys win; what is no object gives way to the other."""
    fields = lambda c: F.from_json(c, "map<string,variant>")
    is_object = lambda c: F.coalesce(F.trim(c).startswith("{"), F.lit(False))
    both = F.map_concat(F.map_filter(fields(old), lambda k, _: ~F.array_contains(F.map_keys(fields(new)), k)), fields(new))
    return F.when(is_object(old) & is_object(new), F.to_json(both)).when(is_object(new), new).otherwise(old)


def set_key(content: Column, key: str, value: Column) -> Column:
    return merged(content, F.to_json(F.create_map(F.lit(key), value)))


def canonical(content: Column) -> Column:
    """JSON with sorted keys and no spaces; empty and broken content is {}."""
    return F.coalesce(F.to_json(F.try_parse_json(F.nullif(F.trim(content), F.lit("")))), F.lit("{}"))


def content_hash(kind: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", kind, canonical(content)), 256)


def preview(content: Column, most: int = 80) -> Column:
    """The text cut to ``most`` characters, or the number of a list's items."""
    text, n = text_of(content), F.size(item_texts(content))
    return F.when(n > 0, F.format_string("(list of %d)", n)).when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def folded(df: DataFrame, keys: list[str], order: str, items: Column) -> DataFrame:
    """keys, items (all items in order), first (the first position): blocks folded into one list."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), items.alias("items"))))
    return df.groupBy(*keys).agg(F.flatten(F.transform(listed, lambda s: s["items"])).alias("items"), F.min(order).alias("first"))


def snapshot(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, snapshot: all other columns of a document's blocks as one JSON array, in order."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(order, *rest)))).alias("snapshot"))


def restored(snapshots: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """The blocks of snapshots again; schema: of the array's elements."""
    return snapshots.select(*keys, F.explode(F.from_json("snapshot", f"array<struct<{schema}>>")).alias("b")).select(*keys, "b.*")


def migrated_equation(content: Column) -> Column:
    """An equation's content in the newer shape: source and notation in place of latex; content that has a source is left as it is."""
    old, mode = F.get_json_object(content, "$.latex"), F.get_json_object(content, "$.mode")
    new = F.to_json(F.struct(old.alias("source"), F.coalesce(F.get_json_object(content, "$.notation"), F.lit("latex")).alias("notation"), mode.alias("mode")))
    return F.when(F.get_json_object(content, "$.source").isNull() & old.isNotNull(), new).otherwise(content)


def equation_source(content: Column) -> Column:
    """Source of an equation in either shape."""
    return F.coalesce(F.get_json_object(content, "$.source"), F.get_json_object(content, "$.latex"), F.lit(""))


def filled(content: Column) -> Column:
    """Content that is null or an empty string becomes an empty object."""
    return F.when(F.trim(F.coalesce(content, F.lit(""))).isin("", '""'), "{}").otherwise(content)


def is_array(content: Column, path: str) -> Column:
    """Whether the value at a path is an array; a string that looks like one is none."""
    return F.try_variant_get(F.try_parse_json(content), path, "array<variant>").isNotNull()
