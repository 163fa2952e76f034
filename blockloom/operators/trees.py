r"""Nested JSON to rows, to any depth.

The texts of a block are read from its own row, value by value (walked_texts). Rows of all strings come from tokens and running
sums in place of a recursive walk (json_strings): a value's enclosing containers are those that are open where it stands. What they have in common with a condition
(a field's name, say) is a sum of +1 where such a container opens and -1 where it closes, so no level is counted out and no
job runs per level. Tokens stay in the row of their text, as an array, so there is no sort and no shuffle by text. Broken JSON and nulls have no values.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scans

TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++'
#: Keys whose text is LaTeX source (fixed values).
LATEX_KEYS = ("source", "latex", "raw", "rawlatex", "preamble")
#: Scripts by ranges of code points (fixed values).
SCRIPTS = (
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Thai", 0x0E00, 0x0E7F), ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF),
    ("Hangul", 0xAC00, 0xD7AF), ("Hangul", 0x1100, 0x11FF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x3400, 0x4DBF), ("Cyrillic", 0x0400, 0x04FF), ("Greek", 0x0370, 0x03FF),
)


def _strings(rows: DataFrame, column: str, **within: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Adds _strings: the strings that are values of each row, in order, as in json_strings; null for broken JSON."""
    tokens = F.when(F.try_parse_json(column).isNotNull(), F.regexp_extract_all(column, F.lit(TOKEN), F.lit(0)))
    kept = rows.columns
    found = rows.withColumn("_tokens", tokens)
    one_of = lambda *which: F.transform("_tokens", lambda t: t.isin(*which))
    found = found.withColumn("_in", scans.pairs(one_of("{", "["), one_of("}", "]")))
    parsed = lambda token: F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 0)
    unquoted = lambda token: F.when(F.contains(token, F.lit("\\")), parsed(token)).otherwise(F.btrim(token, F.lit('"')))
    at = lambda i: F.get("_tokens", i)
    named = lambda i: unquoted(F.when(at(i - 1) == ":", at(i - 2)))
    meets = lambda test: F.transform("_tokens", lambda t, i: F.when(t.isin("{", "["), F.coalesce(test(t, F.get("_in", i)["depth"], named(i)), F.lit(False))))
    found = found.withColumns({f"_{name}": scans.inside(meets(test), F.col("_in.partner")) for name, test in within.items()})
    value = lambda t, i: (F.left(t, F.lit(1)) == '"') & ~F.coalesce(at(i + 1) == ":", F.lit(False))
    each = F.transform("_tokens", lambda t, i: F.when(value(t, i), F.struct(
        i.alias("pos"), F.get("_in", i)["around"].alias("parent"), F.get("_in", i)["depth"].alias("depth"), named(i).alias("field"), unquoted(t).alias("value"), *(F.get(f"_{name}", i).alias(name) for name in within))))
    return found.select(*kept, F.when(F.col("_tokens").isNotNull(), F.filter(each, lambda x: x.isNotNull())).alias("_strings"))


def json_strings(rows: DataFrame, keys: list[str], column: str, **within: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """keys, pos, parent, depth, field, value, and a count for each name in within: the strings that are values, in order.

    field: the name that the string has in its object, null in arrays and at the top. parent: position of the object or
    array around it. depth: containers around it. within: conditions on a container's token ({ or [), depth (itself included) and own
    field; the count is of the containers around the string that meet it.
    """
    return _strings(rows, column, **within).select(*keys, F.inline("_strings"))


def _fields(pairs: list[tuple[str, object]]) -> dict[str, object]:
    fields = dict(pairs)
    if len(fields) < len(pairs):
        raise ValueError("a name comes twice")
    return fields


def _refused(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_fields, parse_int=float, parse_constant=_refused)


def _walked(content: str | None) -> str:
    try:
        block = _DECODER.decode(content or "")
    except (ValueError, RecursionError):
        return ""
    if isinstance(block, dict) and isinstance(block.get("text"), str):
        return block["text"]
    found, left = [], [block]
    while left:
        value = left.pop()
        if isinstance(value, dict):
            if isinstance(value.get("text"), str):
                found.append(value["text"])
            value = value.get("content")
        if isinstance(value, list):
            left.extend(reversed(value))
    return " ".join(found).strip(" ")


@F.arrow_udf(T.StringType())
def _walked_all(contents: pa.Array) -> pa.Array:
    # one text at a time is held as Python values; half a surrogate pair becomes a question mark, as in the JVM
    return pa.array([_walked(x.as_py()).encode("utf-8", "replace").decode() for x in contents], pa.string())


def walked_texts(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, text: the text of a block, else the texts of its nested content lists in order, joined by spaces; empty if there are none.

    A list in a list is walked, other fields are not. Broken JSON, names that come twice in an object too, and nulls are empty.
    """
    return rows.select(*keys, _walked_all(F.col(column)).alias("text"))


def requirements(rows: DataFrame, keys: list[str], group: list[str], column: str) -> DataFrame:
    """group, kind, value: what the blocks of a group ask of a renderer, each once.

    command: control words in strings below a key of LATEX_KEYS; codepoint: characters beyond ASCII, anywhere, as U+XXXX; script: of these by SCRIPTS.
    """
    strings = json_strings(rows, keys, column, latex=lambda _token, _depth, field: F.lower(field).isin(*LATEX_KEYS))
    source = (F.col("latex") > 0) | F.coalesce(F.lower("field").isin(*LATEX_KEYS), F.lit(False))
    commands = F.when(source, F.regexp_extract_all("value", F.lit(r"\\([a-zA-Z]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    chars = F.regexp_extract_all("value", F.lit(r"[^\x00-\x7F]"), F.lit(0))
    listed = lambda kind, values: F.transform(F.array_distinct(values), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    once = strings.select(*group, F.inline(F.concat(listed("command", commands), listed("char", chars)))).distinct()
    bytes_ = F.encode("value", "UTF-32")
    coded = once.withColumn("code", F.when(F.col("kind") == "char", F.conv(F.hex(bytes_), 16, 10).cast("int")))
    script = F.coalesce(*(F.when(F.col("code").between(low, high), name) for name, low, high in SCRIPTS))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    point = F.concat(F.lit("U+"), F.when(F.col("code") < 0x1000, F.lpad(F.hex("code"), 4, "0")).otherwise(F.hex("code")))
    told = F.when(F.col("kind") == "command", F.array(pair("command", F.col("value")))).otherwise(F.array(pair("codepoint", point), pair("script", script)))
    return coded.select(*group, F.inline(told)).where("value IS NOT NULL").distinct()
