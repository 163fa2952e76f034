"""Optional filters, search, sorting and paging."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, needle_pattern


def where_all(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """Applies the predicates that are given; None is a filter that was not asked for."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(and_, given)) if given else df


def equals(name: str, value: object | None, null_name: str | None = None) -> Column | None:
    """name = value if a value is asked for; the value ``null_name`` asks for null."""
    if value is None:
        return None
    return F.col(name).isNull() if null_name is not None and value == null_name else F.col(name) == value


def within_days(name: str, as_of: object, days: int, most: int = 365) -> Column:
    """The trailing window; as_of is explicit so that a query gives the same rows tomorrow."""
    return F.col(name) >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(clamp(days, 1, most)))


def search_any(needle: str | None, *columns: str, wildcards: bool = False) -> Column | None:
    """Case-insensitive substring in any of the columns; with wildcards, % and _ of the needle keep their meaning."""
    if not (needle or "").strip():
        return None
    pattern = f"%{needle}%" if wildcards else needle_pattern(needle)
    return reduce(or_, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns))


def sorted_by(df: DataFrame, spec: dict[str, list[Column]], field: str, descending: bool, tie: str) -> DataFrame:
    """Sorts by a named specification; unknown names fall back to "default". ``tie`` makes the order total."""
    keys = spec.get(field, spec["default"])
    return df.orderBy(*(k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys), F.col(tie))


def page(df: DataFrame, number: int, size: int, most: int = 100) -> DataFrame:
    """A page of a sorted frame, numbered from 1. A top-k: Spark keeps offset + size rows per task, never a full sort."""
    number, size = max(1, number), clamp(size, 1, most)
    return df.offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """total_count and total_pages of a filtered frame."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total_count"), F.ceil(total / F.lit(float(size))).cast("long").alias("total_pages"))


def split_valid(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rows for which the rule is null are rejected."""
    rule = F.coalesce(valid, F.lit(False))
    return df.where(rule), df.where(~rule)


def begins_with(name: str, prefix: str | None) -> Column | None:
    """Values with a literal prefix: no character of it is a wildcard."""
    return F.startswith(F.col(name), F.lit(prefix)) if prefix else None


def plan_cap(plan: str, name: str) -> Column:
    """A cap of a plan kept as JSON; null if it has none."""
    return F.get_json_object(plan, f"$.caps.{name}").cast("long")


def has_feature(plan: str, name: str) -> Column:
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(plan, "$.features"), "array<string>"), name), F.lit(False))
