"""Computations over ordered rows: outlines, carried state, merges with neighbours, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def outline(df: DataFrame, keys: list[str], order: str, level: str, most: int = 6) -> DataFrame:
    """Adds parent: the position of the nearest earlier heading with a smaller level; other rows hang on the last heading.

    level is null for rows that are no headings. One running maximum per level replaces a stack.
    """
    positions = [F.max(F.when(F.col(level) == n, F.col(order))).over(_before(keys, order)) for n in range(1, most + 1)]
    parents = F.lit(None).cast(df.schema[order].dataType)
    for own in range(2, most + 1):
        above = F.greatest(*positions[: own - 1]) if own > 2 else positions[0]
        parents = F.when(F.col(level) == own, above).otherwise(parents)
    last = F.max(F.when(F.col(level).isNotNull(), F.col(order))).over(_before(keys, order))
    return df.withColumn("parent", F.when(F.col(level).isNull(), last).otherwise(parents))


def subtree_sizes(df: DataFrame, keys: list[str], position: str, level: str, most: int = 6) -> DataFrame:
    """Adds n_below: for headings, the rows up to the next heading of the same or a higher rank. position counts from 1 without gaps."""
    after = Window.partitionBy(*keys).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    total = F.max(position).over(Window.partitionBy(*keys))
    out = F.lit(None).cast("long")
    for n in range(1, most + 1):
        following = F.min(F.when(F.col(level) <= n, F.col(position))).over(after)
        out = F.when(F.col(level) == n, F.coalesce(following, total + 1) - F.col(position) - 1).otherwise(out)
    return df.withColumn("n_below", out.cast("long"))


def carried(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the last non-null value at or before each row: state that headings set and other rows inherit."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def runs(df: DataFrame, keys: list[str], order: str, starts: Column, name: str) -> DataFrame:
    """Adds the number of the run of each row; a run begins where ``starts`` holds, the first row begins run 1."""
    window = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(window) == 1
    return df.withColumn(name, F.sum((first | F.coalesce(starts, F.lit(False))).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def chapters(df: DataFrame, keys: list[str], order: str, is_break: Column, is_top_heading: Column) -> DataFrame:
    """Adds chapter (from 1). Breaks end a chapter and are dropped, top headings begin one; there are no empty chapters."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.sum((is_break | is_top_heading).cast("int")).over(upto)
    return df.withColumn("_mark", mark).where(~is_break).withColumn("chapter", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_mark"))).drop("_mark")


def level_jumps(df: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """Headings whose level is more than one below the previous heading's."""
    heads = df.where(F.col(level).isNotNull()).withColumn("previous_level", F.lag(level).over(Window.partitionBy(*keys).orderBy(order)))
    return heads.where(F.col(level) > F.col("previous_level") + 1)


def paged(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Adds page, from 1, of ``size`` rows."""
    return df.withColumn("page", (F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size) + 1).cast("long"))


def merged_runs(df: DataFrame, keys: list[str], order: str, kind: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Neighbours of one kind become one row: first order, kind, joined text, number of parts."""
    changed = F.lag(kind).over(Window.partitionBy(*keys).orderBy(order)) != F.col(kind)
    marked = runs(df.withColumn("_changed", changed), keys, order, F.col("_changed"), "_run")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return marked.groupBy(*keys, "_run", kind).agg(F.min(order).alias(order), F.array_join(parts, separator).alias(text), F.count(F.lit(1)).alias("n_parts")).drop("_run")
