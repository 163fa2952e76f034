"""Lookups, semi joins, latest rows and merges that take more than one built-in operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key. The filter on the rank lets Spark drop rows before the shuffle."""
    return keep_first(df, keys, 1, *order)


def keep_first(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def beyond_first(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """What a prune removes: the rows after the first n of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") > n).drop("_rank")


def visible_to(items: DataFrame, key: str, *granted: DataFrame) -> DataFrame:
    """Items whose key is in any of the grants. A union and one semi join, where an OR of EXISTS would nest loops."""
    ids = reduce(DataFrame.union, (g.select(F.col(g.columns[0]).alias(key)) for g in granted))
    return items.join(ids, key, "left_semi")


def with_counts(parents: DataFrame, key: str, *children: tuple[DataFrame, str, str]) -> DataFrame:
    """Adds a count of each child table's rows (frame, its key, name of the count): aggregated before the join, so nothing fans out."""
    out = parents
    for child, child_key, name in children:
        n = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def complete(dimension: DataFrame, counts: DataFrame, key: str, *measures: str) -> DataFrame:
    """Every row of the dimension with its measures, 0 where there are none."""
    return dimension.join(counts, key, "left").fillna(0, list(measures))


def covering(df: DataFrame, group: str, item: str, required: DataFrame) -> DataFrame:
    """Groups that hold every required item (relational division)."""
    wanted = required.select(F.col(required.columns[0]).alias(item)).where(F.col(item).isNotNull()).distinct()
    held = df.join(F.broadcast(wanted) if _small(wanted) else wanted, item).groupBy(group).agg(F.count_distinct(item).alias("n"))
    return held.join(wanted.agg(F.count(F.lit(1)).alias("n")), "n").select(group)


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a frame has few rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def fallback_lookup(facts: DataFrame, dimension: DataFrame, key: list[str], candidates: list[list[tuple[Column, Column]]], rank: Column) -> DataFrame:
    """Joins each fact to its best row of the dimension by several rules in order of preference.

    candidates: for each rule the pairs (column of facts, column of dimension) that must be equal. ``rank``
    breaks ties within a rule (lowest first). Facts without any match stay, with nulls.
    """
    found = [
        facts.alias("f").join(dimension.alias("d"), [(a == b) for a, b in rule]).select("f.*", "d.*", F.lit(i).alias("_rule"))
        for i, rule in enumerate(candidates)
    ]
    best = first_per_key(reduce(DataFrame.unionByName, found), key, F.col("_rule"), rank).withColumnRenamed("_rule", "matched_rule")
    added = [c for c in best.columns if c not in facts.columns]
    return facts.join(best.select(*key, *added), key, "left")


def merge_by_priority(key: Column, priority: str, *frames: DataFrame) -> DataFrame:
    """Union of frames with one row per key: that of the least priority value."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return first_per_key(both.withColumn("merge_key", key), ["merge_key"], F.col(priority))


def look_back(captures: DataFrame, events: DataFrame, same: list[str], capture_id: str, ts: str, minutes: int, n: int, event_id: str) -> DataFrame:
    """capture id and the ids of its newest n events of the minutes before, newest first; captures without any have an empty list.

    Events meet captures on time slots of the window's length, so the join is an equi-join.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / (60 * minutes))
    left = captures.select(*same, F.col(capture_id).alias("_capture"), F.col(ts).alias("_at")).withColumn("_slot", F.explode(F.array(slot("_at"), slot("_at") - 1)))
    right = events.select(*same, F.col(event_id).alias("_event"), F.col(ts).alias("_ts")).withColumn("_slot", slot("_ts"))
    near = left.join(right, [*same, "_slot"]).where((F.col("_ts") < F.col("_at")) & (F.col("_ts") >= F.col("_at") - F.make_interval(mins=F.lit(minutes))))
    newest = keep_first(near, ["_capture"], n, F.desc("_ts"), F.desc("_event"))
    lists = newest.groupBy(F.col("_capture").alias(capture_id)).agg(F.transform(F.sort_array(F.collect_list(F.struct("_ts", "_event")), asc=False), lambda s: s["_event"]).alias("trail"))
    return captures.select(capture_id).join(lists, capture_id, "left").withColumn("trail", F.coalesce("trail", F.array().cast(lists.schema["trail"].dataType)))


def closest_start(points: DataFrame, point: str, starts: DataFrame, start: str, keys: list[str]) -> DataFrame:
    """As-of lookup: each point with the row of the greatest start at or before it, by a merged ordered window."""
    payload = [c for c in starts.columns if c not in (*keys, start)]
    a = points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"), F.lit(None).alias("_start"))
    b = starts.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).alias("_point"), F.struct(start, *payload).alias("_start"))
    order = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_found", F.last("_start", ignorenulls=True).over(order)).where(F.col("_kind") == 1)
    return found.select("_point.*", "_found.*")


def all_belong(pairs: DataFrame, member: str, owner: str, owned: DataFrame) -> DataFrame:
    """Proposed members that do not belong to their owner; no rows mean that all do."""
    return pairs.join(owned.select(member, owner).distinct(), [member, owner], "left_anti")
