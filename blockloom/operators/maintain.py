"""Upserts, retention and other rewrites of tables. Each returns the new table; writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; null keys are equal."""
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.alias("n"), on, "left_anti")
    return kept.unionByName(new)


def upsert_filled(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but a null of new keeps the old value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new"))).alias(c) for c in old.columns if c not in keys)).select(*old.columns)


def upsert_counts(old: DataFrame, delta: DataFrame, keys: list[str], count: str, first: str, last: str) -> DataFrame:
    """Adds the counts of delta, keeps the first and moves the last time seen."""
    return old.unionByName(delta).groupBy(*keys).agg(F.sum(count).alias(count), F.min(first).alias(first), F.max(last).alias(last))


def insert_missing(dimension: DataFrame, wanted: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Get-or-insert: rows for keys that the dimension lacks, with ids that follow from the key."""
    keyed = wanted.select(*keys).distinct()
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    missing = keyed.alias("w").join(dimension.alias("d"), on, "left_anti")
    return missing.withColumn(id_col, F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256))


def expired(df: DataFrame, ts: str, as_of: object, days: int) -> tuple[DataFrame, DataFrame]:
    """(expired, live) by age; rows without a time are live."""
    old = F.coalesce(F.col(ts) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)), F.lit(False))
    return df.where(old), df.where(~old)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def promoted(df: DataFrame, seen: DataFrame, key: str, level: str, ranks: list[str]) -> DataFrame:
    """Raises the level of rows to the highest seen; never lowers it. Unknown levels rank lowest."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), c), F.lit(0))
    best = seen.groupBy(key).agg(F.max(rank(F.col(level))).alias("_best"))
    joined = df.join(best, key, "left")
    return joined.withColumn(level, F.when(F.coalesce(F.col("_best"), F.lit(0)) > rank(F.col(level)), F.get(F.array(*map(F.lit, ranks)), F.col("_best").cast("int") - 1)).otherwise(F.col(level))).drop("_best")


def reordered(df: DataFrame, ids: list, id_col: str, order: str) -> DataFrame:
    """New positions by index in a list of ids; other rows keep theirs."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col(id_col)) if ids else F.lit(0)
    return df.withColumn(order, F.when(place > 0, place - 1).otherwise(F.col(order)).cast(df.schema[order].dataType))


def with_paths(parents: DataFrame, children: DataFrame, parent_key: str, key: str, position: str) -> DataFrame:
    """Materialised paths: the parent's path, a dot and the position padded to four digits."""
    own = F.lpad(F.col(position).cast("string"), 4, "0")
    joined = children.join(parents.select(F.col(key).alias(parent_key), F.col("path").alias("_parent")), parent_key, "left")
    return joined.withColumn("path", F.when(F.col("_parent").isNull(), own).otherwise(F.concat_ws(".", "_parent", own))).drop("_parent")


def next_number(df: DataFrame, new: DataFrame, keys: list[str], number: str, order: str) -> DataFrame:
    """Numbers new rows onwards from the greatest in use, by key; a key that is not in use begins at 1."""
    most = df.groupBy(*keys).agg(F.max(number).alias("_most"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return new.join(most, keys, "left").withColumn(number, F.coalesce("_most", F.lit(0)) + rank).drop("_most")


def bulk_status(df: DataFrame, where: Column, status: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the new status, a row with the number affected)."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumn(status, F.when(hit, value).otherwise(F.col(status))), df.agg(F.count_if(hit).alias("affected"))


def missed(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose content hash and rule version the result cache does not hold: the only ones to compute."""
    return wanted.join(cache.select(*keys), keys, "left_anti")


def corrections(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, old, new: an entry for every value that an edit changed."""
    both = before.select(key, F.struct(*columns).alias("b")).join(after.select(key, F.struct(*columns).alias("a")), key)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"b.{c}").cast("string").alias("old"), F.col(f"a.{c}").cast("string").alias("new")) for c in columns))
    return both.select(key, F.explode(each).alias("x")).select(key, "x.*").where(~F.col("old").eqNullSafe(F.col("new")))


def insert_unless_active(old: DataFrame, new: DataFrame, text: str, active: Column, order: str) -> DataFrame:
    """Rows of new whose text, in any case, is in no active row of old; of equal new ones the first by ``order``."""
    seen = old.where(F.coalesce(active, F.lit(False))).select(F.lower(text).alias("_text"))
    fresh = new.withColumn("_text", F.lower(text)).join(seen, "_text", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_text").orderBy(order))).where("_n = 1").drop("_n", "_text")


def batch_upsert(old: DataFrame, new: DataFrame, keys: list[str], document: str, versions: DataFrame, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """(the new table, a row per document of new with version and applied).

    new has the blocks of whole documents as a client holds them: its blocks replace or join the old ones, a null keeps
    the old value (or the default in a new block), blocks that it lacks go. versions: document, version, expected. A document
    whose version is not the expected one is left as it is; otherwise its version grows by one. A null expectation always holds.
    """
    touched = new.select(document).distinct()
    state = versions.join(touched, document, "left_semi").withColumn("applied", F.coalesce(F.col("expected") == F.col("version"), F.lit(True)))
    applied = state.where("applied").select(document)
    on, values = [document, *keys], [c for c in old.columns if c not in (document, *keys)]
    untouched = old.join(applied, document, "left_anti")
    before = old.join(applied, document, "left_semi").select(*on, *(F.col(c).alias(f"_{c}") for c in values))
    merged = new.join(applied, document, "left_semi").join(before, on, "left")
    filled = [F.coalesce(F.col(c), F.col(f"_{c}"), *([F.lit(defaults[c])] if c in defaults else [])).cast(old.schema[c].dataType).alias(c) for c in values]
    out = untouched.unionByName(merged.select(*on, *filled))
    return out, state.select(document, F.when(F.col("applied"), F.col("version") + 1).otherwise(F.col("version")).alias("version"), "applied")


def cloned(rows: DataFrame, key: str, parent: str, document: str, copy: str) -> DataFrame:
    """Copies of all blocks of documents under new ids, which follow from the old ones and the name of the copy; parents point into the copy."""
    new_id = lambda c: F.when(c.isNotNull(), F.sha2(F.concat_ws("/", F.lit(copy), c.cast("string")), 256))
    inside = rows.select(F.col(document).alias("_document"), F.col(key).alias("_key"))
    linked = rows.join(inside, (F.col(document) == F.col("_document")) & (F.col(parent) == F.col("_key")), "left")
    return linked.select(*(new_id(F.col(c)).alias(c) if c in (key, document) else new_id(F.col("_key")).alias(c) if c == parent else F.col(c) for c in rows.columns))


def refreshed_counts(parents: DataFrame, children: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """Denormalised counters set from the children; parents without any have 0."""
    own = children.groupBy(key).agg(*(F.count_if(c).alias(f"_{name}") for name, c in counts.items()))
    joined = parents.drop(*counts).join(own, key, "left")
    return joined.withColumns({name: F.coalesce(F.col(f"_{name}"), F.lit(0)).cast("long") for name in counts}).drop(*(f"_{name}" for name in counts))


def backfill_checks(before: DataFrame, after: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check, status: PASS or FAIL of the row count and of every rule that the new rows must all meet."""
    broken = after.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    total = before.agg(F.count(F.lit(1)).alias("_total"))
    one = broken.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    each = [F.struct(F.lit("row_count").alias("check"), (F.col("_n") == F.col("_total")).alias("ok"))] + [F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("ok")) for n in rules]
    return one.select(F.explode(F.array(*each)).alias("c")).select("c.check", F.when(F.col("c.ok"), "PASS").otherwise("FAIL").alias("status"))


def purged(df: DataFrame, deleted_at: str, as_of: object, days: int = 30) -> DataFrame:
    """Rows that stay: live ones, and those deleted at most ``days`` ago."""
    return df.where(F.col(deleted_at).isNull() | (F.col(deleted_at) >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))))
