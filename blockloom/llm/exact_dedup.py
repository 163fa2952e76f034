"""Exact deduplication with an extendible-hash index on shared files (DataFrame operations only).

1. One scan stores every row with its text, the text's key (a 64-bit hash of the normalised form) and
   its SHA-256 in the shared folder.
2. The leading bits of the keys address a directory. A bucket of more than ``capacity`` distinct keys is
   split by its next bit; the directory doubles until no cell is overfull, at most to the bits of a key.
3. Each row goes to the owner task of its bucket. There the rows of a key form a chain, their texts are
   compared byte by byte, and of each text the smallest id stays. Rows of very frequent keys are combined
   before that shuffle, so a group of copies however large reaches its owner as one row a task.
4. The owners write the index, a folder per bucket, and each row finds its entry through its bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, fresh_path, partitions, split_join, stored, table, text_or_empty

#: Distinct keys of a bucket; more where the table would else have over MOST_BUCKETS of them.
CAPACITY = 2_000
MOST_BUCKETS = 1 << 16
#: A key is hot if one in HOT_PART rows has it, and HOT_LEAST at least: there are no more than HOT_PART hot keys.
HOT_PART, HOT_LEAST = 10_000, 16
_KEY_BITS = 64


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _cell(key: Column | str, bits: int) -> Column:
    """The leading bits of the key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.shiftrightunsigned(key, _KEY_BITS - bits) if bits else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[int, DataFrame]:
    """Depth and directory (cell, bucket) for a table of distinct keys (column key).

    A bucket is the shortest run of leading bits with at most ``capacity`` keys; its number is those bits
    after a 1, so it tells its own depth. The directory has the cells that hold keys. It doubles
    until each cell fits a bucket; distinct keys differ in some bit, so it always comes to that.
    """
    total = keys.count()
    capacity = max(capacity, math.ceil(total / MOST_BUCKETS))
    depth = min(_KEY_BITS - 1, math.ceil(math.log2(max(1.0, total / capacity))) + 2)
    while True:
        cells = stored(keys.groupBy(_cell("key", depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "exact-cells")
        if depth == _KEY_BITS - 1 or (cells.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth = min(depth + 6, _KEY_BITS - 1)
    level = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local"))
    prefix = level.withColumn("bucket", F.expr(f"shiftleft(1L, local) + shiftrightunsigned(cell, {depth} - local)"))
    fits = prefix.groupBy("local", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("local") == depth))
    first = prefix.join(fits, ["local", "bucket"]).groupBy("cell").agg(F.min(F.struct("local", "bucket")).alias("at"))
    return depth, stored(first.select("cell", "at.bucket"), "exact-directory")


def _in_bucket(rows: DataFrame, depth: int, directory: DataFrame) -> DataFrame:
    """Adds the bucket of each row's key, through the directory."""
    return rows.withColumn("cell", _cell("key", depth)).join(directory, "cell").drop("cell")


class Index:
    """An index on shared files.

    rows: id, key, text_sha256 of every row; entries: bucket, key, chain, text_sha256, keep_id, group_size and
    ``first``, the row that stays, for every text. ``chain`` counts the texts of one key.
    """

    def __init__(self, rows: DataFrame, entries: DataFrame, depth: int, directory: DataFrame, total: int):
        self.rows, self.entries, self.depth, self.directory, self.total = rows, entries, depth, directory, total

    def found(self) -> DataFrame:
        """Every row with its entry's keep_id and group_size.

        Entries of hot groups are few, and go to all tasks; the others meet their rows by bucket and key.
        """
        on = ["bucket", "key", "text_sha256"]
        entries = self.entries.select(*on, "keep_id", "group_size")
        return split_join(_in_bucket(self.rows, self.depth, self.directory), entries, on, "group_size", self.total)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, carry: tuple[str, ...] = (), key: Callable[[Column], Column] = F.xxhash64) -> Index:
    """Indexes every row of docs. carry: columns of the row that stays, kept in the entries' ``first``.

    Rows are told apart by the bytes of their normalised texts, whatever ``key`` gives.
    """
    spark = docs.sparkSession
    norm = normalised(text_or_empty(text_col))
    body = text_or_empty(text_col) if carry else norm
    others = [F.col(c).alias(f"_{c}") for c in carry if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body"), (F.col(text_col).isNull()).alias("no_text"), norm.alias("norm"), *others)
    rows = stored(rows.withColumns({"key": key(F.col("norm")), "text_sha256": F.sha2("norm", 256)}).drop("norm"), "exact-rows")
    counts = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = max(HOT_LEAST, total // HOT_PART)
    depth, directory = grow_directory(counts.select("key"), capacity)

    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), *([F.col("no_text"), F.col("body"), *(F.col(f"_{c}") for c in carry if c not in (id_col, text_col))] if carry else []))
    compared = normalised(F.col("body")) if carry else F.col("body")
    group = ["key", "text_sha256", "norm"]
    often = F.broadcast(counts.where(F.col("n") > hot).select("key"))
    heavy = rows.join(often, "key", "left_semi").withColumn("norm", compared).groupBy(*group).agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n"))
    heavy = heavy.select("key", "text_sha256", "first.*", "n") if carry else heavy.select("key", "text_sha256", "first.*", F.col("norm").alias("body"), "n")
    light = rows.join(often, "key", "left_anti").withColumns({"none": F.col("id").isNull(), "n": F.lit(1).cast("long")})
    routed = _in_bucket(light.unionByName(heavy, allowMissingColumns=True), depth, directory).repartition(partitions(spark), "bucket")
    # The owner of a bucket has all its rows: no further exchange for the groups and the chains.
    texts = routed.withColumn("norm", compared).groupBy("bucket", *group).agg(F.min(own).alias("first"), F.sum("n").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("first.none", "first.id", "text_sha256"))
    entries = texts.select("bucket", "key", chain.alias("chain"), "text_sha256", F.col("first.id").alias("keep_id"), "group_size", "first")
    path = fresh_path(spark, "exact-index")
    entries.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    members = stored(rows.select("id", "key", "text_sha256"), "exact-members")
    forget(rows, counts)  # the texts are not needed any more
    return Index(members, spark.read.schema(entries.schema).parquet(path), depth, directory, total)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Returns id, keep_id, group_size, kept, text_sha256: a row per input row.

    Null text counts as empty; empty texts are equal to each other. Of equal texts the row with the
    smallest id stays. Rows without an id are members of their group and stay only if no row of it
    has one. Repeated ids are rows of their own. Other columns are ignored. No rows: no rows.
    """
    found = build_index(docs, id_col, text_col, capacity, key=key).found()
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def first_rows(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The columns of the one row that stays of each text: the smallest id, of equal ids the smallest by the other columns.

    columns must hold id and text and no maps. The row travels with its text, so whole texts are shuffled once.
    """
    entries = build_index(docs, id_col, text_col, capacity, carry=columns).entries
    names = {id_col: F.col("first.id"), text_col: F.when(~F.col("first.no_text"), F.col("first.body"))}
    return entries.select(*(names.get(c, F.col(f"first._{c}")).cast(docs.schema[c].dataType).alias(c) for c in columns))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
