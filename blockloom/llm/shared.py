"""Reading tables and writing intermediate tables to the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of intermediate tables that scratch() may delete, and catalog tables over them.
_made: list[str] = []
_tables: list[str] = []
#: Frames of stored() and their folders.
_folders: dict[int, tuple[DataFrame, str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a session in one process makes its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def catalog_name(name: str) -> str:
    """A new name for a table of the session's catalog that scratch() may drop."""
    _tables.append(f"{name}_{uuid.uuid4().hex}")
    return _tables[-1]


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[id(found)] = (found, path)
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more: all that was made from them has been stored."""
    for table in tables:
        _, path = _folders.pop(id(table))
        discard(table.sparkSession, [path])
        _made.remove(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of intermediate tables; what was made from them must have been stored."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """Deletes at the end what the operators stored inside; write their results inside, elsewhere.

    keep: the number of folders made last that stay, as the caller still reads them.
    """
    since, named = len(_made), len(_tables)
    yield
    for name in _tables[named:]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    del _tables[named:]
    last = len(_made) - keep
    gone = set(_made[since:last])
    discard(spark, sorted(gone))
    del _made[since:last]
    for number in [n for n, (_, path) in _folders.items() if path in gone]:
        del _folders[number]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives the memory that a task no longer uses back to the system: Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a partition's batches; what it held is released after its last batch."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        release()

    return run


def slices(batch: pa.RecordBatch, texts: pa.Array, rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows that begin no more than ``size`` bytes of text (or elements of lists); a longer one is one of its own."""
    lengths = pc.list_value_length(texts) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def below(order: str, n: int, total: int) -> Column:
    """Whether a row is in the hashed sample of about n of total rows; order: a column of 64-bit hashes."""
    share = 1.0 if total <= n else n / total
    return F.shiftrightunsigned(F.col(order), 1) <= F.lit(min(int(share * 2.0**63), (1 << 63) - 1))


#: A key is hot if one in HOT_PART rows has it and LEAST_HOT have it at least; so there are no more than HOT_PART.
HOT_PART, LEAST_HOT = 10_000, 100_000


def split_join(rows: DataFrame, other: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner equi-join with ``other``, which has a row per key with the count of its rows, of ``total`` in all.

    What belongs to hot keys goes to all tasks, so no task gets all rows of such a key. Among fewer rows than LEAST_HOT no key is hot.
    """
    if total <= LEAST_HOT:
        return rows.join(other, on)
    often = F.col(count) > max(LEAST_HOT, total // HOT_PART)
    hot = F.broadcast(other.where(often))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(other.where(~often), on))


#: Ids that a task may hold at once: 16 MB and their hash table.
MOST_BROADCAST_IDS = 1_000_000


def having(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids (distinct, stored). Few ids, by count, go to the scan's tasks; more meet the rows in a shuffle."""
    few = ids.count() <= MOST_BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")
