"""Readers and writers of tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The Parquet tables below a folder, read when asked for: tables.events, tables["events"]."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many tasks as there are shuffle partitions: small rows of few files that become long texts, before they do."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def live(df: DataFrame, deleted_at: str = "deleted_at", include_deleted: bool = False) -> DataFrame:
    """Rows that are not soft-deleted; all of them on request, or if the table has no such column."""
    return df if include_deleted or deleted_at not in df.columns else df.where(F.col(deleted_at).isNull())


def visible_documents(df: DataFrame) -> DataFrame:
    """Live documents that are neither templates nor playground copies (a null flag counts as false)."""
    flags = [c for c in ("is_template", "is_playground") if c in df.columns]
    out = live(df)
    for flag in flags:
        out = out.where(~F.coalesce(F.col(flag), F.lit(False)))
    return out


def whole_texts(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """path, text: a row per file, for the text parsers."""
    files = spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def looks_like_lml(text: Column) -> Column:
    """Whether one of the first 40 lines opens a block with @name."""
    head = F.slice(F.split(text, "\n"), 1, 40)
    return F.exists(head, lambda line: line.rlike(r"^\s*@[A-Za-z][A-Za-z0-9_-]*(\[|\s*$|\s)"))


def piped_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a dump with fields separated by |, spaces around them dropped."""
    raw = spark.read.schema(schema).csv(path, sep="|", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.dropna("all")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header, as monitoring pulls are kept."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; a session in one process may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="blockloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
