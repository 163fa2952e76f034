"""Pulls of new rows by a watermark that is kept with what was pulled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def committed(spark: SparkSession, path: str) -> tuple[int, object | None]:
    """(number, watermark) of the last pull that was committed below path; (0, None) before the first."""
    if not _exists(spark, f"{path}/commits"):
        return 0, None
    last = spark.read.parquet(f"{path}/commits").orderBy(F.desc("number")).limit(1).collect()
    return (last[0]["number"], last[0]["watermark"]) if last else (0, None)


def pull(rows: DataFrame, ts: str, path: str) -> tuple[int, DataFrame]:
    """(number, rows) newer than the last watermark, stored below path; then the greatest of their times is the watermark.

    Strictly newer: rows that come later with the watermark's own time, or an earlier one, are never pulled, and none is
    pulled twice. A pull that is broken off before its commit leaves the watermark; the next one takes its place and its number.
    A pull without new rows commits nothing.
    """
    spark = rows.sparkSession
    number, watermark = committed(spark, path)
    number += 1
    new = rows if watermark is None else rows.where(F.col(ts) > F.lit(watermark))
    folder = f"{path}/pulls/number={number}"
    new.where(F.col(ts).isNotNull()).write.mode("overwrite").parquet(folder)
    pulled = spark.read.schema(rows.schema).parquet(folder)
    top = pulled.agg(F.max(ts).alias("watermark")).where("watermark IS NOT NULL").select(F.lit(number).alias("number"), "watermark")
    if top.count():
        top.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number, pulled
