"""Event capture and stateful work on streams, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch_folder

#: Events that one client call may bring.
MOST_EVENTS = 100
SOURCES = ("panel", "palette", "slash", "package-modal")
KINDS = ("command", "environment", "declaration", "length", "counter")


def event_stream(spark: SparkSession, folder: str, table: str = "events", files_per_batch: int = 1000) -> DataFrame:
    """A table below a folder as a stream of its files; the schema is that of the table."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{table}.parquet")


def cleaned(events: DataFrame) -> DataFrame:
    """Trimmed names, known kinds and sources; rows with an empty name or an unknown value are dropped."""
    trimmed = events.withColumn("name", F.trim("name")).withColumn("package_slug", F.nullif(F.trim("package_slug"), F.lit("")))
    return trimmed.where((F.col("name") != "") & F.col("kind").isin(*KINDS) & F.col("source").isin(*SOURCES))


def oversized(calls: DataFrame, call: str, most: int = MOST_EVENTS) -> DataFrame:
    """Calls that bring more events than allowed, to be refused as a whole."""
    return calls.groupBy(call).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time for streams; times without a zone are read in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "1 day", late: str | None = "1 day") -> DataFrame:
    """start, key, n per tumbling window; with a watermark on streams, so that state is dropped in time."""
    rows = _watermarked(events, ts, late) if late else events
    return rows.groupBy(F.window(ts, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = "1 day") -> DataFrame:
    rows = _watermarked(events, ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """At-least-once delivery made once: by key within the watermark."""
    return _watermarked(events, ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def resolved(events: DataFrame, dimension: DataFrame, slug: str, dimension_id: str) -> DataFrame:
    """Stream-static lookup of ids at ingest: the first id of a slug; unknown slugs stay, without id."""
    first = dimension.groupBy(slug).agg(F.min(dimension_id).alias(dimension_id))
    return events.join(first, slug, "left")


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Drains what the stream holds now into the shared folder and returns the result table."""
    spark, path = stream.sparkSession, scratch_folder(stream.sparkSession, "drained")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch_folder(spark, "drained-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).select(*stream.columns)


def into_table(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = 3, change: Callable[[DataFrame], DataFrame] | None = None, dropped: str | None = None):
    """Micro-batches appended to a folder; each batch has its own subfolder, so that a repeated batch overwrites itself.

    seconds: the time between batches, or None to drain what is there and stop. dropped: a folder for the numbers, sizes and
    errors of batches that could not be written; with it such a batch is given up and the stream goes on, without it the stream fails.
    """

    def write(batch: DataFrame, number: int) -> None:
        try:
            (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        except Exception as error:
            if dropped is None:
                raise
            lost = batch.agg(F.count(F.lit(1)).alias("n")).select(F.lit(number).cast("long").alias("batch"), "n", F.lit(type(error).__name__).alias("error"))
            lost.write.mode("overwrite").parquet(f"{dropped}/number={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def throttled(events: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Adds kept and bucket: rows at least ``seconds`` after the last kept row of their key open a new bucket.

    After a gap of that length a row is kept whatever came before. So rows are first cut at such gaps, and
    the runs between two gaps, not all rows of a key, are dealt to tasks, which walk them in order.
    """
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    at = F.col(ts).cast("timestamp").cast("double")
    gap = at - F.lag(at).over(order) >= seconds
    cut = events.withColumn("_cut", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, 0.0  # carried from batch to batch: a run of rows may span several
        for batch in batches:
            kept = []
            for own, t in zip(zip(*(batch[c] for c in (*keys, "_cut")), strict=True), batch["_at"], strict=True):
                kept.append(own != run or t - last >= seconds)
                if kept[-1]:
                    run, last = own, t
            yield batch.assign(kept=kept)

    cut = cut.withColumn("_at", at)
    walked = cut.repartition(*keys, "_cut").sortWithinPartitions(*keys, "_cut", ts, tie).mapInPandas(walk, f"{fields}, _at double, kept boolean").drop("_cut", "_at")
    return walked.withColumn("bucket", F.sum(F.col("kept").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def throttled_stream(events: DataFrame, key: str, ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """key, ts of kept rows: the same rule on a stream, with the last kept time of each key as state."""

    def walk(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(batches).sort_values(ts)
        kept = []
        for t in rows[ts]:
            if last is None or (t - last).total_seconds() >= seconds:
                kept.append(t)
                last = t
        if last is not None:
            state.update((int(last.value // 1000) if last.unit == "ns" else int(last.as_unit("us").value),))
        yield pd.DataFrame({key: [group[0]] * len(kept), ts: kept})

    kind = events.schema[key].dataType.simpleString()
    rows = _watermarked(events.select(key, ts), ts, late)
    return rows.groupBy(key).applyInPandasWithState(walk, f"{key} {kind}, {ts} timestamp", "last long", "append", "NoTimeout")


def presence(events: DataFrame, document: str, user: str, ts: str, action: str) -> DataFrame:
    """document, user: who is in a document after its joins and leaves; the last action of a user counts. A row each, so busy documents stay spread."""
    last = events.groupBy(document, user).agg(F.max_by(action, F.struct(ts, action)).alias("_last"))
    return last.where(F.col("_last") != "leave").select(document, user)


def locks(events: DataFrame, document: str, block: str, user: str, ts: str, action: str) -> DataFrame:
    """document, block, user: locks that are held; the last lock or unlock of a block counts, and a leave frees the user's locks."""
    last = events.where(F.col(action).isin("lock", "unlock")).groupBy(document, block).agg(F.max_by(F.struct(user, action, ts), F.struct(ts, action)).alias("l"))
    left = events.where(F.col(action) == "leave").groupBy(document, user).agg(F.max(ts).alias("left_at"))
    held = last.where(F.col(f"l.{action}") == "lock").select(document, block, F.col(f"l.{user}").alias(user), F.col(f"l.{ts}").alias("since"))
    return held.join(left, [document, user], "left").where(F.col("left_at").isNull() | (F.col("left_at") < F.col("since"))).select(document, block, user)


def new_since(events: DataFrame, ts: str, watermark: object | None) -> tuple[DataFrame, DataFrame]:
    """(rows newer than the watermark, a row with the next watermark); equal times are not seen again."""
    rows = events if watermark is None else events.where(F.col(ts) > F.lit(watermark).cast("timestamp"))
    return rows, rows.agg(F.max(ts).alias("watermark"))
