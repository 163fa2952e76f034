"""Streams drained to the end, and the stateful folds in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables, scratch_folder
from ..streaming import events as stream
from ..streaming import monitor
from ..streaming import presence as documents
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@catalog.query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(t: Tables) -> DataFrame:
    return stream.run_once(stream.windowed_counts(stream.event_stream(t.spark, t.folder), "ts", "event_type"))


@catalog.query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_deduplicated(t: Tables) -> DataFrame:
    """Every event delivered twice, counted once."""
    once = stream.event_stream(t.spark, t.folder).select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    unique = stream.run_once(stream.deduplicated(once, "ts", ["event_id"], "60 days"), "append")
    return unique.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("""
    SELECT e.event_type, count(*) AS n, count(d.first_part) AS n_resolved FROM events e LEFT JOIN (SELECT p_size, min(p_partkey) AS first_part FROM part GROUP BY 1) d ON d.p_size = (e.user_id % 60) GROUP BY 1""")
def stream_resolved(t: Tables) -> DataFrame:
    parts = t.part.select("p_size", "p_partkey")
    rows = stream.event_stream(t.spark, t.folder).withColumn("p_size", (F.col("user_id") % 60).cast("int"))
    found = stream.resolved(rows, parts, "p_size", "p_partkey")
    return stream.run_once(found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("p_partkey").alias("n_resolved")))


@catalog.query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(t: Tables) -> DataFrame:
    return stream.sessions(t.events, "ts", "user_id")


@catalog.query("""
    WITH RECURSIVE k AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
        UNION ALL SELECT k.user_id, min(e.ts) AS ts FROM k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 6 HOUR GROUP BY k.user_id, k.ts)
    SELECT user_id, ts FROM k""")
def event_throttled(t: Tables) -> DataFrame:
    """Snapshots at most every six hours: measured from the last one kept."""
    return stream.throttled(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 6 * 3600).where("kept").select("user_id", "ts")


@catalog.query("""
    WITH RECURSIVE k AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
        UNION ALL SELECT k.user_id, min(e.ts) AS ts FROM k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 1 HOUR GROUP BY k.user_id, k.ts)
    SELECT k.user_id, k.ts AS bucket_start, count(*) AS hits FROM events e ASOF JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts GROUP BY 1, 2""")
def event_rate_buckets(t: Tables) -> DataFrame:
    """Hits per rate bucket: a bucket opens at a hit and lasts an hour; the next hit after it opens another."""
    rows = stream.throttled(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 3600)
    return rows.groupBy("user_id", "bucket").agg(F.min("ts").alias("bucket_start"), F.count(F.lit(1)).alias("hits")).drop("bucket")


@catalog.query("""
    SELECT doc, user_id FROM (SELECT user_id % 7 AS doc, user_id, arg_max(event_type, ts) AS last FROM events GROUP BY 1, 2) WHERE last <> 'signup'""")
def event_presence(t: Tables) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "leave").otherwise("join")
    rows = t.events.select((F.col("user_id") % 7).alias("doc"), "user_id", "ts", action.alias("action"))
    return stream.presence(rows, "doc", "user_id", "ts", "action")


def editor_actions(events: DataFrame) -> DataFrame:
    """Events as actions of users on blocks of seven documents: signups leave, purchases unlock, errors and views lock, others join."""
    kinds = {"signup": "leave", "purchase": "unlock", "error": "lock", "view": "lock"}
    action = F.coalesce(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")], F.lit("join"))
    return events.select((F.col("user_id") % 7).alias("doc"), "user_id", (F.col("event_id") % 5).alias("block"), "ts", "event_id", action.alias("action"))


def _changes(t: Tables, streamed: bool) -> DataFrame:
    rows = editor_actions(stream.event_stream(t.spark, t.folder) if streamed else t.events)
    log = documents.changes(rows, "doc", "user_id", "block", "ts", "event_id", "action", 3600)
    with documents.rocks_state(t.spark):
        return stream.run_once(log, "append") if streamed else log


@catalog.query("""
    SELECT (user_id % 7)::VARCHAR AS document, user_id::VARCHAR AS "user" FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events WHERE event_type NOT IN ('purchase', 'error', 'view') GROUP BY 1) WHERE last <> 'signup'""")
def stream_presence(t: Tables) -> DataFrame:
    """Users in documents, by a stream's state."""
    last = documents.users(editor_actions(stream.event_stream(t.spark, t.folder)), "doc", "user_id", "ts", "event_id", "action")
    return stream.run_once(last).where("action = 'join'").drop("action")


@catalog.query()
def stream_locks(t: Tables) -> DataFrame:
    """Changes of locks by kind, and blocks held at the end, by a stream's state."""
    log = _changes(t, True)
    counts = log.where("block IS NOT NULL").groupBy("document", "change").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(documents.held(log).groupBy("document").agg(F.count(F.lit(1)).alias("n")).select("document", F.lit("held").alias("change"), "n"))


@catalog.query("""
    WITH w AS (SELECT max(ts) AS w FROM events WHERE event_id % 2 = 0 AND event_id % 1000 < 600)
    SELECT event_id, 1 AS pull FROM events WHERE event_id % 2 = 0 AND event_id % 1000 < 600 UNION ALL SELECT event_id, 2 FROM events, w WHERE ts > w""")
def pulled_twice(t: Tables) -> DataFrame:
    """A pull of part of the events, and one when all have come: what is no newer than the first one's newest is lost, nothing comes twice."""
    path = scratch_folder(t.spark, "pulls")
    early = t.events.where("event_id % 2 = 0 AND event_id % 1000 < 600")
    pulls = [monitor.pull(rows, "ts", path) for rows in (early, t.events, t.events)]
    return pulls[0][1].select("event_id", F.lit(1).alias("pull")).unionByName(pulls[1][1].select("event_id", F.lit(2).alias("pull"))).unionByName(pulls[2][1].select("event_id", F.lit(3).alias("pull")))
