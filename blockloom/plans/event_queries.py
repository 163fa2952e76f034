"""Queries on the event log: usage, health, ledgers, pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import credits, distinct_with_null, percent
from ..operators import predicates, relational
from ..sources.tables import Tables
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL


def _as_of(t: Tables):
    """The newest event: the clock of these reports."""
    return t.events.agg(F.max("ts")).first()[0]


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


@catalog.query("""
    SELECT event_type, count(*) AS hits, count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS users, count(*) FILTER (value > 50) AS flagged
    FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY event_type ORDER BY hits DESC, event_type LIMIT 3""")
def event_top_types(t: Tables) -> DataFrame:
    recent = t.events.where(predicates.within_days("ts", _as_of(t), 14))
    usage = recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("hits"), distinct_with_null("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("flagged"))
    return usage.orderBy(F.desc("hits"), "event_type").limit(3)


@catalog.query("""
    SELECT event_type, date_trunc('day', ts) AS day, count(*) AS hits, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def event_source_mix(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("user_id").alias("users"))


@catalog.query("""
    SELECT event_type, count(*) AS n, CASE WHEN sum(count(*)) OVER () = 0 THEN 0 ELSE round_even(100.0 * count(*) FILTER (value > 30) / count(*), 1) END AS pct_large,
           round_even(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct_of_all FROM events GROUP BY event_type""")
def event_window_pct(t: Tables) -> DataFrame:
    by_type = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 30).alias("large"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over a row per type
    return by_type.select("event_type", "n", percent(F.col("large"), F.col("n")).alias("pct_large"), percent(F.col("n"), total).alias("pct_of_all"))


@catalog.query("""
    SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def event_last_per_user(t: Tables) -> DataFrame:
    return relational.first_per_key(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], F.desc("ts"), F.col("event_id"))


@catalog.query("""
    SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3""")
def event_keep_newest_3(t: Tables) -> DataFrame:
    return relational.keep_first(t.events.select("user_id", "event_id", "ts"), ["user_id"], 3, F.desc("ts"), F.col("event_id")).drop("ts")


@catalog.query("""
    SELECT user_id, count(*) AS n_pruned FROM (SELECT user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) > 50) GROUP BY user_id""")
def event_prune_beyond_50(t: Tables) -> DataFrame:
    rest = relational.beyond_first(t.events.select("user_id", "event_id", "ts"), ["user_id"], 50, F.desc("ts"), F.col("event_id"))
    return rest.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pruned"))


@catalog.query("""
    SELECT user_id, count(*) AS runs, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
           round(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv, round(count(*) FILTER (event_type = 'error') * 1.0 / nullif(count(*), 0), 6) AS fail_rate,
           round(0.35 * count(*) FILTER (event_type = 'error') / nullif(count(*), 0) + 0.25 * count(*) FILTER (event_type = 'signup') / nullif(count(*), 0), 6) AS flake_score
    FROM events GROUP BY user_id""")
def event_health(t: Tables) -> DataFrame:
    """A health view: duration percentiles, variation, failure rate, flake score."""
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    fails, retries = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "signup")
    return t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.percentile("value", 0.5), 6).alias("p50"),
        F.round(F.percentile("value", 0.95), 6).alias("p95"),
        F.round(F.stddev_samp("value") / F.nullif(F.avg("value"), F.lit(0.0)), 6).alias("cv"),
        F.round(fails / n, 6).alias("fail_rate"),
        F.round(0.35 * fails / n + 0.25 * retries / n, 6).alias("flake_score"),
    )


@catalog.query("""
    SELECT user_id, min(event_type) AS usual_type FROM (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1 GROUP BY user_id""")
def event_mode_by_user(t: Tables) -> DataFrame:
    """The most frequent type; of equally frequent ones the first in order."""
    return t.events.groupBy("user_id").agg(F.mode("event_type", True).alias("usual_type"))


@catalog.query("""
    SELECT user_id, quantile_disc(value, 0.9) AS p90_nearest FROM events GROUP BY user_id""")
def event_nearest_rank(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90_nearest"))


@catalog.query("""
    SELECT date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def event_daily_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@catalog.query("""
    SELECT event_type, (props::JSON->>'k')::BIGINT % 10 AS bucket, count(*) AS n, sum((props::JSON->>'k')::BIGINT) AS k_sum FROM events GROUP BY 1, 2""")
def event_props_stats(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", (_k() % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(_k()).alias("k_sum"))


@catalog.query("""
    SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END * (props::JSON->>'k')::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS balance FROM events""")
def event_running_balance(t: Tables) -> DataFrame:
    """A ledger of signed deltas: the balance is their running sum."""
    delta = F.when(F.col("event_type") == "purchase", -_k()).otherwise(_k())
    return t.events.select("event_id", "user_id", F.sum(delta).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("balance"))


@catalog.query("""
    SELECT event_id, greatest(1, ceil((props::JSON->>'k')::BIGINT * 37 / 1000.0 * 1.25 + (props::JSON->>'k')::BIGINT * 11 / 1000.0 * 3.5))::BIGINT AS credits FROM events""")
def event_credit_cost(t: Tables) -> DataFrame:
    return t.events.select("event_id", credits(_k() * 37, _k() * 11, "1.25", "3.5").alias("credits"))


@catalog.query("""
    SELECT user_id, coalesce(sum(value) FILTER (event_type = 'purchase'), 0)::DECIMAL(18,2) AS spent, count(*) AS n FROM events
    WHERE ts >= date_trunc('month', (SELECT max(ts) FROM events)) GROUP BY user_id""")
def event_month_to_date(t: Tables) -> DataFrame:
    recent = t.events.where(F.col("ts") >= F.date_trunc("month", F.lit(_as_of(t))))
    spent = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0))
    return recent.groupBy("user_id").agg(spent.cast("decimal(18,2)").alias("spent"), F.count(F.lit(1)).alias("n"))


@catalog.query("""
    SELECT user_id, count(*) AS n FROM events WHERE ts >= date_trunc('day', (SELECT max(ts) FROM events)) AND event_type = 'click' GROUP BY user_id""")
def event_day_quota(t: Tables) -> DataFrame:
    """Uses of one tool since midnight, by user."""
    today = t.events.where((F.col("ts") >= F.date_trunc("day", F.lit(_as_of(t)))) & (F.col("event_type") == "click"))
    return today.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("""
    SELECT user_id, event_type, count(*) AS uses, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def event_upsert_sum(t: Tables) -> DataFrame:
    """Upsert with increment: what was counted before day 15 merged with what came after."""
    from ..operators.maintain import upsert_counts

    usage = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("uses"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    cut = F.lit("2024-01-15").cast("timestamp")
    return upsert_counts(usage(t.events.where(F.col("ts") < cut)), usage(t.events.where(F.col("ts") >= cut)), ["user_id", "event_type"], "uses", "first_seen", "last_seen")


@catalog.query("""
    SELECT event_id, ts, nullif(regexp_extract(props, '"k": ?([0-9]+)', 1), '') AS code FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-20 00:00:00'""")
def event_watermark_pull(t: Tables) -> DataFrame:
    """What a monitor has not seen yet: strictly newer than the stored watermark."""
    code = F.coalesce(F.nullif(F.regexp_extract("props", '"k": ?([0-9]+)', 1), F.lit("")), F.nullif(F.regexp_extract("props", '"code": ?"([^"]*)"', 1), F.lit("")))
    return t.events.where((F.col("event_type") == "error") & (F.col("ts") > F.lit("2024-01-20").cast("timestamp"))).select("event_id", "ts", code.alias("code"))


@catalog.query("""
    SELECT c.event_id, coalesce(list(e.event_id ORDER BY e.ts DESC, e.event_id DESC) FILTER (e.event_id IS NOT NULL), []) AS trail
    FROM (SELECT * FROM events WHERE event_type = 'error') c LEFT JOIN LATERAL (
        SELECT x.event_id, x.ts FROM events x WHERE x.user_id = c.user_id AND x.ts < c.ts AND x.ts >= c.ts - INTERVAL 600 MINUTE ORDER BY x.ts DESC, x.event_id DESC LIMIT 3) e ON true
    GROUP BY c.event_id""")
def event_look_back(t: Tables) -> DataFrame:
    """Each error with the newest three events of its user in the ten hours before."""
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    return relational.look_back(events.where(F.col("event_type") == "error"), events, ["user_id"], "event_id", "ts", 600, 3, "event_id")


@catalog.query("""
    SELECT day, n, sum(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS trailing_7 FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)""")
def event_trailing_week(t: Tables) -> DataFrame:
    """Trailing sums over a row per day, joined by day so that no task gets all of history."""
    days = t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spread = days.select(F.explode(F.sequence("day", F.col("day") + F.make_interval(days=F.lit(6)), F.expr("INTERVAL 1 DAY"))).alias("day"), F.col("n").alias("part"))
    return days.join(spread, "day").groupBy("day", "n").agg(F.sum("part").alias("trailing_7"))


@catalog.query("""
    SELECT regexp_extract(props, '"k": ?([0-9])', 1) AS class, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, class LIMIT 5""")
def event_error_classes(t: Tables) -> DataFrame:
    by_class = t.events.where(F.col("event_type") == "error").groupBy(F.regexp_extract("props", '"k": ?([0-9])', 1).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return by_class.orderBy(F.desc("n"), "class").limit(5)


@catalog.query("""
    SELECT array_to_string(list(n || ' ' || event_type ORDER BY event_type), ', ') AS summary FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def event_summary_line(t: Tables) -> DataFrame:
    by_type = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return by_type.agg(F.expr("listagg(concat(n, ' ', event_type), ', ') WITHIN GROUP (ORDER BY event_type)").alias("summary"))


@catalog.query("""
    SELECT user_id, to_json(map_from_entries(list({'k': event_type, 'v': n} ORDER BY event_type)))::VARCHAR AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def event_count_objects(t: Tables) -> DataFrame:
    """An object {type: n} for each user."""
    by_type = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))
    return by_type.groupBy("user_id").agg(F.to_json(entries).alias("counts"))
