"""Queries over the star schema: catalog coverage, access control, lookups, archives.

Parts stand for catalog tokens, line items for their use, orders for sessions, customers and suppliers for users.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import penalty_score, percent, safe_quality
from ..operators import maintain, predicates, relational
from ..sources.tables import Tables
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL

#: Coverage levels from best to worst.
LEVELS = ("full", "partial", "shimmed", "none", "unsupported")
_LEVEL_SQL = "(CASE p_size % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'shimmed' WHEN 3 THEN 'none' ELSE 'unsupported' END)"


def level() -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), (F.col("p_size") % 5).cast("int"))


@catalog.query(f"""
    SELECT {_LEVEL_SQL} AS level, sum(l_quantity)::BIGINT AS uses, count(DISTINCT l_partkey) AS tokens FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def coverage_by_level(t: Tables) -> DataFrame:
    used = t.lineitem.select("l_partkey", "l_quantity").join(t.part.select(F.col("p_partkey").alias("l_partkey"), level().alias("level")), "l_partkey")
    return used.groupBy("level").agg(F.sum("l_quantity").cast("long").alias("uses"), F.count_distinct("l_partkey").alias("tokens"))


@catalog.query(f"""
    SELECT p_name, p_brand, sum(l_quantity)::BIGINT AS uses FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {_LEVEL_SQL} IN ('none', 'unsupported') AND l_shipdate >= TIMESTAMP '1996-01-01'
    GROUP BY 1, 2 ORDER BY uses DESC, p_name, p_brand LIMIT 20""")
def top_unsupported(t: Tables) -> DataFrame:
    lacking = t.part.where(level().isin("none", "unsupported")).select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    recent = t.lineitem.where(F.col("l_shipdate") >= "1996-01-01").select("l_partkey", "l_quantity")
    return recent.join(lacking, "l_partkey").groupBy("p_name", "p_brand").agg(F.sum("l_quantity").cast("long").alias("uses")).orderBy(F.desc("uses"), "p_name", "p_brand").limit(20)


@catalog.query(f"""
    SELECT l_orderkey, count(*) AS n, count(*) FILTER ({_LEVEL_SQL} = 'full') AS n_full, count(*) FILTER ({_LEVEL_SQL} = 'partial') AS n_partial, count(*) FILTER ({_LEVEL_SQL} = 'shimmed') AS n_shimmed,
           round_even(100.0 * count(*) FILTER ({_LEVEL_SQL} = 'full') / count(*), 1) AS pct_full, max(p_size % 5) AS worst FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def session_coverage(t: Tables) -> DataFrame:
    used = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), level().alias("level"), "p_size"), "l_partkey")
    counts = [F.count_if(F.col("level") == x).alias(f"n_{x}") for x in LEVELS[:3]]
    by_session = used.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), *counts, F.max(F.col("p_size") % 5).alias("worst"))
    return by_session.withColumn("pct_full", percent(F.col("n_full"), F.col("n"), None))


@catalog.query("""
    SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 5000 WHERE l_returnflag = 'R'""")
def inner_then_left(t: Tables) -> DataFrame:
    """An inner join, then a left join whose condition on the right side is applied before it."""
    rich = t.supplier.where(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    lines = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(rich, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@catalog.query("""
    SELECT a.l_orderkey, a.l_linenumber, a.l_shipdate - b.o_orderdate > INTERVAL 60 DAY AS late FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey AND a.l_quantity > b.o_orderkey % 50""")
def composite_join(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").join(orders, "l_orderkey").where(F.col("l_quantity") > F.col("l_orderkey") % 50)
    return joined.select("l_orderkey", "l_linenumber", (F.col("l_shipdate") - F.col("o_orderdate") > F.expr("INTERVAL 60 DAYS")).alias("late"))


@catalog.query("""
    SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)
        OR EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = o_custkey AND n_regionkey = 2 AND c_mktsegment = 'BUILDING')""")
def visible_sessions(t: Tables) -> DataFrame:
    """Access by owner, by collaboration or by group, as one semi join."""
    owned = t.orders.where(F.col("o_custkey") == 7).select("o_orderkey")
    shared = t.lineitem.where(F.col("l_suppkey") == 7).select("l_orderkey")
    members = t.customer.where(F.col("c_mktsegment") == "BUILDING").join(t.nation.where(F.col("n_regionkey") == 2), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    grouped = t.orders.join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return relational.visible_to(t.orders.select("o_orderkey"), "o_orderkey", owned, shared, grouped)


@catalog.query("""
    SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey <> 3 AND c_nationkey IN (
        SELECT c_nationkey FROM customer WHERE c_custkey = 3 UNION SELECT s_nationkey FROM supplier WHERE s_suppkey IN (1, 2) UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 4)
    AND c_name ILIKE '%00001%'""")
def peers(t: Tables) -> DataFrame:
    """Members of the places that user 3 shares, found by three sets of ids."""
    own = t.customer.where(F.col("c_custkey") == 3).select("c_nationkey")
    others = t.customer.where((F.col("c_custkey") != 3) & F.col("c_name").ilike("%00001%")).select("c_custkey", "c_name", "c_nationkey")
    places = (own, t.supplier.where(F.col("s_suppkey").isin(1, 2)).select("s_nationkey"), t.nation.where(F.col("n_regionkey") == 4).select("n_nationkey"))
    return relational.visible_to(others, "c_nationkey", *places).select("c_custkey", "c_name")


@catalog.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def orphaned_users(t: Tables) -> DataFrame:
    return maintain.orphans(t.customer.select("c_custkey"), t.orders.where(F.col("o_totalprice") > 250000).select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@catalog.query("""
    SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_final FROM customer""")
def correlated_counts(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderstatus")
    return relational.with_counts(t.customer.select("c_custkey"), "c_custkey", (orders, "o_custkey", "n_orders"), (orders.where(F.col("o_orderstatus") == "F"), "o_custkey", "n_final"))


@catalog.query("""
    SELECT n_name, count(DISTINCT s_suppkey) AS n_links, count(c_custkey) FILTER (c_acctbal > 0) AS n_uses_multiplied
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def coverage_view_multiplied(t: Tables) -> DataFrame:
    """The materialised view's own counts: two facts joined first, so uses are multiplied by links. Each fact is counted by nation before the join, which then has a row for each nation."""
    links = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_rows"))
    uses = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("n_uses"))
    nations = t.nation.select("n_nationkey", "n_name")
    multiplied = nations.join(links, "n_nationkey", "left").join(uses, "n_nationkey", "left")
    multiplied = multiplied.groupBy("n_name").agg(F.coalesce(F.sum(F.coalesce("n_rows", F.lit(1)) * F.col("n_uses")), F.lit(0).cast("long")).alias("n_uses_multiplied"))
    linked = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(F.broadcast(nations), "n_nationkey")
    distinct = linked.groupBy("n_name").agg(F.count_distinct("s_suppkey").alias("n_links"))
    return multiplied.join(distinct, multiplied.n_name.eqNullSafe(distinct.n_name), "left").select(multiplied.n_name, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_uses_multiplied")


@catalog.query("""
    SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_links, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS n_uses FROM nation""")
def coverage_view(t: Tables) -> DataFrame:
    """The live view: each fact is counted on its own."""
    users = t.customer.where(F.col("c_acctbal") > 0)
    return relational.with_counts(t.nation.select("n_nationkey", "n_name"), "n_nationkey", (t.supplier, "s_nationkey", "n_links"), (users, "c_nationkey", "n_uses")).drop("n_nationkey")


@catalog.query("""
    SELECT n_name, list_sort(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 9900)) AS segments, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS best_building FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def filtered_array_agg(t: Tables) -> DataFrame:
    """An array of distinct values under a filter: null, not empty, where there are none."""
    joined = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    found = F.array_sort(F.collect_set(F.when(F.col("c_acctbal") > 9900, F.col("c_mktsegment"))))
    return joined.groupBy("n_name").agg(F.when(F.size(found) > 0, found).alias("segments"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("best_building"))


def resolved_parts(t: Tables, lines: DataFrame) -> DataFrame:
    facts = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("Brand#"), F.col("l_suppkey") % 30).alias("brand"), (F.col("l_partkey") % 60).alias("size"))
    keys = facts.select("brand", "size").distinct()
    parts = t.part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("token"))
    rules = [[(F.col("f.brand"), F.col("d.p_brand")), (F.col("f.size"), F.col("d.p_size"))], [(F.col("f.brand"), F.col("d.p_brand"))]]
    found = relational.fallback_lookup(keys, parts, ["brand", "size"], rules, F.col("token"))
    return facts.join(found.select("brand", "size", "token", "matched_rule"), ["brand", "size"]).select("l_orderkey", "l_linenumber", "token", "matched_rule")


@catalog.query("""
    SELECT l_orderkey, l_linenumber, coalesce(a.p_partkey, b.p_partkey) AS token, CASE WHEN a.p_partkey IS NOT NULL THEN 0 WHEN b.p_partkey IS NOT NULL THEN 1 END AS matched_rule
    FROM (SELECT *, 'Brand#' || (l_suppkey % 30) AS brand, l_partkey % 60 AS size FROM lineitem) l
    LEFT JOIN (SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2) a ON a.p_brand = l.brand AND a.p_size = l.size
    LEFT JOIN (SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1) b ON b.p_brand = l.brand""")
def fallback_lookup(t: Tables) -> DataFrame:
    """Every line item resolved by brand and size, else by brand alone."""
    return resolved_parts(t, t.lineitem)


@catalog.query("""
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 7 FROM supplier) UNION ALL SELECT s_suppkey * 7, 'NEW' FROM supplier""")
def upserted(t: Tables) -> DataFrame:
    """All customers, with a change for every seventh; the changes grow with the suppliers."""
    from ..operators.maintain import upsert

    new = t.supplier.select((F.col("s_suppkey") * 7).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return upsert(t.customer.select("c_custkey", "c_mktsegment"), new, ["c_custkey"])


@catalog.query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> c_custkey % 25")
def foreign_members(t: Tables) -> DataFrame:
    """All members that do not belong to their owner."""
    owned = t.customer.select("c_custkey", (F.col("c_custkey") % 25).cast("int").alias("c_nationkey"))
    return relational.all_belong(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", owned)


@catalog.query("""
    SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size IN (SELECT p_size FROM part WHERE p_partkey < 8)
    GROUP BY l_suppkey HAVING count(DISTINCT p_size) = (SELECT count(DISTINCT p_size) FROM part WHERE p_partkey < 8)""")
def covers_all(t: Tables) -> DataFrame:
    """Suppliers that have had every wanted size: relational division."""
    held = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey").select("l_suppkey", "p_size").distinct()
    return relational.covering(held, "l_suppkey", "p_size", t.part.where(F.col("p_partkey") < 8).select("p_size"))


@catalog.query("""
    SELECT o_orderkey, greatest(0, 100 - 30 * count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.08) - 5 * count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'N'))::BIGINT AS score,
           greatest(1, ceil((2 * count(l_orderkey) + 60 * count(*) FILTER (l_returnflag = 'R') + 30 * count(*) FILTER (l_returnflag = 'A')) / 60.0))::BIGINT AS minutes
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def quality_score(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if((flag == "R") & (F.col("l_discount") > 0.08)).alias("errors"), F.count_if(flag == "A").alias("risky"), F.count_if(flag == "N").alias("others"), F.count(F.lit(1)).alias("n"), F.count_if(flag == "R").alias("r")
    )
    both = t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0)
    return both.select("o_orderkey", penalty_score(F.col("errors"), F.col("risky"), F.col("others")).alias("score"), safe_quality(F.col("n"), F.col("r"), F.col("risky")).alias("minutes"))


@catalog.query("""
    SELECT o_orderkey, count(l_orderkey) AS n_blocks, count(DISTINCT l_partkey) AS n_tokens, coalesce(sum(l_quantity), 0)::BIGINT AS uses, count(*) FILTER (l_returnflag = 'R') AS n_errors,
           round_even(date_diff('minute', o_orderdate, max(l_shipdate)) / 1440.0, 1) AS days
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1996-06-01' GROUP BY o_orderkey, o_orderdate""")
def archive_rows(t: Tables) -> DataFrame:
    """What remains of expired sessions: one aggregate per source, joined on the session."""
    old, _ = maintain.expired(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1996-06-01", 0)
    facts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("l_partkey").alias("n_tokens"), F.sum("l_quantity").cast("long").alias("uses"), F.count_if(F.col("l_returnflag") == "R").alias("n_errors"), F.max("l_shipdate").alias("last")
    )
    both = old.join(facts, "o_orderkey", "left").fillna(0, ["n_blocks", "n_tokens", "uses", "n_errors"])
    minutes = F.floor((F.unix_timestamp("last") - F.unix_timestamp("o_orderdate")) / 60)
    return both.select("o_orderkey", "n_blocks", "n_tokens", "uses", "n_errors", F.bround(minutes / 1440.0, 1).alias("days"))


@catalog.query("""
    SELECT o_orderpriority AS label, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'O') AS done, count(*) AS total FROM orders GROUP BY 1
    UNION ALL SELECT 'none', 0, 0, 0""")
def tab_statistics(t: Tables) -> DataFrame:
    """Pending, done and total of every tab of a fixed list, 0 for tabs without rows."""
    tabs = t.spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none")], "label string")
    status = F.col("o_orderstatus")
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("label")).agg(F.count_if(status == "O").alias("pending"), F.count_if(status != "O").alias("done"), F.count(F.lit(1)).alias("total"))
    return relational.complete(tabs, counts, "label", "pending", "done", "total")


@catalog.query("""
    SELECT lower(coalesce(c_mktsegment, '')) AS merge_key, min(CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END) AS priority, min_by(c_custkey, {'a': CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END, 'b': c_custkey}) AS c_custkey FROM customer GROUP BY 1""")
def active_over_pending(t: Tables) -> DataFrame:
    """One row per key from two lists: an active one wins over a pending one."""
    flagged = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    rank = lambda base: F.struct(F.lit(base).alias("a"), F.col("c_custkey").alias("b"))
    active = flagged.where(F.col("c_acctbal") > 0).select("c_custkey", "c_mktsegment", rank(0).alias("rank"))
    pending = flagged.where(~(F.col("c_acctbal") > 0)).select("c_custkey", "c_mktsegment", rank(1).alias("rank"))
    merged = relational.merge_by_priority(F.lower(F.coalesce("c_mktsegment", F.lit(""))), "rank", active, pending)
    return merged.select("merge_key", F.col("rank.a").alias("priority"), "c_custkey")


@catalog.query("""
    SELECT c_nationkey, list(c_custkey ORDER BY c_acctbal DESC, c_custkey)[1:3] AS top FROM customer GROUP BY c_nationkey""")
def top_members(t: Tables) -> DataFrame:
    """The first three of an ordered list per group, ranked before they are collected."""
    best = relational.keep_first(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], 3, F.desc("c_acctbal"), F.col("c_custkey"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey")))
    return best.groupBy("c_nationkey").agg(F.transform(listed, lambda s: s["c_custkey"]).alias("top"))


@catalog.query("""
    SELECT p_type, n, examples FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) JOIN (
        SELECT p_type, list(p_name || ' ' || p_partkey ORDER BY p_name, p_partkey) AS examples FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) <= 10) GROUP BY 1) USING (p_type)""")
def histogram_with_examples(t: Tables) -> DataFrame:
    """Counts by bucket with at most ten examples each."""
    some = relational.keep_first(t.part.select("p_type", "p_name", "p_partkey"), ["p_type"], 10, F.col("p_name"), F.col("p_partkey"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))), lambda s: F.concat_ws(" ", s["p_name"], s["p_partkey"]))
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).join(some.groupBy("p_type").agg(listed.alias("examples")), "p_type")


@catalog.query("""
    SELECT l_orderkey, CASE max(l_quantity::INT % 5) WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'shimmed' WHEN 3 THEN 'none' ELSE 'unsupported' END AS verdict FROM lineitem GROUP BY 1""")
def worst_verdict(t: Tables) -> DataFrame:
    """The worst of a session's verdicts, as ranks: an ordered lattice folds by max."""
    rank = F.max(F.col("l_quantity").cast("int") % 5)
    return t.lineitem.groupBy("l_orderkey").agg(rank.alias("r")).select("l_orderkey", F.get(F.array(*map(F.lit, LEVELS)), F.col("r")).alias("verdict"))


@catalog.query("""
    SELECT r_name, p.* FROM region, (SELECT (SELECT count(*) FROM customer) AS n_users, (SELECT sum(c_acctbal) FROM customer)::DECIMAL(18,2) AS balance, (SELECT max(o_totalprice) FROM orders) AS dearest) p""")
def scalar_subqueries(t: Tables) -> DataFrame:
    """One-row aggregates side by side."""
    one = t.customer.agg(F.count(F.lit(1)).alias("n_users"), F.sum("c_acctbal").cast("decimal(18,2)").alias("balance"))
    other = t.orders.agg(F.max("o_totalprice").alias("dearest"))
    return t.region.select("r_name").join(F.broadcast(one)).join(F.broadcast(other))


@catalog.query("""
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND (c_name ILIKE '%9%' OR c_mktsegment ILIKE '%9%') ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20""")
def search_page(t: Tables) -> DataFrame:
    """Optional filters, search over two columns, a sort by name and the second page."""
    asked = [predicates.equals("c_mktsegment", "BUILDING"), predicates.equals("c_nationkey", None), F.col("c_acctbal") > 0, predicates.search_any("9", "c_name", "c_mktsegment")]
    found = predicates.where_all(t.customer, asked).select("c_custkey", "c_name", "c_acctbal")
    return predicates.page(predicates.sorted_by(found, {"balance": [F.col("c_acctbal")], "default": [F.col("c_name")]}, "balance", True, "c_custkey"), 2, 20)


@catalog.query("""
    SELECT count(*) AS total_count, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_name ILIKE '%9%'""")
def search_page_count(t: Tables) -> DataFrame:
    asked = [predicates.equals("c_mktsegment", "BUILDING"), F.col("c_acctbal") > 0, predicates.search_any("9", "c_name")]
    return predicates.page_count(predicates.where_all(t.customer, asked), 20)


@catalog.query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'owner' WHEN l.n > 4 THEN 'editor' ELSE 'viewer' END AS role FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def resolved_role(t: Tables) -> DataFrame:
    """Owner first, then a collaborator's role, else viewer."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    role = F.when(F.col("o_custkey") % 3 == 0, "owner").when(F.col("n") > 4, "editor").otherwise("viewer")
    return t.orders.select("o_orderkey", "o_custkey").join(n, "o_orderkey", "left").select("o_orderkey", role.alias("role"))


@catalog.query("""
    SELECT p_partkey, p_name FROM part WHERE (p_brand = 'Brand#1' OR p_size > 48) ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_size % 2 = 0 DESC, p_partkey LIMIT 25""")
def custom_rank_order(t: Tables) -> DataFrame:
    rank = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    found = t.part.where((F.col("p_brand") == "Brand#1") | (F.col("p_size") > 48))
    return found.orderBy(rank, (F.col("p_size") % 2 == 0).desc(), "p_partkey").limit(25).select("p_partkey", "p_name")


@catalog.query("""
    SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part""")
def flattened_tags(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("tag")).distinct()


@catalog.query("""
    SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'F' ELSE 'O' END AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1999-01-01' GROUP BY 1, 2""")
def scope_switch(t: Tables) -> DataFrame:
    """History before a date, active rows after it, within a range."""
    day = F.col("o_orderdate")
    scope = F.col("o_orderstatus") == F.when(day < "1997-01-01", "F").otherwise("O")
    return t.orders.where(scope & day.between("1994-01-01", "1999-01-01")).groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("""
    SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + coalesce((SELECT max(s_suppkey % 7) FROM supplier WHERE s_suppkey % 100 = o_custkey % 100), 0) AS version FROM orders""")
def next_versions(t: Tables) -> DataFrame:
    """New rows are numbered on from the greatest number in use."""
    used = t.supplier.select((F.col("s_suppkey") % 100).alias("slot"), (F.col("s_suppkey") % 7).alias("version"))
    most = used.groupBy("slot").agg(F.max("version").alias("most"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = t.orders.select("o_orderkey", "o_custkey", rank.alias("rank"), (F.col("o_custkey") % 100).alias("slot"))
    return orders.join(most, "slot", "left").select("o_orderkey", "o_custkey", (F.col("rank") + F.coalesce("most", F.lit(0))).alias("version"))


@catalog.query("""
    SELECT c_custkey, lower(c_mktsegment) || '-' || c_nationkey AS slug, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE left(c_name, 10) || '…' END AS label FROM customer""")
def slugs_and_labels(t: Tables) -> DataFrame:
    from ..functions.columns import shortened, slug

    return t.customer.select("c_custkey", slug(F.concat_ws(" / ", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("slug"), F.when(F.col("c_acctbal") < 0, "debt").otherwise(shortened(F.col("c_name"), 10)).alias("label"))


@catalog.query("""
    SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS names FROM nation GROUP BY 1 HAVING count(*) >= 5""")
def groups_of_names(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("names"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5).drop("n")


@catalog.query("""
    SELECT p_partkey, s_suppkey AS start_at, s_name FROM part ASOF JOIN supplier ON p_partkey % 5 = s_suppkey % 5 AND p_partkey % 100 >= s_suppkey""")
def line_to_block(t: Tables) -> DataFrame:
    """As-of lookup: each line with the block of the greatest start at or before it."""
    lines = t.part.select((F.col("p_partkey") % 100).alias("line"), "p_partkey", (F.col("p_partkey") % 5).alias("doc"))
    blocks = t.supplier.select(F.col("s_suppkey").alias("start_at"), "s_name", (F.col("s_suppkey") % 5).alias("doc"))
    return relational.closest_start(lines, "line", blocks, "start_at", ["doc"]).select("p_partkey", "start_at", "s_name")


@catalog.query("""
    SELECT DISTINCT p_size AS cp FROM part WHERE p_size BETWEEN 3 AND 7 OR p_size BETWEEN 20 AND 22 OR p_size BETWEEN 40 AND 45""")
def range_containment(t: Tables) -> DataFrame:
    """Code points that a charset of ranges covers."""
    ranges = t.spark.createDataFrame([([(3, 7), (20, 22), (40, 45)],)], "charset array<struct<lo:int,hi:int>>").select(F.explode("charset").alias("r"))
    points = t.part.select(F.col("p_size").alias("cp")).distinct()
    return points.join(F.broadcast(ranges), F.col("cp").between(F.col("r.lo"), F.col("r.hi")), "left_semi")


def _summed(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


@catalog.query("""
    SELECT 'user' AS kind, c_nationkey AS place FROM customer UNION SELECT 'seller', s_nationkey FROM supplier UNION SELECT 'nation', n_nationkey FROM nation""")
def union_of_ids(t: Tables) -> DataFrame:
    return _summed([
        t.customer.select(F.lit("user").alias("kind"), F.col("c_nationkey").alias("place")), t.supplier.select(F.lit("seller"), "s_nationkey"), t.nation.select(F.lit("nation"), "n_nationkey"),
    ]).distinct()
