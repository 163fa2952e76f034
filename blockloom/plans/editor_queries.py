"""Queries of an editor's tables: filters, upserts, clones, block contents, import findings, captured events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import blocks, fulltext, latex, maintain, predicates, trees
from ..sources import tables as sources
from ..sources.tables import Tables, spread
from ..streaming import events as stream
from .registry import Catalog

catalog = Catalog()
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@catalog.query("SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def live_lines(t: Tables) -> DataFrame:
    """Soft-deleted rows are left out: returned lines count as deleted."""
    rows = t.lineitem.withColumn("deleted_at", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return sources.live(rows).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@catalog.query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def tsv_extract(t: Tables) -> DataFrame:
    """A table written as a tab-separated extract and read again."""
    path = sources.scratch_folder(t.spark, "extract")
    sources.write_tsv(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
    return t.spark.read.schema("c_custkey long, c_name string, c_acctbal double").csv(path, sep="\t", header=True)


@catalog.query("SELECT p_partkey, p_name, p_size FROM part")
def piped_dump(t: Tables) -> DataFrame:
    """A dump with fields between bars and spaces around them, read again."""
    path = sources.scratch_folder(t.spark, "dump")
    t.part.select(F.concat_ws(" | ", "p_partkey", "p_name", "p_size").alias("value")).write.text(path)
    return sources.piped_rows(t.spark, path, "p_partkey long, p_name string, p_size int")


@catalog.query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def appended_twice(t: Tables) -> DataFrame:
    """A bulk sink: two appends to one folder, by type."""
    path = sources.scratch_folder(t.spark, "appended")
    for _ in range(2):
        sources.append(t.events.select("event_id", "event_type"), path, ("event_type",))
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("""SELECT DISTINCT c_mktsegment AS segment, sha256('{"segment":"' || c_mktsegment || '"}') AS id FROM customer WHERE c_mktsegment >= 'C'""")
def inserted_segments(t: Tables) -> DataFrame:
    """Get-or-insert: names that the dimension lacks, with ids that follow from them."""
    wanted = t.customer.select(F.col("c_mktsegment").alias("segment"))
    return maintain.insert_missing(wanted.where("segment < 'C'").distinct(), wanted, ["segment"])


@catalog.query("""
    SELECT min(c_custkey) AS id, lower(c_mktsegment) || '@' || c_nationkey AS address FROM customer
    WHERE lower(c_mktsegment) || '@' || c_nationkey NOT IN (SELECT 'building@' || s_nationkey FROM supplier WHERE s_acctbal > 0) GROUP BY 2""")
def waitlist_joined(t: Tables) -> DataFrame:
    """New addresses that no active member has, in any case, each once."""
    old = t.supplier.select(F.concat(F.lit("Building@"), "s_nationkey").alias("address"), "s_acctbal")
    new = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.col("c_mktsegment"), F.lit("@"), "c_nationkey").alias("address"))
    return maintain.insert_unless_active(old, new, "address", F.col("s_acctbal") > 0, "id").select("id", F.lower("address").alias("address"))


@catalog.query("SELECT p_type, count(*) AS n FROM part WHERE '[' || p_type LIKE '[E%' GROUP BY 1")
def tagged_parts(t: Tables) -> DataFrame:
    """A literal prefix: the bracket is no wildcard."""
    return t.part.withColumn("tag", F.concat(F.lit("["), "p_type")).where(predicates.begins_with("tag", "[E")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderpriority = '5-LOW'")
def kernel_rows(t: Tables) -> DataFrame:
    """A value that asks for null: low priorities are stored as null here and asked for by name."""
    rows = t.orders.select("o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("package"))
    return predicates.where_all(rows, [predicates.equals("package", "kernel", null_name="kernel"), predicates.equals("o_totalprice", None)]).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@catalog.query("SELECT event_type, coalesce(event_type IN ('click', 'view', 'purchase') AND value > 1, false) AS accepted, count(*) AS n FROM events GROUP BY 1, 2")
def checked_vocabulary(t: Tables) -> DataFrame:
    """Rows dealt to accepted and rejected by a vocabulary and a rule."""
    good, bad = predicates.split_valid(t.events, F.col("event_type").isin("click", "view", "purchase") & (F.col("value") > 1))
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("event_type", "accepted").agg(F.count(F.lit(1)).alias("n"))


@catalog.query("SELECT c_custkey, c_nationkey::BIGINT AS most_documents, c_mktsegment = 'BUILDING' AS may_export FROM customer")
def plan_caps(t: Tables) -> DataFrame:
    """Caps and features of a plan, kept as JSON."""
    plan = F.to_json(F.struct(F.struct(F.col("c_nationkey").alias("documents")).alias("caps"), F.array(F.lit("view"), F.when(F.col("c_mktsegment") == "BUILDING", "export").otherwise("none")).alias("features")))
    rows = t.customer.select("c_custkey", plan.alias("plan"))
    return rows.select("c_custkey", predicates.plan_cap("plan", "documents").alias("most_documents"), predicates.has_feature("plan", "export").alias("may_export"))


@catalog.query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 5 = 2 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def open_comments(t: Tables) -> DataFrame:
    """A page of comments by optional filters, newest first."""
    rows = t.orders.withColumn("block", F.col("o_custkey") % 5)
    asked = [predicates.equals("block", 2), predicates.equals("o_orderstatus", "O"), predicates.equals("o_custkey", None)]
    return predicates.page(predicates.where_all(rows, asked).orderBy(F.desc("o_orderdate"), "o_orderkey"), 1, 50).select("o_orderkey", "o_custkey", "o_orderdate")


@catalog.query("""
    SELECT p_partkey, category, row_number() OVER (ORDER BY coalesce(category, 'zzz'), p_partkey) AS place FROM (SELECT *, nullif(p_type, 'STANDARD') AS category, nullif(p_brand, 'Brand#1') AS package FROM part)
    WHERE (package IS NULL OR package IN ('Brand#2', 'Brand#3')) AND p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
    ORDER BY place LIMIT 100""")
def available_parts(t: Tables) -> DataFrame:
    """Insertions on offer: no package or an installed one, big enough, not mapped yet; those without category last. The first hundred."""
    rows = t.part.select("p_partkey", "p_size", F.nullif("p_type", F.lit("STANDARD")).alias("category"), F.nullif("p_brand", F.lit("Brand#1")).alias("package"))
    free = rows.where((F.col("package").isNull() | F.col("package").isin("Brand#2", "Brand#3")) & (F.col("p_size") > 10))
    free = free.join(t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    first = free.orderBy(F.coalesce("category", F.lit("zzz")), "p_partkey").limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("category", F.lit("zzz")), "p_partkey")).cast("long")).select("p_partkey", "category", "place")


@catalog.query("SELECT o_orderkey, l_linenumber, p_partkey, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def ordered_assets(t: Tables) -> DataFrame:
    """A junction of many to many with the place of each member."""
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("o_orderkey", "l_linenumber", "p_partkey", "p_name")


@catalog.query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_suppkey = l.l_partkey % 100)")
def previewed_lines(t: Tables) -> DataFrame:
    """A semi join on an id within the same document."""
    of = t.lineitem.select(F.col("l_orderkey").alias("_order"), F.col("l_suppkey").alias("_supplier"))
    return t.lineitem.join(of, (F.col("l_orderkey") == F.col("_order")) & (F.col("l_partkey") % 100 == F.col("_supplier")), "left_semi").select("l_orderkey", "l_linenumber")


@catalog.query("""
    SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place FROM events WHERE value IS NULL OR value < 5 QUALIFY place <= 20""")
def invalid_by_validator(t: Tables) -> DataFrame:
    """Rows that are not valid, by validator and the newest first: twenty of each."""
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    rows = t.events.where(F.col("value").isNull() | (F.col("value") < 5)).withColumn("place", F.row_number().over(newest).cast("long"))
    return rows.where("place <= 20").select("event_id", "event_type", "ts", "place")


@catalog.query("SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag) || list(l_linestatus) || list('q' || floor(l_quantity / 10)::INT))) AS warnings, list_sort(list_distinct(list(l_returnflag) || ['N', 'Z'])) AS known FROM lineitem GROUP BY 1")
def warnings_of_orders(t: Tables) -> DataFrame:
    """Warnings of three kinds as one list without repeats, and a set union with a fixed set."""
    flags, states = F.collect_list("l_returnflag"), F.collect_list("l_linestatus")
    decades = F.collect_list(F.concat(F.lit("q"), F.floor(F.col("l_quantity") / 10).cast("string")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.array_distinct(F.concat(flags, states, decades))).alias("warnings"), F.array_sort(F.array_union(flags, F.array(F.lit("N"), F.lit("Z")))).alias("known"))


@catalog.query("SELECT conv_id, 'Conversation ' || conv_id || ' ' || string_agg(text, ' ' ORDER BY turn) AS search_text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def search_texts(t: Tables) -> DataFrame:
    """The text that a search reads: the title and all blocks, in order."""
    return fulltext.search_text(t.conversations, "conv_id", "turn", "text", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))


@catalog.query("SELECT doc_id, 0.0::DOUBLE AS rank FROM documents WHERE contains(lower(text), 'scum tras')")
def searched_by_substring(t: Tables) -> DataFrame:
    """No document has the second term as a word, so the search goes on as one for a substring."""
    index = fulltext.inverted_index(t.documents, "doc_id", {"text": 1.0}, stem=False)
    return fulltext.search_or_substring(t.documents, index, ["scum", "tras"], "doc_id", "text")


@catalog.query(r"""
    WITH w AS (SELECT doc_id, weight, term FROM (SELECT doc_id, 1.0 AS weight, unnest(regexp_extract_all(lower(source), '[a-z]+')) AS term FROM documents
        UNION ALL SELECT doc_id, 0.4, unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents)),
    f AS (SELECT doc_id, weight, term, count(*) AS tf FROM w WHERE term IN ('site', 'the') GROUP BY 1, 2, 3)
    SELECT doc_id, sum(tf)::BIGINT AS tf, round(sum(weight * (1 + ln(tf))), 6) AS rank FROM f GROUP BY doc_id""")
def weighted_search(t: Tables) -> DataFrame:
    """Terms weigh more in the source than in the text."""
    index = fulltext.inverted_index(t.documents, "doc_id", {"source": 1.0, "text": 0.4}, stem=False)
    return fulltext.search(index, ["site", "the"], every=False).withColumn("rank", F.round("rank", 6))


def shaped_blocks(t: Tables) -> DataFrame:
    """A block for every turn, in five shapes of content; k tells which."""
    k, text = F.col("turn") % 5, F.concat(F.col("role"), F.lit(" "), F.col("conv_id").cast("string"))
    make = lambda **fields: F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))
    shapes = [make(text=F.lit(""), title=text), make(items=F.array(text, F.lit("b"))), make(rows=F.array(F.array(text, F.lit("x")), F.array(F.lit("y"), F.lit("z")))), make(latex=text, mode=F.lit("display")), F.lit("")]
    content = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        content = F.when(k == i, shape).otherwise(content)
    return t.conversations.select("conv_id", "turn", k.alias("k"), "role", content.alias("content"))


@catalog.query("""
    SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN s WHEN 1 THEN s || chr(10) || 'b' WHEN 2 THEN s || ' — x' || chr(10) || 'y — z' WHEN 3 THEN s ELSE '' END AS text,
        CASE turn % 5 WHEN 1 THEN '(list of 2)' WHEN 2 THEN s || ' — x' || chr(10) || 'y — z' WHEN 4 THEN '' ELSE s END AS preview, turn % 5 = 1 AS is_list
    FROM (SELECT *, role || ' ' || conv_id AS s FROM conversations)""")
def block_texts(t: Tables) -> DataFrame:
    """Text and preview of blocks of all shapes: the first field that is filled, else items, else rows."""
    c = F.col("content")
    return shaped_blocks(t).select("conv_id", "turn", blocks.text_of(c).alias("text"), blocks.preview(c).alias("preview"), blocks.is_array(c, "$.items").alias("is_list"))


@catalog.query("""
    SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN '{"source":"' || s || '","notation":"latex","mode":"display"}' WHEN 4 THEN '{}' END AS migrated, CASE turn % 5 WHEN 3 THEN s ELSE '' END AS source
    FROM (SELECT *, role || ' ' || conv_id AS s FROM conversations) WHERE turn % 5 >= 3""")
def migrated_blocks(t: Tables) -> DataFrame:
    """Equations in the newer shape, and empty contents made empty objects."""
    rows = shaped_blocks(t).where("k >= 3").withColumn("content", blocks.filled(F.col("content")))
    return rows.select("conv_id", "turn", blocks.migrated_equation(F.col("content")).alias("migrated"), blocks.equation_source(F.col("content")).alias("source"))


@catalog.query("""SELECT conv_id, turn, '{"text":"' || role || '","level":3}' AS relevelled, '{"a":1,"text":"' || role || '"}' AS keyed, '{"a":1,"b":2,"text":"new"}' AS merged FROM conversations""")
def edited_headings(t: Tables) -> DataFrame:
    """Headings of a new level, with a key set, and merged with other content; keys of the last two sorted."""
    content = F.to_json(F.struct(F.col("role").alias("text"), F.lit(1).alias("a")))
    rows = t.conversations.select("conv_id", "turn", content.alias("c"))
    keyed = blocks.set_key(F.to_json(F.struct(F.get_json_object("c", "$.text").alias("text"))), "a", F.lit(1))
    return rows.select("conv_id", "turn", blocks.relevel(F.col("c"), 3).alias("relevelled"), blocks.canonical(keyed).alias("keyed"), blocks.canonical(blocks.merged(F.col("c"), F.lit('{"text":"new","b":2}'))).alias("merged"))


@catalog.query("SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 THEN role || ' inner ' || conv_id || ' end' ELSE role END) AS text FROM conversations")
def walked_texts(t: Tables) -> DataFrame:
    """All texts of nested contents, in order."""
    leaf = lambda x: F.struct(x.alias("text"))
    part = lambda *x: F.struct(F.array(*x).alias("content"))
    nested = F.to_json(part(part(leaf(F.col("role")), leaf(F.lit("inner"))), part(leaf(F.col("conv_id").cast("string")), leaf(F.lit("end")))))
    flat = F.to_json(F.struct(F.col("role").alias("text")))
    return trees.walked_texts(t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, nested).otherwise(flat).alias("c")), ["conv_id", "turn"], "c")


#: Containers around a text: a list that is walked, a field that is not, and a block's own text, which comes before what it holds.
_DEEP = r"""
    SELECT o_orderkey, 'own ' || o_orderkey || ' "q" \ ' || o_orderpriority || ' é last' AS text FROM orders"""


@catalog.query(_DEEP)
def deep_texts(t: Tables) -> DataFrame:
    """Texts of contents nested up to fifty deep; other fields, strings that look like lists and texts of other types are passed over."""
    depth = (F.col("o_orderkey") % 50 + 1).cast("int")
    quoted = lambda x: F.to_json(F.struct(x.alias("text")))
    inner = F.concat(F.lit('{"type":"p","attrs":{"text":"no","content":[{"text":"no"}]},"content":[{"n":1,"text":3},'), quoted(F.concat(F.lit('"q" \\ '), F.col("o_orderpriority"))), F.lit(',{"content":"[{\\"text\\":\\"no\\"}]"},[{"text":"\\u00e9"}]],"text":"own '), F.col("o_orderkey").cast("string"), F.lit('"}'))
    deep = F.concat(F.repeat(F.lit('{ "x": {"content":[{"text":"no"}]}, "content" : ['), depth), inner, F.repeat(F.lit("]}"), depth))
    content = F.concat(F.lit('{"content":['), deep, F.lit(',{"text":"last"}],"other":[{"text":"no"}]}'))
    orders = spread(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return trees.walked_texts(orders.select("o_orderkey", content.alias("c")), ["o_orderkey"], "c")


@catalog.query(r"""
    WITH c AS (SELECT conv_id, unnest(list_distinct(string_split(text || ' Жλ中', ''))) AS c FROM conversations),
    u AS (SELECT DISTINCT conv_id, unicode(c) AS u FROM c WHERE unicode(c) > 127)
    SELECT conv_id, 'command' AS kind, 'frac' AS value FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
    SELECT DISTINCT conv_id, 'command', 'role' || left(role, 1) FROM conversations UNION ALL
    SELECT conv_id, 'codepoint', 'U+' || lpad(printf('%X', u), 4, '0') FROM u UNION ALL
    SELECT conv_id, 'script', unnest(['Cyrillic', 'Greek', 'Han']) FROM (SELECT DISTINCT conv_id FROM conversations)""")
def block_requirements(t: Tables) -> DataFrame:
    """Characters of blocks anywhere in them, and commands below keys that hold LaTeX only, at any depth and in any case of the key."""
    role = F.concat(F.lit("\\role"), F.left("role", F.lit(1)))
    latex = F.struct(F.array(F.struct(role.alias("z")), F.struct(F.lit("x\\frac{1}{2}").alias("z"))).alias("v"))
    block = F.struct(F.struct(F.array(F.struct(F.concat("text", F.lit(" \\no Жλ")).alias("text"))).alias("content")).alias("a"), latex.alias("RawLatex"), F.lit("中 \\neither").alias("title"))
    rows = t.conversations.select("conv_id", "turn", F.to_json(block).alias("c"))
    return trees.requirements(rows, ["conv_id", "turn"], ["conv_id"], "c")


@catalog.query("SELECT n_nationkey, CASE n_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 11 THEN 2 ELSE n_regionkey END AS n_regionkey FROM nation")
def reordered_nations(t: Tables) -> DataFrame:
    return maintain.reordered(t.nation.select("n_nationkey", "n_regionkey"), [7, 3, 11], "n_nationkey", "n_regionkey")


@catalog.query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'seg' || c_custkey ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
    UNION ALL SELECT -1 - c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'seg' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END FROM customer""")
def filled_upsert(t: Tables) -> DataFrame:
    """New values replace old ones where they are given."""
    old = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    values = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("seg"), "c_custkey")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = t.customer.select("c_custkey", *values).unionByName(t.customer.select((-1 - F.col("c_custkey")).alias("c_custkey"), *values))
    return maintain.upsert_filled(old, new, ["c_custkey"])


@catalog.query("""
    WITH v AS (SELECT o_orderkey, o_custkey % 3 <> 0 AS ok FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN ok THEN 1 ELSE 0 END AS l_quantity FROM l LEFT JOIN v ON l_orderkey = o_orderkey WHERE NOT coalesce(ok, false) OR l_linenumber <> 2
    UNION ALL SELECT o_orderkey, 99, 5.0 FROM v WHERE ok""")
def batch_upserted(t: Tables) -> DataFrame:
    """Orders edited as whole documents: lines changed, the second dropped, one added; orders of a stale version stay as they are."""
    old = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    versions = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(4).alias("version"), F.when(F.col("o_custkey") % 3 == 0, 3).otherwise(4).alias("expected"))
    edited = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = old.where("l_linenumber <> 2").join(edited, "l_orderkey", "left_semi").withColumn("l_quantity", F.col("l_quantity") + 1)
    new = lines.unionByName(edited.select("l_orderkey", F.lit(99).alias("l_linenumber"), F.lit(None).cast("double").alias("l_quantity")))
    return maintain.batch_upsert(old, new, ["l_linenumber"], "l_orderkey", versions, {"l_quantity": 5.0})[0]


@catalog.query("""SELECT o_orderkey AS document, CASE WHEN o_custkey % 3 = 0 THEN 4 ELSE 5 END AS version, o_custkey % 3 <> 0 AS applied FROM orders WHERE o_orderkey % 2 = 0""")
def batch_versions(t: Tables) -> DataFrame:
    """Versions after the batch: one more where the expectation held."""
    versions = t.orders.select(F.col("o_orderkey").alias("document"), F.lit(4).alias("version"), F.when(F.col("o_custkey") % 3 == 0, 3).otherwise(4).alias("expected"))
    new = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document"), F.lit(1).alias("line"), F.lit("x").alias("text"))
    return maintain.batch_upsert(new.limit(0), new, ["line"], "document", versions, {})[1]


@catalog.query("""
    SELECT sha256('copy/' || conv_id) AS conv_id, sha256('copy/' || (conv_id * 1000 + turn)) AS id, CASE WHEN turn > 0 THEN sha256('copy/' || (conv_id * 1000)) END AS parent, role FROM conversations""")
def cloned_blocks(t: Tables) -> DataFrame:
    """Deep copies: all ids are new, and parents point to copies."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    rows = t.conversations.select("conv_id", number.alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent"), "role")
    return maintain.cloned(rows, "id", "parent", "conv_id", "copy")


@catalog.query("SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_failed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def refreshed_totals(t: Tables) -> DataFrame:
    """Counters of runs set from the runs themselves."""
    parents = t.customer.select("c_custkey", F.lit(-1).alias("n_orders"), F.lit(-1).alias("n_failed"))
    return maintain.refreshed_counts(parents, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", {"n_orders": F.col("o_orderkey").isNotNull(), "n_failed": F.col("o_orderstatus") == "F"})


@catalog.query("""
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_totalprice < 0) AS negative, count(*) FILTER (o_orderdate IS NULL) AS undated FROM orders)
    SELECT unnest(['row_count', 'has_source', 'never_display', 'price_kept', 'dated']) AS "check",
           unnest(['PASS', CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN negative = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN undated = 0 THEN 'PASS' ELSE 'FAIL' END]) AS status FROM c""")
def backfill_checked(t: Tables) -> DataFrame:
    """A backfill of equations over all orders checks itself: failed orders have no old source, so that rule breaks where there are any."""
    latex = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("x_"), F.col("o_orderkey").cast("string")))
    before = t.orders.select("o_totalprice", "o_orderdate", F.to_json(F.struct(latex.alias("latex"), F.lit("display").alias("mode"))).alias("content"))
    after = before.withColumn("content", blocks.migrated_equation(F.col("content")))
    c = F.col("content")
    rules = {"has_source": F.get_json_object(c, "$.source").isNotNull(), "never_display": F.get_json_object(c, "$.mode") != "display", "price_kept": F.col("o_totalprice") >= 0, "dated": F.col("o_orderdate").isNotNull()}
    return maintain.backfill_checks(before, after, rules)


@catalog.query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' OR l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY GROUP BY 1")
def purged_lines(t: Tables) -> DataFrame:
    """Rows deleted more than thirty days ago go for good."""
    newest = t.lineitem.agg(F.max("l_shipdate")).first()[0]
    rows = t.lineitem.withColumn("deleted_at", F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")))
    return maintain.purged(rows, "deleted_at", newest).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def marked_turns(t: Tables) -> DataFrame:
    """Texts with inline marks at places that follow from the row."""
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("é "), F.repeat(F.lit("x"), (F.col("turn") % 7).cast("int")), F.lit(" **"), "role", F.lit("** and `c d` or *it* __b__ _i_")).alias("text"))


@catalog.query("""
    WITH m AS (SELECT conv_id, turn, 2 + (turn % 7) + 1 AS a, length(role) AS n FROM conversations)
    SELECT conv_id, turn, 'bold' AS style, a::INT AS start, (n + 4)::INT AS length FROM m UNION ALL SELECT conv_id, turn, 'bold', (a + n + 23)::INT, 5 FROM m
    UNION ALL SELECT conv_id, turn, 'italic', (a + n + 18)::INT, 4 FROM m UNION ALL SELECT conv_id, turn, 'italic', (a + n + 29)::INT, 3 FROM m UNION ALL SELECT conv_id, turn, 'code', (a + n + 9)::INT, 5 FROM m""")
def inline_marks(t: Tables) -> DataFrame:
    """Offsets and lengths of bold, italic and code runs."""
    return marked_turns(t).select("conv_id", "turn", F.explode(markup.inline_spans(F.col("text"))).alias("s")).select("conv_id", "turn", "s.*")


@catalog.query("""
    SELECT s_suppkey, r::INT AS cell_row, c::INT AS cell, CASE WHEN r = 0 THEN ['Name', 'Key'][c + 1] WHEN c = 0 THEN s_name ELSE s_suppkey::VARCHAR END AS text FROM supplier, range(2) AS a(r), range(2) AS b(c)""")
def tabular_rows(t: Tables) -> DataFrame:
    """Cells of LaTeX tables; rules and empty rows hold none."""
    body = F.concat(F.lit("\\hline\n Name & Key \\\\ \\midrule\n"), F.col("s_name"), F.lit(" &"), F.col("s_suppkey").cast("string"), F.lit("\\\\\n\\cline{1-2}\n \\\\ \\bottomrule\n"))
    rows = t.supplier.select("s_suppkey", F.posexplode(markup.tabular_cells(body)).alias("cell_row", "cells"))
    return rows.select("s_suppkey", "cell_row", F.posexplode("cells").alias("cell", "text"))


@catalog.query("SELECT c_custkey, 'see ' || c_name || ' now ' || c_mktsegment AS text FROM customer")
def unwrapped_commands(t: Tables) -> DataFrame:
    """LaTeX commands of one argument give way to it, up to eighteen nested ones too; others go with theirs."""
    depth = (F.col("c_custkey") % 9).cast("int")
    text = F.concat(F.lit("see "), F.repeat(F.lit("\\textbf{\\emph{"), depth), "c_name", F.repeat(F.lit("}}"), depth), F.lit(" now\\vspace{2mm} \\textit{"), "c_mktsegment", F.lit("}\\label{x}"))
    found = latex.plain_spans(spread(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", text.alias("text")), "c_custkey", "text", drop=("vspace", "label"))
    return found.select("c_custkey", F.col("plain").alias("text"))


@catalog.query("""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'methods' WHEN 1 THEN 'references' WHEN 2 THEN 'introduction' END AS kind FROM customer""")
def section_kinds(t: Tables) -> DataFrame:
    """Kinds of sections by their titles, without numbers and case."""
    titles = F.array(*map(F.lit, (" 2.1 Methodology", "IV. BIBLIOGRAPHIE:", "Introduction", "3 Other matters")))
    known = {"methods": ("methods", "methodology"), "references": ("references", "bibliographie"), "introduction": ("introduction", "einleitung")}
    return t.customer.select("c_custkey", markup.section_keyword(F.get(titles, (F.col("c_custkey") % 4).cast("int")), known).alias("kind"))


@catalog.query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unsupported_package' WHEN o_orderpriority = '2-HIGH' THEN 'load_order' WHEN o_orderstatus = 'F' THEN 'missing_asset' WHEN o_orderstatus = 'O' THEN 'unknown_macro' ELSE 'parse_ambiguity' END AS category,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'info' WHEN o_orderpriority = '2-HIGH' THEN 'warning' WHEN o_orderstatus = 'F' THEN 'error' WHEN o_orderstatus = 'O' THEN 'info' ELSE 'warning' END AS severity FROM orders""")
def diagnosed_warnings(t: Tables) -> DataFrame:
    """Category and severity of warnings by type, unless a word in them tells more."""
    kind = F.when(F.col("o_orderstatus") == "F", "ImageExtractionFailed").when(F.col("o_orderstatus") == "O", "UnknownStyle").otherwise("Else")
    details = F.when(F.col("o_orderpriority") == "1-URGENT", "A TikZ picture").when(F.col("o_orderpriority") == "2-HIGH", "\\usepackage{HyperRef} and tikz")
    found = markup.diagnosis(kind, details, F.lit("found"), markup.WARNINGS, markup.WARNING_WORDS, markup.OTHER_WARNING)
    return t.orders.select("o_orderkey", found.alias("d")).select("o_orderkey", "d.*")


@catalog.query("""
    SELECT conv_id, turn, CASE WHEN conv_id % 3 > 0 THEN CASE WHEN role = 'user' AND turn % 2 = 0 THEN 'may not fit a column' WHEN role <> 'user' AND len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 80)) > 0 THEN 'lines over 80 characters' END END AS hint FROM conversations""")
def layout_hints(t: Tables) -> DataFrame:
    """Blocks that may not fit a page of several columns."""
    kind = F.when(F.col("role") == "user", "figure").otherwise("code")
    span = F.when(F.col("turn") % 2 == 0, "column").otherwise("page")
    return t.conversations.select("conv_id", "turn", markup.layout_hint(F.col("conv_id") % 3 + 1 - F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0), kind, span, F.col("text")).alias("hint"))


@catalog.query("SELECT c_custkey, c_custkey % 4 = 1 AS wrong_order FROM customer")
def load_order_traps(t: Tables) -> DataFrame:
    """Packages loaded after one that they must come before."""
    both = F.array(*map(F.lit, ("\\usepackage{hyperref}\\usepackage{cleveref}", "\\usepackage{cleveref}\n\\usepackage[x]{amsmath,hyperref}", "\\usepackage{hyperref}", "none")))
    text = F.get(both, (F.col("c_custkey") % 4).cast("int"))
    return t.customer.select("c_custkey", F.coalesce(markup.loaded_in_wrong_order(text, "hyperref", "cleveref"), F.lit(False)).alias("wrong_order"))


@catalog.query("SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE value >= 1 GROUP BY 1")
def captured_events(t: Tables) -> DataFrame:
    """Events captured as a stream in micro-batches: bad ones are dropped on the way, and a batch that is repeated replaces itself."""
    path = sources.scratch_folder(t.spark, "captured")
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    query = stream.into_table(source, f"{path}/rows", f"{path}/state-{uuid.uuid4().hex}", seconds=None, change=lambda batch: batch.where("value >= 1"))
    query.awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
