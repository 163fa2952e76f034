"""What has to hold for queries to grow no faster than their tables."""

import duckdb
from test_catalog import rows

from pyspark import shuffle
from pyspark.sql import functions as F

from blockloom.functions import markup
from blockloom.plans import relational_queries, text_queries


def test_multiplied_counts(spark, tmp_path):
    """the facts never meet row by row; nations of one name, without facts, and null keys count as in the SQL."""
    tables = {
        "nation": ([(1, "A"), (2, "B"), (3, "A"), (4, "C"), (5, None), (None, "D")], "n_nationkey int, n_name string"),
        "supplier": ([(10, 1), (10, 3), (11, 1), (12, 5), (13, None), (None, 1)], "s_suppkey int, s_nationkey int"),
        "customer": ([(1, 1, 5.0), (2, 1, -1.0), (3, 3, 2.0), (4, 2, 1.0), (5, 5, 3.0), (6, None, 9.0), (None, 1, 4.0), (7, 1, None)], "c_custkey int, c_nationkey int, c_acctbal double"),
    }
    con = duckdb.connect()
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = relational_queries.QUERIES["coverage_view_multiplied"](spark, str(tmp_path))
    assert rows(got.toPandas()) == rows(con.sql(relational_queries.SQL["coverage_view_multiplied"]).df())
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and "customer" not in "".join(joins)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sum(") < plan.index("c_acctbal")  # customers are counted before any join


def test_scripts_without_a_row_a_character(spark, tmp_path):
    """characters are counted within their text, in all planes and at the ends of ranges."""
    ends = "".join(chr(x) for _, low, high in markup.SCRIPT_RANGES for x in (low - 1, low, high, high + 1))
    texts = [(1, "en", "Aé 1\n\U0001f600Ж中\U00020000"), (2, "de", ends), (3, None, ends * 2 + "x"), (4, "fr", ""), (5, "fr", None), (6, "de", " @")]
    spark.createDataFrame(texts, "doc_id int, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text_queries.QUERIES["docs_scripts"](spark, str(tmp_path))
    points = spark.read.parquet(f"{tmp_path}/documents.parquet").select("lang", F.explode(markup.code_points(F.col("text"))).alias("cp"))
    want = points.groupBy("lang", markup.script_of(F.col("cp")).alias("script")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(got.toPandas()) == rows(want.toPandas()) and want.count() > 12
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scripts_of_empty_texts(spark, tmp_path):
    """an empty text counts once as common, as in the SQL; a null text does not count."""
    texts = [(1, "en", ""), (2, "en", "aé 1"), (3, "de", ""), (4, "de", ""), (5, None, ""), (6, "fr", None), (7, "es", "Жλ\0")]
    spark.createDataFrame(texts, "doc_id int, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = text_queries.QUERIES["docs_scripts"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(text_queries.SQL["docs_scripts"]).df()) and len(got) == 7


def test_actions_beyond_memory(monkeypatch):
    """Actions of a document that do not fit in memory are sorted on disk, with the same changes in the same order."""
    from types import SimpleNamespace

    from blockloom.streaming import presence

    class State(dict):
        containsKey, getValue, removeKey, iterator = dict.__contains__, dict.__getitem__, dict.__delitem__, lambda self: iter(list(self.items()))
        updateValue = dict.__setitem__

    def ran():
        rows = (SimpleNamespace(at=i * 7919 % 10007, seq=i % 3, user=f"u{i % 11}", block=f"b{i % 5}", action=("join", "lock", "leave", "unlock", "lock")[i % 5 - i % 2]) for i in range(30000))
        op = presence.Documents(0)
        op.users, op.locks = State(), State()
        return [tuple(r.asDict().values()) for r in op.handleInputRows(("d",), rows, None)]

    used, spilled = [], shuffle.DiskBytesSpilled
    whole = ran()
    monkeypatch.setattr(shuffle, "get_used_memory", lambda: used.append(1) or 10000 * len(used))
    assert ran() == whole and whole and shuffle.DiskBytesSpilled > spilled
