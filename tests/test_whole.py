"""The queries over whole tables and texts see what those over parts do not."""

import os
import unicodedata

from blockloom.operators import fulltext
from blockloom.plans import catalog


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))


def run(spark, folder, name):
    return catalog.QUERIES[name](spark, str(folder)).collect()


def test_whole_texts(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    saved(spark, tmp_path, "documents", [(1, "a" * 300 + "Ж", "en"), (2, item[:62] + " and no more", "de"), (3, "x " + item, "fr"), (4, "b" * 70 + "éß", "en")], "doc_id long, text string, lang string")
    saved(spark, tmp_path, "benchmark", [(1, item)], "item_id long, text string")
    assert [r.n for r in run(spark, tmp_path, "docs_scripts") if r.script == "cyrillic"] == [1]
    assert [r.n_docs for r in run(spark, tmp_path, "benchmark_contained")] == [1]
    assert {r.doc_id: r.folded[-1] for r in run(spark, tmp_path, "folded_texts")} == {1: "Ж", 2: "E", 3: "N", 4: "S"}


def test_folded_texts_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).upper()
    assert {r.doc_id: r.folded for r in run(spark, "/root/testdata/sf0.001", "folded_texts")} == {i: fold(s) for i, s in texts.items()}


def test_needles_of_any_length(spark):
    texts = ["Ab cd ef gh ij kl", "x", "", None, "xab cd efg", "é ab"]
    needles = ["", "a", "AB", "b cd e", "cd ef gh ij", "zz", None, "é", "b c", "ab cd ef gh ij kl"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fulltext.containing(docs, spark.createDataFrame(list(enumerate(needles)), "item_id long, needle string"), "doc_id", "text", "item_id", "needle").collect()
    assert {r.item_id: r.n_docs for r in got} == {i: sum(n is not None and t is not None and n.lower() in t.lower() for t in texts) for i, n in enumerate(needles)}
    plan = fulltext.containing(docs, spark.createDataFrame([(1, "ab")], "item_id long, needle string"), "doc_id", "text", "item_id", "needle")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
