import hashlib
import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_near_dedup import brute

from blockloom.llm import mixing, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=str)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_run_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    keep = [r for r in rows if r.text and re.search(r"[^\W\d_]", r.text)]
    first = {}
    for r in sorted(keep, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    near = {i for i, _, _, kept in brute([(r.doc_id, r.text) for r in first.values()], 5) if kept}
    left = [r for r in first.values() if r.doc_id in near]
    mixed = mixing.mix(spark.createDataFrame(left), mixing.TARGET, mixing.source_domain(F.col("source")), budget_share=0.9)
    tok = words.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in mixed.collect():
        own = tok.encode(r.text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((r.doc_id, len(own), sha(",".join(map(str, own))), sha(tok.decode(own, skip_special_tokens=False))))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_stages_take_odd_rows(spark):
    rows = [
        (1, "the cat and the dog ran to the house", "en", "s1", 1), (2, "the  cat and the dog\tran to the house", "en", "s1", 1), (2, "der hund und die katze", "de", "s2", 1),
        (2, "der hund und die katze", "de", "s2", 1), (None, "ohne id und die", "de", None, None), (None, "the cat and the dog ran to the house", None, "s1", 1), (3, None, "en", "s1", 1),
        (4, "", "en", "s1", 1), (5, "... 123 !", "en", "s1", 1), (6, "word " * 60_000, "en", "s1", 1),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", kept string")
    assert ids(stage("language ID")(spark, docs, "")) == sorted([1, 2, 2, 2, None, None, 6], key=str)
    exact = stage("exact dedup")(spark, docs, "")
    assert exact.columns == list(corpus_pipeline.COLUMNS) and ids(exact) == sorted([1, 2, None, 3, 5, 6], key=str)
    assert ids(stage("MinHash near-dedup")(spark, docs, "")) == sorted([1, 2, 2, None, None, 3, 4, 5, 6], key=str)  # the copy of 1 with the repeated id 2 goes
    assert stage("mixing")(spark, docs, "").columns == list(corpus_pipeline.COLUMNS)
    assert stage("BPE encoding")(spark, docs, "").count() == len(rows)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), "").count() == 0


def test_language_decides(spark):
    good = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    pick = {x: next(r for r in good if r.lang == x and 300 < len(r.text) < 900) for x in ("en", "de")}
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 4, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 4, "4f9c0be1a7d3" * 60]
    odd = [(-1, pick["de"].text, "en"), (-2, pick["en"].text, None), (-3, pick["de"].text, None)] + [(-4 - i, t, None) for i, t in enumerate(foreign)]
    docs = spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in good] + [(*r, "s1", 1) for r in odd], SCHEMA)
    got = {r.doc_id: r.lang for r in stage("language ID")(spark, docs, "").collect()}
    assert (got[-1], got[-2], got[-3]) == ("de", "en", "de")  # the text tells, not the label
    assert not {-4, -5, -6} & set(got)
    assert sum(got.get(r.doc_id) == r.lang for r in good) >= 0.99 * len(good)
