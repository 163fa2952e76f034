import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from blockloom.llm import spotsigs

ANCHORS = set(spotsigs.ANCHORS)


def brute_chains(text):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    found = [f"{words[a]} {words[b]}" for a, b in zip(content, content[1:]) if a and words[a - 1] in ANCHORS]
    found = found or [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return set(found)


def sets(part):
    return {part[i : i + 8] for i in range(0, len(part), 8)}


def alike(a, b):
    """Likeness of two printed fingerprints, from the strings alone."""
    (spots, free_a), (others, free_b) = a.split("."), b.split(".")
    return jaccard(sets(spots[:-1]), sets(others[:-1])) if spots.endswith("!") and others.endswith("!") else jaccard(sets(free_a), sets(free_b))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = ["", None, "The quick brown fox of the old house and the dog", "the the the", "word", "no anchors here whatsoever, really!", "É de la maison, le chien; der Hund 12", "the cat " * 30_000, "  \n ", "a b", "of cats", "😀😀😀 the 日本 語 and x"]


def test_chains(spark):
    rows = [(i, t or "") for i, t in enumerate(TEXTS)]
    got = spark.createDataFrame(rows, "i int, text string").select("i", spotsigs.chains(F.col("text")).alias("c")).collect()
    for r in got:
        assert set(r.c) == brute_chains(rows[r.i][1]) and len(set(r.c)) == len(r.c), rows[r.i][1][:50]


def check(got, rows):
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    texts = {r[0]: r[1] or "" for r in rows}
    prints = {r.doc_id: r.fingerprint for r in got}
    follows = {a[0]: b[0] for a, b in zip(order, [*order[1:], order[0]])}
    for r in got:
        text, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = text[: n - n // 3] + texts[follows[r.doc_id]][: n // 3]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - alike(r.fingerprint, prints[follows[r.doc_id]])) < 1e-12
        assert [len(sets(part)) for part in r.fingerprint.replace("!", "").split(".")] == [len(anchored(text)), len(free(text))]


def test_edited_texts(spark):
    rows = [(i * i - 7, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, bucket int")
    got = spotsigs.edited_fingerprints(docs).collect()
    check(got, rows)
    same = {}
    for r in got:
        assert same.setdefault(dict(rows)[r.doc_id] or "", r.fingerprint) == r.fingerprint


def test_few_and_odd_rows(spark):
    schema = "doc_id long, text string"
    assert spotsigs.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = spotsigs.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], schema)).collect()
    check(one, [(5, "abcdef")])
    odd = spotsigs.edited_fingerprints(spark.createDataFrame([(None, "aaa"), (1, "bbb"), (1, "ccc"), (None, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in odd) == [("1", 3), ("1", 3), ("None", 0), ("None", 3)]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = spotsigs.op7_spotsigs(spark, "/root/testdata/sf0.001").collect()
    check(got, rows)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)
    assert all(r.near_edited > 0 for r in got if r.n_chars >= 150)  # no text of some length loses its likeness to an edit of a third


def test_matches(spark):
    base = "the cat sat on the red mat and the dog ran to the old house with a small bird in the green tree by the lake"
    rows = [(1, base), (2, base + " now"), (3, base.replace("cat", "cow")), (4, base[: len(base) // 2]), (5, ""), (6, base), (7, "other words of the world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (0.5, 0.8):
        prints = spotsigs.fingerprints(docs, least=least)
        got = {(r.query_id, r.id): r.likeness for r in spotsigs.matches(prints, prints, least=least).collect()}
        want = {(a, b): jaccard(brute_chains(s), brute_chains(t)) for a, s in rows for b, t in rows if s and t}
        assert got == {pair: x for pair, x in want.items() if x >= least} and len(got) > 6


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        spotsigs.edited_fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def free(text):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:])} or set(words)


def anchored(text):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    return {f"{words[a]} {words[b]}" for a, b in zip(content, content[1:]) if a and words[a - 1] in ANCHORS}


def test_texts_are_compared_in_one_form(spark):
    bare = " ".join(f"word{i}" for i in range(60))
    spotted = " ".join(f"the cat{i} dog{i}" for i in range(60))
    few = bare + " the end of it all"
    texts = dict(enumerate([bare, spotted, few, spotted + " x", bare, "", "a"]))
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    enough = lambda t: len(anchored(t)) >= max(8, len(t) / 100)
    like = lambda a, b: jaccard(anchored(a), anchored(b)) if enough(a) and enough(b) else jaccard(free(a), free(b))
    for i, text in texts.items():
        follows = texts[(i - 1) % len(texts)]
        edited = text[: len(text) - len(text) // 3] + follows[: len(text) // 3]
        assert abs(got[i].near_edited - like(text, edited)) < 1e-12 and abs(got[i].near_next - like(text, follows)) < 1e-12
    assert got[4].near_edited > 0.4 and got[2].near_edited > 0.4  # two thirds of them are unchanged
