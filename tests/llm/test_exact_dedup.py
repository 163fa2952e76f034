import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from blockloom.llm import exact_dedup as op
from blockloom.llm import shared


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, " "), (6, "a b "), (7, "x" * 300_000), (8, "x" * 300_000), (8, "x" * 300_000), (None, "a\nb"), (None, "z")]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(*r, "k", 7) for r in ROWS], "doc_id long, text string, key string, bucket int")
    got = op.exact_dedup(docs, capacity=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_empty(spark):
    assert op.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("key", [lambda text: F.lit(5).cast("long"), lambda text: F.length(text).cast("long"), lambda text: F.shiftright(F.xxhash64(text), 62)])
def test_colliding_keys_are_told_apart_by_bytes(spark, key):
    rows = ROWS + [(100 + i, f"text {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, op.exact_dedup(docs, capacity=1, key=key).collect()), key=str) == brute(rows)
    index = op.build_index(docs, capacity=1, key=key).entries.collect()
    chains = defaultdict(list)
    for r in index:
        chains[r.key].append(r.chain)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values()) and max(map(len, chains.values())) > 1


def test_hot_groups_and_text_ids(spark):
    rows = [(f"id{i:05}", "very often" if i % 3 else f"text {i // 6}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, op.exact_dedup(docs, capacity=10).collect()), key=str) == brute(rows)


def directory(spark, keys, capacity):
    depth, cells = op.grow_directory(spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long"), capacity)
    return depth, {r.cell: r.bucket for r in cells.collect()}


def test_directory_doubles_and_splits(spark):
    depth, cells = directory(spark, [c << 60 | i for c in range(16) for i in range(3)], 12)
    assert sorted(set(cells.values())) == [4, 5, 6, 7] and all(b == 4 | c >> (depth - 2) for c, b in cells.items())
    depth, cells = directory(spark, [*(i << 54 for i in range(64)), 15 << 60], 10)  # all but one begin with four zeros
    assert set(cells.values()) == {(1 << 7) + i for i in range(8)} | {3}
    assert directory(spark, [], 10)[1] == {}


def test_directory_is_bound_by_the_keys_only(spark):
    """Keys that differ in the last bits only: the directory doubles far beyond any fixed depth."""
    depth, cells = directory(spark, [1 << 40 | i << 8 for i in range(40)], 2)
    assert depth > 50 and max(list(cells.values()).count(b) for b in cells.values()) <= 2


def test_many_buckets(spark, monkeypatch):
    rows = [(i, f"text {i % 700}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, op.exact_dedup(docs, capacity=3).collect()), key=str) == brute(rows)
    monkeypatch.setattr(op, "MOST_BUCKETS", 4)
    assert op.build_index(docs, capacity=3).entries.select("bucket").distinct().count() <= 8


def test_first_rows(spark):
    rows = [(*r, "k", 7) for r in ROWS] + [(7, "x" * 300_000, "a", 1), (1, "a b", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, first int")
    got = sorted(map(tuple, op.first_rows(docs, ("doc_id", "text", "key")).collect()), key=str)
    want = {}
    for i, text, key, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        rank = (i is None, i or 0, text is None, text or "", key is not None, key or "")
        want[norm] = min(want.get(norm, (rank,)), (rank, (i, text, key)))[:2] if norm in want else (rank, (i, text, key))
    assert got == sorted((w[1] for w in want.values()), key=str)


def test_scratch_deletes_what_was_stored(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    with shared.scratch(spark):
        at = len(shared._made)
        op.exact_dedup(docs).write.parquet(str(tmp_path / "out"))
        made = shared._made[at:]
    assert made and spark.read.parquet(str(tmp_path / "out")).count() == 2
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
