import random
import re

import pytest

from blockloom.llm import components, near_dedup

SCHEMA = "doc_id long, text string"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    parts = union_find(ids, links)
    return sorted((i, len(sets[i]), parts[i], parts[i] == i) for i in ids)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("k", [2, 5])
def test_matches_brute_force(spark, k):
    rng = random.Random(k)
    rows, n = [], 0
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(80 + 40 * base)]
        texts = [" ".join(words)]
        for _ in range(8):  # a walk: each step stays near the last, the ends drift apart
            texts.append(edited(texts[-1].split(), 2 + base // 2, rng))
        texts += [edited(words, e, rng) for e in (1, 3, 6, 9, 12)] + [texts[0].upper(), texts[0].replace(" ", "\n\t")]
        rng.shuffle(texts)
        for t in texts:
            rows.append((n, t))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "One "), (n + 5, "É one"), (n + 6, "é one"), (n + 7, "big " * 40_000 + "end"), (n + 8, "big " * 30_000 + "end")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", component long, key int")
    got = sorted(map(tuple, near_dedup.near_duplicates(docs, shingle=k).collect()))
    assert got == brute(rows, k)


def test_links_far_from_the_first(spark, monkeypatch):
    """The first of every bucket is a hub of an other component: the links between the rest must still be found."""
    monkeypatch.setattr(near_dedup, "TILE", 4)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, edited(words, 45, rng))]  # about 0.55 to 0.75 from all others
    for i in range(1, 40, 2):
        copy = edited(words, 22, rng)
        rows += [(i, copy), (i + 1, edited(copy.split(), 3, rng))]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=2).collect()))
    assert got == brute(rows, 2)


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(words, 2, rng)) for i in range(600)] + [(1000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))) for i in range(50)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=2).collect()
    assert {r.component_id for r in got if r.doc_id < 1000} == {0} and all(r.kept for r in got if r.doc_id >= 1000)


def test_odd_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (3, "a b c"), (3, "a b c"), (2, None)]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (None, 1, None, True), (3, 1, 3, True), (3, 1, 3, True), (2, 0, 2, True)], key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7), (5, None)]
    nodes = {n for e in edges if None not in e and e[0] != e[1] for n in e}
    want = union_find(nodes, [e for e in edges if None not in e and e[0] != e[1]])
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_text_ids_and_repeated_ids(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    rows = [("b", " ".join(words)), ("a", edited(words, 1, rng)), ("c", " ".join(other)), ("b", edited(other, 1, rng)), ("b", "alone here"), ("d", "alone here"), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, shingle=2).collect()), key=str)
    assert got == sorted([("b", "a", False), ("a", "a", True), ("c", "b", False), ("b", "b", True), ("b", "b", True), ("d", "b", False), (None, None, True)], key=str)
    left = sorted((tuple(r) for r in near_dedup.first_rows(docs, ("doc_id", "text"), shingle=2).collect()), key=str)
    assert left == sorted([rows[1], rows[3], rows[4], rows[6]], key=str)


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from blockloom.llm.shared import slices

    texts = pa.array(["x" * n for n in (5, 3, 0, 40, 1, 1, 1, 1, 1, 1)] + [None])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    assert [[len(t or "") for t in s.column(0).to_pylist()] for s in slices(batch, texts, rows=4, size=8)] == [[5, 3, 0], [40], [1, 1, 1, 1], [1, 1, 0]]
