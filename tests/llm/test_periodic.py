import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from blockloom.llm import periodic as op


def brute(words):
    """Runs of every exponent from 2 on by comparing words at every distance."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in best.items())


def made(rnd, most=70):
    words = [rnd.randrange(rnd.randint(1, 4)) for _ in range(rnd.randint(0, most))]
    if words and rnd.random() < 0.5:
        at, q = rnd.randrange(len(words)), rnd.randint(1, 12)
        words[at:] = [words[at + (i - at) % q] if at + (i - at) % q < len(words) else 0 for i in range(at, len(words))]
    return words


def test_runs_against_brute_force():
    rnd = random.Random(4)
    for _ in range(150):
        texts = [made(rnd) for _ in range(rnd.randint(1, 5))]
        assert op.runs_of([np.array(t, np.int64) for t in texts]) == [brute(t) for t in texts]


@pytest.mark.parametrize("least_length, least_times", [(2, 2), (6, 2), (9, 3), (24, 3), (10, 4)])
def test_limits_and_stretches(least_length, least_times):
    rnd = random.Random(least_length)
    for _ in range(100):
        texts = [made(rnd, 150) for _ in range(rnd.randint(0, 4))]
        got = op.found_runs([[b"%d" % w for w in t] for t in texts], least_length, least_times)
        assert got == [[r for r in brute(t) if r[1] >= max(least_length, least_times * r[2])] for t in texts]


def test_fibonacci_words_and_one_letter():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    assert op.runs_of([np.array(b)]) == [brute(b)]
    assert op.runs_of([np.zeros(3000, np.int64), np.array([1])]) == [[(0, 3000, 1)], []]


def test_squares_of_the_vocabulary_are_all_there():
    rnd = random.Random(9)
    for _ in range(60):
        words = [rnd.randrange(2) for _ in range(40)]
        text = np.array([9, *words, 10])
        tree = op.SuffixTree(text)
        low, _, half = op.vocabulary(tree, *op.covering_squares(tree))
        got = [tuple(text[tree.array[x] : tree.array[x] + 2 * k].tolist()) for x, k in zip(low, half, strict=True)]
        want = {tuple(words[i : i + 2 * k]) for i in range(40) for k in range(1, 21) if i + 2 * k <= 40 and words[i : i + k] == words[i + k : i + 2 * k]}
        whole = {s for s in want if not any(len(s) // 2 % d == 0 and s[:d] * (len(s) // d) == s for d in range(1, len(s) // 2))}
        assert len(got) == len(set(got)) and set(got) == whole


def plain_rows(rows, change):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        words = change(words, doc_id) if change else words
        runs = [r for r in brute(words) if r[1] >= max(24, 3 * r[2])]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        out.append((doc_id, runs, best, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "la " * 23), (5, "la " * 24), (6, "a b c " * 8 + "a b"), (6, "x a b c " * 8), (None, "u v w " * 30), (None, None), (7, "é ü\x0b" * 40 + "one two three " + "é ü\x0c" * 40),
    (8, " ".join(f"w{i % 300}" for i in range(1000))), (9, "the same line of nine words stands here twice " * 2), (10, "x" * 500_000), (11, "ab ab ab ab " * 6 + "cd " + "ab " * 25),
]


@pytest.mark.parametrize("change", [None, op.repeated_tail])
def test_documents(spark, change):
    rows = ROWS + [(i, " ".join(f"w{(i * j * j) % 97}" for j in range(i % 90))) for i in range(100, 260)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, best int")
    got = op.periodic_runs(docs, change=change)
    assert got.columns == ["doc_id", "runs", "best", "collapsed"]
    assert sorted(((r[0], [tuple(x) for x in r[1]], tuple(r[2]) if r[2] else None, r[3]) for r in got.collect()), key=str) == plain_rows(rows, change)


def test_empty_and_text_ids(spark):
    assert op.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert op.periodic_runs(spark.createDataFrame([("a", "x y " * 20)], "id string, body string"), "id", "body").collect()[0].collapsed == "x y"


def test_changed_tail():
    for doc_id in range(200):
        words = [b"%d" % i for i in range(doc_id % 37)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        want = list(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert op.repeated_tail(words, doc_id) == want


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in op.op11_runs(spark, "/root/testdata/sf0.001").select(*names).collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({op.SQL['op11_runs']})").fetchall()) and any(r[1] for r in got)
    assert all(r[6] == hashlib.sha256(b"").hexdigest() for r in got if not r[1])
