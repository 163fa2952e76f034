import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = [(i, ("fine words here. " * (i % 4)) + ("You Idiot! " if i % 3 == 0 else "You friend! ") + "more text\nend", int(i % 3 == 0)) for i in range(90)]
    return toxicity.train(spark.createDataFrame([*rows, (900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int"))


def test_noisy_or_matches_brute_force(toxic_model):
    texts = ["", "one idiot. two idiot friend! none\n?", "É idiot's idiot", "...", "a" * 50_000 + " idiot"]
    total, each = toxic_model.document_scores(toxicity.sentences(pa.array(texts)))
    at = 0
    for text, got in zip(texts, total, strict=True):
        parts = [p for p in re.findall(r"[^.!?\n\r]*[.!?\n\r]|[^.!?\n\r]+$", text)]
        assert math.isclose(got, 1 - np.prod([1 - p for p in each[at : at + len(parts)]]), abs_tol=1e-12)
        at += len(parts)
    assert at == len(each)


def test_locates_sentences_and_handles_odd_rows(spark, toxic_model):
    rows = [(1, "Good day. You IDIOT! Bye.", "s"), (2, None, "t"), (3, "", "u"), (4, "good day.", "v"), (1, "Good day. You IDIOT! Bye.", "w")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), toxic_model).collect()
    assert [r.score >= 0.7 for r in got] == [True, False, False, False, True] and got[1].score == got[2].score == 0
    assert [(o.start, o.end, o.sentence) for o in got[0].offending] == [(9, 20, " You IDIOT!")]


def test_training_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.train(none)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(spark.createDataFrame([(1, "hello")], "doc_id long, text string"), model).first().score < 0.1


@pytest.mark.parametrize(("sf", "n", "recall"), [(SF, 1000, 0.5), ("/root/testdata/sf0.1", 10_000, 0.8)])
def test_toxicity_held_out(spark, sf, n, recall):
    """The smaller tables have too few labelled documents for all offensive words to recur."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.op3_toxicity(spark, sf).drop("offending").collect()
    assert len(got) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted for r in held if not labels[r.doc_id]) <= 0.005 * len(held)
    assert sum(r.predicted for r in held if labels[r.doc_id]) >= recall * sum(labels[r.doc_id] for r in held)


def plain_hash(word):
    """The 64-bit hash of a word, byte by byte."""
    total = 0
    for i, b in enumerate(word):
        x = (b + 1) * ((i * 0x9E3779B97F4A7C15) % 2**64 | 1) % 2**64
        total += (x ^ x >> 31) * 0xBF58476D1CE4E5B9
    total %= 2**64
    return total ^ total >> 32


def plain_sentences(text):
    """Words of every sentence of a text."""
    parts = re.findall(rb"[^.!?\n\r]*[.!?\n\r]|[^.!?\n\r]+$", text.encode())
    return [re.findall(rb"[0-9a-z'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), p)) for p in parts]


def test_scores_match_brute_force(spark):
    """From text to score without the operator's code, on real texts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("toxic"), F.lit(1).alias("label"))
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    weight = dict(zip(model.tags.tolist(), model.weights.tolist(), strict=True))
    some = docs.where("doc_id % 5 = 0").unionByName(spark.createDataFrame([(-1, "", "x", 1), (-2, "É ... You'd idiot!Next\r\nline", "x", 1)], docs.schema))
    for r in toxicity.score(some, model).collect():
        z = [model.bias + sum(weight.get(plain_hash(w), 0.0) for w in words) for words in plain_sentences(r.text or "")]
        want = 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z)
        assert math.isclose(r.score, want, abs_tol=1e-9), r.doc_id
        assert len(r.offending) == sum(1 / (1 + math.exp(-x)) >= 0.5 for x in z)


def test_fit_matches_dense_training(spark):
    """The same training with a row for every sentence, words or none, by plain matrices."""
    rng = np.random.default_rng(3)
    names = ["bad", "vile", "sun", "tree", "house", "walk"]
    docs, labels = [], []
    for i in range(120):
        toxic = i % 4 == 0
        own = [[names[j] for j in rng.integers(2, 6, 3)] if rng.random() < 0.7 else ["filler"] for _ in range(int(rng.integers(1, 9)))]
        if toxic:
            own[int(rng.integers(len(own)))].append(names[int(rng.integers(2))])
        docs.append(own)
        labels.append(int(toxic))
    flat = [words for own in docs for words in own]
    x = np.array([[words.count(n) for n in names] for words in flat], float)
    doc, y, n = np.repeat(np.arange(120), [len(d) for d in docs]), np.array(labels), len(docs)
    w, b, m, v = np.zeros(6), -6.0, np.zeros(7), np.zeros(7)
    for step in range(1, toxicity.STEPS + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        clean = np.array([np.prod(1 - p[doc == d]) for d in range(n)])
        slope = np.where(y == 1, -(1 - toxicity.NOISE) * clean / (toxicity.NOISE + (1 - toxicity.NOISE) * (1 - clean)), 1.0)
        dz = slope[doc] * p / n
        g = np.append(x.T @ dz + toxicity.PRIOR / n * w, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        move = toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], min(b - move[-1], -4.0)
    tags = np.arange(6, dtype=np.uint64)
    sentence, feature = np.nonzero(x)
    times = x[sentence, feature].astype(int)
    got = toxicity.fit(tags, np.repeat(feature, times), np.repeat(sentence, times), np.array([len(d) for d in docs]), y)
    full = np.zeros(6)
    full[got.tags.astype(int)] = got.weights
    assert np.allclose(full, np.where(np.abs(w) >= toxicity.LEAST_WEIGHT, w, 0), atol=1e-6) and abs(got.bias - b) < 1e-6
    assert full[0] > 2 and full[1] > 2


def test_long_texts_and_clashing_columns_train(spark):
    long = "fine words here. " * 3000
    rows = [(i, long * (i % 4 == 0) + ("You Idiot! " if i % 3 == 0 else "You friend! ") + "more text\nend", i, "c") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic long, order string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "own") for i in range(60)], "doc_id long, toxic int, text string")
    model = toxicity.train(toxicity.labelled_sample(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc_id", "score").collect()}
    assert all((got[i] >= 0.7) == (i % 3 == 0) for i in got)


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = langid.op4_language(spark, SF).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97


def test_pooling_matches_direct_convolution():
    random = np.random.default_rng(1)
    data = random.integers(0, 256, 700).astype(np.uint8)
    windows, text, size = langid.cut_windows(data, np.array([0, 0, 3, 500, 700]))
    assert list(np.bincount(text, size, minlength=4))[:2] == [0, 3] and set(text) == {1, 2, 3}
    net = langid.fit(windows[:0], np.empty(0, np.int64), ["a", "b"])
    got = net.pooled(windows)
    want = [[max(sum(tap[o, w[i + o], f] for o in range(len(tap))) for i in range(langid.WINDOW - len(tap) + 1)) for tap in net.taps for f in range(langid.FILTERS)] for w in windows[:2]]
    assert np.allclose(got[:2], want, atol=1e-4)


def test_windows_cover_every_filter_span():
    for n in (1, 3, 127, 128, 129, 252, 253, 1000):
        windows, _, size = langid.cut_windows((np.arange(n) % 251 + 1).astype(np.uint8), np.array([0, n]))
        seen, step = set(), langid.WINDOW - max(langid.WIDTHS) + 1
        for k, s in enumerate(size):
            seen |= {k * step + i for i in range(int(s) - max(langid.WIDTHS) + 1)}
        assert seen >= set(range(n - max(langid.WIDTHS) + 1))


def plain_predict(net, text):
    """Language and score of one text, window by window and filter by filter."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, step = text.encode(), langid.WINDOW - max(langid.WIDTHS) + 1
    starts = [0]
    while starts[-1] + langid.WINDOW < len(data):
        starts.append(starts[-1] + step)
    mass, weight = np.zeros(len(net.langs)), 0
    for s in starts:
        window = np.frombuffer(data[s : s + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
        pooled = []
        for tap in net.taps:
            pooled += list(np.max([np.sum([tap[o, window[i + o]] for o in range(len(tap))], axis=0) for i in range(langid.WINDOW - len(tap) + 1)], axis=0))
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.out_bias
        p = np.exp(z - z.max())
        size = min(len(data) - s, langid.WINDOW)
        mass, weight = mass + size * p / p.sum(), weight + size
    return net.langs[int(mass.argmax())], float(mass.max() / weight)


def test_predict_matches_plain_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.train(docs)
    some = docs.where("doc_id % 4 = 0 AND length(text) < 3000").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "1 2"), (-3, "é")], "doc_id long, text string"))
    rows = langid.predict(some, net).collect()
    assert len(rows) > 20
    for r in rows:
        lang, score = plain_predict(net, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, r.doc_id


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog " * 20, "en"), ("der hund und die katze " * 20, "de")] * 20)] + [(99, "x", None)], "doc_id long, text string, lang string")
    net = langid.train(docs)
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 ... !", "q"), (4, "the dog " * 9000, "q"), (4, "der die und", "q")], "doc_id long, text string, score string")
    got = langid.predict(odd, net).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de"] and all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert langid.predict(odd, langid.train(empty)).first().lang_pred == "und"


def test_all_supported_languages_are_learned(spark):
    rows = [(i * 10 + k, f"word{i} text{k}", f"l{i:03}") for i in range(120) for k in range(4)] + [(9999, "junk", "once")]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == [f"l{i:03}" for i in range(120)]
