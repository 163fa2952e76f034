import hashlib
import random
import re

import numpy as np
import pytest

from blockloom.llm import pii as op

SF = "/root/testdata/sf0.1"


def check_sum(digits):
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else (d * 2 - 9 if d * 2 > 9 else d * 2)
    return total % 10 == 0


def patterns(text):
    """Base spans as the contract words them."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and check_sum(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, *m.span()) for k, (rule, good) in enumerate(rules) for m in re.finditer(rule, text) if good(m)]


def test_base_spans():
    rnd = random.Random(2)
    parts = ["1", "2", ".", ".", "@", "a", "-", " ", "+", "(", ")", "10", "255", "é", "4111111111111111", "_", "\n"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        assert op.base_spans(text) == patterns(text)
    for part in ("a", "1", "1.", "a@", "+1 ", "1 "):
        op.base_spans(part * 300_000)  # in linear time


def test_gradients():
    rng = np.random.default_rng(0)
    net = op.Tagger(*(rng.standard_normal(s) * 0.3 for s in ((op.SYMBOLS, 2, 4 * op.HIDDEN), (2, op.HIDDEN, 4 * op.HIDDEN), (2 * op.HIDDEN, op.TAGS), (op.TAGS,), (op.TAGS, op.TAGS))))
    windows, tags = rng.integers(1, 100, (3, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [7, 8, 8, 0, 0, 1, 1]])
    _, found = op.gradients(net, windows, tags)
    for k, (p, g) in enumerate(zip(net.parameters(), found, strict=True)):
        at = (int(windows[0, 1]), 1, 5) if k == 0 else (1, 2) if k == 4 else tuple(n // 2 for n in p.shape)
        was = p[at]
        losses = []
        for e in (1e-2, -1e-2):
            p[at] = was + e
            losses.append(op.gradients(net, windows, tags)[0])
        p[at] = was
        assert abs((losses[0] - losses[1]) / 2e-2 - g[at]) < 1e-3


def test_best_paths():
    """Viterbi against all paths; tags inside never follow another kind's."""
    import itertools

    rng = np.random.default_rng(1)
    moves = np.where(op._ALLOWED, rng.standard_normal((op.TAGS, op.TAGS)), op.NEVER).astype(np.float32)
    scores = [rng.standard_normal((n, op.TAGS)).astype(np.float32) for n in (1, 4, 2, 4, 3)]
    for own, path in zip(scores, op.best_paths(scores, moves), strict=True):
        value = lambda p: sum(own[t, x] for t, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) + (0 if op._FIRST[p[0]] else -1e4)  # noqa: B023, E731
        assert tuple(path) == max(itertools.product(range(op.TAGS), repeat=len(own)), key=value)


@pytest.fixture(scope="module")
def net(spark):
    from pyspark.sql import functions as F

    return op.train(spark.read.parquet(f"{SF}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0))


def test_held_out(spark, net):
    """On documents not trained on: other ways to write a span are found, numbers that are none and the rest of the texts left alone."""
    from pyspark.sql import functions as F

    held = spark.read.parquet(f"{SF}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1)
    texts = [r.text or "" for r in held.select("text").collect()]
    base = [op.base_spans(t) for t in texts]
    assert sum(map(len, op.added_spans(net, texts, base))) <= 0.02 * sum(map(len, base))
    rng, found, false, total, none = np.random.default_rng(5), 0, 0, 0, 0
    for text, own in zip(texts, base, strict=True):
        for kind, start, end in own:
            told, new = op._written(kind, text[start:end], rng)
            before, after = text[max(0, start - 150) : start], text[end : end + 150]
            changed, at = before + new + after, (len(before), len(before) + len(new))
            spans = op.base_spans(changed)
            spans += op.added_spans(net, [changed], [spans])[0]
            if told < 0:
                none, false = none + 1, false + any(a < at[1] and b > at[0] for _, a, b in spans)
            else:
                total, found = total + 1, found + ((told, *at) in spans)
    assert total > 100 and found >= 0.85 * total and false <= 0.05 * none


def test_windows_are_reconciled(net):
    """A span is found whole wherever windows are cut around it, and the same in a batch with others."""
    whole = 0
    for gap in range(0, 70):
        text = "erst den haus 1999 von " * 3 + "der und la "[: gap % 11] + "in den " * (gap // 3) + "call (626) 555-1660 now " + "word " * 30
        at = text.index("(626)")
        alone = op.tagged(net, [text])[0]
        assert op.tagged(net, ["", text, "1 @ 2"])[1] == alone
        assert all(b <= c for (_, _, b), (_, c, _) in zip(alone, alone[1:]))
        whole += (3, at, at + 14) in alone
    assert whole >= 63


ROWS = [
    (1, None), (2, ""), (3, "mail a.b@mail.example.com or +1 (626) 555-1660, 4111 1111 1111 1111 at 10.0.0.255"), (3, "mail a.b@mail.example.com or +1 (626) 555-1660, 4111 1111 1111 1111 at 10.0.0.255"),
    (None, "x@y.z"), (None, None), (4, "é" * 10 + "\U0001f600 ü@x.de u@x.de"), (5, "12345 " * 60_000), (6, "256.1.1.1 4111111111111112 +1 234"), (7, "x" * 300_000 + "@" + "y." * 50 + "z"),
]


@pytest.mark.parametrize("trained", [True, False])
def test_documents(spark, net, trained):
    docs = spark.createDataFrame([(*r, "x", 3) for r in ROWS], "doc_id long, text string, spans string, kind int")
    got = op.find_spans(docs, net if trained else None)
    assert got.columns == ["doc_id", "base", "spans"]
    rows = [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in got.collect()]
    want = [(i, [(op.KINDS[k], a, b) for k, a, b in patterns(t or "")]) for i, t in ROWS if i != 7]
    assert sorted([r[:2] for r in rows if r[0] != 7], key=str) == sorted(want, key=str)
    for _, base, spans in rows:
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (op.KINDS.index(s[0]), s[1]))
        extra = [s for s in spans if s not in base]
        assert all(e <= a or b <= s for _, s, e in extra for _, a, b in base) and (trained or not extra)


def test_nothing_to_learn_from(spark):
    assert op.train(spark.createDataFrame([(1, "no spans 12 @")], "doc_id long, text string")) is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.train(empty) is None and op.find_spans(empty, None).count() == 0


def test_query(spark):
    rows = op.op12_pii(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = patterns(texts[r.doc_id])
        told = [f"{op.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and set(told) <= set(r.spans.split(","))


def test_stretches_hold_every_span():
    """written at signs and words longer than REACH are looked at whole."""
    from blockloom.llm import pii

    far = "word " * 40
    for span in ("jo [at] site [dot] org", "jo(at)site.org", "jo@" + "long-" * 30 + "site.org", "x" * 200 + "@site.org", "1.2.3.4"):
        text = far + span + " " + far
        begin, end = len(far), len(far) + len(span)
        parts = pii.stretches(text)
        assert any(a <= begin and end <= b for a, b in parts) and sum(b - a for a, b in parts) < len(span) + 100
        assert pii.stretches(far) == [] and all(a < b for a, b in parts)
    assert pii.stretches("1x" * 500_000) == [(0, 1_000_000)]
