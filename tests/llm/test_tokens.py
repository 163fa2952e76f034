import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import bpe, token_counts, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the", " ", "  ", "\n", "\n\n", "'s", "'", "don't", "x9", "é", "É.", " ", " ", "　", "日本", "😀", "<|endoftext|>", "<|endof", "text|>", "!!", "\x1c", "\t", "²", "ß7", "​", "á", "×", "_", "\u0085"]
TEXTS = ["", "Hello world's  end.\n\n Next\tline \n", "<|endoftext|> a<|endoftext|>b <|endoftext|>", "<|endof", "text|>", " ", "\n", "é.é, ñ", "x " * 60_000, "   a 　b"]


def brute(text):
    tok = words.tokenizer(PATH)
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def split_ids(texts):
    import pyarrow as pa

    found, n_words = words.split(pa.array(texts, pa.string()), words.special_strings(PATH))
    distinct = [w.decode() for w in found.to_pylist()]
    ids = [list(memoryview(b).cast("I")) for b in words.encode_words(PATH, distinct)]
    out, at = [], 0
    for n in n_words:
        out.append([i for w in ids[at : at + n] for i in w])
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=5))
def test_words_encode_as_whole_text(texts):
    assert split_ids(texts) == [brute(t)[0] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert split_ids(texts) == [brute(t)[0] for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "b") for i, t in enumerate(TEXTS)] + [(100, None, 2, "c"), (None, "no id", 3, "d"), (1, TEXTS[1], 4, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, ids string"), rows


def test_encode_decode(docs):
    frame, rows = docs
    got = bpe.decode(bpe.encode(frame, PATH, block_bytes=1000), PATH).collect()
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_digests(docs):
    frame, rows = docs
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids, text = brute(r[1])
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(text)))
    assert sorted(map(tuple, bpe.encoded_digests(frame, PATH).collect()), key=str) == sorted(want, key=str)


def test_counts(docs):
    frame, rows = docs
    got = token_counts.count_tokens(frame, PATH, block_bytes=1000).collect()
    want = [(r[0], len((r[1] or "").encode()), len(brute(r[1])[0])) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded_digests(empty, PATH).count() == 0
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_decode_odd_ids(spark):
    rows = [(1, [99999, -1, 64]), (2, None), (3, []), (4, [None, 64]), (5, [127])]
    got = {r.k: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), PATH).collect()}
    assert got == {1: "a", 2: "", 3: "", 4: "a", 5: brute("x")[1][:0] + words.tokenizer(PATH).decode([127], skip_special_tokens=False)}
