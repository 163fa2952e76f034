"""What blocks of words hold in tasks, on disk and on the way."""

import gc

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from blockloom.llm import words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(n):
    random = np.random.default_rng(3)
    known = ["".join(map(chr, random.integers(97, 123, 12))) for _ in range(3000)]
    return [" ".join(known[x] for x in random.integers(0, 3000, 200)) for _ in range(n)]


def test_texts_of_a_part_can_go():
    """op2_token_counts: of the texts of a block, a task keeps the words only, also where ids share the texts' buffer."""
    before = pa.total_allocated_bytes()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64()), ("text", pa.string())])) as stream:
        stream.write_batch(pa.record_batch([pa.array(range(2000)), pa.array(texts(2000))], names=["id", "text"]))
    whole = sink.getvalue()
    size = whole.size
    batch = pa.ipc.open_stream(whole).read_next_batch()
    part = words._part(batch, ())
    assert part.ids.to_pylist() == list(range(2000)) and part.n_words.tolist() == [200] * 2000
    del sink, stream, whole, batch
    gc.collect()
    assert pa.total_allocated_bytes() - before < 0.8 * size


def test_lists_are_compressed(spark):
    """op1_bpe_roundtrip: lists of words are stored and shuffled compressed, in no more than three quarters of their bytes (of random letters)."""
    docs = spark.createDataFrame(list(enumerate(texts(500))), "doc_id long, text string").coalesce(1)
    _, lists = words.word_blocks(docs, PATH, "doc_id", "text", counted=False)
    found = [w for r in lists.collect() for w in words.unpacked_words(r.words)]
    assert lists.select(F.sum(F.length("words"))).first()[0] < 0.75 * sum(len(w.encode()) for w in found)
    assert {w.strip() for w in found} == {w for t in texts(500) for w in t.split()}


def test_packed_words():
    for given in ([], ["a"], ["", "日本", "\x00", " x" * 70_000]):
        listed = pa.array(["before", *given], pa.large_string()).cast(pa.large_binary())[1:]
        assert words.unpacked_words(words.packed_words(listed)) == given


def test_small_pieces_make_the_same_counts(spark, monkeypatch):
    """Slices of a few texts, words forgotten after each list: counts are those of the whole texts."""
    from blockloom.llm import bpe, token_counts

    for name, value in (("MOST_KNOWN", 0), ("LIST_BYTES", 1)):
        monkeypatch.setattr(words, name, value)
    monkeypatch.setattr(bpe, "PART_WORDS", 7)
    monkeypatch.setattr(bpe, "PART_IDS", 11)
    own = [*texts(40), "", None, "x" * 5000, "<|endoftext|> a"]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    want = {i: words.tokenizer(PATH).encode(t or "", add_special_tokens=False).ids for i, t in enumerate(own)}
    got = token_counts.count_tokens(docs, PATH, block_bytes=3000)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(ids) for i, ids in want.items()}
    both = bpe.decode(bpe.encode(docs, PATH, block_bytes=3000), PATH).collect()
    assert {r.doc_id: (list(r.ids), r.decoded) for r in both} == {i: (want[i], t or "") for i, t in enumerate(own)}
