"""Word table shared by BPE encoding and token counting.

Documents are split into words inside the scan tasks. Each task gathers its documents into blocks of
``block_bytes`` of text, a slice at a time, and keeps, per block, the list of distinct words and the
documents as ranks into it; of a slice only its words stay. Lists are compressed before they are stored and shuffled. So what is shuffled by word is one entry per (block, distinct word), however often a common
word occurs, and what comes back to a block is one answer per distinct word. Blocks are written once
to a table bucketed by block in the shared folder: both uses read the same bytes even if a task of
the scan is run again, and the join back by block needs no exchange of the documents.

A word is a piece of text that the tokenizer's own pre-tokenizer never joins to its neighbours; the
library still pre-tokenizes every word itself, so ids are those of the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import catalog_name, fresh_path, partitions, release, slices, text_or_empty, trimmed

BLOCK_BYTES = 8 << 20
#: Text that is split at once.
SLICE_BYTES = 2 << 20
#: Buckets of words for each shuffle partition. A task holds the words of one bucket at a time, up to MOST_KNOWN.
BUCKETS = 4
#: Buckets in all: each block has a list for each, and lists of few words compress badly.
MOST_BUCKETS = 1024
#: Words that a task remembers at most; with more in its bucket, some are encoded again.
MOST_KNOWN = 500_000
#: Compressed lists that are encoded at once.
LIST_BYTES = 256 << 10
#: Words that the library encodes in one call.
CALL_WORDS = 5_000

# Byte classes.
OTHER, LETTER, SPACE, HIGH, UNSURE = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:] = HIGH
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        CLASS[_b] = LETTER
CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE
CLASS[0x1C:0x20] = UNSURE


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[bytes, ...]:
    """Added tokens; raises if the file is not a byte-level BPE that splits texts as assumed here."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path}: added tokens that strip their surroundings are not supported")
    return tuple(t["content"].encode() for t in added)


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def pieces(path: str) -> pa.Array:
    """The bytes of every id; ids that the vocabulary lacks are empty."""
    tok, alphabet = tokenizer(path), byte_of_char()
    vocab = tok.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for token, number in vocab.items():
        out[number] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return pa.array(out, pa.binary())


def _after_unicode_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space outside ASCII."""
    a, b, c = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return (
        ((b == 0xC2) & ((a == 0x85) | (a == 0xA0)))
        | ((c == 0xE1) & (((b == 0x9A) & (a == 0x80)) | ((b == 0xA0) & (a == 0x8E))))
        | ((c == 0xE2) & (((b == 0x80) & ((a <= 0x8B) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F))))
        | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    )


def cuts(data: np.ndarray, starts: np.ndarray, specials: tuple[bytes, ...]) -> np.ndarray:
    """Sorted positions where words begin. starts: where the non-empty texts begin in data.

    Cut where white space follows a character that is surely none, where ASCII punctuation or a digit
    follows a letter, and after a single line break between two such characters. The pre-tokenizer's
    pattern ends a match at each of these, and reads nothing across them.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kind = CLASS[data]
    cut = np.zeros(n + 1, bool)
    space = kind == SPACE
    solid = (kind == OTHER) | (kind == LETTER)  # surely not white space
    cut[1:n] = space[1:] & solid[:-1]
    high = np.flatnonzero(space[1:] & (kind[:-1] == HIGH)) + 1
    cut[high[~_after_unicode_space(data, high)]] = True
    lines = np.flatnonzero(cut[: n - 1] & (data[:-1] != 0x20)) if n > 1 else np.empty(0, np.int64)
    cut[lines[solid[lines + 1] | (data[lines + 1] == 0xC3)] + 1] = True
    letter = kind == LETTER
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter[1:] |= latin & (kind[1:] == HIGH)
    cut[1:n] |= (kind[1:] == OTHER) & letter[:-1]
    cut[starts] = True
    raw = data.tobytes() if specials else b""
    for special in specials:
        at = raw.find(special)
        while at >= 0:
            end = at + len(special)
            inside = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, end, "left")]
            if not len(inside):
                cut[at + 1 : end] = False
                cut[[at, end]] = True
            at = raw.find(special, end if not len(inside) else at + 1)
    return np.flatnonzero(cut[:n])


def split(texts: pa.Array, specials: tuple[bytes, ...]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of each text's words."""
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    offsets = offsets - first
    starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
    at = cuts(data, starts, specials)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, last - first)), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(at, offsets)).astype(np.int32)


def word_hash(words: pa.Array) -> np.ndarray:
    """A 64-bit polynomial hash of every word's bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    mixed = (data + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.add.reduceat(mixed, offsets[:-1] - offsets[0])
    return total ^ (total >> np.uint64(32))


def packed(numbers: np.ndarray) -> bytes:
    """Zstandard over the byte planes of unsigned 32-bit numbers."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def packed_words(words: pa.Array) -> bytes:
    """Zstandard over the number of the words (large_binary), their lengths as byte planes, and their bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    planes = np.ascontiguousarray(np.diff(offsets).astype("<u4").view(np.uint8).reshape(-1, 4).T)
    data = memoryview(words.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    return zstandard.compress(np.array([len(words)], "<u4").tobytes() + planes.tobytes() + bytes(data), 3)


def unpacked_words(blob: bytes) -> list[str]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    planes = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, -1)
    offsets = np.concatenate([[0], np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw).slice(4 + 4 * n)]).to_pylist()


class _Part(NamedTuple):
    """A slice of documents: copies of its ids, so that its texts can go, and its words by its own dictionary."""

    ids: pa.Array
    lengths: pa.Array
    n_words: np.ndarray
    coded: pa.DictionaryArray


def _part(batch: pa.RecordBatch, specials: tuple[bytes, ...]) -> _Part:
    ids, texts = batch.columns
    words, n_words = split(texts, specials)
    return _Part(ids.take(pa.array(np.arange(len(ids)))), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), n_words, words.dictionary_encode())


def _counted(part: _Part, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text: how many, their ranks, how often they occur."""
    texts = len(part.n_words)
    key, times = np.unique(np.repeat(np.arange(texts), part.n_words) << 32 | ranks, return_counts=True)
    return np.bincount(key >> 32, minlength=texts).astype(np.int32), (key & 0xFFFFFFFF).astype(np.uint32), times.astype(np.uint32)


def _block(parts: list[_Part], buckets: int, counted: bool) -> dict:
    """One block: ids and lengths of its texts, its words by bucket, and the texts as ranks (or counts of ranks)."""
    coded = pa.chunked_array([p.coded for p in parts]).unify_dictionaries()
    distinct = coded.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])
    order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    distinct, ranks, n_words, times = distinct.take(pa.array(order)), rank[codes], [p.n_words for p in parts], b""
    bucket = (word_hash(distinct) % np.uint64(buckets)).astype(np.int64) if len(distinct) else np.empty(0, np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
    listed = distinct.take(pa.array(by_bucket))
    lists = [(b, packed_words(listed[ends[b] : ends[b + 1]])) for b in range(buckets) if ends[b + 1] > ends[b]]
    if counted:
        own = np.split(ranks, np.cumsum([n.sum() for n in n_words])[:-1])
        n_words, ranks, frequency = zip(*map(_counted, parts, own), strict=True)
        ranks, times = np.concatenate(ranks), packed(np.concatenate(frequency))
    ids, lengths = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
    return {"ids": ids, "lengths": lengths, "n_words": pa.array(np.concatenate(n_words), pa.int32()), "ranks": packed(ranks), "times": times, "bucket": packed(bucket), "lists": lists}


def word_blocks(docs: DataFrame, path: str, id_col: str, text_col: str, counted: bool, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts, lists): the blocks of the documents, and (block, bucket, words) of their distinct words, as packed_words()."""
    spark, buckets, specials = docs.sparkSession, min(MOST_BUCKETS, BUCKETS * partitions(docs.sparkSession)), special_strings(path)
    id_type = docs.schema[id_col].dataType
    lists = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())]))
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("n_words", T.ArrayType(T.IntegerType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("ranks", "times", "bucket")]
        + [T.StructField("lists", lists)]
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            b = _block(held, buckets, counted)
            list_of = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            nested = pa.StructArray.from_arrays([pa.array([n for n, _ in b["lists"]], pa.int32()), pa.array([w for _, w in b["lists"]], pa.binary())], names=["bucket", "words"])
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), list_of(b["ids"]), list_of(b["lengths"]), list_of(b["n_words"]), *(pa.array([b[c]], pa.binary()) for c in ("ranks", "times", "bucket")), list_of(nested)],
                names=schema.names,
            )

        for batch in batches:
            for some in slices(batch, batch.column(1), size=min(SLICE_BYTES, block_bytes)):
                held.append(_part(some, specials))
                size += pc.sum(held[-1].lengths).as_py() or 0
                if size >= block_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    name = catalog_name("word_blocks")
    (rows.mapInArrow(trimmed(build), schema).write.option("compression", "zstd").option("path", fresh_path(spark, "word-blocks"))
     .bucketBy(partitions(spark), "block").saveAsTable(name))
    blocks = spark.table(name)
    words = blocks.select("block", F.explode("lists").alias("list")).select("block", "list.bucket", "list.words")
    return blocks.drop("lists"), words


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """The ids of every word as bytes of 32-bit numbers; plain words go to the library joined by line breaks."""
    tok, size = tokenizer(path), piece_lengths(path)
    out: list[bytes] = [b""] * len(words)

    def one_by_one(which: list[int]) -> None:
        for i, e in zip(which, tok.encode_batch_fast([words[i] for i in which], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()

    plain = [i for i, w in enumerate(words) if not w[-1].isspace() and not (w[0].isspace() and (w[0] != " " or w[1].isspace()))]
    seen = set(plain)
    one_by_one([i for i in range(len(words)) if i not in seen])
    for at in range(0, len(plain), CALL_WORDS):
        some = plain[at : at + CALL_WORDS]
        ids = np.array(tok.encode_batch_fast(["\n".join(words[i] for i in some)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(size[ids])
        length = np.array([len(words[i].encode()) + 1 for i in some])
        stop = np.cumsum(length) - 1  # a word ends here, a line break follows
        start = stop - length + 1
        to = np.searchsorted(ends, stop) + 1
        since = np.searchsorted(ends - size[ids], start)
        if not (np.array_equal(ends[to - 1], stop) and np.array_equal(ends[since] - size[ids[since]], start)):
            one_by_one(some)  # the library saw other words than these
            continue
        for i, a, b in zip(some, since, to, strict=True):
            out[i] = ids[a:b].tobytes()
    return out


@lru_cache(maxsize=4)
def piece_lengths(path: str) -> np.ndarray:
    return pc.binary_length(pieces(path)).to_numpy().astype(np.int64)


def encoded_lists(lists: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """(block, bucket, counts, ids): every distinct word of a bucket is encoded once, in the task that owns the bucket."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        now = None
        for whole in batches:
            starts = np.flatnonzero(np.diff(whole.column(1).to_numpy(), prepend=-1))
            for at, to in zip(starts, [*starts[1:], whole.num_rows], strict=True):
                batch = whole.slice(at, to - at)
                if batch.column(1)[0].as_py() != now:
                    known, now = {}, batch.column(1)[0].as_py()
                for some in slices(batch, batch.column(2), size=LIST_BYTES):
                    yield answers(some, known)

    def answers(batch: pa.RecordBatch, known: dict[str, bytes]) -> pa.RecordBatch:
        lists = [unpacked_words(blob) for blob in batch.column(2).to_pylist()]
        ends = np.cumsum([0, *map(len, lists)])
        words = [w for own in lists for w in own]
        if len(known) > MOST_KNOWN:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, encode_words(path, new), strict=True))
        found = [known[w] for w in words]
        counts = np.fromiter(map(len, found), np.int32, len(found)) // 4
        blobs = [b"".join(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)] if with_ids else [b""] * batch.num_rows
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([packed(counts[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array([packed(np.frombuffer(b, "<u4")) for b in blobs], pa.binary())],
            names=["block", "bucket", "counts", "ids"],
        )

    dealt = lists.repartition(partitions(lists.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(encode), "block long, bucket int, counts binary, ids binary")


def per_block(texts: DataFrame, answers: DataFrame, finish: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """Joins each block to the answers for its words, in the order of their ranks.

    finish gets the block's row, and of the words by rank: the number of ids, where they start, all ids.
    """
    arrow = None

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_batches(max_chunksize=1):
            if not row.num_rows:
                continue
            block = {c: row.column(c) for c in row.schema.names}
            right = right.sort_by("bucket")
            empty = np.empty(0, np.uint32)
            counts = np.concatenate([empty, *(unpacked(b) for b in right.column("counts").to_pylist())]).astype(np.int64)
            ids = np.concatenate([empty, *(unpacked(b) for b in right.column("ids").to_pylist())])
            order = np.argsort(unpacked(block["bucket"][0].as_py()), kind="stable")
            if len(order) != len(counts):
                raise RuntimeError("a block lacks answers for some of its words")
            by_rank, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            by_rank[order], start[order] = counts, np.cumsum(counts) - counts
            parts.append(finish(block, by_rank, start, ids))
        release()
        return pa.concat_tables(parts) if parts else arrow

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema).empty_table()
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)
