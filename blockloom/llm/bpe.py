"""BPE encoding and decoding through a table of distinct words and an id-to-piece join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, table, trimmed
from .words import BLOCK_BYTES, encoded_lists, per_block, pieces, word_blocks

TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids are looked up at once, and ids whose pieces are.
PART_WORDS, PART_IDS = 100_000, 500_000


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns id, ids (array<int>): a row per input row, as the tokenizers library encodes the whole text.

    No special tokens are added; the special strings of the file are found inside texts. Null and
    empty texts have no ids. Rows with equal or null ids stay rows of their own. Other columns are ignored.
    """
    texts, lists = word_blocks(docs, path, id_col, text_col, counted=False, block_bytes=block_bytes)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def finish(block: dict, counts: np.ndarray, start: np.ndarray, ids: np.ndarray) -> pa.Table:
        from .words import unpacked

        ranks = unpacked(block["ranks"][0].as_py())
        n_words = block["n_words"].values.to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts[ranks])])[np.concatenate([[0], np.cumsum(n_words)])]
        flat, at = np.empty(ends[-1], np.int32), 0
        for k in range(0, len(ranks), PART_WORDS):
            some = ranks[k : k + PART_WORDS]
            found = ids[_ranges(start[some], counts[some])]
            flat[at : at + len(found)] = found
            at += len(found)
        return pa.table([block["ids"].values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    return per_block(texts, encoded_lists(lists, path, with_ids=True), finish, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of every row's ids: a map-side join of the ids to the pieces of the vocabulary.

    The vocabulary's size is fixed by the tokenizer file. Ids outside it have no piece. Special tokens
    are kept. Bytes that are no UTF-8 become U+FFFD. Null arrays give the empty text. Other columns stay.
    """
    schema = T.StructType([f for f in encoded.schema.fields if f.name != out_col] + [T.StructField(out_col, T.StringType())])
    kept = schema.names[:-1]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = pieces(path)
        for batch in (some for whole in batches for some in slices(whole, whole.column(ids_col), size=PART_IDS)):
            column = batch.column(ids_col)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            flat = column.flatten()
            known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(table_of)))
            joined = pc.fill_null(table_of.take(pc.if_else(known, flat, None)), b"")
            at = np.concatenate([[0], np.cumsum(lengths)])
            offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
            data = pa.py_buffer(joined.buffers()[2] or b"")
            text = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.ascontiguousarray(offsets[at])), data])
            try:
                out = text.cast(pa.string())
            except pa.ArrowInvalid:
                out = pa.array([b.decode("utf-8", "replace") for b in text.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=schema.names)

    return encoded.mapInArrow(trimmed(join), schema)


def encoded_digests(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. block_bytes: of text that a task works on at once; less takes less memory and more shuffle."""
    both = decode(encode(docs, path, block_bytes=block_bytes), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op1_bpe_roundtrip": op1_bpe_roundtrip}
SQL: dict[str, str] = {}
