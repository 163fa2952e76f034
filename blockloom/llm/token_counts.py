"""Token counts: pieces are counted once per distinct word and joined to each document's word frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table
from .words import BLOCK_BYTES, encoded_lists, per_block, unpacked, word_blocks

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Returns id, n_bytes (UTF-8), n_tokens: a row per input row, by the tokenizers library's own ids.

    Special strings inside texts count as the library finds them, and none are added. Null and empty
    texts have 0 and 0. No ids of documents are made. Rows with equal or null ids stay rows of their own.
    """
    texts, lists = word_blocks(docs, path, id_col, text_col, counted=True, block_bytes=block_bytes)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def finish(block: dict, counts: np.ndarray, start: np.ndarray, ids: np.ndarray) -> pa.Table:
        n_words = block["n_words"].values.to_numpy()
        weights = counts[unpacked(block["ranks"][0].as_py())] * unpacked(block["times"][0].as_py())
        total = np.concatenate([[0], np.cumsum(weights)])
        ends = np.concatenate([[0], np.cumsum(n_words)])
        return pa.table([block["ids"].values, block["lengths"].values, pa.array(np.diff(total[ends]), pa.int64())], names=schema.names)

    return per_block(texts, encoded_lists(lists, path, with_ids=False), finish, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
