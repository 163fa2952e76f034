"""A training corpus from raw documents: language ID, exact and near dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and reads it again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import bpe, exact_dedup, langid, mixing, near_dedup
from blockloom.llm.shared import scratch, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages, with that language as ``lang``, whatever they were labelled.

    Texts without a letter go, and those that score less than langid.least_score(), which all labelled texts
    fix: they are in another language or in none. The model learns from the documents that have a language; if none has, nothing
    can be told and all with letters stay as they are.
    """
    rows = docs.select(*COLUMNS)
    net = langid.train(rows)
    if not net.langs:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    told = stored(langid.predict(rows, net).where(F.col("lang_pred") != langid.UNDETERMINED), "told-languages")
    told = told.where(F.col("score") >= langid.least_score(told, net))
    return told.withColumn("lang", F.col("lang_pred").cast(docs.schema["lang"].dataType)).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest id stays, once; one without an id only if none has one."""
    return exact_dedup.first_rows(docs, COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard of 0.8, the rows with the smallest id stay; rows without an id stay."""
    return near_dedup.first_rows(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words, dealt to sources by target weights; no document is repeated."""
    domain = mixing.source_domain(F.col("source"))
    return mixing.mix(docs.select(*COLUMNS), mixing.TARGET, domain, budget_share=0.9, max_epochs=1).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encoded_digests(docs, public_tokenizers.path(bpe.TOKENIZER))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE encoding", encode),
]

#: Language ID, mixing and encoding are beyond SQL; tests/llm/test_pipeline.py checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark, keep=1):  # the stage's result stays, what its operators stored goes
            docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
