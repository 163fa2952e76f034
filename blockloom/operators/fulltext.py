"""Full-text search over an inverted index table."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no meaning for a search (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")
_ENDINGS = (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("ingly", ""), ("edly", ""), ("sses", "ss"), ("ies", "i"), ("ing", ""), ("ed", ""), ("ly", ""), ("es", "e"), ("s", ""))


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """A light English stemmer: strips one common ending and leaves a stem of three letters at least."""

    def one(word: str | None) -> str | None:
        for ending, new in _ENDINGS:
            if word and word.endswith(ending) and len(word) - len(ending) + len(new) >= 3 and not word.endswith("ss" if ending == "s" else "\0"):
                return word[: len(word) - len(ending)] + new
        return word

    return words.map({w: one(w) for w in words.dropna().unique()})


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def inverted_index(docs: DataFrame, id_col: str, fields: dict[str, float], stem: bool = True, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, weight, tf): a row per document, term and field weight. Counted before the shuffle; stems are made once per term."""
    each = reduce(DataFrame.union, (docs.select(F.col(id_col), F.lit(w).alias("weight"), F.explode(terms(F.col(c))).alias("term")) for c, w in fields.items()))
    each = each.where(~F.col("term").isin(*stop_words)) if stop_words else each
    counted = each.groupBy(id_col, "weight", "term").agg(F.count(F.lit(1)).alias("tf"))
    if not stem:
        return counted
    return counted.withColumn("term", stemmed("term")).groupBy(id_col, "weight", "term").agg(F.sum("tf").alias("tf"))


def search(index: DataFrame, query: list[str], every: bool) -> DataFrame:
    """(id, tf, rank) of documents with all, or any, of the terms. rank = sum of weight * (1 + ln tf) over terms and fields."""
    id_col = index.columns[0]
    wanted = list(dict.fromkeys(query))
    hits = index.where(F.col("term").isin(*wanted)).groupBy(id_col).agg(
        F.sum("tf").alias("tf"), F.sum(F.col("weight") * (1 + F.log("tf"))).alias("rank"), F.count_distinct("term").alias("_terms")
    )
    return (hits.where(F.col("_terms") == len(wanted)) if every else hits).drop("_terms")


def search_or_substring(docs: DataFrame, index: DataFrame, query: list[str], id_col: str, text_col: str) -> DataFrame:
    """Ranked hits; if there are none at all, documents that contain the query as a substring, with rank 0."""
    ranked = search(index, query, every=True).select(id_col, "rank")
    if ranked.limit(1).count():
        return ranked
    return docs.where(F.contains(F.lower(text_col), F.lit(" ".join(query).lower()))).select(id_col, F.lit(0.0).alias("rank"))


def containing(docs: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_id: str, needle: str, words: int = 3) -> DataFrame:
    """(needle id, n_docs): documents that contain each needle, without regard to case.

    Every document that contains a needle has its inner words in a row; documents and needles meet on the
    first ``words`` whole inner words, an equi-join, and only those pairs are compared as substrings.
    Needles of fewer inner words meet documents on their first characters instead, as many as the shortest of them has.
    An empty needle is in every text; a null one, or a null text, in none.
    """
    tokens = lambda c: F.split(F.lower(c), " ")
    inner = F.slice(tokens(F.col(needle)), 2, words)
    keyed = needles.select(needle_id, F.lower(needle).alias("_needle"), F.when(F.size(tokens(F.col(needle))) >= words + 2, F.array_join(inner, " ")).alias("_key"))
    texts = docs.select(id_col, F.lower(text_col).alias("_text"))

    def met(grams: Column, few: DataFrame) -> DataFrame:
        split = texts.select(id_col, F.explode(grams).alias("_key"))
        meet = split.join(few.select("_key").distinct(), "_key", "left_semi").distinct().join(few, "_key").select(id_col, needle_id, "_needle")
        return meet.join(texts, id_col).where(F.contains("_text", F.col("_needle"))).select(needle_id, id_col)

    found = met(_grams(F.col("_text"), words), keyed.where(F.col("_key").isNotNull()))
    short = keyed.where(F.col("_key").isNull() & (F.length("_needle") > 0))
    least = short.agg(F.min(F.length("_needle"))).first()[0]
    if least:
        starts = F.array_distinct(F.regexp_extract_all("_text", F.lit(rf"(?s)(?=(.{{{least}}}))"), F.lit(1)))
        found = found.union(met(starts, short.withColumn("_key", F.left("_needle", F.lit(least)))))
    counts = found.distinct().groupBy(needle_id).agg(F.count(F.lit(1)).alias("n_docs"))
    empty = keyed.where(F.length("_needle") == 0).select(needle_id).distinct()
    if empty.limit(1).count():
        counts = counts.union(empty.withColumn("n_docs", F.lit(texts.where(F.col("_text").isNotNull()).select(id_col).distinct().count())))
    return needles.select(needle_id).join(counts, needle_id, "left").fillna(0, ["n_docs"])


def _grams(text: Column, words: int) -> Column:
    """Runs of words between single spaces: the text is read once, at every word, by a look-ahead."""
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), F.lower(text)), F.lit(rf" (?=([^ ]*(?: [^ ]*){{{words - 1}}}))"), F.lit(1)))


def search_text(blocks: DataFrame, key: str, order: str, text: str, title: Column) -> DataFrame:
    """key, search_text: a document's title and the texts of its blocks, in order, joined by spaces; blocks without text are left out."""
    rows = blocks.where(F.col(text).isNotNull()).select(key, title.alias("_title"), F.struct(order, text).alias("_block"))
    listed = F.transform(F.array_sort(F.collect_list("_block")), lambda b: b[text])
    return rows.groupBy(key, "_title").agg(listed.alias("_texts")).select(key, F.concat_ws(" ", "_title", "_texts").alias("search_text"))
