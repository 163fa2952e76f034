"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence by its words, a noisy-or
combines the scores to the document's, and only labels of documents train it:
P(toxic) = 1 - prod(1 - p(sentence)). The sentence scores then tell where the offence stands.

Training runs on the driver over a bounded sample: about ``train_rows`` labelled documents of any length, chosen
by a hash of the id. Of their sentences the driver gets those with words that may carry weight, and the number
of the others, which all score alike. Scoring reads every sentence of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import below, crc_mod, slices, stored, table, text_or_empty

TRAIN_ROWS = 20_000
#: Words of fewer training documents carry no weight, nor do those whose documents are labelled much like
#: all others (likelihood ratio G below LEAST_G, the 0.001 point of chi square).
MIN_DOCUMENTS = 3
LEAST_G = 10.83
#: Share of documents labelled toxic for reasons that no sentence shows.
NOISE = 0.02
STEPS = 200
RATE = 0.2
#: Gaussian prior on the weights: its precision.
PRIOR = 0.02
#: Smaller weights are noise of the sample; long documents would add them up.
LEAST_WEIGHT = 0.5
OFFENDING = 0.5
THRESHOLD = 0.7

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


@dataclass
class Sentences:
    """Words (as 64-bit hashes) of the sentences of some texts; starts and ends are byte positions."""

    word: np.ndarray
    of_word: np.ndarray  # the sentence of each word
    starts: np.ndarray
    of_sentence: np.ndarray  # the text of each sentence
    offsets: np.ndarray  # of the texts
    data: np.ndarray


def sentences(texts: pa.Array) -> Sentences:
    """Sentences end at . ! ? and line ends; words are runs of letters, digits, ' and non-ASCII, lower-cased in ASCII."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    offsets = offsets - first
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[1:] = _STOP[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[filled] = True
    starts = np.flatnonzero(begins[:n])
    of_sentence = np.searchsorted(offsets, starts, "right") - 1
    inside = _WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1:n]
    word_bytes = _LOWER[data[inside]].astype(np.uint64)
    at = np.flatnonzero(opens)
    head = np.flatnonzero(opens[inside])  # where words begin among the word bytes
    lengths = np.diff(np.append(head, len(word_bytes)))
    place = np.arange(len(word_bytes), dtype=np.int64) - np.repeat(head, lengths)
    word_bytes = (word_bytes + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    word_bytes ^= word_bytes >> np.uint64(31)
    word_bytes *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.add.reduceat(word_bytes, head) if len(head) else np.empty(0, np.uint64)
    number = np.cumsum(begins[:n], dtype=np.int32) - 1
    return Sentences(total ^ (total >> np.uint64(32)), number[at], starts, of_sentence, offsets, data)


@dataclass
class Model:
    """Weights of words by their hash (tags, sorted)."""

    tags: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(s)))

    def logits(self, s: Sentences) -> np.ndarray:
        if not len(self.tags):
            return np.full(len(s.starts), self.bias)
        at = np.searchsorted(self.tags, s.word)
        at[at == len(self.tags)] = 0
        hit = self.tags[at] == s.word
        return self.bias + np.bincount(s.of_word[hit], self.weights[at[hit]], minlength=len(s.starts))

    def document_scores(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of each text's sentences, and the sentences' own scores. A text without sentences has 0."""
        z = self.logits(s)
        softplus = np.logaddexp(0, z)
        total = np.bincount(s.of_sentence, softplus, minlength=len(s.offsets) - 1)
        return -np.expm1(-total), 1 / (1 + np.exp(-z))


def fit(tags: np.ndarray, feature: np.ndarray, sentence: np.ndarray, n_sentences: np.ndarray, labels: np.ndarray) -> Model:
    """Adam on the noisy-or likelihood of the documents' labels.

    tags: hashes of the words that may carry weight, sorted; feature and sentence: their occurrences, with
    sentences numbered through all documents; n_sentences: of each document. Sentences without such words are only counted.
    """
    if not len(labels) or labels.min() == labels.max():
        rate = float(np.clip(labels.mean(), 0.001, 0.5)) if len(labels) else 0.001
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(rate)) - 6)
    spoken, sentence = np.unique(sentence, return_inverse=True)
    document = np.searchsorted(np.cumsum(n_sentences), spoken, "right")
    silent = n_sentences - np.bincount(document, minlength=len(labels))
    w, b = np.zeros(len(tags)), -6.0
    m, v = np.zeros(len(tags) + 1), np.zeros(len(tags) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence, w[feature], minlength=len(document))
        clean = np.exp(-np.bincount(document, np.logaddexp(0, z), minlength=len(labels)) - silent * np.logaddexp(0, b))
        pull = np.where(labels == 1, -(1 - NOISE) * clean / (NOISE + (1 - NOISE) * (1 - clean)), 1.0)
        dz = pull[document] / (1 + np.exp(-z)) / len(labels)
        gradient = np.append(np.bincount(feature, dz[sentence], minlength=len(tags)) + PRIOR / len(labels) * w, dz.sum() + (pull * silent).sum() / (1 + np.exp(-b)) / len(labels))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], min(b - move[-1], -4.0)
    strong = np.abs(w) >= LEAST_WEIGHT
    return Model(tags[strong], w[strong], float(b))


def choose_words(rows: DataFrame) -> np.ndarray:
    """Hashes, sorted, of the words whose documents are labelled unlike the others; counted in Spark, over the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column("text"), rows=2000):
                s, labels = sentences(part.column("text")), part.column("label").to_numpy()
                distinct, code = np.unique(s.word, return_inverse=True)
                pairs = np.unique(code.astype(np.int64) * part.num_rows + s.of_sentence[s.of_word])
                n = np.bincount(pairs // part.num_rows, minlength=len(distinct))
                hits = np.bincount(pairs // part.num_rows, labels[pairs % part.num_rows], minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n, pa.int64()), pa.array(hits.astype(np.int64))], names=["word", "n", "hits"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).first()
    if not total["hits"] or total["hits"] == total["n"]:
        return np.empty(0, np.uint64)
    words = rows.mapInArrow(count, "word long, n long, hits long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    n, hits, all_n, all_hits = F.col("n"), F.col("hits"), F.lit(float(total["n"])), F.lit(float(total["hits"]))

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    rate = all_hits / all_n
    g = 2 * (part(hits, n * rate) + part(n - hits, n * (1 - rate)) + part(all_hits - hits, (all_n - n) * rate) + part(all_n - n - all_hits + hits, (all_n - n) * (1 - rate)))
    strong = words.where((n >= MIN_DOCUMENTS) & (g >= LEAST_G)).select("word").toArrow()
    return np.sort(strong.column("word").to_numpy().view(np.uint64))


def sample_order(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(3))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, text, label of about train_rows labelled documents, whatever other columns the two tables share.

    The labels are sampled first: so few that they go to every task of the scan.
    """
    some = labels.select(F.col(id_col), F.col(label_col), sample_order(id_col).alias("_order"))
    some = some.where(below("_order", train_rows, some.count())).drop("_order")
    return docs.select(id_col, text_col).join(F.broadcast(some), id_col)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on rows with a label of 0 or 1; about train_rows rows, chosen by a hash of the id. Other columns are ignored.

    The driver gets the occurrences of the chosen words only, and the number of each document's sentences.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        text_or_empty(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), sample_order(id_col).alias("order")
    )
    rows = stored(rows.where(below("order", train_rows, rows.count())), "toxicity-sample")
    tags = choose_words(rows)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column("text"), rows=2000):
                s = sentences(batch.column("text"))
                at = np.searchsorted(tags, s.word)
                at[at == len(tags)] = 0
                hit = tags[at] == s.word if len(tags) else np.zeros(len(s.word), bool)
                text = s.of_sentence[s.of_word[hit]]
                n = np.bincount(s.of_sentence, minlength=batch.num_rows)
                ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
                number = s.of_word[hit] - (np.cumsum(n) - n)[text]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (at[hit], number)]
                yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(n, pa.int32()), *lists], names=["order", "label", "n", "feature", "sentence"])

    got = rows.select("order", "label", "text").mapInArrow(occurrences, "order long, label int, n int, feature array<int>, sentence array<int>").toArrow()
    got = got.sort_by([("order", "ascending"), ("label", "ascending"), ("n", "ascending")]).combine_chunks()
    n = got.column("n").to_numpy().astype(np.int64)
    flat = {c: got.column(c).combine_chunks() for c in ("feature", "sentence")}
    sizes = np.diff(flat["feature"].offsets.to_numpy()) if got.num_rows else np.empty(0, np.int64)
    feature, sentence = (flat[c].flatten().to_numpy().astype(np.int64) for c in ("feature", "sentence"))
    return fit(tags, feature, sentence + np.repeat(np.cumsum(n) - n, sizes), n, got.column("label").to_numpy())


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and offending, the sentences of OFFENDING and more with their byte spans.

    Null and empty texts score 0. Other columns stay; columns named score or offending are replaced.
    """
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType())]))
    kept = [c for c in docs.columns if c not in ("score", "offending")]
    frame = docs.select(*kept, text_or_empty(text_col).alias("offending"))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("offending", spans)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(len(kept)), rows=2000):
                s = sentences(batch.column(len(kept)))
                total, each = model.document_scores(s)
                found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for i in np.flatnonzero(each >= OFFENDING):
                    doc, a = int(s.of_sentence[i]), int(s.starts[i])
                    b = int(min(s.starts[i + 1] if i + 1 < len(s.starts) else len(s.data), s.offsets[doc + 1]))
                    base = int(s.offsets[doc])
                    found[doc].append({"start": a - base, "end": b - base, "score": float(each[i]), "sentence": s.data[a:b].tobytes().decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.float64()), pa.array(found, arrow_spans)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_spans = to_arrow_type(spans)
    return frame.mapInArrow(apply, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1).select("doc_id", "toxic")
    model = train(labelled_sample(docs, labels))
    scored = score(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
