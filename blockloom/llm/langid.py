"""Language identification with a byte convolutional network trained in numpy.

One convolution over bytes for each width, max pooling over a window, and softmax. A text is cut
into windows of WINDOW bytes that overlap by the widest filter less one, so every run of bytes that
a filter can see is seen; a text's probabilities are its windows' mean, weighted by their length.

Training uses a bounded sample: about ``train_rows`` texts of each language, chosen in the scan by a
hash of the id, and TRAIN_WINDOWS windows of each, spread over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod, slices, table, text_or_empty, trimmed

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 128
TRAIN_ROWS = 1_000
#: Every language is learned that labels so many texts.
LEAST_TEXTS = 3
#: Texts of all languages together; with many languages each has an equal part.
TRAIN_TOTAL = 100_000
TRAIN_WINDOWS = 4
EPOCHS = 6
BATCH = 128
RATE = 0.01
UNDETERMINED = "und"
#: A clean text scores at least the score that LEAST_SHARE of all labelled texts do not exceed, and never needs more than LEAST_SCORE.
LEAST_SHARE = 0.005
LEAST_SCORE = 0.6
#: Scores are counted in so many cells between 0 and 1.
CELLS = 1000


@dataclass
class Network:
    """taps[k][o] holds, for filters of width WIDTHS[k], each byte's response at offset o."""

    langs: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out_bias: np.ndarray
    _pairs: list | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_pairs": None}

    def pairs(self) -> list[list[tuple[int, np.ndarray]]]:
        """The taps of two neighbouring offsets summed for every pair of bytes; an odd last tap stays single."""
        if self._pairs is None:
            self._pairs = []
            for tap in self.taps:
                own = [(o, (tap[o][:, None] + tap[o + 1][None, :]).reshape(65536, -1)) for o in range(0, len(tap) - 1, 2)]
                self._pairs.append(own + ([(len(tap) - 1, tap[-1])] if len(tap) % 2 else []))
        return self._pairs

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max over the window of every filter, for windows of bytes (n, WINDOW)."""
        two = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        out = []
        for width, parts in zip(WIDTHS, self.pairs(), strict=True):
            span = windows.shape[1] - width + 1
            got = None
            for o, taps in parts:
                codes = two if len(taps) == 65536 else windows
                part = taps[codes[:, o : o + span]]
                got = part if got is None else np.add(got, part, out=got)
            out.append(got.max(axis=1))
        return np.concatenate(out, axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(windows) + self.bias, 0)
        return softmax(hidden @ self.dense + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each); bytes beyond a text's end are 0."""
    step = WINDOW - max(WIDTHS) + 1
    lengths = np.diff(offsets)
    n = np.where(lengths > 0, np.maximum(1, -(-(lengths - (WINDOW - step)) // step)), 0)
    text = np.repeat(np.arange(len(lengths)), n)
    start = offsets[:-1][text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    at = start[:, None] + np.arange(WINDOW)
    end = offsets[1:][text]
    windows = np.where(at < end[:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(text) else np.empty((0, WINDOW), np.uint8)
    return windows, text, np.minimum(end - start, WINDOW)


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 5) -> Network:
    """Adam on cross-entropy; gradients flow to the bytes where each filter had its maximum."""
    random = np.random.default_rng(seed)
    taps = [(random.standard_normal((w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    net = Network(langs, taps, np.zeros(total, np.float32), (random.standard_normal((total, len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*taps, net.bias, net.dense, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS if len(langs) > 1 else 0):
        order = random.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            tops, maxima = [], []
            for tap, width in zip(taps, WIDTHS, strict=True):
                span = WINDOW - width + 1
                got = sum(tap[o][x[:, o : o + span]] for o in range(width))
                tops.append(got.argmax(axis=1))
                maxima.append(np.take_along_axis(got, tops[-1][:, None], 1)[:, 0])
            pooled = np.concatenate(maxima, axis=1) + net.bias
            hidden = np.maximum(pooled, 0)
            wrong = softmax(hidden @ net.dense + net.out_bias)
            wrong[np.arange(len(y)), y] -= 1
            wrong /= len(y)
            back = (wrong @ net.dense.T) * (pooled > 0)
            gradients = []
            for k, (tap, width) in enumerate(zip(taps, WIDTHS, strict=True)):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(tap)
                for o in range(width):
                    seen = np.take_along_axis(x, tops[k] + o, 1).astype(np.int64)
                    g[o] = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), own.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
                gradients.append(g)
            gradients += [back.sum(0), hidden.T @ wrong, wrong.sum(0)]
            step += 1
            for p, g, m, v in zip(params, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def training_texts(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """text, lang: about train_rows rows of each language, with a non-empty text."""
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_or_empty(text_col)) > 0)).select(
        text_or_empty(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(4)).alias("order")
    )
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS).collect()]
    each = max(1, min(train_rows, TRAIN_TOTAL // max(1, len(counts))))
    shares = [(lang, min(int(min(1.0, each / n) * 2.0**63), (1 << 63) - 1)) for lang, n in counts]
    most = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, most long"))
    return rows.join(most, "lang").where(F.shiftrightunsigned("order", 1) <= F.col("most")).select("text", "lang")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Network:
    """Fits on rows with a language and a non-empty text; about train_rows of each language."""
    return train_on(training_texts(labelled, text_col, lang_col, id_col, train_rows))


def train_on(texts: DataFrame) -> Network:
    """Fits on all rows of training_texts()."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lang = [t.encode() for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
            out, names = [], []
            for t, name in zip(texts, lang, strict=True):
                spread = max(0, len(t) - WINDOW)
                starts = sorted({spread * k // max(1, TRAIN_WINDOWS - 1) for k in range(TRAIN_WINDOWS)})
                out += [t[s : s + WINDOW].ljust(WINDOW, b"\0") for s in starts]
                names += [name] * len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["window", "lang"])

    got = texts.mapInArrow(sample, "window binary, lang string").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    lang = got.column("lang").to_pylist()
    langs = sorted(set(lang))
    windows = np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return fit(windows, np.array([langs.index(x) for x in lang], np.int64), langs)


def predict(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, the mean probability of that language over the whole text's windows.

    Texts that are null or have no letter, and all texts if no language was learned, get 'und' and 0.
    Other columns stay; columns named lang_pred or score are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    text = F.col(text_col).cast("string")
    letters = text.rlike(r"\p{L}")
    plain = text_col in kept and docs.schema[text_col].dataType == T.StringType()  # then it travels once, beside a flag
    at = kept.index(text_col) if plain else len(kept)
    frame = docs.select(*kept, (letters if plain else F.when(letters, text)).alias("score"))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.langs, UNDETERMINED], dtype=object)
        for whole in batches:
            for batch in slices(whole, whole.column(at), rows=200, size=2 << 20):
                texts = pc.if_else(batch.column(len(kept)).fill_null(False), batch.column(at), "") if plain else batch.column(at)
                texts = texts.fill_null("").cast(pa.large_string())
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
                windows, text, size = cut_windows(data, offsets - offsets[0])
                if not net.langs:
                    windows, text, size = windows[:0], text[:0], size[:0]
                mass = np.zeros((batch.num_rows, len(net.langs)))
                for k in range(0, len(windows), 512):
                    p = net.probabilities(windows[k : k + 512]) * size[k : k + 512, None]
                    np.add.at(mass, text[k : k + 512], p)
                weight = np.bincount(text, size, minlength=batch.num_rows)
                known = weight > 0
                best = np.where(known, mass.argmax(axis=1), len(net.langs)) if net.langs else np.zeros(batch.num_rows, int)
                score = np.where(known, mass.max(axis=1, initial=0) / np.maximum(weight, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=schema.names)

    return frame.mapInArrow(trimmed(apply), schema)


def least_score(predicted: DataFrame, net: Network, lang_col: str = "lang") -> float:
    """The score below which a text is in none of the network's languages, from all rows of predict() that are labelled with one of these.

    Fewer than LEAST_SHARE of them fall below it; it is a multiple of 1 / CELLS. 0 if there is nothing to fit on.
    """
    labelled = predicted.where((F.col("lang_pred") != UNDETERMINED) & F.col(lang_col).cast("string").isin(net.langs))
    counts = sorted(labelled.groupBy(F.floor(F.col("score") * CELLS).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
    below = np.cumsum([r["n"] for r in counts])
    if not len(below):
        return 0.0
    fitted = counts[int(np.searchsorted(below, below[-1] * LEAST_SHARE - 1e-9))]["cell"] / CELLS
    return min(LEAST_SCORE, fitted)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.where(crc_mod("doc_id", 5) != 0))
    predicted = predict(docs.select("doc_id", "text"), net)
    return predicted.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
SQL: dict[str, str] = {}
