"""Periodic runs of words: stretches that repeat with a period at least three times over.

Squares (tandem repeats) are found as Gusfield and Stoye do. Lempel-Ziv blocks of a text tell where the
leftmost occurrence of every kind of square can lie: around the blocks' borders. Longest common
extensions there give squares that cover all leftmost ones. Walks along suffix links from these, each
step dropping the first word and asking whether it can follow the last, complete the vocabulary of
squares. A square is a place in the suffix tree; the leaves below it are all its occurrences. Squares of
one period that begin at consecutive words are one run.

The suffix tree is kept as a suffix array with its common prefixes: a place is an interval of the array. It comes
from the names of factors of 2^k words (two factors have equal names if they are equal), which
also answer longest common extensions ahead and behind. All steps but the Lempel-Ziv parse are numpy over many texts
at once, each text's words told apart from all others'. Squares of squares are left out: a run has its least period.

What can hold no run is passed over first, exactly: in a run of 24 words and three periods, nine windows of
8 words in a row return within one period. Stretches where windows return so soon are cut out with all that a run
from there can reach, and only they are searched. Memory is some 300 bytes for each word of a stretch, of
which a task holds those of 8 MB of text, or of one longer text, at a time.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, table, text_or_empty

LEAST_LENGTH = 24
LEAST_TIMES = 3


class SuffixTree:
    """Of a sequence of numbers in which the ends of texts, and number 0 before the first, occur once only."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        names = np.unique(text, return_inverse=True)[1]
        self.text, self.names, width = text, [names.astype(np.int32)], 1
        while names.max(initial=0) + 1 < n:
            after = np.zeros(n, np.int64)
            after[: n - width] = names[width:] + 1
            names = np.unique(names * np.int64(n + 1) + after, return_inverse=True)[1]
            self.names.append(names.astype(np.int32))
            width *= 2
        self.leaf = names
        self.array = np.empty(n, np.int64)
        self.array[names] = np.arange(n)
        shared = np.zeros(n, np.int32)
        shared[1:] = self.ahead(self.array[:-1], self.array[1:])
        self.least = [shared]  # least[k][r]: of the 2^k common prefixes up to r
        while (size := 1 << (len(self.least) - 1)) * 2 <= n:
            last = self.least[-1]
            self.least.append(np.concatenate([last[:size], np.minimum(last[size:], last[:-size])]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are the same, for i other than j."""
        at, other = i.astype(np.int64), j.astype(np.int64)
        for k in reversed(range(len(self.names))):
            step = (self.names[k][at] == self.names[k][other]).astype(np.int64) << k
            at, other = at + step, other + step
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i and j, these included, are the same."""
        at, other = i.astype(np.int64), j.astype(np.int64)
        for k in reversed(range(len(self.names))):
            a, b = at - (1 << k) + 1, other - (1 << k) + 1
            step = ((a >= 0) & (b >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
            at, other = at - step, other - step
        return i - at

    def place(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the place of the ``length`` words at i."""
        low, high = self.leaf[i].astype(np.int64), self.leaf[i].astype(np.int64)
        n = len(self.text)
        for k in reversed(range(len(self.least))):
            low -= (self.least[k][low] >= length) * ((low >= 1 << k).astype(np.int64) << k)
            up = high + (1 << k)
            high = np.where((up < n) & (self.least[k][np.minimum(up, n - 1)] >= length), up, high)
        return low, high

    def blocks(self) -> np.ndarray:
        """Begins of the Lempel-Ziv blocks: each is as long as the longest prefix of what follows that begins earlier too, or one word."""
        n = len(self.text)
        earlier, later, stack = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for i in self.array.tolist():  # nearest leaves on both sides that begin earlier
            while stack and stack[-1] > i:
                later[stack.pop()] = i
            if stack:
                earlier[i] = stack[-1]
            stack.append(i)
        earlier[0] = later[0] = n - 1
        everywhere = np.arange(n)
        longest = [np.where(other < everywhere, self.ahead(everywhere, other), 0) for other in (earlier, later)]
        length, begins, i = np.maximum(*longest).tolist(), [], 0
        while i < n:
            begins.append(i)
            i += max(1, length[i])
        return np.array(begins)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counts its index and 0, 1, ... below it, one after another."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(begin, half length) of primitive squares that cover, by rotation to the right, the leftmost square of every kind."""
    begin = tree.blocks()
    end = np.append(begin[1:], len(tree.text))
    size = end - begin
    # centre in the block, begin in it: the border is the block's end
    block, k = _spread(np.where(end < len(tree.text), size, 0))
    k, border = k + 1, end[block]
    partner = border - k
    right, left = tree.ahead(border, partner), tree.behind(border - 1, partner - 1)
    fits = (right + left >= k) & (right > 0)
    found = [(np.maximum(partner - left, partner - k + 1)[fits], k[fits])]
    # begin before the block, centre in it: the border is the block's begin
    reach = np.where(begin > 0, np.minimum(size + np.append(size[1:], 0), len(tree.text) - 1 - begin), 0)
    block, k = _spread(reach)
    k, border = k + 1, begin[block]
    partner = border + k
    right, left = tree.ahead(border, partner), tree.behind(border - 1, partner - 1)
    start = np.maximum(border - left, border - k + 1)
    fits = (right + left >= k) & (left > 0) & (start + k <= end[block])
    found.append((start[fits], k[fits]))
    start, half = (np.concatenate(x) for x in zip(*found, strict=True))
    start, half = np.unique(np.stack([start, half]), axis=1) if len(start) else (start, half)
    return start[(p := primitive(tree, start, half))], half[p]


def primitive(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the ``half`` words at start are no power of fewer words."""
    most = int(half.max(initial=1))
    factor = np.zeros(most + 1, np.int64)
    for p in range(2, most + 1):
        if not factor[p] and p * p <= most:
            own = factor[p * p :: p]
            own[own == 0] = p
    factor[factor == 0] = np.arange(most + 1)[factor == 0]
    good, rest = np.ones(len(half), bool), half.copy()
    while (left := np.flatnonzero(rest > 1)).size:
        p = factor[rest[left]]
        period = half[left] // p
        good[left] &= tree.ahead(start[left], start[left] + period) < half[left] - period
        rest[left] //= p
    return good


def vocabulary(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, last leaf, half length) of every kind of square, by walks along suffix links from the covering ones.

    As long as the word that a step drops follows in the text itself, the next square is one word on; so a walk
    takes all steps that its occurrence allows at once, and looks for another occurrence where they end.
    """
    n = len(tree.text)
    known = np.empty(0, np.int64)
    kept: list[tuple[np.ndarray, ...]] = []
    while len(start):
        room = np.minimum(tree.ahead(start, start + half) - half, half - 1)
        which, step = _spread(room + 1)
        k = half[which]
        low, high = tree.place(start[which] + step, 2 * k)
        key, first = np.unique(low * (n + 1) + k, return_index=True)
        new = first[~np.isin(key, known, assume_unique=True)]
        kept.append((low[new], high[new], k[new]))
        known = np.union1d(known, key)
        stuck = room < half - 1  # not all rotations seen: drop the first word and ask for it behind
        i, k = (start + room)[stuck], half[stuck]
        low, high = tree.place(i + 1, 2 * k - 1)
        names, word = tree.names[0], tree.names[0][i]
        below, above = low, high + 1
        while (open_ := below < above).any():  # the first leaf below the place whose next word is not less
            middle = np.where(open_, (below + above) // 2, low)
            less = names[tree.array[middle] + 2 * k - 1] < word
            below, above = np.where(open_ & less, middle + 1, below), np.where(open_ & ~less, middle, above)
        leaf = np.minimum(below, high)
        follows = (below <= high) & (names[tree.array[leaf] + 2 * k - 1] == word)
        start, half = tree.array[leaf[follows]], k[follows]
        low, _ = tree.place(start, 2 * half)
        key, first = np.unique(low * (n + 1) + half, return_index=True)
        fresh = first[~np.isin(key, known, assume_unique=True)]
        start, half = start[fresh], half[fresh]
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (known, known, known)


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs that hold a square, for each text of word numbers, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    size = np.array([len(t) for t in texts], np.int64)
    if not size.sum():
        return out
    begin = np.cumsum(size + 1) - size  # word 0 and one after each text belong to no text
    words = np.concatenate(texts).astype(np.int64)
    words -= words.min()
    owner = np.repeat(np.arange(len(texts)), size)
    text = np.empty(len(words) + len(texts) + 1, np.int64)
    ends = np.append(0, begin + size)
    inner = np.ones(len(text), bool)
    inner[ends] = False
    text[inner] = owner * (words.max() + 1) + words
    text[ends] = (len(texts) + 1) * (words.max() + 1) + np.arange(len(ends))
    tree = SuffixTree(text)
    low, high, half = vocabulary(tree, *covering_squares(tree))
    which, step = _spread(high - low + 1)
    start, period = tree.array[low[which] + step], half[which]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(start))[: len(at)] - 1
    found, period = start[at], period[at]
    length = start[last] + 2 * period - found
    text_of = np.searchsorted(begin, found, "right") - 1
    for i in np.lexsort((period, found)):
        out[text_of[i]].append((int(found[i] - begin[text_of[i]]), int(length[i]), int(period[i])))
    return out


def stretches(words: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> list[tuple[int, int]]:
    """Begin and end of parts that hold every run whole; ends: where the texts end in words, one after another."""
    n = len(words)
    again = -(-least_length * (least_times - 1) // least_times)  # so many words in a row return after one period at least
    gram = max(1, again // 2)
    if n < least_length or n <= gram:
        return []
    number = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    number ^= number >> np.uint64(29)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    value = text[: n - gram + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(gram):
        value = value * np.uint64(0xBF58476D1CE4E5B9) + number[k : n - gram + 1 + k]
    inside = np.flatnonzero(text[: n - gram + 1] == text[gram - 1 :])
    inside = inside[np.argsort(value[inside], kind="stable")]
    distance = np.zeros(n - gram + 2, np.int64)
    same = value[inside[1:]] == value[inside[:-1]]
    distance[inside[:-1][same]] = np.diff(inside)[same]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], distance > 0, [False]]).astype(np.int8)))
    out: list[tuple[int, int]] = []
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        here = np.flatnonzero(np.diff(text[low:high])) + low + 1 if text[low] != text[high - 1] else []
        for a, b in zip([low, *here], [*here, high], strict=True):
            reach = (b - a + gram - 1) // (least_times - 1)  # no period is longer
            if b - a + gram - 1 >= again and distance[a:b].min() <= reach:
                end = min(b + gram + reach, int(ends[text[a]]))
                if out and a < out[-1][1]:
                    out[-1] = (out[-1][0], max(out[-1][1], end))
                else:
                    out.append((int(a), end))
    return out


def found_runs(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of words, by start and period."""
    number = defaultdict(count().__next__)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(ends[-1]) if len(ends) else 0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts = stretches(words, ends, least_length, least_times)
    for (begin, _), runs in zip(parts, runs_of([words[a:b] for a, b in parts]), strict=True):
        text = int(np.searchsorted(ends, begin, "right"))
        offset = begin - (int(ends[text - 1]) if text else 0)
        out[text] += [(offset + s, length, q) for s, length, q in runs if length >= max(least_length, least_times * q)]
    return out


def repeated_tail(words: list[bytes], doc_id: object) -> list[bytes]:
    """The contract's change: in every tenth document, by crc32 of its id, the words from some point on repeat with a period. A null id is an empty text."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


Change = Callable[[list[bytes], object], list[bytes]]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, change: Change | None = None) -> DataFrame:
    """id, runs (by start and period), best, collapsed: a row per document, repeated and null ids too.

    A run is a stretch of consecutive words with smallest period q and a length of at least least_length and
    least_times * q that no neighbouring word extends. best: the one with the greatest exact length / period, then the smallest
    start and period; null without runs. collapsed: the words joined by one space, without those that a run contains
    after its first q words. Words are runs of what is no ASCII white space; a null text has none. Other columns are ignored.
    change: of a document's words and id, before the search.
    """
    run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(f"runs array<{run}>, best {run}, collapsed string").fields])
    kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, pc.fill_null(whole.column(1), "")):
                ids = batch.column(0).to_pylist()
                texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]  # bytes: at ASCII white space only
                if change:
                    texts = [change(words, i) for words, i in zip(texts, ids, strict=True)]
                runs = found_runs(texts, least_length, least_times)
                best = [max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else None for own in runs]
                collapsed = []
                for words, own in zip(texts, runs, strict=True):
                    if own:
                        keep = np.ones(len(words), bool)
                        for start, length, period in own:
                            keep[start + period : start + length] = False
                        words = [words[i] for i in np.flatnonzero(keep)]
                    collapsed.append(b" ".join(words).decode())
                told = lambda r: r and dict(zip(kind.names, r, strict=True))
                columns = [pa.array([[told(r) for r in own] for own in runs], pa.list_(kind)), pa.array(list(map(told, best)), kind), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(search, schema)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), change=repeated_tail)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


SQL = {
    "op11_runs": r"""
        WITH bits AS (
            SELECT list(list_reduce(list_concat([b], range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
        c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(doc_id::VARCHAR, ''), '') AS k FROM documents),
        h AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_concat([4294967295], list_transform(k, lambda x: ord(x)::BIGINT)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM c, bits),
        a AS (SELECT *, (h // 10) % greatest(n, 1) AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
        d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w, n FROM p),
        x AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
        e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND r.i - l.i <= l.n // 3),
        g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM e),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(24, 3 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
        f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM r GROUP BY doc_id),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
        u AS (SELECT DISTINCT x.doc_id, x.i FROM x JOIN r ON x.doc_id = r.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM x ANTI JOIN u USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM d LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""
}
QUERIES = {"op11_runs": op11_runs}
