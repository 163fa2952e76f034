"""Personal data in texts: emails, addresses of hosts, payment cards, phone numbers.

Fixed patterns give base spans. A character-level bidirectional LSTM with a CRF over its tags (outside, begin and inside
of each kind) adds what the patterns miss: it is trained in numpy on the corpus's own base spans, and on copies of them
written in other ways (a phone without its +, digits grouped otherwise, an at sign in words), next to numbers that are none of these.

A span of any of the kinds has a digit or an at sign, which may be written [at] or (at). So text within REACH characters of one is cut into stretches, a
stretch into windows that overlap by half, and all are scored, whatever the length of the text. A character counts by the window
in which it lies farthest from the ends, and one Viterbi path over the whole stretch decides, so spans across windows are whole.
A span that the network finds is added if it touches no base span and is what it is called: so many digits,
the card's check sum, parts up to 255.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import below, slices, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begin, 2 + 2k inside of kind k
WINDOW, STEP, REACH = 96, 48, 40
HIDDEN = 16
#: Documents, chosen by a hash of their id, from which windows for training are cut.
TRAIN_DOCS = 20_000
#: Labelled windows of these that the network is trained on, chosen by a hash of document and place, and ways each is written in.
TRAIN_WINDOWS, WRITTEN = 2_000, 2
LEAST_TRAINED = 3_000
#: A window that a base span makes longer than this is not trained on.
LONGEST = 4 * WINDOW
EPOCHS, BATCH, RATE = 4, 64, 0.01
Span = tuple[int, int, int]  # kind, start, end


# Base spans. The patterns are the contract's; each is searched so that long runs of characters take linear time.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGNS = re.compile("[0-9@]+")
#: What every span holds, at signs in words too.
_ANCHORS = re.compile(r"[0-9@]+|[\[(]at[\])]")
_BREAK = re.compile(r"\s")


def emails(text: str) -> list[tuple[int, int]]:
    """An email begins where the run of its characters before the at sign does, or where the last one ended."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        rest = _DOMAIN.match(text, at) if begin < at else None
        if rest:
            found.append((begin, rest.end()))
        elif begin < at:
            free = at  # what has been walked over is not walked over again
        free = rest.end() if rest else max(free, at)
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _is_card(s: str) -> bool:
    return 13 <= len(d := _digits(s)) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    found = [(0, *span) for span in emails(text)] if "@" in text else []
    if _SIGNS.search(text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m.group().split("."))]
        found += [(2, *m.span()) for m in _CARD.finditer(text) if _is_card(m.group())]
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


# The network.


def coded(text: str) -> np.ndarray:
    """A number per character: ASCII as it is, 128 other letters, 129 other characters; 0 stands for what is beyond the text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    other = np.where((points >= 0xAA) & (points < 0x2000) | (points > 0x2E80), 128, 129)
    return np.where(points < 128, np.maximum(points, 1), other).astype(np.uint8)


SYMBOLS = 130
_ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b, b - 1) for b in range(TAGS)] for a in range(TAGS)])
_FIRST = np.array([b == 0 or b % 2 == 1 for b in range(TAGS)])
NEVER = np.float32(-1e4)


@dataclass
class Tagger:
    """symbols[c]: what a character adds to the gates (in, forget, out, new) of both directions."""

    symbols: np.ndarray  # SYMBOLS, 2, 4 H
    state: np.ndarray  # 2, H, 4 H
    out: np.ndarray  # 2 H, TAGS
    bias: np.ndarray  # TAGS
    moves: np.ndarray  # TAGS, TAGS

    def parameters(self) -> list[np.ndarray]:
        return [self.symbols, self.state, self.out, self.bias, self.moves]

    def run(self, windows: np.ndarray, keep: bool = False) -> tuple:
        """Scores of all tags at every character of windows (n, length), and with keep what training needs."""
        n, length = windows.shape
        both = np.stack([windows, windows[:, ::-1]])
        gates = np.empty((length, 2, n, 4 * HIDDEN), np.float32) if keep else None
        cells, hidden = np.empty((length + 1, 2, n, HIDDEN), np.float32), np.empty((length + 1, 2, n, HIDDEN), np.float32)
        cells[0], hidden[0] = 0, 0
        for t in range(length):
            z = hidden[t] @ self.state
            for way in range(2):
                z[way] += self.symbols[both[way, :, t], way]
            g = np.tanh(z[..., 3 * HIDDEN :])
            s = 1 / (1 + np.exp(-z[..., : 3 * HIDDEN]))
            cells[t + 1] = s[..., HIDDEN : 2 * HIDDEN] * cells[t] + s[..., :HIDDEN] * g
            hidden[t + 1] = s[..., 2 * HIDDEN :] * np.tanh(cells[t + 1])
            if keep:
                gates[t, ..., : 3 * HIDDEN], gates[t, ..., 3 * HIDDEN :] = s, g
        seen = np.concatenate([hidden[1:, 0], hidden[:0:-1, 1]], axis=2)  # length, n, 2 H
        scores = seen @ self.out + self.bias
        return (scores, seen, both, gates, cells, hidden) if keep else scores

    def masked(self) -> np.ndarray:
        return np.where(_ALLOWED, self.moves, NEVER)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(net: Tagger, windows: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the CRF a window, and its gradient by parameters()."""
    n, length = windows.shape
    scores, seen, both, gates, cells, hidden = net.run(windows, keep=True)
    moves, first = net.masked(), np.where(_FIRST, 0, NEVER).astype(np.float32)
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0] + first
    for t in range(1, length):
        ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, :, None] + moves, 1)
    for t in range(length - 1, 0, -1):
        behind[t - 1] = _log_sum(moves + (scores[t] + behind[t])[:, None, :], 2)
    whole = _log_sum(ahead[-1], 1)
    grad = np.exp(ahead + behind - whole[None, :, None])
    pairs = np.zeros((TAGS, TAGS), np.float32)
    for t in range(1, length):
        pairs += np.exp(ahead[t - 1][:, :, None] + moves + (scores[t] + behind[t])[:, None, :] - whole[:, None, None]).sum(0)
    rows, steps = np.arange(n), np.arange(length)[:, None]
    right = scores[steps, rows, tags.T].sum() + moves[tags[:, :-1], tags[:, 1:]].sum()
    loss = float((whole.sum() - right) / n)
    grad[steps, rows, tags.T] -= 1
    np.subtract.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    grad /= n
    d_out, d_bias = np.einsum("tnh,tnk->hk", seen, grad), grad.sum((0, 1))
    back = grad @ net.out.T
    ways = np.stack([back[..., :HIDDEN], back[::-1, :, HIDDEN:]], axis=1)  # length, 2, n, H in each way's own order
    d_symbols, d_state = np.zeros_like(net.symbols), np.zeros_like(net.state)
    d_h, d_c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    d_gates = np.empty_like(gates)
    turned = net.state.transpose(0, 2, 1)
    for t in range(length - 1, -1, -1):
        i, f, o, g = (gates[t, ..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        d_h = d_h + ways[t]
        top = np.tanh(cells[t + 1])
        d_c = d_c + d_h * o * (1 - top * top)
        d_gates[t] = np.concatenate([d_c * g * i * (1 - i), d_c * cells[t] * f * (1 - f), d_h * top * o * (1 - o), d_c * i * (1 - g * g)], axis=2)
        d_c = d_c * f
        d_h = d_gates[t] @ turned
    for way in range(2):
        d_state[way] = np.einsum("tnh,tnk->hk", hidden[:-1, way], d_gates[:, way])
        flat, order = d_gates[:, way].reshape(-1, 4 * HIDDEN), both[way].T.ravel()
        for symbol in np.unique(order):
            d_symbols[symbol, way] = flat[order == symbol].sum(0)
    return loss, [d_symbols, d_state, d_out, d_bias, np.where(_ALLOWED, pairs / n, 0).astype(np.float32)]


def fit(windows: np.ndarray, tags: np.ndarray, seed: int = 12) -> Tagger:
    """Adam on windows (n, WINDOW) of coded() characters and their tags."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: (random.standard_normal(shape) * 0.2).astype(np.float32)
    net = Tagger(draw(SYMBOLS, 2, 4 * HIDDEN), draw(2, HIDDEN, 4 * HIDDEN), draw(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    net.symbols[:, :, HIDDEN : 2 * HIDDEN] += 1  # remember at first
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            _, found = gradients(net, windows[order[at : at + BATCH]], tags[order[at : at + BATCH]])
            norm = np.sqrt(sum(float((g * g).sum()) for g in found))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS * 0.7)
            for p, g, m, v in zip(net.parameters(), found, first, second, strict=True):
                g = g * min(1.0, 5.0 / max(norm, 1e-6))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


# Training windows.


def _written(kind: int, span: str, random: np.random.Generator) -> tuple[int, str]:
    """The span of a kind written in another way, or as a number that is none: (kind or -1, text)."""
    pick = lambda *options: options[random.integers(len(options))]
    digits = _digits(span)
    if random.random() < 0.2:  # what looks alike and is none
        number = "".join(str(x) for x in random.integers(0, 10, random.integers(1, 13)))
        code = "".join(pick(*"0123456789abcdef") for _ in range(random.integers(8, 40)))
        year = str(random.integers(1900, 2100))
        return -1, pick(number, code, code.upper(), year, f"{year}-0{random.integers(1, 10)}-1{random.integers(10)}", f"1{random.integers(10)}:{random.integers(10, 60)}", f"{random.integers(1, 20)}.{random.integers(30)}.{random.integers(9)}", f"{number[:3]},{number[3:6]}", f"@{code[:6]}", f"{code[:3]} @ {number}", f"{number}%", f'"{code}"')
    if kind == 0:
        name, _, host = span.partition("@")
        sign = pick("@", "@", " @ ", "[at]", " [at] ", "(at)", " (at) ", "@ ")
        dot = pick(".", ".", ".", "[.]", " . ", "[dot]", " [dot] ", "(dot)")
        if random.random() < 0.2:
            at = random.integers(1, len(name) + 1)
            name = name[:at] + pick("é", "ü", "ñ", "ß") + name[at:]
        return kind, name + sign + host.replace(".", dot)
    if kind == 1:
        return kind, span.replace(".", pick(".", ".", "[.]", "(.)", " . ", "[dot]"))
    if kind == 2:
        gap = pick("", " ", "-", ".", "/", "  ", "_", "\n")
        return kind, gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    own = digits[-10:]
    area, middle, last = own[:3], own[3:6], own[6:]
    prefix = pick("", "", "", "1-", "1 ", f"00{digits[:-10] or 1} ", f"+{digits[:-10] or 1}/", f"(+{digits[:-10] or 1}) ")
    return kind, prefix + pick(f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", f"{area} {middle} {last}", f"{area}/{middle}-{last}", f"({area}){middle}-{last}")


def labelled_windows(texts: list[tuple[str, list[Span]]], written: int = WRITTEN, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of texts of about a window with their spans, as they are and written in other ways."""
    random = np.random.default_rng(seed)
    windows, tags = [], []
    rounds = max(written, -(-LEAST_TRAINED // max(1, len(texts))) - 1)
    for text, spans in texts:
        for again in range(1 + rounds):
            out, marks, at, begin = "", [], 0, 0
            for kind, start, end in sorted(spans, key=lambda s: s[1]):
                if start < at:
                    continue
                told, new = _written(kind, text[start:end], random) if again else (kind, text[start:end])
                out += text[at:start]
                if told >= 0:
                    marks.append((told, len(out), len(out) + len(new)))
                out, at, begin = out + new, end, len(out)
            out += text[at:]
            shift = max(0, min(begin - int(random.integers(0, WINDOW // 2)), len(out) - WINDOW)) if again else 0
            codes, tag = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
            part = coded(out[shift : shift + WINDOW])
            codes[: len(part)] = part
            for kind, start, end in marks:
                a, b = max(0, start - shift), min(WINDOW, end - shift)
                if a < b:
                    tag[a:b] = 2 + 2 * kind
                    tag[a] = 1 + 2 * kind
            windows.append(codes)
            tags.append(tag)
    return np.stack(windows), np.stack(tags)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_WINDOWS) -> Tagger | None:
    """Fits on at most ``most`` windows around digits and at signs, of about TRAIN_DOCS documents, labelled by base spans; None if there is no base span to learn from."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, pc.fill_null(whole.column(1), "")):
                ids, parts, spans = [], [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found, free = sorted(base_spans(text), key=lambda s: s[1]), 0
                    starts = [s[1] for s in found]
                    for m in _SIGNS.finditer(text):
                        if m.start() < free:
                            continue
                        begin = max(free, m.start() - WINDOW // 2)
                        at = bisect_left(starts, begin)
                        begin = max(free, min([begin, *(s[1] for s in found[max(0, at - len(KINDS)) : at] if s[2] > begin)]))
                        inner = found[bisect_left(starts, begin) : bisect_left(starts, begin + WINDOW)]
                        free = max([begin + WINDOW, *(s[2] for s in inner)])
                        if free - begin > LONGEST:
                            continue
                        ids.append(f"{i}:{begin}")
                        parts.append(text[begin:free])
                        spans.append([x for s in inner for x in (s[0], s[1] - begin, s[2] - begin)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.string()), pa.array(spans, pa.list_(pa.int32()))], names=["place", "part", "spans"])

    marked = F.col(text_col).cast("string").rlike("[0-9@]")
    chosen = docs.withColumn("_order", F.xxhash64(F.col(id_col).cast("string"), F.lit(7))).where(below("_order", TRAIN_DOCS, docs.count()))
    windows = chosen.where(marked).select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(cut, "place string, part string, spans array<int>")
    sample = windows.orderBy(F.xxhash64("place", F.lit(12)), "place", "part").limit(most).collect()
    texts = [(r["part"], [tuple(r["spans"][k : k + 3]) for k in range(0, len(r["spans"]), 3)]) for r in sample]
    return fit(*labelled_windows(texts)) if any(spans for _, spans in texts) else None


# Search.


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within REACH of a digit or an at sign, be it written [at] or (at), and to the ends of words there; parts that meet are one."""
    out: list[tuple[int, int]] = []
    for m in _ANCHORS.finditer(text):
        begin, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        known = out[-1][1] if out else 0
        while begin > known and not text[begin - 1].isspace():
            begin -= 1
        if end > known:
            stop = _BREAK.search(text, end)
            end = stop.start() if stop else len(text)
        if out and begin <= known:
            out[-1] = (out[-1][0], max(end, known))
        else:
            out.append((begin, end))
    return out


def best_paths(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best tags of each sequence of scores (length, TAGS); sequences of like length go together."""
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
    at = 0
    while at < len(order):
        longest = len(scores[order[at]]) * 3 // 2 + 16
        to = at
        while to < len(order) and len(scores[order[to]]) <= longest and to - at < 256:
            to += 1
        group = order[at:to]
        length = max(len(scores[k]) for k in group)
        padded = np.zeros((len(group), length, TAGS), np.float32)
        size = np.array([len(scores[k]) for k in group])
        for row, k in enumerate(group):
            padded[row, : len(scores[k])] = scores[k]
        best = padded[:, 0] + np.where(_FIRST, 0, NEVER)
        back = np.zeros((length, len(group), TAGS), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + moves
            on = (t < size)[:, None]  # behind its end a sequence stays as it is
            back[t] = np.where(on, ways.argmax(1), np.arange(TAGS))
            best = np.where(on, ways.max(1) + padded[:, t], best)
        tag = best.argmax(1)
        path = np.empty((length, len(group)), np.int8)
        for t in range(length - 1, -1, -1):
            path[t] = tag
            tag = back[t, np.arange(len(group)), tag]
        for row, k in enumerate(group):
            out[k] = path[: len(scores[k]), row]
        at = to
    return out


def tagged(net: Tagger, texts: list[str]) -> list[list[Span]]:
    """The spans that the network finds in each text, by start."""
    parts = [(k, a, b) for k, text in enumerate(texts) for a, b in stretches(text)]
    codes = [coded(texts[k][a:b]) for k, a, b in parts]
    cuts = [(p, s) for p, c in enumerate(codes) for s in ([0] if len(c) <= WINDOW else [*range(0, len(c) - WINDOW, STEP), len(c) - WINDOW])]
    scores = [np.empty((len(c), TAGS), np.float32) for c in codes]
    margin = [np.full(len(c), -1, np.int16) for c in codes]
    inside = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for at in range(0, len(cuts), 512):
        group = cuts[at : at + 512]
        windows = np.zeros((len(group), WINDOW), np.uint8)
        for row, (p, s) in enumerate(group):
            own = codes[p][s : s + WINDOW]
            windows[row, : len(own)] = own
        found = net.run(windows)
        for row, (p, s) in enumerate(group):
            own = slice(s, min(s + WINDOW, len(codes[p])))
            size = own.stop - s
            room = inside[:size].copy()
            if s == 0:
                room[: WINDOW // 2] = WINDOW  # nothing comes before
            better = room > margin[p][own]
            scores[p][own][better] = found[:size, row][better]
            margin[p][own][better] = room[better]
    out: list[list[Span]] = [[] for _ in texts]
    for (k, a, _), path in zip(parts, best_paths(scores, net.masked()), strict=True):
        for start in np.flatnonzero(path % 2 == 1).tolist():
            end = start + 1
            while end < len(path) and path[end] == path[start] + 1:
                end += 1
            out[k].append((int(path[start]) // 2, a + start, a + end))
    return out


_AT = r"\s?(?:@|[\[(]at[\])])\s?"
_DOT = r"(?:\.|\s\.\s|\s?[\[(](?:dot|\.)[\])]\s?)"
_EMAIL_LIKE = re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_PHONE_LIKE = re.compile(r"\(?\+?[0-9][\s()./0-9-]*[0-9]")


def is_a(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span can be what it is called; no letter or digit may stand next to it."""
    span = text[start:end]
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    if kind == 0:
        return _EMAIL_LIKE.fullmatch(span) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]+(?:[^0-9A-Za-z]+[0-9]+|\[dot\][0-9]+){3}", span) is not None and _is_ip(re.findall("[0-9]+", span))
    if kind == 2:
        return re.fullmatch(r"[0-9](?:[^0-9A-Za-z]{0,2}[0-9])+", span) is not None and _is_card(span)
    return _PHONE_LIKE.fullmatch(span) is not None and 9 <= len(_digits(span)) <= 15 and re.search("[^0-9]", span) is not None


def added_spans(net: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans of the network beside the base spans."""
    out = []
    for text, own, found in zip(texts, base, tagged(net, texts), strict=True):
        taken = sorted((s[1], s[2]) for s in own)
        ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        new = []
        for kind, start, end in found:
            before = bisect_left(taken, (end,))
            if (not before or ends[before - 1] <= start) and is_a(kind, text, start, end):
                new.append((kind, start, end))
        out.append(new)
    return out


def find_spans(docs: DataFrame, net: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base, spans: arrays of (kind, start, end) by KINDS, then start; code points, end exclusive. A row per document, repeated and null ids too.

    spans holds the base spans and those that the network adds (none without a network). A null text is empty. Other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("base array<struct<kind:string,start:bigint,end:bigint>>, spans array<struct<kind:string,start:bigint,end:bigint>>").fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, pc.fill_null(whole.column(1), "")):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                new = added_spans(net, texts, base) if net is not None else [[]] * len(texts)
                told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
                both = [told(sorted(a + b)) for a, b in zip(base, new, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(told, base)), kind), pa.array(both, kind)], names=schema.names)

    return docs.select(id_col, text_or_empty(text_col).alias("text")).mapInArrow(search, schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, train(docs))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))


QUERIES = {"op12_pii": op12_pii}
SQL: dict[str, str] = {}
