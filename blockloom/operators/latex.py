r"""LaTeX to rows. A text becomes tokens; what a parser would keep on a stack are running sums over them.

The tokenizer is one pattern whose first alternatives shield what must not be read: verbatim environments and
inline verbatim are one token each, comments too. Brackets of any kind form a monoid: the running sum of opens less
closes, less its running minimum, is the depth, and strays fall out; at a depth, opens and closes alternate, so the next row
there is the partner. Depths of braces, environments, conditionals and lists come from this one step, whatever the nesting.

All functions take a frame with a document key and a text, and give a row, or rows, for each of its rows. The tokens of a
document are an array in its own row, cut by Spark; Arrow batches of them are worked on in slices of many documents, so
there is no sort and no shuffle of tokens. Optional arguments in square brackets are read with the command before them unless
they hold braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scans
from ..functions.scans import picked

_VERBATIM = r"verbatim|lstlisting|minted|comment"
_OPTION = r"(?:\[[^\]\[{}]*\])?"
TOKEN = "|".join((
    rf"\\begin\{{({_VERBATIM})(\*?)\}}[\s\S]*?\\end\{{\1\2\}}",
    rf"\\(?:verb\*?|lstinline{_OPTION}|mintinline\{{[^{{}}]*\}})(?:\{{[^{{}}]*\}}|([^A-Za-z\s*{{])[\s\S]*?\3)",
    rf"\\begin\{{[A-Za-z]+\*?\}}{_OPTION}", r"\\end\{[A-Za-z]+\*?\}", rf"\\[A-Za-z]+\*?{_OPTION}", r"\\[\s\S]",
    r"%[^\n]*", r"\$\$?", r"[{}]", r"[^\\{}$%]+", r"\\",
))
_IF = r"(?:if[A-Za-z]+|else|fi)(?![A-Za-z])"
_RUN = "|".join((
    r"[^\\%]+", r"\\(?:" + "|".join((
        rf"(?!{_IF})(?:begin\{{({_VERBATIM})(\*?)\}}[\s\S]*?\\end\{{\1\2\}}",
        rf"(?:verb\*?|lstinline{_OPTION}|mintinline\{{[^{{}}]*\}})(?:\{{[^{{}}]*\}}|([^A-Za-z\s*{{])[\s\S]*?\3)",
        rf"begin\{{[A-Za-z]+\*?\}}{_OPTION}", rf"[A-Za-z]+\*?{_OPTION})", r"[^A-Za-z]", r"(?![\s\S])",
    )) + ")", r"%[^\n]*",
))
#: For conditionals: a command of theirs, and all up to the next one, are one token; what TOKEN shields is read over.
IF_TOKEN = rf"(?:\\{_IF}\*?{_OPTION}|(?!\\{_IF})(?=[\s\S]))(?:{_RUN})*+"

#: Environments by what they become, those that only style what they hold, and brace arguments of those that take any (fixed values).
KINDS = {
    "equation": ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math"),
    "figure": ("figure", "wrapfigure", "marginfigure", "marginlisting"),
    "table": ("table", "margintable", "sidewaystable", "wraptable"),
    "tabular": ("tabular", "tabularx", "longtable", "supertabular"),
    "list": ("itemize", "enumerate", "description"),
    "theorem": ("theorem", "lemma", "proposition", "corollary", "definition", "example", "remark", "proof", "conjecture", "axiom"),
    "algorithm": ("algorithm",),
    "abstract": ("abstract",),
    "bibliography": ("thebibliography",),
    "blockquote": ("quote", "quotation", "verse"),
}
PASS_THROUGH = ("document", "center", "flushleft", "flushright", "spacing", "small", "footnotesize", "large", "minipage", "multicols", "tcolorbox", "landscape", "frame", "sloppypar", "samepage")
ARGUMENTS = {"tabular": 1, "tabularx": 2, "longtable": 1, "supertabular": 1, "wrapfigure": 2, "wraptable": 2, "thebibliography": 1}
SECTIONS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
#: Conditionals whose branch is known where pdfTeX compiles: true ones keep the first branch, false ones the second (fixed values).
TRUE_IFS, FALSE_IFS = ("ifpdftex", "iftrue"), ("ifxetexorluatex", "ifxetex", "ifluatex", "iffalse")
#: Marks of inline text (fixed values).
MARKS = {"textbf": "bold", "textit": "italic", "emph": "italic", "underline": "underline", "texttt": "monospace"}


TEXT, OPEN, CLOSE, MATH, COMMENT, SHIELD, BEGIN, END, VERB, COMMAND, ESCAPE = range(11)
_WORD = re.compile(r"\\([A-Za-z]+)")
_SPECIAL = ("begin", "end", "verb", "lstinline", "mintinline")
_STARTS = (
    (SHIELD, rf"\\begin\{{(?:{_VERBATIM})\*?\}}[\s\S]*\\end\{{"), (BEGIN, r"\\begin\{"), (END, r"\\end\{"),
    (VERB, r"\\(?:verb|lstinline|mintinline)[^A-Za-z\s][\s\S]|\\mintinline"),
)
_STARTS = tuple((kind, re.compile(pattern, re.ASCII)) for kind, pattern in _STARTS)
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{([A-Za-z]+)")
_SPACES = " \t\n\r\f\v\u0085\u2028\u2029"
_BLANK = re.compile(r"\s*[\u0085\u2028\u2029]?", re.ASCII)


def _told(token: str) -> tuple[int, str | None]:
    """Kind and name of a token."""
    if token[0] != "\\":
        return {"{": OPEN, "}": CLOSE, "$": MATH, "%": COMMENT}.get(token[0], TEXT), None
    word = _WORD.match(token)
    if not word:
        return ESCAPE, None
    kind = next((kind for kind, pattern in _STARTS if pattern.match(token)), COMMAND) if word[1].startswith(_SPECIAL) else COMMAND
    found = None if kind == VERB else word if kind == COMMAND else _ENVIRONMENT.match(token)
    return kind, found and found[1]


def _tokens(text: Column, token: str = TOKEN) -> Column:
    """array<string>: the tokens in order; joined, they are the text again. A null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(token), F.lit(0))


class _Tokens(scans.Laid):
    """The tokens of some documents. kind: one of the above; name: a number for that of a command or environment, without star, else 0; blank: whether a token is only space."""

    def __init__(self, texts: pa.Array, codes: np.ndarray, row: np.ndarray, told: tuple[np.ndarray, ...], numbers: dict[str, int]) -> None:
        super().__init__(row)
        self.texts, self.codes, self.told, self.numbers = texts, codes, told, numbers
        self.kind, self.name, self.blank = (x[codes] for x in told)

    @classmethod
    def of(cls, lists: pa.ListArray) -> _Tokens:
        """Each different token is looked at once."""
        flat = lists.flatten().dictionary_encode()
        texts = flat.dictionary
        kinds, names, blanks, numbers = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), {}
        for i, token in enumerate(texts.to_pylist()):
            kinds[i], name = _told(token)
            names[i] = numbers.setdefault(name, len(numbers) + 1) if name else 0
            blanks[i] = token[0] in _SPACES and _BLANK.fullmatch(token) is not None
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return cls(texts, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths), (kinds, names, blanks), numbers)

    def where(self, keep: np.ndarray) -> _Tokens:
        return _Tokens(self.texts, self.codes[keep], self.row[keep], self.told, self.numbers)

    def reads(self, text: str) -> np.ndarray:
        """Whether a token is this text."""
        return pc.equal(self.texts, text).to_numpy(zero_copy_only=False)[self.codes]

    def named(self, names: Iterable[str], of: np.ndarray | None = None) -> np.ndarray:
        """Whether the name, or a number in its place, is one of these."""
        return self.number(dict.fromkeys(names, 1), self.name if of is None else of, 0) == 1

    def number(self, values: dict[str, int], of: np.ndarray, missing: int) -> np.ndarray:
        """Values by name, for numbers of names."""
        out = np.full(len(self.numbers) + 1, missing)
        for name, value in values.items():
            if name in self.numbers:
                out[self.numbers[name]] = value
        return out[of]

    def joined(self, groups: np.ndarray, n: int, keep: np.ndarray, texts: pa.Array | None = None, changed: np.ndarray | None = None) -> pa.Array:
        """The kept tokens of each of n groups, in order, as one text; groups are numbers from 0. texts: what tokens are to read instead, those that changed, if not all."""
        if changed is not None:
            codes, texts = self.codes + changed * len(self.texts), pa.concat_arrays([self.texts, texts])
        else:
            codes, texts = self.codes, self.texts if texts is None else texts
        at = np.flatnonzero(keep)
        at = at[np.argsort(groups[at], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(groups[at], minlength=n))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.take(pa.array(codes[at]))), "")


class _Braces:
    """Pairs of braces. open, close: of whole pairs; argument: the number of the argument that a brace opens, owner (a name) and of (a kind): the command or environment before the first one; 0, 0 and -1 for others."""

    def __init__(self, t: _Tokens) -> None:
        opens = t.kind == OPEN
        self.partner, self.depth = t.pairs(opens, t.kind == CLOSE)
        self.open, self.close = opens & (self.partner >= 0), ~opens & (self.partner >= 0)
        blank = t.blank & (t.kind == TEXT)
        one, two = t.place(-1), t.place(-2)
        before = np.where(picked(blank, one, False).astype(bool), two, one)
        calls = np.isin(picked(t.kind, before, TEXT), (COMMAND, BEGIN))
        first = self.open & ~picked(self.close, before, False).astype(bool)
        level = np.where(self.open, self.depth, np.where(self.close, self.depth + 1, 0))
        begin = t.grouped(level, lambda laid, at: picked(at, laid.last(first[at]), -1))
        count = t.grouped(level, lambda laid, at: laid.sums(self.open[at].astype(np.int64)))
        owner = np.where(calls, picked(t.name, before, 0), 0)
        held = self.open & (begin >= 0) & (picked(owner, begin, 0) > 0)
        self.argument = np.where(held, count - picked(count, begin, 0) + 1, 0)
        self.owner = np.where(held, picked(owner, begin, 0), 0)
        self.of = np.where(held, picked(picked(t.kind, before, -1), begin, -1), -1)

    def where(self, keep: np.ndarray) -> _Braces:
        """Those of the kept tokens; a partner that goes is none."""
        out, place = object.__new__(_Braces), np.where(keep, np.cumsum(keep) - 1, -1)
        for name, values in vars(self).items():
            setattr(out, name, values[keep])
        out.partner = picked(place, out.partner, -1)
        return out

    def inside(self, t: _Tokens, test: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs that the test picks: whether they open at a token, whether it lies in one (its braces included), and how many have opened."""
        opens = test & self.open
        shuts = self.close & picked(opens, self.partner, False).astype(bool)
        return opens, (t.sums(opens.astype(np.int64) - shuts) > 0) | shuts, t.sums(opens.astype(np.int64))


def _by_slices(kind: T.DataType, walk: Callable[..., pa.Array]) -> Callable[..., Column]:
    """A column function of token arrays: walk gets the tokens of some documents, and how many these are."""

    @F.arrow_udf(kind)
    def run(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([walk(_Tokens.of(lists.slice(*part)), part[1]) for part in scans.slices(lists)])

    return run


def _listed(rows: np.ndarray, n: int, **columns: pa.Array) -> pa.Array:
    """Lists of structs, one for each of n documents; rows: the document of each struct, rising."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def branches(docs: DataFrame, key: str, text: str, true: tuple[str, ...] = TRUE_IFS, false: tuple[str, ...] = FALSE_IFS) -> DataFrame:
    """key, text: conditionals whose branch is known give way to it, nested to any depth; others, and those without an end, stay. A row for each document."""

    def walk(t: _Tokens, n: int) -> pa.Array:
        command = t.kind == COMMAND
        opens = command & t.named(x for x in t.numbers if x.startswith("if") and x not in ("if", "iff", "ifthenelse"))
        partner, depth = t.pairs(opens, command & t.named(["fi"]))
        # a conditional's marks (its begin, each \\else, its end) are a group, named by where it begins
        other = command & t.named(["else"])
        begin = np.where(partner >= 0, np.minimum(t.index, partner), np.where(other, t.around(opens, partner, depth), -1))
        no = t.grouped(begin + 1, lambda laid, _: laid.index - laid.first + 1)
        name = picked(t.name, begin, 0)
        first, second = t.named(true, name), t.named(false, name)
        # what begins (1) or ends (-1) to be dead at a mark of a known conditional; a further \\else is text of the branch
        at_end = np.where(no > 2, first, second)  # up to the end the second branch is dead, or the only one
        step = np.where(begin == t.index, second, np.where(other, np.where(second, -1, 1), -at_end.astype(np.int64)))
        mark = (first | second) & ~(other & (no > 2))
        dead = t.sums(np.where(mark, step, 0))
        after = pc.replace_substring_regex(t.texts, rf"^\\(?:if[A-Za-z]+|else|fi)\*?{_OPTION}", "", max_replacements=1)
        return t.joined(t.row, n, dead == 0, after, mark)

    return docs.select(key, _by_slices(T.StringType(), walk)(_tokens(F.col(text), IF_TOKEN)).alias("text"))


def inline_code(text: Column) -> Column:
    r"""Inline verbatim (\verb, \lstinline, \mintinline, any delimiter) as `code`; verbatim environments and comments stay as they are."""
    begin = rf"\\(?:verb\*?|lstinline{_OPTION}|mintinline\{{[^{{}}]*\}})"
    verb = rf"{begin}(?:\{{[^{{}}]*\}}|([^A-Za-z\s*{{])[\s\S]*?\1)"
    shield = rf"\\begin\{{({_VERBATIM})(\*?)\}}[\s\S]*?\\end\{{\2\3\}}|\\[^A-Za-z]|%[^\n]*"
    parts = F.regexp_extract_all(text, F.lit(rf"{verb}|{shield}|[^\\%]+|[\s\S]"), F.lit(0))
    quoted = lambda x: F.concat(F.lit("`"), F.regexp_replace(F.regexp_replace(x, rf"^{begin}", ""), r"^[\s\S]|[\s\S]\z", ""), F.lit("`"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(rf"^{verb}\z"), quoted(x)).otherwise(x)), "")


def normalised(text: Column) -> Column:
    """Variants of environments in their plain form: tabularx, rSection, frames and their titles."""
    for pattern, plain in (
        (r"\\end\{tabularx\}", r"\\end{tabular}"), (r"\\begin\{rSection\}\s*\{([^}]*)\}", r"\\section*{$1}"), (r"\\end\{(?:rSection|frame)\}", ""),
        (r"\\begin\{frame\}\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}", r"\\section*{$1}"), (r"\\begin\{frame\}\s*(?:\[[^\]]*\])?", ""), (r"\\frametitle\s*\{([^}]*)\}", r"\\section*{$1}"),
        (r"\\framesubtitle\s*\{([^}]*)\}", r"\\textbf{$1}\\par"), (r"\\titlepage\b", r"\\maketitle"),
    ):
        text = F.regexp_replace(text, pattern, plain)
    wide = r"\\begin\{tabularx\}\s*\{[^}]*\}\s*\{([^}]*)\}"
    columns = lambda x: F.concat(F.lit("\\begin{tabular}{"), F.translate(F.regexp_extract(x, wide, 1), "X", "l"), F.lit("}"))
    parts = F.regexp_extract_all(text, F.lit(rf"{wide}|[^\\]+|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(rf"^{wide}"), columns(x)).otherwise(x)), "")


_SPANS = T.StructType().add("plain", T.StringType()).add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("type", T.StringType())))


def plain_spans(docs: DataFrame, key: str, text: str, marks: dict[str, str] = MARKS, unwrap: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    r"""key, plain, spans (start, length, type): text without the commands that mark it, at any depth, and where in the plain text each mark lies.

    marks and unwrap: commands of one argument that give way to it; the former leave a span. drop: commands that go with their
    argument. Offsets are running sums of what is kept, so they refer to the plain text. Comments go; escaped signs lose
    their backslash; a command without its argument stays. Spans are ordered by start, the longer first, then by type; a null text is empty.
    """
    known, kinds = [*marks, *unwrap, *drop], sorted(set(marks.values()))

    def walk(t: _Tokens, n: int) -> pa.Array:
        t = t.where(t.kind != COMMENT)
        brace = _Braces(t)
        own = brace.open & (brace.argument == 1) & t.named(known, brace.owner)
        shut = brace.close & picked(own, brace.partner, False).astype(bool)
        called_by = np.where(own, brace.owner, np.where(shut, picked(brace.owner, brace.partner, 0), 0))
        blank, next_own = t.blank, lambda by: picked(own, t.place(by), False).astype(bool)
        follows = next_own(1) | (picked(blank, t.place(1), False).astype(bool) & next_own(2))
        called = (t.kind == COMMAND) & t.named(known) & follows
        gap = blank & picked(called, t.place(-1), False).astype(bool)
        drops = t.named(drop, called_by)
        dropped = t.sums((own & drops).astype(np.int64) - (shut & drops))
        gone = called | gap | own | shut | (dropped > 0)
        plain = pa.array([x[1] if len(x) == 2 and x[0] == "\\" and x[1] in "#$%&_{}" else x for x in t.texts.to_pylist()], pa.string())
        lengths = np.where(gone, 0, pc.utf8_length(plain).to_numpy(zero_copy_only=False)[t.codes] if len(t.codes) else 0)
        start = t.sums(lengths) - lengths
        kind = t.number({name: kinds.index(mark) for name, mark in marks.items()}, brace.owner, -1)
        at = np.flatnonzero(own & (kind >= 0) & (dropped == 0))
        length = start[brace.partner[at]] - start[at]
        order = np.lexsort((kind[at], -length, start[at], t.row[at]))
        at, length = at[order], length[order]
        found = _listed(t.row[at], n, start=pa.array(start[at], pa.int64()), length=pa.array(length, pa.int64()), type=pa.array(kinds, pa.string()).take(pa.array(kind[at])))
        return pa.StructArray.from_arrays([t.joined(t.row, n, ~gone, plain), found], names=["plain", "spans"])

    return docs.select(key, _by_slices(_SPANS, walk)(_tokens(F.col(text))).alias("_s")).select(key, "_s.plain", "_s.spans")


_ITEMS = T.ArrayType(T.StructType().add("depth", T.IntegerType()).add("text", T.StringType()))
_FOUND = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "name")] + [T.StructField("level", T.IntegerType())] + [T.StructField(x, T.StringType()) for x in ("text", "captioned", "labelled")] + [T.StructField("items", _ITEMS)]))


def _elements(t: _Tokens, n: int) -> pa.Array:
    """The elements of documents as _FOUND: kind (null: of text), name, level, the tokens of text, of the first caption and label with their braces, and all items."""
    t = t.where((t.kind != COMMENT) & ~((t.kind == SHIELD) & t.named(["comment"])))
    brace = _Braces(t)
    document = t.named(["document"])
    start = t.last((t.kind == BEGIN) & document)
    final = np.searchsorted(t.row, t.row, side="right") - 1  # the last token of the document
    after = t.index > picked(start, final, -1)
    before = t.sums(((t.kind == END) & document).astype(np.int64)) == 0
    t, brace = t.where(after & before), brace.where(after & before)
    double = t.reads("$$")
    sign = np.where(double, 2 - t.sums(double.astype(np.int64)) % 2, t.reads("\\[") + 2 * t.reads("\\]"))
    numbers = [t.numbers.setdefault(x, len(t.numbers) + 1) for x in ("$$", "[")]
    t.name = np.where(sign > 0, np.where(double, *numbers), t.name)
    opens = (t.kind == BEGIN) | (sign == 1)
    partner, _ = t.pairs(opens, (t.kind == END) | (sign == 2), t.name)
    env_open, env_close = opens & (partner >= 0), ~opens & (partner >= 0)
    passes = t.named(PASS_THROUGH)
    into, out = env_open & ~passes, env_close & ~passes
    depth = t.sums(into.astype(np.int64) - out)
    styled = (partner >= 0) & passes & (depth == 0)
    # arguments of the outermost environments and of styles are no text
    limit = np.where(depth == 1, t.number(ARGUMENTS, brace.owner, 0), np.where(t.named(PASS_THROUGH, brace.owner) & (depth == 0), 9, 0))
    only = brace.argument == 1
    setup = brace.inside(t, (brace.of == BEGIN) & (brace.argument <= limit))[1]
    held = {name: brace.inside(t, only & t.named([of], brace.owner)) for name, of in (("captioned", "caption"), ("labelled", "label"))}
    title_open, titled, _ = brace.inside(t, only & t.named(SECTIONS, brace.owner) & (depth == 0))
    at = lambda flags, by: picked(flags, t.place(by), False).astype(bool)
    heads = (t.kind == COMMAND) & t.named(SECTIONS) & (depth == 0) & np.where(at(t.blank, 1), at(title_open, 2), at(title_open, 1))
    code = (t.kind == SHIELD) & (depth == 0)
    starts = (into & (depth == 1)) | code | heads
    shuts = (out & (depth == 0)) | code | ((t.kind == CLOSE) & titled & ~at(titled, 1))
    begins = starts | t.new | at(shuts, -1)
    element = np.cumsum(begins) - 1
    # lists inside: the item of a token is the last one at its own depth
    is_list = t.named(KINDS["list"])
    list_in, list_out = env_open & is_list, env_close & is_list
    lists = t.sums(list_in.astype(np.int64) - list_out)
    is_item = (t.kind == COMMAND) & t.named(["item"]) & (lists > 0)
    item = t.grouped(np.maximum(lists, 0), lambda laid, at: picked(at, laid.last((is_item | list_in)[at]), -1))
    in_item = (lists > 0) & picked(is_item, item, False).astype(bool) & ~list_in & ~list_out & ~is_item
    edge, brace_sign = starts | shuts, (t.kind == OPEN) | (t.kind == CLOSE)
    gone = styled | setup | (~(t.kind == SHIELD) & ((edge & (t.kind != CLOSE)) | (titled & brace_sign & (title_open | shuts))))
    firsts = np.flatnonzero(begins)
    m = len(firsts)
    # a row for each element
    heading, shield, formula, outer = heads[firsts], code[firsts], np.isin(t.name[firsts], numbers) & starts[firsts], (into & starts)[firsts]
    names = pa.array([None, *t.numbers], pa.string())
    kinds = [None, "heading", "code", "equation", *KINDS, "embed"]
    by_name = t.number({name: kinds.index(kind) for kind, of in KINDS.items() for name in of}, t.name[firsts], kinds.index("embed"))
    kind = np.select([heading, shield, formula, outer], [1, 2, 3, by_name], 0)
    level = t.number(SECTIONS, t.name[firsts], 0)
    texts = {}
    for name, (_, inside, no) in held.items():
        where = np.flatnonzero(inside)
        chosen = np.zeros(m, np.int64)
        chosen[element[where[::-1]]] = no[where[::-1]]  # of the first in the element
        texts[name] = t.joined(element, m, inside & (no == chosen[element]) if m else inside)
    # items by element, then by where they begin
    which = element * (len(t.row) + 1) + item
    keys, groups = np.unique(which[in_item], return_inverse=True)
    of = np.zeros(len(t.row), np.int64)
    of[in_item] = groups
    begin = keys % (len(t.row) + 1)
    per = np.bincount(keys // (len(t.row) + 1), minlength=m)
    items = pa.StructArray.from_arrays([pa.array(lists[begin], pa.int32()), t.joined(of, len(keys), in_item)], names=["depth", "text"])
    ends = np.concatenate([[0], np.cumsum(per)])
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(per == 0, False)), items)
    return _listed(
        t.row[firsts], n, kind=pa.array(kinds, pa.string()).take(pa.array(kind)), name=names.take(pa.array(np.where((kind > 1), t.name[firsts], 0))),
        level=pa.array(level, pa.int32(), mask=~heading), text=t.joined(element, m, ~gone), captioned=texts["captioned"], labelled=texts["labelled"], items=listed,
    )


def elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    r"""key, pos (from 0), kind, name, level, text, caption, label, items: the elements of each document in order.

    kind: heading (level and title), paragraph (one for each part between blank lines, without lines of a lone command), code, embed (an unknown environment), or one
    of KINDS; name: of the environment. The outermost environment takes all it holds; environments that only style
    (PASS_THROUGH) and comments give way to what they hold. text: what the environment holds, without arguments. caption, label: the first inside.
    items (depth, text): of all lists inside, nested ones too, in order. What has no partner of its name is text.
    """
    inner = lambda x: F.nullif(F.regexp_replace(x, r"^\{|\}\z", ""), F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")

    def bodies(x: Column) -> Column:
        code = F.regexp_replace(F.regexp_replace(x["text"], r"^\\begin\{[a-z]+\*?\}(?:\[[^\]]*\])?(?:\{[^}\n]*\})?\n?", ""), r"\n?\\end\{[a-z]+\*?\}\z", "")
        lone = F.transform(F.split(x["text"], r"\n[ \t]*\n\s*"), lambda p: F.regexp_replace(p, r"(?m)^[ \t]*\\[A-Za-z]+\*?[ \t]*(?:\n|\z)", ""))
        parts = F.transform(F.filter(lone, lambda p: ~p.rlike(r"^\s*$")), lambda p: F.regexp_replace(strip(p), r"[ \t]+\n", "\n"))
        return F.when(x["kind"].isNull(), parts).when(x["kind"] == "code", F.array(code)).otherwise(F.array(strip(x["text"])))

    def told(x: Column, body: Column) -> Column:
        whole = F.coalesce(x["kind"] != "heading", F.lit(False))
        items = F.transform(x["items"], lambda i: F.struct(i["depth"].alias("depth"), F.trim(strip(i["text"])).alias("text")))
        return F.struct(
            F.coalesce(x["kind"], F.lit("paragraph")).alias("kind"), x["name"].alias("name"), x["level"].alias("level"), body.alias("text"),
            F.when(whole, inner(x["captioned"])).alias("caption"), F.when(whole, inner(x["labelled"])).alias("label"), F.when(x["kind"].isNotNull(), items).alias("items"),
        )

    found = docs.select(key, _by_slices(_FOUND, _elements)(_tokens(F.col(text))).alias("_found"))
    each = F.flatten(F.transform("_found", lambda x: F.transform(bodies(x), lambda body: told(x, body))))
    return found.select(key, F.posexplode(each).alias("pos", "_x")).select(key, "pos", "_x.*")


_ENTRIES = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("page", T.StringType())]))


def _entries(t: _Tokens, n: int) -> pa.Array:
    """The entries of auxiliary files that have a label or page, as _ENTRIES; with the braces of both."""
    brace = _Braces(t)
    ours = t.named(["newlabel"], brace.owner)
    value_open, value, _ = brace.inside(t, ours & (brace.argument == 2))
    _, label, _ = brace.inside(t, ours & (brace.argument == 1))
    entry = t.sums(((t.kind == COMMAND) & t.named(["newlabel"])).astype(np.int64))
    outer = picked(brace.depth, t.last(value_open), -1)
    group = brace.open & value & (brace.depth == outer + 1)
    number = t.grouped(entry, lambda laid, at: laid.sums(group[at].astype(np.int64)))
    _, page, _ = brace.inside(t, group & (number == 2))
    keys, groups = np.unique(t.row * (len(t.row) + 1) + entry, return_inverse=True)
    keep = np.bincount(groups, label | page, minlength=len(keys)) > 0
    texts = [t.joined(groups, len(keys), x).filter(pa.array(keep)) for x in (label, page)]
    row, entry = keys[keep] // (len(t.row) + 1), keys[keep] % (len(t.row) + 1)
    return _listed(row, n, entry=pa.array(entry, pa.int32()), label=texts[0], page=texts[1])


def page_map(docs: DataFrame, key: str, text: str, prefix: str = "blk-") -> DataFrame:
    r"""key, label, page: where the labels of an auxiliary file stand, without their prefix; labels without it are left out.

    An entry is \newlabel{label}{{number}{page}...}; groups may hold groups. Only whole numbers are pages; of a label that is defined more than once the last counts.
    """
    bare = lambda x: F.regexp_replace(x, r"^\{|\}\z", "")
    rows = docs.select(key, F.inline(_by_slices(_ENTRIES, _entries)(_tokens(F.col(text)))))
    found = rows.select(key, "entry", bare(F.col("label")).alias("label"), F.trim(bare(F.col("page"))).try_cast("int").alias("page"))
    found = found.where(F.startswith("label", F.lit(prefix)) & F.col("page").isNotNull())
    return found.groupBy(key, F.substring("label", len(prefix) + 1, 1 << 30).alias("label")).agg(F.max_by("page", "entry").alias("page"))
