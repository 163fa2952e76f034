"""The LaTeX operators against small parsers that walk the characters with a stack."""

import random
import re

from pyspark.sql import functions as F

from blockloom.operators import latex


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def walked(text, keep=0):
    """(plain, spans) of nested marks by recursion; text: as made by marked()."""
    spans = []

    def group(i, at):
        out = ""
        while i < len(text) and text[i] != "}":
            m = re.match(r"\\(textbf|emph|texttt|box|label)\s*\{", text[i:])
            if m and m[1] == "label":
                before = len(spans)
                i = group(i + m.end(), 0)[1]
                del spans[before:]
            elif m:
                inner, end = group(i + m.end(), at + len(out))
                kind = latex.MARKS.get(m[1])
                if kind:
                    spans.append((at + len(out), len(inner), kind))
                out += inner
                i = end
            elif text[i] == "{":
                inner, i = group(i + 1, at + len(out) + 1)
                out += "{" + inner + "}"
            elif text[i] == "\\":
                out += text[i + 1] if text[i + 1] in "%{}" else text[i : i + 2]
                i += 2
            elif text[i] == "%":
                i = text.find("\n", i) if "\n" in text[i:] else len(text)
            else:
                out += text[i]
                i += 1
        return out, i + 1

    plain = group(0, 0)[0]
    return plain, sorted(spans, key=lambda s: (s[0], -s[1], s[2]))


def marked(rnd, depth=0, label=True):
    parts = []
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.randrange(8)
        if kind < 4 and depth < 12:
            name = rnd.choice(["textbf", "emph", "texttt", "box"])
            parts.append("\\" + name + rnd.choice(["", " "]) + "{" + marked(rnd, depth + 1, label) + "}")
        elif kind == 4 and label:
            parts.append("\\label{" + rnd.choice(["", "a", "b{c}", "\\emph{d}"]) + "}")
        elif kind == 5:
            parts.append("{" + marked(rnd, depth + 1, label) + "}")
        else:
            parts.append(rnd.choice(["word ", "é\U0001f600", "\\%", "\\{", "x", "\\\\", "% gone \\emph{y}\n", " "]))
    return "".join(parts)


def test_spans_against_a_stack(spark):
    rnd = random.Random(3)
    texts = [marked(rnd) for _ in range(300)] + ["\\textbf{" * 40 + "deep" + "}" * 40]
    got = latex.plain_spans(frame(spark, texts), "k", "t", unwrap=("box",), drop=("label",)).collect()
    for r in got:
        assert (r.plain, [tuple(s) for s in r.spans]) == walked(texts[r.k]), texts[r.k]
    assert len(got) == len(texts)


def test_spans_of_odd_texts(spark):
    texts = [None, "", "\\textbf", "\\textbf{open", "close}} \\emph{x}", "\\emph {}", "\\emph{a}{b}", "\\cmd{a}\\emph{b}"]
    got = {r.k: (r.plain, [tuple(s) for s in r.spans]) for r in latex.plain_spans(frame(spark, texts), "k", "t").collect()}
    assert got == {0: ("", []), 1: ("", []), 2: ("\\textbf", []), 3: ("\\textbf{open", []), 4: ("close}} x", [(8, 1, "italic")]), 5: ("", [(0, 0, "italic")]), 6: ("a{b}", [(0, 1, "italic")]), 7: ("\\cmd{a}b", [(7, 1, "italic")])}


def chosen(text):
    """Branches by a stack over the commands."""
    tokens, out, stack = re.split(r"(\\[A-Za-z]+)", text), "", []
    for token in tokens:
        name = token[1:] if token.startswith("\\") else ""
        live = all(s[1] for s in stack)
        if name.startswith("if") and len(name) > 2:
            kind = "first" if name in latex.TRUE_IFS else "second" if name in latex.FALSE_IFS else None
            out += token if kind is None and live else ""
            stack.append([kind, kind != "second", False])
        elif name == "else" and stack:
            kind, _, seen = stack[-1]
            if kind is None or seen:
                out += token if all(s[1] for s in stack) else ""
            else:
                stack[-1][1] = kind == "second"
            stack[-1][2] = True
        elif name == "fi" and stack:
            kind = stack.pop()[0]
            out += token if kind is None and all(s[1] for s in stack) else ""
        else:
            out += token if live else ""
    return out


def test_branches_against_a_stack(spark):
    rnd = random.Random(5)

    def made(depth=0):
        out = ""
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.6 and depth < 7:
                out += "\\" + rnd.choice([*latex.TRUE_IFS, *latex.FALSE_IFS, "ifmine"]) + " " + made(depth + 1) + (rnd.choice(["\\else ", ""]) and "\\else " + made(depth + 1)) + "\\fi "
            else:
                out += rnd.choice(["a ", "{b} ", "\\cmd ", "c"])
        return out

    texts = [made() for _ in range(300)] + [None, "\\fi stray \\else x", "\\iff"]
    got = {r.k: r.text for r in latex.branches(frame(spark, texts), "k", "t").collect()}
    assert got == {k: chosen(t or "") for k, t in enumerate(texts)}
    assert latex.branches(frame(spark, ["\\ifxetex never closed \\else x"]), "k", "t").first().text == "\\ifxetex never closed \\else x"


def test_inline_code(spark):
    texts = [r"a \verb+\x{y}+ b \lstinline[l=c]!int a;! \mintinline{py}{q} \verb*|s|", r"\begin{verbatim}\verb|k|\end{verbatim} 5\% % \verb|c|", r"\verb open", "", None]
    got = [r.x for r in frame(spark, texts).orderBy("k").select(latex.inline_code(F.col("t")).alias("x")).collect()]
    assert got == [r"a `\x{y}` b `int a;` `q` `s`", texts[1], texts[2], "", None]


TEXT = r"""\documentclass{article}
\begin{document}
\maketitle
Intro text % note \section{no}
more \verb|\section{x}| here.

Second par with \{ and $x_1$.
\section[short]{The \texttt{deploy {now}} command}
\begin{center}
\begin{itemize}
\item one \begin{enumerate} \item a
\item b \end{enumerate} tail
\item two
\end{itemize}
\end{center}
\begin{figure*}[h]
\begin{subfigure}\caption{first {x}}\label{a}\end{subfigure}\caption{second}\label{b}
\begin{tabular}{l@{\hspace{3cm}}r} a & b \end{tabular}
\end{figure*}
\[ x = \frac{1}{2} \]
\begin{theorem}[P] Let \begin{align} a \end{align} done \end{theorem}
\begin{lstlisting}[language=C]
\begin{itemize} \section{q}
\end{lstlisting}
\begin{comment} \section{no} \end{comment}
\begin{odd} \begin{even} z \end{even} \end{odd}
\begin{tabular}{l@{\hspace{3cm}}r}c\end{tabular}
\end{itemize} stray \begin{open} end.
\end{document} trailing
"""


def test_elements(spark):
    got = latex.elements(frame(spark, [TEXT, None, "", "plain only", "\\subsection*{T}x $$y$$ z"]), "k", "t").orderBy("k", "pos").collect()
    assert [(r.kind, r.name, r.level, r.text) for r in got if r.k == 0] == [
        ("paragraph", None, None, "Intro text\nmore \\verb|\\section{x}| here."), ("paragraph", None, None, "Second par with \\{ and $x_1$."), ("heading", None, 1, "The \\texttt{deploy {now}} command"),
        ("list", "itemize", None, "\\item one \\begin{enumerate} \\item a\n\\item b \\end{enumerate} tail\n\\item two"),
        ("figure", "figure", None, "\\begin{subfigure}\\caption{first {x}}\\label{a}\\end{subfigure}\\caption{second}\\label{b}\n\\begin{tabular}{l@{\\hspace{3cm}}r} a & b \\end{tabular}"),
        ("equation", "[", None, "x = \\frac{1}{2}"), ("theorem", "theorem", None, "Let \\begin{align} a \\end{align} done"), ("code", "lstlisting", None, "\\begin{itemize} \\section{q}"), ("embed", "odd", None, "\\begin{even} z \\end{even}"),
        ("tabular", "tabular", None, "c"), ("paragraph", None, None, "\\end{itemize} stray \\begin{open} end."),
    ]
    lists, figure = got[3], got[4]
    assert [tuple(i) for i in lists.items] == [(1, "one  tail"), (2, "a"), (2, "b"), (1, "two")] and (figure.caption, figure.label) == ("first {x}", "a")
    assert [(r.kind, r.level, r.text) for r in got if r.k == 3] == [("paragraph", None, "plain only")]
    assert [(r.kind, r.level, r.text) for r in got if r.k == 4] == [("heading", 2, "T"), ("paragraph", None, "x"), ("equation", None, "y"), ("paragraph", None, "z")]
    assert [r.pos for r in got if r.k == 0] == list(range(11)) and {r.k for r in got} == {0, 3, 4}


def test_normalised(spark):
    text = r"\begin{frame}[t]{One}\framesubtitle{s}\begin{tabularx}{3cm}{lX}a\end{tabularx}\end{frame}\begin{rSection}{Two}\titlepage"
    assert frame(spark, [text]).select(latex.normalised(F.col("t")).alias("x")).first().x == r"\section*{One}\textbf{s}\par\begin{tabular}{ll}a\end{tabular}\section*{Two}\maketitle"
