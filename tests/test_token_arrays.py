"""Tokens of LaTeX stay in the rows of their documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.functions import scans
from blockloom.operators import latex
from blockloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["latex_nested", "latex_spans", "unwrapped_commands", "page_numbers"])
def test_no_windows(spark, name):
    """no sort and no shuffle of tokens; what is grouped are lines, files or entries, not tokens."""
    found = plan(catalog.QUERIES[name](spark, SF))
    assert "Window" not in found and "pos#" not in "".join(line for line in found.splitlines() if "Aggregate" in line)


def test_walks_by_slices():
    """documents come out alike, however many are worked on at once."""
    rnd = random.Random(2)
    parts = ["\\begin{itemize}", "\\end{itemize}", "\\item ", "{", "}", "\\caption{", "\\label", "$$", "\\[", "\\]", "%c\n", " ", "a b", "\\newlabel{blk-a}{{1}{2}}", "\\section{x}", "\n\n", "\\begin{verbatim}v\\end{verbatim}"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(60)] + ["", "{" * 400 + "}" * 400]
    lists = pa.array([[m.group() for m in re.finditer(latex.TOKEN, x, re.ASCII)] for x in texts], pa.list_(pa.string()))
    for walk in (latex._elements, latex._entries):
        whole = walk(latex._Tokens.of(lists), len(lists))
        cut = [walk(latex._Tokens.of(lists.slice(*part)), part[1]) for part in scans.slices(lists, 40)]
        assert len(cut) > 10 and pa.concat_arrays(cut).to_pylist() == whole.to_pylist()
        assert walk(latex._Tokens.of(lists[:0]), 0).to_pylist() == []


def test_laid_against_loops():
    """Sums, neighbours and last flags stay within their row, and within its groups."""
    rnd = np.random.default_rng(1)
    row, group, flag = np.sort(rnd.integers(0, 9, 200)), rnd.integers(0, 3, 200), rnd.integers(0, 2, 200) > 0
    laid = scans.Laid(row)
    ahead, sums, last, count = laid.place(2), laid.sums(group), laid.last(flag), laid.grouped(group, lambda x, at: x.sums(flag[at].astype(int)))
    for i in range(200):
        own = [j for j in range(200) if row[j] == row[i]]
        upto = [j for j in own if j <= i]
        assert ahead[i] == (i + 2 if i + 2 in own else -1) and sums[i] == sum(group[j] for j in upto)
        assert last[i] == max((j for j in upto if flag[j]), default=-1) and count[i] == sum(flag[j] for j in upto if group[j] == group[i])


def test_conditionals_and_what_hides_them(spark):
    """a token is a command of a conditional and all up to the next one; verbatim, comments and options hide commands."""
    hidden = "\\fi*\\fix \\verb|\\fi| \\begin{verbatim}\\fi\\end{verbatim}\\\\fi %\\else\n\\cmd[\\fi]\\if"
    parts, rnd = ["\\iftrue", "\\fi", "\\else ", "\\verb|", "|", "%", "\n", "\\begin{comment}", "\\end{comment}", "[", "]", "\\", "a", "{", "\\lstinline", "\\begin{x}", "*"], random.Random(8)
    texts = ["A\\ifxetex X\\else[k] P{$" + hidden + "\\iff\\"] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = rows.select("t", latex._tokens(F.col("t")).alias("short"), latex._tokens(F.col("t"), latex.IF_TOKEN).alias("long")).orderBy("k").collect()
    assert found[0].long == ["A", "\\ifxetex X", "\\else[k] P{$", hidden, "\\iff\\"]
    mark = re.compile(r"\\(?:if[A-Za-z]+|else|fi)(?![A-Za-z])")
    for r in found:
        short, long = ([m[0] for x in tokens if (m := mark.match(x))] for tokens in (r.short, r.long))
        assert "".join(r.long) == r.t and long == short
