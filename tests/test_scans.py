"""Scans of arrays against plain loops, and plans of what is built on them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from blockloom.functions import scans
from blockloom.operators import trees
from blockloom.plans import editor_queries, latex_queries
from blockloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_stack(signs, names=None):
    """partner, around, depth of brackets without strays between names that differ."""
    partner, stack = [None] * len(signs), []
    for i, sign in enumerate(signs):
        if sign == "(":
            stack.append(i)
        elif sign == ")" and stack:
            j = stack.pop()
            partner[i], partner[j] = j, i
    around, depth, open_ = [None] * len(signs), [], []
    for i in range(len(signs)):
        if partner[i] is not None and partner[i] < i:
            open_.pop()
        around[i] = open_[-1] if open_ else None
        if partner[i] is not None and partner[i] > i:
            open_.append(i)
        depth.append(len(open_))
    return list(zip(partner, around, depth, strict=True))


def test_scans(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice("(()).") for _ in range(rnd.randint(0, 40))], [rnd.randint(0, 3) or None for _ in range(12)]) for k in range(200)] + [(200, None, None), (201, [], []), (202, ["("] * 3000 + [")"] * 3000, [1])]
    df = spark.createDataFrame(rows, "k int, s array<string>, g array<int>").repartition(3)
    signs = lambda x: F.transform("s", lambda t: t == x)
    df = df.withColumn("p", scans.pairs(signs("("), signs(")"))).withColumn("n", scans.inside(signs("("), F.col("p.partner")))
    df = df.withColumns({"t": scans.totals(F.col("g")), "r": scans.ranks(F.col("g")), "l": scans.latest(F.col("g"), F.transform("g", lambda x, i: i % 2 == 0))})
    for r in df.collect():
        assert [tuple(x) for x in r.p] == by_stack(r.s or []) and r.n == [x.depth for x in r.p]
        g = r.g or []
        assert [tuple(x) for x in r.t] == [(g[i], sum(x or 0 for x in g[: i + 1])) for i in range(len(g))]
        assert [tuple(x) for x in r.r] == [(x, None if x is None else g[: i + 1].count(x)) for i, x in enumerate(g)]
        assert r.l == [None if x is None else max((j for j in range(i + 1) if g[j] == x and j % 2 == 0), default=None) for i, x in enumerate(g)]


def test_pairs_agree_in_names(spark):
    df = spark.createDataFrame([(["(", "(", ")", ")"], ["a", "b", None, "a"]), (["(", ")"], [None, None])], "s array<string>, n array<string>")
    signs = lambda x: F.transform("s", lambda t: t == x)
    found = df.select(scans.pairs(signs("("), signs(")"), F.col("n")).alias("p")).collect()
    assert [[x.partner for x in r.p] for r in found] == [[3, None, None, 0], [1, 0]]


def test_json_needs_no_sort(spark):
    """tokens of JSON are neither sorted nor shuffled."""
    assert "Window" not in plan(editor_queries.deep_texts(Tables(spark, SF))) and "Join" not in plan(editor_queries.deep_texts(Tables(spark, SF)))
    assert "Window" not in plan(editor_queries.block_requirements(Tables(spark, SF)))
    broken = spark.createDataFrame([(1, '{"text":"a"}'), (2, "{"), (3, None), (4, '{"content":[{"text":"b"},{"content":[{"text":"\\u00e9"}]}]}')], "k int, c string")
    assert sorted(map(tuple, trees.walked_texts(broken, ["k"], "c").collect())) == [(1, "a"), (2, ""), (3, ""), (4, "b é")]


def test_branches_need_no_sort(spark):
    """tokens of conditionals are neither sorted nor shuffled."""
    found = plan(latex_queries.latex_branches(Tables(spark, SF)))
    assert "Window" not in found and "Join" not in found and "Aggregate" not in found


def test_deep_texts_hold_no_tokens(spark):
    """texts come from their own rows, one at a time, without arrays of tokens; they may lie deeper than a thousand levels."""
    found = plan(editor_queries.deep_texts(Tables(spark, SF)))
    assert "regexp_extract_all" not in found and found.count("ArrowEvalPython") == 1
    deep = '{"content":[' * 2000 + '{"text":"a"},[{"text":"\\ud800"}]' + "]}" * 2000
    odd = [deep, '{"text":"a","text":"b"}', '{"content":[{"text":NaN}]}', '{"content":[{"text":" p "},{"x":{"text":"no"}}]}', '[{"text":"q"}]', '"text"']
    rows = spark.createDataFrame(list(enumerate(odd)), "k int, c string")
    assert [r.text for r in trees.walked_texts(rows, ["k"], "c").orderBy("k").collect()] == ["a ?", "", "", "p", "q", ""]


def test_scans_by_slices(monkeypatch):
    """numbers are held for a stretch of rows at a time, with the same results."""
    rnd = random.Random(9)
    rows = [[rnd.choice("(.)") for _ in range(rnd.randint(0, 9))] for _ in range(50)] + [None, ["("] * 30 + [")"] * 30]
    opens, closes = (pa.array([None if r is None else [t == x for t in r] for r in rows], pa.list_(pa.bool_())) for x in "()")
    whole = scans._pairs.func(opens, closes)
    monkeypatch.setattr(scans, "SLICE", 20)
    parts = scans.slices(opens)
    assert len(parts) > 10 and sum(n for _, n in parts) == len(rows) and max(sum(len(r or []) for r in rows[a : a + n]) for a, n in parts[:-1]) <= 20
    assert scans._pairs.func(opens, closes).to_pylist() == whole.to_pylist() and scans.slices(opens[:0]) == [(0, 0)]
