import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockloom.functions import columns, markup
from blockloom.operators import blocks, emit, findings, fulltext, maintain, parsers, predicates, relational, sequences
from blockloom.sources import tables
from blockloom.streaming import events as stream


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def test_percent_rounds_half_to_even_and_guards_zero(spark):
    assert one(spark, columns.percent(F.lit(1), F.lit(16))) == 6.2
    assert [one(spark, columns.percent(F.lit(0), F.lit(0), d)) for d in (0.0, 100.0, None)] == [0.0, 100.0, None]


def test_null_counts_as_a_user(spark):
    df = spark.createDataFrame([(1,), (2,), (1,), (None,)], "u int")
    assert df.agg(columns.distinct_with_null("u").alias("n")).first().n == 3
    assert df.where("u > 9").agg(columns.distinct_with_null("u").alias("n")).first().n == 0


def test_search_escapes_or_keeps_wildcards(spark):
    df = spark.createDataFrame([("50% off",), ("50 off",), ("a_b",), ("axb",), (None,)], "t string")
    found = lambda needle, **k: [r.t for r in df.where(predicates.search_any(needle, "t", **k)).collect()]
    assert found("0%") == ["50% off"] and found("A_B") == ["a_b"] and found("A_B", wildcards=True) == ["a_b", "axb"]
    assert predicates.search_any("  ", "t") is None and predicates.where_all(df, [None]).count() == 5


def test_outline_matches_a_stack(spark):
    import random

    rng = random.Random(1)
    rows = [(d, p, rng.choice([None, 1, 2, 3, 4, 5, 6])) for d in range(20) for p in range(1, 30)]
    want = {}
    for d in range(20):
        stack = []
        for _, p, level in (r for r in rows if r[0] == d):
            if level is None:
                want[d, p] = max((q for q, _ in [*stack, *done]), default=None) if (done := [(q, v) for (dd, q, v) in rows if dd == d and v and q < p]) else None
                continue
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[d, p] = stack[-1][0] if stack else None
            stack.append((p, level))
    got = sequences.outline(spark.createDataFrame(rows, "d int, p int, level int"), ["d"], "p", "level").collect()
    assert {(r.d, r.p): r.parent for r in got} == want
    sized = sequences.subtree_sizes(spark.createDataFrame(rows, "d int, p int, level int"), ["d"], "p", "level").collect()
    for r in sized:
        later = [p for d, p, v in rows if d == r.d and p > r.p and v and r.level and v <= r.level]
        assert r.n_below == ((min(later, default=30) - r.p - 1) if r.level else None)


def test_chapters(spark):
    kinds = ["p", "h", "p", "b", "b", "p", "h", "b"]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "d int, p int, k string")
    got = sequences.chapters(df, ["d"], "p", F.col("k") == "b", F.col("k") == "h").orderBy("p").collect()
    assert [(r.p, r.chapter) for r in got] == [(0, 1), (1, 2), (2, 2), (5, 3), (6, 4)]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), ("c", 3, "z")], "k string, n int, t string")
    new = spark.createDataFrame([("a", None, "new"), (None, 9, None)], "k string, n int, t string")
    assert sorted(map(tuple, maintain.upsert(old, new, ["k"]).collect()), key=str) == sorted([("a", None, "new"), (None, 9, None), ("c", 3, "z")], key=str)
    assert sorted(map(tuple, maintain.upsert_filled(old, new, ["k"]).collect()), key=str) == sorted([("a", 1, "new"), (None, 9, "y"), ("c", 3, "z")], key=str)
    added = maintain.insert_missing(old.withColumn("id", F.lit("i")), spark.createDataFrame([("a",), ("d",), ("d",), (None,)], "k string"), ["k"]).collect()
    assert [r.k for r in added] == ["d"]
    assert maintain.next_number(old, spark.createDataFrame([("a", 5), ("q", 5), ("a", 6)], "k string, o int"), ["k"], "n", "o").orderBy("k", "o").select("n").collect() == [(2,), (3,), (1,)]
    gone, live = maintain.expired(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01"), (3, None)], "i int, d string").withColumn("d", F.to_timestamp("d")), "d", "2024-03-02", 30)
    assert [r.i for r in gone.collect()] == [1] and sorted(r.i for r in live.collect()) == [2, 3]


def test_fallback_lookup_prefers_rules_in_order(spark):
    facts = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "q"), ("z", "z")], "name string, pkg string")
    dimension = spark.createDataFrame([("a", "p", 3), ("a", "k", 2), ("b", "k", 1), ("b", "m", 0)], "dname string, dpkg string, rank int")
    rules = [[(F.col("f.name"), F.col("d.dname")), (F.col("f.pkg"), F.col("d.dpkg"))], [(F.col("f.name"), F.col("d.dname"))]]
    got = {(r.name, r.pkg): (r.dpkg, r.matched_rule) for r in relational.fallback_lookup(facts, dimension, ["name", "pkg"], rules, F.col("rank")).collect()}
    assert got == {("a", "p"): ("p", 0), ("a", "q"): ("k", 1), ("b", "q"): ("m", 1), ("z", "z"): (None, None)}


def test_json_blocks(spark):
    kinds = ["paragraph", "heading", "equation", "code", "list", "theorem", "figure", "unknown"]
    df = spark.createDataFrame([(k, "one\ntwo") for k in kinds], "k string, t string").withColumn("c", blocks.content_of(F.col("k"), F.col("t")))
    assert {r.t for r in df.select(blocks.text_of(F.col("c")).alias("t")).collect()} == {"one\ntwo"}
    rows = one(spark, blocks.text_of(F.lit('{"rows":[["a",{"text":"b"}],["c"]]}')))
    assert rows == "a — b\nc"
    assert one(spark, blocks.text_of(F.lit('{"items":["x",{"text":"y","children":[]}]}'))) == "x\ny"
    assert one(spark, blocks.canonical(F.lit('{"b": 1, "a": [1, 2]}'))) == '{"a":[1,2],"b":1}' and one(spark, blocks.canonical(F.lit(""))) == "{}"
    assert one(spark, blocks.merged(F.lit('{"a":1,"b":2}'), F.lit('{"b":3}'))) in ('{"a":1,"b":3}', '{"b":3,"a":1}')
    assert one(spark, blocks.merged(F.lit("[]"), F.lit('{"b":3}'))) == '{"b":3}' and one(spark, blocks.merged(F.lit('{"b":3}'), F.lit("[]"))) == '{"b":3}'
    assert one(spark, blocks.preview(F.lit('{"items":["x","y"]}'))) == "(list of 2)" and one(spark, F.length(blocks.preview(F.lit('{"text":"' + "é" * 90 + '"}')))) == 81
    assert one(spark, blocks.relevel(F.lit('{"text":"t","x":1}'), 3)) == '{"text":"t","level":3}'
    snap = blocks.snapshot(df.select(F.lit(1).alias("d"), F.monotonically_increasing_id().alias("o"), "k", "t"), ["d"], "o")
    assert sorted(r.k for r in blocks.restored(snap, ["d"], "o long, k string, t string").collect()) == sorted(kinds)


def test_redaction_numbers_hits_in_rule_order(spark):
    text = "a@b.de and c.d@e.org, https://github.com/me/ or +49 (30) 1234 5678; 0000-0001-2345-678X"
    out = text
    for name, pattern in markup.PII_RULES:
        n = iter(range(1, 99))
        out = re.sub(pattern, lambda _: f"[[{name.upper()}_{next(n)}]]", out)
    assert one(spark, markup.pii_redacted(F.lit(text))) == out
    assert one(spark, markup.pii_counts(F.lit(text)))["email"] == 2
    assert one(spark, markup.pii_redacted(F.lit("nothing"))) == "nothing" and one(spark, markup.pii_redacted(F.lit(""))) == ""


def test_latex_scans(spark):
    text = r"\documentclass[a4paper, 12pt]{article}\usepackage{hyperref}\usepackage[x]{amsmath,cleveref} \parencite{k1} \cite{a, b}\autocite[42]{k1} \begin{itemize*}\item x\end{itemize*}"
    t = F.lit(text)
    assert one(spark, markup.keys_of(t)) == ["a", "b", "k1"] and one(spark, markup.document_class(t)) == "article"
    assert one(spark, markup.class_options(t)) == ["a4paper", "12pt"] and one(spark, markup.packages(t)) == ["hyperref", "amsmath", "cleveref"]
    assert one(spark, markup.loaded_in_wrong_order(t, "cleveref", "hyperref")) is True and one(spark, markup.loaded_in_wrong_order(t, "hyperref", "cleveref")) is False
    kinds = [(x.name, x.kind) for x in one(spark, markup.latex_tokens(t))]
    assert ("itemize*", "environment") in kinds and ("item", "command") in kinds and ("begin", "command") not in kinds
    assert [one(spark, markup.engine(F.lit(x))) for x in ("x", r"\directlua{}", r"\usepackage{fontspec}", None)] == [0, 1, 1, 0]
    logs = {"! Undefined control sequence.\nl.15 \\x": "undefined_control_sequence", "! Package babel Error: x": "package_error", "Package babel Error: x": "syntax_error", "! x": "syntax_error", "": None, "fine": "unknown"}
    assert {k: one(spark, markup.compile_error(F.lit(k))) for k in logs} == logs


def test_html_tables(spark):
    html = '<table><thead><tr><th colspan="2">A&amp;B</th></tr></thead><tr><td rowspan=3>x</td><td></td></tr></table>'
    rows = [[(c.text, c.header, c.colspan, c.rowspan) for c in r] for r in one(spark, markup.html_tables(F.lit(html)))]
    assert rows == [[("A&B", True, 2, 1)], [("x", False, 1, 3), ("", False, 1, 1)]]


def test_markdown(spark):
    text = "# T\n\ntext *a*\nmore\n\n- x\n- y\n\n```py\ncode\n\n# no heading\n```\n> q\n$$\nE=mc\n$$\n| a | b |\n|---|---|\n---"
    got = parsers.markdown(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "```\nopen")], "d int, t string"), "d", "t").orderBy("d", "pos").collect()
    want = [("heading", 1, "T"), ("paragraph", None, "text *a*"), ("paragraph", None, "more"), ("list", None, "x\ny"), ("code", None, "code\n\n# no heading"), ("quote", None, "q"), ("equation", None, "E=mc"), ("table", None, "| a | b |\n|---|---|"), ("rule", None, "---")]
    assert [(r.kind, r.level, r.text) for r in got if r.d == 1] == want and [(r.kind, r.text) for r in got if r.d == 4] == [("code", "open")]
    assert {r.d for r in got} == {1, 4}


def test_lml(spark):
    text = 'lead\n@heading[level=1, "x"="a, b", bare]\n  Title\n\n@abstract\n  soft\n  wrapped\n'
    got = parsers.lml(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t").orderBy("pos").collect()
    assert [(r.kind, r.text) for r in got] == [("paragraph", "lead"), ("heading", "Title"), ("abstract", "soft\nwrapped")]
    assert got[1].attributes["level"] == "1" and got[1].attributes["bare"] == "true"
    assert one(spark, tables.looks_like_lml(F.lit(text))) is True and one(spark, tables.looks_like_lml(F.lit("mail a@b.de"))) is False


def test_latex_elements(spark):
    text = "\\documentclass{a}\\begin{document}\\section{One} text % no\nmore\n\n\\begin{itemize}\\item a \\begin{tabular}x\\end{tabular}\\end{itemize}after\n\\[x^2\\]\\subsection*{Two}\\end{document}junk"
    got = parsers.latex(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t").orderBy("pos").collect()
    assert [(r.kind, r.level) for r in got] == [("heading", 1), ("paragraph", None), ("itemize", None), ("paragraph", None), ("equation", None), ("heading", 2)]
    assert got[1].text == "text\nmore" and "tabular" in got[2].text and got[4].text == "x^2"


def test_bibtex(spark):
    text = '% @article{no, a={b}}\n@string{x = "y"}\n@Article{k1, Title = {A {Nested} \\} b}, year=2024, author = "X and\n Y"}\n@comment{z}\n@book{k2,\n publisher={P}}@misc{open, note={never'
    got = parsers.bibtex(spark.createDataFrame([(1, text), (2, None)], "d int, t string"), "d", "t").collect()
    assert [(r.cite_key, r.entry_type) for r in got] == [("k1", "article"), ("k2", "book"), ("open", "misc")]
    assert got[0].fields == {"title": "A {Nested} \\} b", "year": "2024", "author": "X and Y"}


def test_citation_styles(spark):
    fields = F.create_map(*map(F.lit, ("author", "Doe, Jane and Max Roe", "title", "T", "year", "2024", "journal", "J", "volume", "3", "number", "2", "pages", "1--9")))
    got = {s: one(spark, emit.citation(s, fields)) for s in emit.STYLES}
    assert got["apa"] == "Doe, J., & Roe, M. (2024). T. J, 3(2), 1–9." and got["ieee"] == 'J. Doe, and M. Roe, "T," J, vol. 3, no. 2, pp. 1–9, 2024.'
    assert got["mla"] == 'Doe, Jane, and Max Roe. "T." J, vol. 3, no. 2, 2024, pp. 1–9.' and got["vancouver"] == "Doe J, Roe M. T. J. 2024;3(2):1–9."
    assert got["chicago"] == 'Doe, Jane, and Max Roe. "T." J 3, no. 2 (2024): 1–9.' and got["harvard"] == "Doe, J. and Roe, M. (2024) 'T', J, 3(2), pp. 1–9."
    assert one(spark, emit.citation("apa", F.create_map(F.lit("x"), F.lit("y")))) == "Unknown (n.d.). Untitled."
    with pytest.raises(ValueError):
        emit.citation("nature", fields)


def test_renderings(spark):
    content = F.lit('{"text":"a **b** <c>","level":9}')
    assert one(spark, emit.block_to("html", F.lit("header"), content)) == "<h6>a <strong>b</strong> &lt;c&gt;</h6>"
    assert one(spark, emit.block_to("latex", F.lit("paragraph"), F.lit('{"text":"5% *x*"}'))) == "5\\% \\textit{x}"
    assert one(spark, emit.block_to("markdown", F.lit("list"), F.lit('{"ordered":true,"items":["a",{"text":"b"}]}'))) == "1. a\n2. b"
    assert [bool(one(spark, emit.block_to(f, F.lit("figure"), F.lit('{"src":"s","caption":"c"}')))) for f in emit.FORMATS] == [True] * 5


def test_fulltext(spark):
    docs = spark.createDataFrame([(1, "Running dogs run", "run"), (2, "the cat", ""), (3, "dog", "cats")], "i int, title string, body string")
    index = fulltext.inverted_index(docs, "i", {"title": 1.0, "body": 0.2}, stop_words=fulltext.STOP_WORDS)
    ids = lambda q, every: sorted(r.i for r in fulltext.search(index, q, every).collect())
    assert ids(["dog"], True) == [1, 3] and ids(["dog", "cat"], True) == [3] and ids(["dog", "cat"], False) == [1, 2, 3] and ids(["the"], False) == []
    assert [r.i for r in fulltext.search_or_substring(docs, index, ["zz", "cat"], "i", "title").collect()] == []
    assert [r.i for r in fulltext.search_or_substring(docs, index, ["the", "cat"], "i", "title").collect()] == [2]
    needles = spark.createDataFrame([("a", "a B c d e f"), ("b", "x y"), ("c", "b c d e")], "n string, t string")
    texts = spark.createDataFrame([(1, "z a b c d e fg"), (2, "a x y"), (3, "")], "i int, text string")
    assert {r.n: r.n_docs for r in fulltext.containing(texts, needles, "i", "text", "n", "t").collect()} == {"a": 1, "b": 1, "c": 1}


def test_stream_cleaning_and_caps(spark):
    rows = [("  hyperref ", "command", "panel", " "), ("", "command", "panel", None), ("   ", "length", "slash", None), ("x", "other", "panel", None), ("y", "counter", "mail", None)]
    got = stream.cleaned(spark.createDataFrame(rows, "name string, kind string, source string, package_slug string")).collect()
    assert [(r.name, r.package_slug) for r in got] == [("hyperref", None)]
    calls = spark.createDataFrame([("a",)] * 101 + [("b",)] * 100, "call string")
    assert [r.call for r in stream.oversized(calls, "call").collect()] == ["a"]


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = [(u, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()) for u in (1, 2) for s in (0, 30, 59, 60, 61, 125, 300)]
    events = spark.createDataFrame([(u, i, t) for i, (u, t) in enumerate(rows)], "u long, i long, ts timestamp")
    want = sorted((r.u, r.ts) for r in stream.throttled(events, ["u"], "ts", "i", 60).where("kept").collect())
    assert [t.second + 60 * t.minute for u, t in want if u == 1] == [0, 60, 125, 300]
    events.repartition(1).write.parquet(str(tmp_path / "events.parquet"))
    got = stream.run_once(stream.throttled_stream(stream.event_stream(spark, str(tmp_path)), "u", "ts", 60), "append")
    assert sorted((r.u, r.ts) for r in got.collect()) == want


def test_sink_is_idempotent(spark, tmp_path):
    spark.range(10).withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "events.parquet"))
    for _ in range(2):
        stream.into_table(stream.event_stream(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "check"), None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_locks(spark):
    rows = [("d", "b1", "u", 1, "lock"), ("d", "b2", "v", 2, "lock"), ("d", "b1", "u", 3, "unlock"), ("d", "b3", "w", 4, "lock"), ("d", None, "w", 5, "leave"), ("d", "b4", "w", 6, "lock")]
    events = spark.createDataFrame(rows, "d string, b string, u string, ts int, a string")
    assert sorted((r.b, r.u) for r in stream.locks(events, "d", "b", "u", "ts", "a").collect()) == [("b2", "v"), ("b4", "w")]


def test_readers(spark, tmp_path):
    (tmp_path / "dump.psv").write_text("  a | 1 \n b|2\n\n")
    assert sorted(map(tuple, tables.piped_rows(spark, str(tmp_path / "dump.psv"), "n string, k int").collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "x.md").write_text("# T\nb")
    assert tables.whole_texts(spark, str(tmp_path), "*.md").first().text == "# T\nb"
    docs = spark.createDataFrame([(1, None, True), (2, "x", None), (3, None, None)], "i int, deleted_at string, is_template boolean")
    assert [r.i for r in tables.visible_documents(docs).collect()] == [3] and tables.live(docs, include_deleted=True).count() == 3
    tables.write_tsv(docs, str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).count() == 3


def test_structural_findings(spark):
    rows = [("tableOfContents", "{}"), ("paragraph", '{"text":"me@x.org"}'), ("paragraph", '{"text":"Short Title"}'), ("paragraph", '{"text":"A sentence."}'), ("list", '{"items":["a"]}')]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "d int, o int, k string, c string")
    assert sorted((r.o, r.rule) for r in findings.structure(df, "d", "o", "k", "c").collect()) == [(0, "empty_contents"), (1, "personal_data"), (2, "paragraph_as_heading"), (4, "list_of_one")]
    heads = spark.createDataFrame([(1, i, "header", f'{{"text":"h","level":{v}}}') for i, v in enumerate((1, 2, 4, 3))], "d int, o int, k string, c string")
    assert [(r.o, r.rule) for r in findings.structure(heads, "d", "o", "k", "c").collect()] == [(2, "skipped_level")]
