"""Rules of detection against a walk with state; custom and disabled rules."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import detection as op
from blockloom.plans.detection_queries import _KINDS


def walked(paragraphs):
    """Sections and rules by walking, from the table of kinds."""
    section, out = "body", []
    for i in paragraphs:
        text, _, rule, makes, opens = _KINDS[i]
        if section == "abstract" and 14 <= i <= 23:
            rule, makes = "abstract.section", f"abstract|{text}|"
        elif section == "references" and i == 15:
            rule, makes = "bibliography.section", "bibliographyEntry|Doe, J. Title.|"
        out.append((section, rule, makes))
        if opens:
            section = opens
        elif rule in ("list", "list.manual-bullet", "title-subtitle.other") and section == "abstract":
            section = "body"
    return out


def test_against_a_walk(spark):
    rnd = random.Random(4)
    docs = [[rnd.randrange(len(_KINDS)) for _ in range(60)] for _ in range(8)]
    rows = [(d, n, *((_KINDS[i][0] if c == "text" else _KINDS[i][1].get(c)) for c in op.PARAGRAPH)) for d, doc in enumerate(docs) for n, i in enumerate(doc)]
    frame = spark.createDataFrame(rows, "d int, n int, " + ", ".join(f"{c} {t}" for c, t in op.PARAGRAPH.items()))
    got = op.detect(frame, "d", "n").orderBy("d", "n").collect()
    line = lambda e: "|".join("" if v is None else str(v) for v in e)
    assert [(r.section, r.rule, ";".join(map(line, r.elements))) for r in got] == [x for doc in docs for x in walked(doc)]
    parts = op.detected_elements(op.detect(frame, "d", "n"), "d", "n")
    assert parts.count() == sum(len(r.elements) for r in got)


def test_custom_and_disabled(spark):
    rows = spark.createDataFrame([(1, 1, "TODO x"), (1, 2, "plain"), (1, 3, None), (1, 4, "y" * 900)], "d int, n int, text string")
    todo = op.Rule("todo", 5, op.text_is("^TODO"), op.if_text(op.made("note")))
    shy = op.Rule("shy", 6, op.always(), F.lit(None).cast(op.ELEMENTS))
    got = op.detect(rows, "d", "n", custom=[todo, shy], disabled=["paragraph"]).orderBy("n").collect()
    assert [(r.rule, r.passed) for r in got] == [("todo", []), ("none", ["shy", "heading.formatting"]), ("none", ["shy"]), ("none", ["shy"])]
    assert got[0].elements[0].kind == "note" and got[1].elements == [] and len(got[3].trace) == 500
    assert op.detect(rows.limit(0), "d", "n").count() == 0
    late = op.Rule("late", 950, op.always(), op.made("x"), section=F.lit("x"))
    with pytest.raises(ValueError):
        op.detect(rows, "d", "n", custom=[late])


def test_sections(spark):
    cases = {"2.1 Methodology": "methods", "IV. BIBLIOGRAPHIE:": "references", "Einleitung": "introduction", "Other": "body", "": "body", "Works cited.": "references"}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", op.section_of(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in got} == cases
