import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from blockloom.llm import conversations as op

SCHEMA = "conv_id long, turn long, role string, text string"


def enumerated(turns):
    """(cost, audit, repaired) of the cheapest edits of (role, text, has to go, truncated), by keeping every audit of near-least cost."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    found = {("", ""): (0, ())}
    for role, text, bad, cut in turns:
        new = {}
        for (state, audit), (cost, lines) in found.items():
            for _ in range(4):
                options = [("D", state, 3, ())]
                if not bad:
                    options += [("K", step.get((state, role[:1])), cut, (f"{role}:{text}",))]
                    options += [("R", step.get((state, to)), 2 + cut, (f"{names[to]}:{text}",)) for to in "ua"]
                for letter, end, price, line in options:
                    if end is not None:
                        key, value = (end, audit + letter), (cost + price, lines + line)
                        new[key] = min(value, new.get(key, value))
                state = step.get((state, "u")) or step[state, "a"]
                audit, cost, lines = audit + "I", cost + 2, (*lines, names[state] + ":")
        least = min(v[0] for v in new.values())
        found = {k: v for k, v in new.items() if v[0] <= least + 9}
    ends = {"": [], "s": ["user:", "assistant:"], "u": ["assistant:"], "a": []}
    return min((cost + 2 * len(ends[s]), audit + "I" * len(ends[s]), (*lines, *ends[s])) for (s, audit), (cost, lines) in found.items())


def brute(rows, damage=True):
    """Result rows by plain Python; rows: (conv_id, turn, role, text)."""
    kept = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = kept.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.sha256(text.encode()).digest(), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in kept.items():
        counts, seen, turns = [0, 0, 0], set(), []
        for _, _, role, _, text in sorted(own):
            blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            cut = not blank and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            seen.add((role, text))
            for k, fault in enumerate((blank, again and not blank, cut)):
                counts[k] += fault
            turns.append((role, text, blank or again, int(cut)))
        numbers = [t for told, t, *_ in own if told]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = enumerated(turns)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, most):
    rnd, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rnd.randint(1, most)):
            text = rnd.choice(["Yes.", "No!", "Hm", " \t", "", "Why?  \n", f"Line {turn}.", "ends.  ", "é…", None])
            rows.append((conv, turn, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), text))
    return rows


EDGES = [
    (None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), (1, None, "user", "late."), (1, None, "assistant", "later"), (1, 5, "user", "late."), (2, 1, "user", "  "),
    (3, 1, "system", "only"), (4, 1, "assistant", "x" * 400_000 + "."), (4, 1, "assistant", "x" * 400_000 + "."), (5, -7, "user", "a.\nb: c"), (5, 9, "assistant", "d."),
]


@pytest.mark.parametrize("damage", [True, False])
def test_against_brute_force(spark, damage):
    rows = made(1, 60, 6) + [(c if c is None else c + 1000, *r) for c, *r in EDGES]
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", hash string, part int")
    got = op.repaired(op.damaged(frame) if damage else op.plain(frame), frame)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, damage)


def test_one_conversation_over_many_ranges(spark):
    rnd = random.Random(2)
    rows = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice([f"Turn {t}.", f"Turn {t}", "Again."])) for t in range(3000)] + [(8, 1, "user", "Hi.")]
    frame = op.plain(spark.createDataFrame(rows, SCHEMA))
    found = op.segments(frame)
    assert found.where("conv_id = 7").count() > 2
    parts = {r.conv_id: r for r in op.repaired(frame).collect()}
    turns = op.segments(op.plain(spark.createDataFrame(rows, SCHEMA).coalesce(1))).where("conv_id = 7").orderBy("part").collect()
    whole = op.Layers().matrix(b"".join(r.turns for r in turns))
    cost, ways = op.joined([whole])
    audit = op.Layers().audit(b"".join(r.turns for r in turns), *ways[0]) + op.ENDS[ways[0][1]][1]
    assert (parts[7].cost, parts[7].audit) == (cost, audit)
    lines = op.repaired_turns(frame).where("conv_id = 7").orderBy("pos").collect()
    assert parts[7].repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in lines)) and [r.pos for r in lines] == list(range(len(lines)))


def test_dropped_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(1, gone, "user", "x")], SCHEMA)
    assert [tuple(r) for r in op.repaired(op.damaged(frame), frame).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], SCHEMA)
    assert op.repaired(op.damaged(empty), empty).count() == 0


def test_text_ids(spark):
    rows = [("a", 1, "user", "Hi."), ("b", 2, "assistant", "Ho.")]
    got = op.repaired(op.plain(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")))
    assert {r.conv_id: r.audit for r in got.collect()} == {"a": "KI", "b": "IK"}


def test_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(op.SQL["op13_repair"]).df()
    got = op.op13_repair(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(map(tuple, got[list(want.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").where(F.col("conv_id") < 40).collect()]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, op.repaired(op.damaged(frame), frame).collect()), key=str) == brute(rows)
