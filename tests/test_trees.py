"""JSON trees against a plain recursive walk."""

import json
import random

from pyspark.sql import functions as F

from blockloom.operators import blocks, trees


def made(rnd, depth=0):
    kind = rnd.randrange(6)
    if kind < 2 and depth < 9:
        return {rnd.choice(["content", "text", "x", "Source", "title"]): made(rnd, depth + 1) for _ in range(rnd.randint(0, 4))}
    if kind < 4 and depth < 9:
        return [made(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return rnd.choice(["a", 'q"\\\\ {[', "é\n", "\\frac{Ж}", "[x", "", 1, None, True, 2.5])


def walk(root):
    if isinstance(root, dict) and isinstance(root.get("text"), str):
        return root["text"]
    parts = []

    def below(node):
        if isinstance(node, dict):
            if isinstance(node.get("text"), str):
                parts.append(node["text"])
            if isinstance(node.get("content"), list):
                below(node["content"])
        elif isinstance(node, list):
            for child in node:
                below(child)

    below(root)
    return " ".join(parts).strip(" ")


def asked(root, latex=False):
    import re

    if isinstance(root, dict):
        return set().union(*(asked(v, latex or k.lower() in trees.LATEX_KEYS) for k, v in root.items()))
    if isinstance(root, list):
        return set().union(*(asked(v, latex) for v in root))
    if not isinstance(root, str):
        return set()
    found = {("command", c) for c in re.findall(r"\\([a-zA-Z]+)", root)} if latex else set()
    for c in root:
        if ord(c) > 127:
            found.add(("codepoint", f"U+{ord(c):04X}"))
            found |= {("script", name) for name, low, high in trees.SCRIPTS if low <= ord(c) <= high}
    return found


def test_trees_against_recursion(spark):
    rnd = random.Random(8)
    roots = [made(rnd) for _ in range(300)]
    roots.append({"latex": "x"})
    deep = {"text": "bottom \U0001f600"}
    for _ in range(150):
        deep = {"content": [deep]}
    roots.append(deep)
    texts = [json.dumps(r, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, r in enumerate(roots)] + ["{broken", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, c string")
    got = {r.k: r.text for r in trees.walked_texts(rows, ["k"], "c").collect()}
    assert got == {i: walk(r) for i, r in enumerate(roots)} | {len(roots) + j: "" for j in range(3)}
    found = {}
    for r in trees.requirements(rows, ["k"], ["k"], "c").collect():
        found.setdefault(r.k, []).append((r.kind, r.value))
    assert all(len(v) == len(set(v)) for v in found.values())
    assert {k: set(v) for k, v in found.items()} == {i: s for i, r in enumerate(roots) if (s := asked(r))}


def test_is_array(spark):
    cases = {'{"items":[1]}': True, '{"items":"[no"}': False, '{"items":"[1]"}': False, '{"items":{}}': False, "{": False, "": False}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", blocks.is_array(F.col("c"), "$.items").alias("x")).collect()
    assert {r.c: r.x for r in got} == cases
