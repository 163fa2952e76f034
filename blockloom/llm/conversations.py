"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate.

The turns of a conversation become a string of role initials that has to be ``(s?(ua)+)?``. Keep costs
0, Rerole to user or assistant 2, Delete 3, Insert of an empty user or assistant turn 2; a truncated
turn that stays costs 1 more; blank and duplicate turns have to go. Of the cheapest edits those win
whose initials are least in ASCII.

The dynamic program has a layer per turn and four states (nothing yet, after s, after u, after a). One
macro edit is a run of inserts with the turn's own edit after it. The codes of macro edits are free of
prefixes, so audits of equally many turns compare code by code: a layer needs no audit strings, only
the rank of each state's audit within the layer, and parent pointers from which the audit is
read at the end. Layers are kept for all four states to start from, so a run of turns is a 4 x 4 matrix
of costs and ranks, and matrices of neighbouring runs combine. Costs relative to the least are bounded, so
matrices recur: each is computed once in a task and turns are steps of an automaton over them.

Spark sorts the turns into ranges. A range's part of a conversation is a segment: a byte per turn and
its matrix. Segments of a conversation (no more than ranges) are combined to find where each begins and
ends; then each is read back by itself, so a very long conversation is worked on by many tasks. Only the
digest of the repaired text is one chain by nature: one task reads a conversation's texts as a stream.

Rows: nulls in role and text count as one space; null ids are a conversation of their own, null turns
come first. Turns with equal numbers are ordered by role and then by the hash of the text. A role is known by
its first letter; with another letter, or none, it has to be reroled or deleted. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, stored, table

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Macro edits in ASCII order.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
REROLE, DELETE, INSERT, STUB = 2, 3, 2, 1
#: Cost and inserts that end a conversation from each state.
ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: From any state the edits that follow another state can be imitated for less, so what costs more is never best.
FAR = 8
BAD, CUT = 4, 8  # bits of a turn's byte beside its role: to be deleted; truncated
OTHER = 3


def macro_edits(turn: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(cost, code) of the best macro edit of a turn between two states; turn: role (0 s, 1 u, 2 a, 3 other) with BAD and CUT."""
    role, bad, stub = turn & 3, bool(turn & BAD), STUB if turn & CUT else 0
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for begin in range(4):
        state = begin
        for inserts in range(3):
            edits = [("D", state, DELETE)]
            if not bad:
                fits = {0: state == START, 1: state != USER, 2: state == USER, OTHER: False}[role]
                edits += [("K", role + 1, stub)] if fits else []
                edits.append(("R", NEXT[state], REROLE + stub))
            for letter, end, cost in edits:
                found = (cost + inserts * INSERT, CODES.index("I" * inserts + letter))
                best[begin, end] = min(found, best.get((begin, end), found))
            state = NEXT[state]
    return best


class Layers:
    """Matrices by number, and the steps between them. A matrix: (costs, ranks), 16 each, row by begin state; -1 costs are out of reach."""

    def __init__(self) -> None:
        self.edits = [macro_edits(turn) for turn in range(16)]
        same = tuple(0 if i % 5 == 0 else -1 for i in range(16))
        self.known: dict[tuple, int] = {(same, (0,) * 16): 0}
        self.matrices = [(same, (0,) * 16)]
        self.steps: dict[int, tuple[int, int, list]] = {}

    def step(self, number: int, turn: int) -> tuple[int, int, list]:
        """(next matrix, cost to add, (state before, code) by begin and end)."""
        key = number << 4 | turn
        if key not in self.steps:
            costs, ranks = self.matrices[number]
            found: list = [None] * 16
            for begin in range(4):
                for (via, end), (cost, code) in self.edits[turn].items():
                    before = costs[4 * begin + via]
                    if before >= 0:
                        new = (before + cost, (ranks[4 * begin + via], code), via)
                        at = 4 * begin + end
                        found[at] = new if found[at] is None else min(found[at], new)
            least = min(f[0] for f in found if f)
            for begin in range(4):
                row = [f[0] for f in found[4 * begin : 4 * begin + 4] if f]
                for at in range(4 * begin, 4 * begin + 4):
                    if found[at] and found[at][0] > min(row) + FAR:
                        found[at] = None
            order = {audit: rank for rank, audit in enumerate(sorted({f[1] for f in found if f}))}
            matrix = (tuple(f[0] - least if f else -1 for f in found), tuple(order[f[1]] if f else 0 for f in found))
            if matrix not in self.known:
                self.known[matrix] = len(self.matrices)
                self.matrices.append(matrix)
            self.steps[key] = (self.known[matrix], least, [(f[2], f[1][1]) if f else None for f in found])
        return self.steps[key]

    def matrix(self, turns: bytes) -> tuple[list[int], list[int]]:
        """Costs and ranks of a run of turns."""
        number = total = 0
        for turn in turns:
            number, cost, _ = self.step(number, turn)
            total += cost
        costs, ranks = self.matrices[number]
        return [c + total if c >= 0 else -1 for c in costs], list(ranks)

    def audit(self, turns: bytes, begin: int, end: int) -> str:
        """The codes of the best edits of a run of turns between two states."""
        number, parents = 0, []
        for turn in turns:
            number, _, pointers = self.step(number, turn)
            parents.append(pointers)
        codes = []
        for pointers in reversed(parents):
            end, code = pointers[4 * begin + end]
            codes.append(CODES[code])
        return "".join(reversed(codes))


def joined(matrices: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """(cost, (begin, end) of each run) of the best edits through neighbouring runs of turns, to a legal end."""
    layer = {START: (0, 0)}
    parents = []
    for costs, ranks in matrices:
        found: dict = {}
        for via, (cost, rank) in layer.items():
            for end in range(4):
                if costs[4 * via + end] >= 0:
                    new = (cost + costs[4 * via + end], (rank, ranks[4 * via + end]), via)
                    found[end] = min(found.get(end, new), new)
        order = {audit: rank for rank, audit in enumerate(sorted({f[1] for f in found.values()}))}
        layer = {end: (cost, order[audit]) for end, (cost, audit, _) in found.items()}
        parents.append({end: via for end, (_, _, via) in found.items()})
    cost, _, _, end = min((cost + ENDS[end][0], rank, ENDS[end][1], end) for end, (cost, rank) in layer.items())
    ways = []
    for pointers in reversed(parents):
        ways.append((pointers[end], end))
        end = pointers[end]
    return cost, ways[::-1]


def _joined(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    """a with the other columns of b; nulls are equal in the join."""
    other = b.select(*(F.col(c).alias(f"_{c}") if c in names else c for c in b.columns))
    on = F.lit(True)
    for name in names:
        on &= F.col(name).eqNullSafe(F.col(f"_{name}"))
    return a.join(other, on, how).drop(*(f"_{name}" for name in names))


def plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (1): nulls in role and text as one space."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select("conv_id", "turn", text("role"), text("text"), F.lit(1).alias("n"))


def damaged(rows: DataFrame) -> DataFrame:
    """plain() rows after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 strips ends of sentences, 3 repeats, 4 makes a user of the role."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain(rows).where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))


def _hash() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, hash, n, blank, seen, cut: rows equal in the first four are one with their number n.

    seen: role and text occur at an earlier turn; the second of n equal rows repeats the first.
    """
    blank, cut = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    slim = rows.select("conv_id", "turn", "role", _hash().alias("hash"), "n", blank.alias("blank"), cut.alias("cut"))
    turns = stored(slim.groupBy("conv_id", "turn", "role", "hash").agg(F.sum("n").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    text = ("conv_id", "role", "hash")
    often = turns.groupBy(*text).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first")).where("times > 1").drop("times")
    seen = F.coalesce(order > F.col("first"), F.lit(False))
    return _joined(turns, often, text, "left").withColumn("seen", seen).drop("first")


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, part, turns, costs, ranks, counts, low, high, distinct: a range's turns of a conversation, in order, with their matrix.

    counts: COUNTS within the segment; low, high, distinct: of the turns' numbers.
    """
    key = ("conv_id", "turn", "role", "hash")
    role = F.instr(F.lit("sua"), F.left("role", F.lit(1))) - 1
    role = F.when((F.length("role") == 0) | (role < 0), OTHER).otherwise(role)
    dealt = faults(rows).repartitionByRange(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    slim = dealt.select("conv_id", F.spark_partition_id().alias("part"), F.col("turn").cast("long").alias("turn"), role.alias("role"), "n", "blank", "seen", "cut")
    kind = rows.schema["conv_id"].dataType
    schema = T._parse_datatype_string("part int, turns binary, costs array<long>, ranks array<int>, counts array<long>, low long, high long, distinct long")
    schema = T.StructType([T.StructField("conv_id", kind), *schema.fields])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, own, done = Layers(), None, []

        def close() -> None:
            turns = bytes(own["turns"])
            roles = [t & 3 for t in turns]
            own["counts"][3] = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(roles, roles[1:], strict=False))
            own["costs"], own["ranks"] = layers.matrix(turns)
            done.append({**own, "turns": turns})

        def flush(kind: pa.Schema) -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(done, schema=kind)
            done.clear()
            return out

        wanted = None
        for batch in batches:
            if wanted is None:
                wanted = pa.schema([pa.field("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("turns", pa.binary()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64())])
            for conv, part, turn, role, n, blank, seen, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != own["conv_id"]:
                    if own is not None:
                        close()
                    own = {"conv_id": conv, "part": part, "turns": bytearray(), "counts": [0, 0, 0, 0], "low": None, "high": None, "distinct": 0}
                bad, counts = blank or seen, own["counts"]
                counts[0] += n if blank else 0
                counts[1] += 0 if blank else n if seen else n - 1
                counts[2] += cut and not bad
                byte = role | (CUT if cut else 0)
                own["turns"].append(byte | (BAD if bad else 0))
                own["turns"] += bytes([byte | BAD]) * (n - 1)
                if turn is not None:
                    own["distinct"] += turn != own["high"]
                    own["low"], own["high"] = turn if own["low"] is None else own["low"], turn
            if len(done) >= 2000:
                yield flush(wanted)
        if own is not None:
            close()
            yield flush(wanted)

    return slim.mapInArrow(gather, schema)


def ways(found: DataFrame) -> DataFrame:
    """conv_id, part, begin, end of every segment, and in a conversation's first one its totals: COUNTS, gaps, cost."""
    slim = found.select("conv_id", "part", "costs", "ranks", "counts", "low", "high", "distinct", F.expr("substring(turns, 1, 1)").alias("first"), F.expr("substring(turns, -1, 1)").alias("last"))
    schema = T.StructType([T.StructField("conv_id", found.schema["conv_id"].dataType), *T._parse_datatype_string("part int, begin int, end int, totals array<long>").fields])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        wanted = None

        def close() -> list[dict]:
            cost, steps = joined([(s["costs"], s["ranks"]) for s in own])
            counts = [sum(s["counts"][k] for s in own) for k in range(4)]
            gaps, high, low, distinct = 0, None, None, 0
            for a, b in zip(own, own[1:], strict=False):
                counts[3] += (a["last"][0] & 3, b["first"][0] & 3) not in ((0, 1), (1, 2), (2, 1))
            for s in own:
                if s["low"] is not None:
                    distinct += s["distinct"] - (s["low"] == high)
                    low, high = s["low"] if low is None else low, s["high"]
            if distinct:
                gaps = min(high - low + 1 - distinct, (1 << 63) - 1)
            return [{"conv_id": s["conv_id"], "part": s["part"], "begin": b, "end": e, "totals": [*counts, gaps, cost] if k == 0 else None} for k, (s, (b, e)) in enumerate(zip(own, steps, strict=True))]

        done: list[dict] = []
        for batch in batches:
            wanted = wanted or pa.schema([pa.field("conv_id", batch.schema.field(0).type), ("part", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("totals", pa.list_(pa.int64()))])
            for row in batch.to_pylist():
                if own and row["conv_id"] != own[0]["conv_id"]:
                    done += close()
                    own = []
                own.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=wanted)
                done = []
        if own:
            yield pa.RecordBatch.from_pylist(close(), schema=wanted)

    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(combine, schema)


def audits(found: DataFrame) -> DataFrame:
    """conv_id, part, audit, totals: the edits of each segment; the last segment's are without the inserts that end the conversation."""
    told = ways(found)
    both = _joined(found.select("conv_id", "part", "turns"), told, ("conv_id", "part"), "inner").select("conv_id", "part", "turns", "begin", "end", "totals")
    schema = T.StructType([T.StructField("conv_id", found.schema["conv_id"].dataType), *T._parse_datatype_string("part int, audit string, end int, totals array<long>").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = Layers()
        for batch in batches:
            turns, begin, end = (batch.column(c).to_pylist() for c in ("turns", "begin", "end"))
            audit = [layers.audit(*run) for run in zip(turns, begin, end, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(audit, pa.string()), batch.column("end"), batch.column("totals")], names=schema.names)

    return both.mapInArrow(read, schema)


class _Repaired:
    """A conversation's audit, and its repaired turns as its rows come by in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.pieces, self.totals, self.end = conv, [], [0] * 6, START
        self.state, self.at, self.audit = START, 0, None

    def take(self, audit: str, end: int, totals: list | None) -> None:
        self.pieces.append(audit)
        self.totals, self.end = totals or self.totals, end

    def closed(self) -> str:
        if self.audit is None:
            self.audit = "".join(self.pieces) + ENDS[self.end][1]
            self.pieces = []
        return self.audit

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        audit = self.closed()
        while self.at < len(audit) and audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", "user" if self.state == USER else "assistant", ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands for the next row."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = "sua".index(role[0]) + 1
            yield edit, role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield edit, "user" if self.state == USER else "assistant", text


def _streamed(rows: DataFrame, ids: DataFrame | None, whole: bool) -> DataFrame:
    """Edits, then rows of each conversation, in order, through one task a conversation."""
    found = stored(segments(rows), "segments")
    null = lambda kind: F.lit(None).cast(kind)
    turn = rows.schema["turn"].dataType
    edits = audits(found).select("conv_id", F.lit(1).alias("kind"), "part", null(turn).alias("turn"), null("string").alias("role"), null("binary").alias("hash"), F.col("audit").alias("text"), F.col("end").alias("n"), "totals")
    texts = rows.select("conv_id", F.lit(2).alias("kind"), F.lit(0).alias("part"), "turn", "role", _hash().alias("hash"), "text", F.col("n").cast("int").alias("n"), null("array<long>").alias("totals"))
    parts = edits.unionByName(texts)
    if ids is not None:
        parts = parts.unionByName(ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(0).alias("part"), null(turn).alias("turn"), null("string").alias("role"), null("binary").alias("hash"), null("string").alias("text"), F.lit(0).alias("n"), null("array<long>").alias("totals")))
    ordered = parts.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", "part", "turn", "role", "hash").drop("part", "turn", "hash")
    names = "pos long, edit string, role string, text string" if whole else "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T._parse_datatype_string(names).fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, first, sha, pos, wanted = None, [], True, None, 0, None

        def put(turns: Iterator[tuple[str, str, str]]) -> None:
            nonlocal pos, first
            for edit, role, text in turns:
                if whole:
                    done.append((own.conv, pos, edit, role, text))
                else:
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                pos, first = pos + 1, False

        def close() -> None:
            put(own.inserted())
            if not whole:
                blank, duplicate, truncated, illegal, gaps, cost = own.totals
                done.append((own.conv, gaps, blank, duplicate, truncated, illegal, cost, own.closed(), sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * len(schema.names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, wanted.types, strict=True)], schema=wanted)

        for batch in batches:
            if wanted is None:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] if whole else [pa.int64()] * 6 + [pa.string()] * 2
                wanted = pa.schema([pa.field("conv_id", batch.schema.field(0).type), *map(pa.field, schema.names[1:], kinds)])
            for conv, kind, role, text, n, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != own.conv:
                    if own is not None:
                        close()
                    own, sha, pos, first = _Repaired(conv), hashlib.sha256(), 0, True
                if kind == 1:
                    own.take(text, n, totals)
                elif kind == 2:
                    for _ in range(n):
                        put(own.turns(role, text))
            if done:
                yield flush()
        if own is not None:
            close()
            yield flush()

    return ordered.mapInArrow(walk, schema)


def repaired(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of plain() or damaged() rows.

    ids: rows whose conv_id is to be in the result even if it has no turns: zeros, an empty audit, the empty string's hash.
    """
    return _streamed(rows, ids, whole=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos, edit (K, R or I), role, text: the repaired conversations."""
    return _streamed(rows, None, whole=True)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repaired(damaged(rows), rows)


QUERIES = {"op13_repair": op13_repair}
SQL = {
    "op13_repair": r"""
        WITH RECURSIVE bits AS (
            SELECT list(list_reduce(list_concat([b], range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
        c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations),
        m AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(k, lambda x: ord(x)::BIGINT)), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 20 AS kind FROM c, bits),
        d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
                     NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
              FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
        f AS (SELECT *, blank OR again AS bad, (cut AND NOT blank AND NOT again)::INT AS stub, left(role, 1) AS r FROM o),
        moves(begin_, inserts, state) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
        runs AS (SELECT begin_, repeat('I', inserts) AS ins, 2 * inserts AS icost, state,
                        array_to_string(CASE WHEN inserts = 0 THEN [] WHEN begin_ = 2 THEN ['assistant:', 'user:'][:inserts] ELSE ['user:', 'assistant:'][:inserts] END, chr(10)) AS itext FROM moves),
        p AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS fixed FROM f
            UNION ALL
            SELECT conv_id, i, state, cost, audit, fixed FROM (
                SELECT p.conv_id, f.i, e.state, p.cost + icost + e.cost AS cost, audit || ins || letter AS audit,
                       array_to_string(list_filter([fixed, itext, e.line], lambda x: x <> ''), chr(10)) AS fixed
                FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN runs ON begin_ = p.state,
                LATERAL (SELECT unnest([
                    {'letter': 'D', 'state': runs.state, 'cost': 3, 'line': ''},
                    {'letter': CASE WHEN NOT bad AND (r = 's' AND runs.state = 0 OR r = 'u' AND runs.state <> 2 OR r = 'a' AND runs.state = 2) THEN 'K' END,
                     'state': CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': stub, 'line': role || ':' || text},
                    {'letter': CASE WHEN NOT bad THEN 'R' END, 'state': CASE runs.state WHEN 2 THEN 3 ELSE 2 END, 'cost': 2 + stub, 'line': CASE runs.state WHEN 2 THEN 'assistant:' ELSE 'user:' END || text}], recursive := true)) e
                WHERE letter IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY p.conv_id, e.state ORDER BY p.cost + icost + e.cost, audit || ins || letter) = 1)),
        n AS (SELECT conv_id, max(i) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(stub) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                     coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
        z AS (SELECT p.conv_id, cost + [0, 4, 2, 0][state + 1] AS cost, audit || ['', 'II', 'I', ''][state + 1] AS audit, fixed || ['', chr(10) || 'user:' || chr(10) || 'assistant:', chr(10) || 'assistant:', ''][state + 1] AS fixed
              FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.n QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost + [0, 4, 2, 0][state + 1], audit || ['', 'II', 'I', ''][state + 1]) = 1)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""
}
