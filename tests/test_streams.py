"""State of documents, pulls and given-up batches, against plain walks; restarts from the checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.sources.tables import scratch_folder
from blockloom.streaming import events, monitor, presence

SCHEMA = "doc int, user string, block string, ts timestamp, seq int, action string"


def made(n, seed=1):
    rnd = random.Random(seed)
    actions = ["join", "leave", "disconnect", "lock", "lock", "lock", "unlock", "other"]
    return [(rnd.randrange(3), f"u{rnd.randrange(4)}", f"b{rnd.randrange(3)}", i * 60 + rnd.randrange(50), i, rnd.choice(actions)) for i in range(n)]


def walked(rows, lock_seconds):
    users, locks, out = set(), {}, []
    for doc, user, block, at, seq, action in sorted(rows, key=lambda r: (r[3], r[4])):
        say = lambda kind, b=None, u=user: out.append((str(doc), seq, u, b, kind))  # noqa: B023, E731
        holder = locks.get((doc, block))
        if action == "join" and (doc, user) not in users:
            users.add((doc, user))
            say("joined")
        elif action in ("leave", "disconnect"):
            if (doc, user) in users:
                users.remove((doc, user))
                say("left")
            for d, b in sorted(k for k, v in locks.items() if k[0] == doc and v[0] == user):
                del locks[d, b]
                say("released", b)
        elif action == "lock" and holder and holder[0] != user and at - holder[1] < lock_seconds:
            say("refused", block)
        elif action == "lock" and (not holder or holder[0] != user):
            if holder:
                say("expired", block, holder[0])
            locks[doc, block] = (user, at)
            say("locked", block)
        elif action == "unlock" and holder and holder[0] == user:
            del locks[doc, block]
            say("released", block)
    return out, {(str(d), u) for d, u in users}, {(str(d), b, v[0]) for (d, b), v in locks.items()}


def frame(spark, rows):
    return spark.createDataFrame([(d, u, b, 0, s, a, t) for d, u, b, t, s, a in rows], "doc int, user string, block string, x int, seq int, action string, sec long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec", "x")


def log_of(rows):
    return sorted(((r.document, r.seq, r.user, r.block, r.change) for r in rows), key=str)


ARGS = ("doc", "user", "block", "ts", "seq", "action")


def test_documents_in_a_batch(spark):
    rows = made(400)
    with presence.rocks_state(spark):
        odd = spark.createDataFrame([(1, None, "b", 1, "join"), (None, "u", "b", 1, "join")], "doc int, user string, block string, seq int, action string").withColumn("ts", F.lit(None).cast("timestamp"))
        log = presence.changes(frame(spark, rows).unionByName(odd), *ARGS, lock_seconds=600).cache()
        want, users, locks = walked(rows, 600)
        assert log_of(log.collect()) == sorted(want, key=str)
        assert {(r.document, r.user) for r in presence.present(log).collect()} == users
        assert {(r.document, r.block, r.user) for r in presence.held(log).collect()} == locks
        log.unpersist()


def test_documents_on_a_stream_that_restarts(spark):
    """Two runs from one checkpoint give what one batch gives; state goes on where it was."""
    rows, folder, out, checkpoint = made(300, 7), *(scratch_folder(spark, n) for n in ("in", "out", "checkpoint"))
    with presence.rocks_state(spark):
        for part in (rows[:120], rows[120:]):
            frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(SCHEMA).parquet(folder)
            events.into_table(presence.changes(stream, *ARGS, lock_seconds=600), out, checkpoint, None).awaitTermination()
    assert log_of(spark.read.parquet(out).collect()) == sorted(walked(rows, 600)[0], key=str)


def test_pulls(spark, monkeypatch):
    path, times = scratch_folder(spark, "pull"), lambda *s: spark.createDataFrame([(i, x) for i, x in enumerate(s)], "id int, at long")
    assert monitor.committed(spark, path) == (0, None)
    number, got = monitor.pull(times(1, 2, 2, None), "at", path)
    assert number == 1 and sorted(r.at for r in got.collect()) == [1, 2, 2] and monitor.committed(spark, path) == (1, 2)
    assert monitor.pull(times(1, 2, 2, 2), "at", path)[1].count() == 0 and monitor.committed(spark, path) == (1, 2)  # equal times are not seen again
    new = times(1, 2, 3, 5, 0)
    real = monitor.F.max
    monkeypatch.setattr(monitor.F, "max", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # broken off after the rows are written, before the commit
        monitor.pull(new, "at", path)
    monkeypatch.setattr(monitor.F, "max", real)
    number, got = monitor.pull(new, "at", path)
    assert number == 2 and sorted(r.at for r in got.collect()) == [3, 5] and monitor.committed(spark, path) == (2, 5)


def test_batches_that_fail_are_dropped_and_counted(spark):
    folder, out, lost, checkpoint = (scratch_folder(spark, n) for n in ("in", "out", "lost", "checkpoint"))
    for value in (1, 2, 3):
        spark.createDataFrame([(value, k) for k in range(10 * value)], "v int, k int").coalesce(1).write.mode("append").parquet(folder)

    def change(batch):
        if batch.where("v = 2").count():
            raise OSError("disk")
        return batch

    stream = spark.readStream.schema("v int, k int").option("maxFilesPerTrigger", 1).parquet(folder)
    events.into_table(stream, out, checkpoint, None, change, lost).awaitTermination()
    assert {r.v: r["count"] for r in spark.read.parquet(out).groupBy("v").count().collect()} == {1: 10, 3: 30}
    assert [(r.n, r.error) for r in spark.read.parquet(lost).collect()] == [(20, "OSError")]


def test_run_once_of_an_empty_stream(spark):
    folder = scratch_folder(spark, "in")
    spark.createDataFrame([], "v int").write.parquet(folder)
    stream = spark.readStream.schema("v int").parquet(folder)
    assert events.run_once(stream, "append").count() == 0 and events.run_once(stream.groupBy("v").count()).count() == 0


def test_users_by_a_state_each(spark):
    """users of documents as by the walk, from a state row a user, in two micro-batches of which the first came late."""
    rows, folder = made(300, 9), scratch_folder(spark, "in")
    last = {}
    for doc, user, _, at, seq, action in sorted(rows, key=lambda r: (r[3], r[4])):
        if action in ("join", "leave", "disconnect"):
            last[str(doc), user] = action
    assert {k for k, action in last.items() if action == "join"} == walked(rows, 600)[1]
    odd = spark.createDataFrame([(1, None, "b", 1, "join"), (None, "u", "b", 1, "join")], "doc int, user string, block string, seq int, action string").withColumn("ts", F.lit(None).cast("timestamp"))
    batch = presence.users(frame(spark, rows).unionByName(odd), "doc", "user", "ts", "seq", "action")
    assert {(r.document, r.user): r.action for r in batch.collect()} == last
    for part in (rows[200:], rows[:200]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    found = events.run_once(presence.users(stream, "doc", "user", "ts", "seq", "action"))
    assert {(r.document, r.user): r.action for r in found.collect()} == last


def test_presence_waits_for_no_document(spark, monkeypatch):
    """what stream_presence keeps is dealt by document and user, without Python, and its state is not that of whole documents."""
    from blockloom.plans import catalog, stream_queries

    monkeypatch.setattr(presence, "Documents", None)
    assert catalog.QUERIES["stream_presence"](spark, "/root/testdata/sf0.001").count() == 8
    rows = stream_queries.editor_actions(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    plan = presence.users(rows, "doc", "user_id", "ts", "event_id", "action")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(document" in plan and "Python" not in plan and "TransformWithState" not in plan


def test_state_is_asked_once():
    """a user's state is asked once in a micro-batch, all locks once, and only what changed is written."""
    from types import SimpleNamespace

    calls = []

    class State(dict):
        containsKey, getValue = lambda self, k: calls.append("asked") or k in self, dict.__getitem__
        updateValue, removeKey = lambda self, k, v: calls.append("written") or self.__setitem__(k, v), lambda self, k: calls.append("written") or self.__delitem__(k)
        iterator = lambda self: calls.append("listed") or iter(list(self.items()))

    op = presence.Documents(0)
    op.users, op.locks = State({("a",): (1,), ("b",): (2,)}), State({("x",): ("a", 1)})
    actions = [("a", "x", "leave"), ("a", "x", "join"), ("b", "y", "lock"), ("b", "y", "unlock"), ("c", "x", "join"), ("c", "x", "lock")] + [("c", "x", "join"), ("b", "x", "join")] * 50
    rows = (SimpleNamespace(at=10 + i, seq=i, user=u, block=b, action=a) for i, (u, b, a) in enumerate(actions))
    found = [(r.user, r.block, r.change) for r in op.handleInputRows(("d",), rows, None)]
    assert found == [("a", None, "left"), ("a", "x", "released"), ("a", None, "joined"), ("b", "y", "locked"), ("b", "y", "released"), ("c", None, "joined"), ("c", "x", "locked")]
    assert dict(op.users) == {("a",): (11,), ("b",): (2,), ("c",): (14,)} and dict(op.locks) == {("x",): ("c", 15)}
    assert (calls.count("asked"), calls.count("listed"), calls.count("written")) == (3, 1, 3)
