"""Who is in a document and who holds its blocks, as state of a stream; the same on a batch."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.shuffle import ExternalSorter
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Memory of a worker from which the actions of a document are sorted on disk.
SORT_MB = 512
CHANGE = "document string, at long, seq long, user string, block string, change string"


class Documents(StatefulProcessor):
    """State of a document: its users and the locks on its blocks. Each action becomes the changes that it brings.

    join and leave (or disconnect) change who is there; a leave releases the user's locks. lock is refused while another user holds the
    block, unless that lock is lock_seconds old; unlock counts only for the holder. What comes twice brings no change.
    """

    def __init__(self, lock_seconds: int) -> None:
        self.lock_us = lock_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.users = handle.getMapState("users", "user string", "since long")
        self.locks = handle.getMapState("locks", "block string", "user string, since long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        """State is asked once for each user that comes and once for all locks, and what differs at the end is written, as each call leaves the worker."""
        asked: dict[str, int | None] = {}  # since when users are there, in the state
        there: dict[str, int | None] = {}  # and now
        stored = {block[0]: (lock[0], lock[1]) for block, lock in self.locks.iterator()}
        locks, own = dict(stored), defaultdict(set)
        for block, (holder, _) in locks.items():
            own[holder].add(block)

        def release(block: str) -> None:
            own[locks.pop(block)[0]].discard(block)

        for r in ExternalSorter(SORT_MB).sorted(rows, key=lambda r: (r.at, r.seq)):  # on the worker's disk beyond that
            change = lambda kind, b=None, u=r.user: Row(document=key[0], at=r.at, seq=r.seq, user=u, block=b, change=kind)  # noqa: B023, E731
            if r.action in ("join", "leave", "disconnect") and r.user not in there:
                there[r.user] = asked[r.user] = self.users.getValue((r.user,))[0] if self.users.containsKey((r.user,)) else None
            if r.action == "join" and there[r.user] is None:
                there[r.user] = r.at
                yield change("joined")
            elif r.action in ("leave", "disconnect"):
                if there[r.user] is not None:
                    there[r.user] = None
                    yield change("left")
                for held in sorted(own.get(r.user, ())):
                    release(held)
                    yield change("released", held)
            elif r.action == "lock":
                lock = locks.get(r.block)
                if lock and lock[0] != r.user and r.at - lock[1] < self.lock_us:
                    yield change("refused", r.block)
                elif not lock or lock[0] != r.user:
                    if lock:
                        release(r.block)
                        yield change("expired", r.block, lock[0])
                    locks[r.block] = (r.user, r.at)
                    own[r.user].add(r.block)
                    yield change("locked", r.block)
            elif r.action == "unlock" and r.block in locks and locks[r.block][0] == r.user:
                release(r.block)
                yield change("released", r.block)
        self._write(self.users, {u: None if x is None else (x,) for u, x in asked.items()}, {u: None if x is None else (x,) for u, x in there.items()})
        self._write(self.locks, stored, locks)

    @staticmethod
    def _write(state: object, before: dict[str, tuple | None], now: dict[str, tuple | None]) -> None:
        for key in before.keys() | now.keys():
            value = now.get(key)
            if value != before.get(key):
                state.updateValue((key,), value) if value is not None else state.removeKey((key,))

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The state store that map states need, for queries that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    _ = spark.streams.active  # starts the coordinator of state stores, which a batch needs too
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _actions(events: DataFrame, document: str, user: str, block: Column, ts: str, seq: str, action: str) -> DataFrame:
    return events.select(
        F.col(document).cast("string").alias("document"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).cast("long").alias("seq"), F.col(user).cast("string").alias("user"), block.cast("string").alias("block"), F.col(action).alias("action")
    ).where("document IS NOT NULL AND user IS NOT NULL AND at IS NOT NULL")


def changes(events: DataFrame, document: str, user: str, block: str, ts: str, seq: str, action: str, lock_seconds: int = 900) -> DataFrame:
    """CHANGE rows of a stream or a batch of events; at: microseconds since 1970. Rows without document, user or time are left out.

    On a stream the events of one micro-batch are taken in the order of time; one that comes in a later batch counts as later.
    """
    rows = _actions(events, document, user, F.col(block), ts, seq, action)
    return rows.groupBy("document").transformWithState(Documents(lock_seconds), StructType.fromDDL(CHANGE), "Append", "None")


def users(events: DataFrame, document: str, user: str, ts: str, seq: str, action: str) -> DataFrame:
    """document, user, action: what each user of a document last did of joining and leaving, on a stream (in complete mode) or a batch.

    Users do not wait for one another, so the state is one row for each, spread over the tasks, and no document is sorted. The last in time counts,
    in whatever batch it came. Rows without document, user or time are left out.
    """
    rows = _actions(events, document, user, F.lit(None), ts, seq, action).where(F.col("action").isin("join", "leave", "disconnect"))
    return rows.groupBy("document", "user").agg(F.max_by("action", F.struct("at", "seq")).alias("action"))


def present(log: DataFrame) -> DataFrame:
    """document, user: who is there after all changes."""
    last = log.where(F.col("change").isin("joined", "left")).groupBy("document", "user").agg(F.max_by("change", F.struct("at", "seq")).alias("last"))
    return last.where("last = 'joined'").drop("last")


def held(log: DataFrame) -> DataFrame:
    """document, block, user: the locks that are held after all changes."""
    marks = log.where(F.col("change").isin("locked", "released"))
    last = marks.groupBy("document", "block").agg(F.max_by(F.struct("user", "change"), F.struct("at", "seq")).alias("last"))
    return last.where("last.change = 'locked'").select("document", "block", "last.user")
