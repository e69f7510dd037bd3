"""Shared state on a stream: keyed state with timers, and what is refused as an output of its own.

Events of a key take effect in the order of their own time and number, not of arrival: they wait in a list until the
watermark has passed them, when a timer takes those that are due, in order, through the key's reducer. A reducer is a small
function of (state, event) that gives the next state and what comes of the event; state is one row a key, in the stream's
state store, so a stopped query goes on where its checkpoint ends.

Each event gives one row with ``refused``, the reason why it had no effect, or null. ``delivered`` writes accepted and
refused rows to two tables, once each.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.tables import why_no_access

#: (state, event) to (next state or None where there is none, the columns of the row that comes out); ``refused`` is one.
Reducer = Callable[[dict[str, Any] | None, Row], tuple[dict[str, Any] | None, dict[str, Any]]]


class _Folded(StatefulProcessor):
    """A key's events through ``step``, in order of (``at``, ``seq``), when the watermark has passed them.

    A key has a timer for the first of what waits, not one for each time: a timer takes all that is due and is set again for
    the first of what is left. Events go to the list in chunks, each one value, since the store converts value by value. So
    calls to the store, and what it converts, grow with keys and chunks.
    """

    CHUNK = 5000

    def __init__(self, step: Reducer, state: StructType, event: StructType, at: str, seq: list[str], out: list[str]):
        self.step, self.kind, self.event, self.at, self.seq, self.out = step, state, event.fieldNames(), at, seq, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.kind)
        self.waiting = handle.getListState("waiting", StructType().add("chunk", "binary"))

    def wait(self, rows: list[tuple]) -> None:
        for n in range(0, len(rows), self.CHUNK):
            self.waiting.appendValue((pickle.dumps(rows[n : n + self.CHUNK], pickle.HIGHEST_PROTOCOL),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        while chunk := list(islice(rows, self.CHUNK)):
            self.wait([tuple(row[c] for c in self.event) for row in chunk])
            least = min(row["_ms"] for row in chunk)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(first, passed + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, later = [], []
        upto = timerValues.getCurrentWatermarkInMs()
        event, made_of = Row(*self.event), Row(*self.out)
        ms = self.event.index("_ms")
        for (chunk,) in self.waiting.get():
            for row in pickle.loads(chunk):
                (due if row[ms] <= upto else later).append(row)
        if not due:  # another timer of this batch has taken them
            return
        self.waiting.clear()
        if later:
            self.wait(later)
            self.handle.registerTimer(min(row[ms] for row in later))
        names = self.kind.fieldNames()
        now = dict(zip(names, self.now.get(), strict=True)) if self.now.exists() else None
        order = [self.event.index(c) for c in (self.at, *self.seq)]
        due.sort(key=lambda r: [(r[i] is not None, r[i]) for i in order])
        for row in due:
            row = event(*row)
            now, made = self.step(now, row)
            yield made_of(*[made[c] if c in made else row[c] for c in self.out])
        if now is None:
            self.now.clear()
        else:
            self.now.update(tuple(now[c] for c in names))

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: list[str], at: str, seq: list[str], step: Reducer, state: str, out: str, delay: str = "10 seconds") -> DataFrame:
    """The rows that ``step`` gives for each of ``events``, a stream, by ``key``; the columns ``out``, of which those that
    ``step`` does not give are the event's own.

    ``at`` is a TIMESTAMP, by which events are ordered, then by ``seq``. An event that comes up to ``delay`` after a later
    one still takes its place; one that comes after its time has passed takes the next. ``state`` is the DDL of a key's
    state. The session's state store must be RocksDB's (``with_state_store``).
    """
    kind = StructType.fromDDL(out)
    events = events.withColumn("_ms", F.unix_millis(at))  # by the session's clock, not the worker's
    made = _Folded(step, StructType.fromDDL(state), events.schema, at, seq, kind.fieldNames())
    return events.withWatermark(at, delay).groupBy(*key).transformWithState(made, kind, outputMode="Append", timeMode="EventTime")


def with_state_store(spark) -> None:
    """Have queries that start from now on keep state in RocksDB, which lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- reducers ---------------------------------------------------------------------------------------------------------


def edit(now: dict | None, e: Row) -> tuple[dict | None, dict]:
    """``op`` insert, update or delete of ``value``: an update of what is not there is refused, a delete of it is silent."""
    if e.op == "insert" or (e.op == "update" and now):
        return {"value": e.value}, {"refused": None, "alive": True, "value": e.value}
    if e.op == "update":
        return now, {"refused": "no such id", "alive": False, "value": None}
    return None, {"refused": None, "alive": False, "value": None}


def drive(now: dict | None, e: Row) -> tuple[dict | None, dict]:
    """``kind`` drive, reset or arrive of a scene's rover. Drives and resets count up ``seq_no``; an arrival is accepted
    only while driving and only with the number of that drive, the first one."""
    number = now["seq_no"] if now else 0
    if e.kind in ("drive", "reset"):
        now = {"seq_no": number + 1, "driving": e.kind == "drive"}
        return now, {"refused": None, "now_seq": now["seq_no"], "driving": now["driving"]}
    if not now or not now["driving"] or e.seq_no != number:
        return now, {"refused": "not the drive under way", "now_seq": number, "driving": bool(now and now["driving"])}
    return {"seq_no": number, "driving": False}, {"refused": None, "now_seq": number, "driving": False}


def retention(keep: int) -> Reducer:
    """The newest ``keep`` ids of a key: a repeated id that is still kept is refused; ``gone`` are the ids that make room."""

    def step(now: dict | None, e: Row) -> tuple[dict, dict]:
        kept = list(now["kept"]) if now else []
        if e.id in kept:
            return {"kept": kept}, {"refused": "already there", "gone": []}
        kept.append(e.id)
        gone, kept = kept[: max(0, len(kept) - keep)], kept[-keep:]
        return {"kept": kept}, {"refused": None, "gone": gone}

    return step


def edits(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``id, seq, op, refused, alive, value`` of each of ``events(id, seq, op, value double, ts)``."""
    return folded(events, ["id"], "ts", ["seq"], edit, "value double", "id long, seq long, op string, refused string, alive boolean, value double", delay)


def drives(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``scene_id, at, kind, refused, now_seq, driving`` of each of ``events(scene_id, at, kind, seq_no, ts)``."""
    out = "scene_id long, at long, kind string, refused string, now_seq long, driving boolean"
    return folded(events, ["scene_id"], "ts", ["at"], drive, "seq_no long, driving boolean", out, delay)


def retained(events: DataFrame, keep: int, delay: str = "10 seconds") -> DataFrame:
    """``scene_id, id, seq, refused, gone`` of each of ``events(scene_id, id, seq, ts)``: the feed of a scene's newest rows."""
    out = "scene_id long, id long, seq long, refused string, gone array<long>"
    return folded(events, ["scene_id"], "ts", ["seq"], retention(keep), "kept array<long>", out, delay)


def checked(events: DataFrame, members: DataFrame, access: DataFrame) -> DataFrame:
    """A stream of ``events(identity, scene_id, ..)`` with ``refused``, by two joins with tables that are read anew for each
    batch: who may do something is decided by what the tables say when the event is taken."""
    return why_no_access(events, members, access)


# --- two outputs ------------------------------------------------------------------------------------------------------


def delivered(stream: DataFrame, accepted: str, refused: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows to two Parquet tables, by whether ``refused`` is null, and return the query.

    A batch's rows lie in ``batch=<number>`` of both tables; a batch that runs again after a failure replaces its own, so
    each row is there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number)).persist()
        try:
            for path, kept in ((accepted, rows.filter("refused is null").drop("refused")), (refused, rows.filter("refused is not null"))):
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
