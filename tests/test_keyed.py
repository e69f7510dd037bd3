"""Streams with keyed state, stopped and started again, against the same rules over whole tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitewright.operators import tables
from sitewright.streaming import keyed, state

EPOCH = datetime(2030, 1, 1)


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    keyed.with_state_store(spark)
    yield
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, rows, kind, make, parts=2):
    """Accepted and refused rows of a query that is stopped and started again between ``parts`` of ``rows``."""
    source = str(tmp_path / "in")
    end = EPOCH + timedelta(days=900)
    size = -(-len(rows) // parts)
    for n in range(parts + 1):
        part = rows[n * size : (n + 1) * size] if n < parts else [(*([-1] + [None] * (kind.count(",") - 1)), end)]
        frame = spark.createDataFrame(part, kind)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(frame.schema).parquet(source))
        keyed.delivered(stream, str(tmp_path / "yes"), str(tmp_path / "no"), str(tmp_path / "c")).awaitTermination()
    read = lambda name: spark.read.schema(stream.schema).parquet(str(tmp_path / name))
    return read("yes"), read("no")


def test_edits_with_restarts_equal_the_batch_fold(spark, tmp_path, store):
    ops = ["insert", "update", "delete", "update"]
    rows = [(i * 7 % 11, i, ops[i * i % 4 if i % 3 else i % 4], float(i), EPOCH + timedelta(minutes=i)) for i in range(120)]
    shuffled = sorted(rows, key=lambda r: (r[1] // 6, -r[1]))  # neighbours come in the wrong order, across parts too
    kind = "id long, seq long, op string, value double, ts timestamp"
    yes, no = streamed(spark, tmp_path, shuffled, kind, lambda s: keyed.edits(s, "30 minutes"))
    whole = {r.id: r for r in state.edits(spark.createDataFrame(rows, kind)).collect()}
    assert yes.count() + no.count() == len(rows)
    refused = {r.id: r.n for r in no.groupBy("id").agg(F.count("*").alias("n")).collect()}
    last = {r.id: (r.alive, r.value) for r in tables.latest(yes, ["id"], ["seq"]).collect()}
    for i, r in whole.items():
        assert refused.get(i, 0) == r.refused
        assert last.get(i, (False, None)) == (r.alive, r.value)


def test_arrivals_with_restarts_equal_the_batch_rule(spark, tmp_path, store):
    rows, number = [], {}
    for i in range(150):
        scene, kind = i * 5 % 4, ("drive", "arrive", "arrive", "reset", "drive", "arrive")[i * 11 % 6]
        if kind != "arrive":
            number[scene] = number.get(scene, 0) + 1
        rows.append((scene, i, kind, number.get(scene, 0) - (i % 7 == 0) if kind == "arrive" else number[scene], EPOCH + timedelta(seconds=i)))
    kind = "scene_id long, at long, kind string, seq_no long, ts timestamp"
    yes, no = streamed(spark, tmp_path, rows, kind, keyed.drives)
    whole = {r.at for r in state.arrivals(spark.createDataFrame(rows, kind)).collect()}
    # the batch rule keeps every report of a drive; the state takes the first and leaves the rest
    got = {r.at for r in yes.filter("kind = 'arrive'").collect()}
    driving, want = {}, set()
    for scene, at, what, seq, _ in rows:
        if what != "arrive":
            driving[scene] = seq if what == "drive" else None
        elif driving.get(scene) == seq:
            want.add(at)
            driving[scene] = None
    assert got == want and got <= whole and no.count() == sum(r[2] == "arrive" for r in rows) - len(want)


def test_retention_and_repeated_ids(spark, tmp_path, store):
    rows = [(i % 3, i * i % 23, i, EPOCH + timedelta(seconds=i)) for i in range(90)]
    kind = "scene_id long, id long, seq long, ts timestamp"
    yes, no = streamed(spark, tmp_path, rows, kind, lambda s: keyed.retained(s, 4))
    kept, want, refused = {}, {}, 0
    for scene, i, seq, _ in rows:
        own = kept.setdefault(scene, [])
        if i in own:
            refused += 1
            continue
        own.append(i)
        want[scene, seq] = own[: max(0, len(own) - 4)]
        kept[scene] = own[-4:]
    assert {(r.scene_id, r.seq): r.gone for r in yes.collect()} == want and no.count() == refused > 5


def test_access_is_checked_against_tables_and_refusals_are_kept(spark, tmp_path):
    members = spark.createDataFrame([("ann", 1), ("bob", 2)], "identity string, org_id int")
    access = spark.createDataFrame([(1, "mars"), (2, "moon")], "org_id int, scene_id string")
    events = [("ann", "mars#room2", 1), ("bob", "mars", 2), ("eve", "moon", 3), ("bob", "moon", 4), ("ann", None, 5)]
    source = str(tmp_path / "in")
    frame = spark.createDataFrame(events, "identity string, scene_id string, n int")
    frame.write.parquet(source)
    stream = keyed.checked(spark.readStream.schema(frame.schema).parquet(source), members, access)
    for _ in range(2):
        keyed.delivered(stream, str(tmp_path / "yes"), str(tmp_path / "no"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "yes")).collect()) == [1, 4]
    no = {r.n: r.refused for r in spark.read.parquet(str(tmp_path / "no")).collect()}
    assert no == {r.n: r.refused for r in tables.why_no_access(frame, members, access).filter("refused is not null").collect()} and set(no) == {2, 3, 5}


class _Store:
    """The calls of one key's state, without a stream."""

    def __init__(self):
        self.rows, self.value, self.timers, self.calls = [], None, [], 0

    def getValueState(self, name, kind):
        return self

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    put = update = lambda self, rows: None

    def exists(self):
        return False


def test_calls_to_the_store_do_not_grow_with_the_times_of_a_key(spark):
    from types import SimpleNamespace

    from pyspark.sql import Row
    from pyspark.sql.types import StructType

    event = StructType.fromDDL("id long, ts timestamp, _ms long")
    folded = keyed._Folded(lambda now, e: ({"n": 1}, {}), StructType.fromDDL("n long"), event, "ts", ["id"], ["id"])
    store = _Store()
    folded.init(store)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    kind = Row("id", "ts", "_ms")
    list(folded.handleInputRows((1,), iter([kind(i, EPOCH + timedelta(milliseconds=i), i) for i in range(1000, 0, -1)]), at(0)))
    assert store.timers == [1] and store.calls == 2
    assert [r.id for r in folded.handleExpiredTimer((1,), at(600), None)] == list(range(1, 601))
    assert store.timers == [1, 601] and len(store.rows) == 1
    assert [r.id for r in folded.handleExpiredTimer((1,), at(1000), None)] == list(range(601, 1001)) and store.rows == []
