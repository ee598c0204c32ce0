"""Streams in several batches: an index that follows changes, a keyed state machine, a log that ends at a change."""

import pytest
from pyspark.sql import functions as F

from leafline.functions import text
from leafline.store import folder, names, scratch, stored
from leafline.streaming import guard, maintain, runlog, status

CHANGE = "doc_id long, text string, deleted boolean, version int"
SAMPLE = "# Top {0}\nintro\n## First\nwords of the first\n## Second\nwords of the second {0}"


@pytest.fixture
def index(spark, tmp_path):
    """(store, bring): bring(rows) drains one more batch of changes."""
    store = maintain.IndexStore(spark, str(tmp_path), buckets=8)

    def bring(rows, summariser=lambda c: text.first_words(c, 6)):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        stream = spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/changes")
        maintain.maintain(stream, store, summariser, "m").awaitTermination()

    return store, bring


def rows_of(df):
    names_ = ["doc_id", "node_seq", "node_id", "parent_seq", "title", "is_leaf", "content", "depth", "summary", "content_hash"]
    return sorted(map(tuple, df.select(*names_).collect()))


def fresh(store, doc_id):
    return {r.node_id for r in store.read().where(f"doc_id = {doc_id} AND NOT reused").collect()}


def test_batches_give_the_index_of_one_build(spark, index, tmp_path):
    store, bring = index
    first = [(i, SAMPLE.format(i), False, 1) for i in range(20)]
    bring(first)
    places = store.places()
    assert len(places) > 4 and set(places.values()) == {0}
    changed, longer = SAMPLE.format(3).replace("words of the second 3", "other words"), SAMPLE.format(7) + " and more"
    rows = [(3, changed, False, 3), (3, "# stale", False, 2), (4, None, False, 2), (5, SAMPLE.format(5), False, 2), (7, longer, False, 2)]
    bring([*rows, (41, "# New\ntext", False, 1), (42, "no heading", False, 1)])
    touched = {b for b, n in store.places().items() if n == 1}
    expected = spark.createDataFrame([(3,), (4,), (7,), (41,), (42,)], "doc_id long").select(store.bucket_of()).distinct().collect()
    assert touched == {r[0] for r in expected} & set(store.places()) and len(touched) < len(places)
    assert fresh(store, 3) == {"second", "top-3"}  # a changed leaf, and the section above it
    assert fresh(store, 7) == {"second"}  # its first words are as before, so the section's input is too
    assert {r[0] for r in store.read().where("batch = 1").select("doc_id").distinct().collect()} == {3, 7, 41}  # others were carried over
    whole = maintain.IndexStore(spark, f"{tmp_path}/whole", buckets=3)
    last = [(i, t, False, 1) for i, t, _, _ in first if i not in (3, 4, 7)] + [(3, changed, False, 1), (7, longer, False, 1), (41, "# New\ntext", False, 1)]
    whole.upsert(spark.createDataFrame(last, CHANGE), 0, lambda c: text.first_words(c, 6), "m")
    assert rows_of(store.read()) == rows_of(whole.read())


def test_batches_that_come_again(spark, tmp_path):
    store = maintain.IndexStore(spark, str(tmp_path), buckets=4)
    bring = lambda rows, number: store.upsert(spark.createDataFrame(rows, CHANGE), number, lambda c: c, "m")
    bring([(i, f"# t{i}", False, 1) for i in range(6)], 0)
    before = rows_of(store.read())
    bring([(1, "# x", False, 9)], 0)  # batch 0 is committed
    bring([(i, f"# t{i}", False, 2) for i in range(6)], 1)  # nothing new: no bucket is written
    assert rows_of(store.read()) == before and store.commits() == [0, 1] and set(store.places().values()) == {0}
    bring([(1, "# other", False, 3)], 2)
    store.vacuum()
    assert store.commits() == [1, 2] and {r.title for r in store.read().collect()} == {"t0", "other", "t2", "t3", "t4", "t5"}
    bring([(i, None, True, 9) for i in range(6)], 3)
    bring([(i, None, True, 9) for i in range(6)], 4)
    store.vacuum()
    assert store.read() is None and store.places() == {}
    assert not any(p.startswith("bucket") for f in names(spark, f"{tmp_path}/rows") for p in names(spark, f"{tmp_path}/rows/{f}"))


def test_empty_store_and_changes(spark, index):
    store, bring = index
    assert store.read() is None and store.commits() == []
    store.upsert(spark.createDataFrame([], CHANGE), 0, lambda c: c, "m")
    assert store.read() is None and store.commits() == [0]


def test_scratch(spark):
    with scratch(spark):
        inside = stored(spark.range(3))
        path = inside.inputFiles()[0]
    left = stored(spark.range(2))
    assert left.count() == 2 and path.rpartition("/")[0].rpartition("/")[2] not in names(spark, folder(spark))


MARK = "ts timestamp, event_id long, node string, status string"


def marks_of(spark, rows):
    made = spark.createDataFrame([(int(t), e, n, s) for t, e, n, s in rows], "t long, event_id long, node string, status string")
    return made.select(F.timestamp_seconds("t").alias("ts"), "event_id", "node", "status").coalesce(1)


def drained(spark, at, batches, **how):
    for rows in batches:
        marks_of(spark, rows).write.mode("append").parquet(f"{at}/marks")
        stream = spark.readStream.schema(MARK).parquet(f"{at}/marks")
        with status.rocksdb(spark):
            updates = runlog.run_available(status.statuses(stream, ["node"], "ts", "event_id", **how), "marks", "update", at=f"{at}/out")
    return updates


def test_late_and_repeated_marks(spark, tmp_path):
    first = [(10, 1, "a", "evaluating"), (20, 2, "a", "kept"), (15, 3, "b", "evaluating"), (15, 4, "b", "unheard of"), (16, 5, "c", None)]
    second = [(12, 6, "a", "pruned"), (20, 2, "a", "kept"), (30, 7, "b", "retrieved"), (30, 8, "b", "error"), (31, 9, "b", "evaluating")]
    updates = drained(spark, str(tmp_path), [first, second], barred=[("error", "evaluating")])
    got = {r.node: tuple(r)[1:] for r in status.latest(updates, ["node"]).collect()}
    assert got["a"] == ("kept", 4, 1, 2, False)  # the late mark and the repeated one are refused
    assert got["b"] == ("error", 5, 2, 2, False)  # an unknown status, and one that is barred after an error
    assert got["c"] == (None, 1, 0, 1, False)
    assert updates.where("node = 'c'").count() == 1 and updates.where("node = 'a'").count() == 2  # update mode tells touched keys only


def test_forgotten_keys(spark, tmp_path):
    batches = [[(10, 1, "a", "kept")], [(100, 2, "b", "kept")], [(200, 3, "b", "pruned")], [(205, 4, "a", "error")]]
    updates = drained(spark, str(tmp_path), batches, late="0 seconds", lives_ms=50_000)
    expired = {(r.node, r.status) for r in updates.where("expired").collect()}
    assert ("a", "kept") in expired  # 'a' was forgotten once event time was past it
    got = {r.node: tuple(r)[1:] for r in status.latest(updates, ["node"]).collect()}
    assert got["a"][:4] == ("error", 1, 0, 0)  # and begins anew


LOG = "run_id string, ts long, index_fingerprint string"


@pytest.mark.parametrize("one_run", [True, False])
def test_log_ends_at_the_change(spark, tmp_path, one_run):
    at = str(tmp_path)
    batches = [[("r", 1, "f"), ("r", 2, "f")], [("r", 4, "g"), ("r", 3, "f"), ("r", 5, "f"), ("r", 6, "g")], [("r", 7, "f"), ("r", 8, "g")]]
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{at}/log")
        stream = spark.readStream.schema(LOG).parquet(f"{at}/log")
        found = guard.guarded(stream, f"{at}/kept", "run_id", ["ts"], one_run=one_run)
    assert sorted(tuple(r) for r in found.collect()) == [("r", 1, "f"), ("r", 2, "f"), ("r", 3, "f"), ("r", 4, "g")]
    stop = guard.runs(spark, f"{at}/kept").first()
    assert (stop.run, stop.expected, stop.stop.ts) == ("r", "f", 4)
    assert len(names(spark, f"{at}/kept/records")) == (2 if one_run else 3)  # a stopped run's stream reads no further


def test_runs_are_guarded_apart(spark, tmp_path):
    at = str(tmp_path)
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, "x"), (None, 1, "y"), (None, 2, "y"), ("b", 9, "z")]
    assert guard.keep(spark.createDataFrame(rows, LOG), 0, at, "run_id", ["ts"]) is False
    assert guard.keep(spark.createDataFrame([("c", 1, "z")], LOG), 0, at, "run_id", ["ts"]) is False  # a batch that is there already
    assert guard.keep(spark.createDataFrame([("b", 10, "q"), ("a", 5, None), (None, 3, "n"), (None, 4, "y")], LOG), 1, at, "run_id", ["ts"]) is True
    got = sorted(map(str, (tuple(r) for r in guard.kept(spark, at).collect())))
    expected = rows[:3] + rows[4:] + [("b", 10, "q"), (None, 3, "n")]
    assert got == sorted(map(str, expected))


def test_marks_meet_the_machine_as_rows(spark):
    """A key costs no pandas frame: marks come and go as rows."""
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.col("value").alias("event_id"), F.lit("a").alias("node"), F.lit("kept").alias("status"))
    plan = status.statuses(stream, ["node"], "ts", "event_id")._jdf.queryExecution().logical().toString()
    assert "python_row" in plan


def test_keys_of_a_shard_are_told_as_if_alone(spark, tmp_path):
    """In one shard or in as many as there are keys: the same rows of each batch, and keys of one shard are forgotten each at its own time."""
    first = [(10, 1, "a", "kept"), (11, 2, "b", "evaluating"), (12, 3, "c", "kept"), (12, 4, "d", None)]
    more = [[(61, 5, "e", "kept")], [(62, 6, "e", "pruned"), (62, 7, "b", "error")], [(90, 8, "a", "error")], [(500, 9, "g", "kept")]]
    told = []
    for shards in (1, 64):
        updates = drained(spark, f"{tmp_path}/{shards}", [first, *more], late="0 seconds", lives_ms=50_000, shards=shards)
        told.append(sorted(map(str, (tuple(r) for r in updates.collect()))))
        gone = {(r.node, r.status, r.marks) for r in updates.where("expired").collect()}
        assert gone == {("a", "kept", 1), ("a", "error", 1), ("b", "evaluating", 1), ("b", "error", 1), ("c", "kept", 1), ("e", "pruned", 2)}
    assert told[0] == told[1]


def test_a_shard_is_read_and_written_once_a_batch():
    """However many keys and marks a batch has in a shard, its state is read, written and given a timer once, and keys are told in few rows."""
    asked = []

    class Held:
        value = None

        def get(self):
            asked.append("get")
            return self.value

        def update(self, value):
            asked.append("update")
            self.value = value

    class Handle:
        held = Held()

        def getValueState(self, *_):
            return self.held

        def registerTimer(self, at):
            asked.append(at)

        def deleteTimer(self, at):
            asked.append(-at)

    machine = status.StatusMachine(1, frozenset(), 100)
    machine.init(Handle())
    rows = [(0, f"n{i % 500}", None, 1000 + i, i, "kept" if i % 2 else "error") for i in range(1500)]
    told = list(machine.handleInputRows((0,), iter(rows), None))
    assert asked == ["get", 1100 + 1000, "update"] and len(told) == 1 and sorted(told[0].k0) == sorted({r[1] for r in rows})
    assert set(told[0].marks) == {3} and set(told[0].status) == {"kept", "error"} and not any(told[0].expired)
    list(machine.handleInputRows((0,), iter([(0, "n0", None, 5000, 9, "kept")]), None))
    assert asked[3:] == ["get", -2100, 2101, "update"]
