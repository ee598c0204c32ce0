"""The status of each node of a run as a keyed state machine over a stream of marks.

A key holds one status. A mark that is newer than the last one moves the key there; an older one, one that was seen
already, an unknown status and a transition that is not allowed are refused and only counted. A key whose marks have stopped is told
for the last time and forgotten once the watermark is past its last mark by the time to live, so the state is bounded by the
keys that are alive, however long the stream runs.

Spark's state holds shards of keys, as what it costs to reach the state, set a timer and hand a result on is the same for one key and for thousands.
"""

from __future__ import annotations

import contextlib
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafline.streaming.runlog import TERMINAL

#: Statuses that a mark may have: not yet decided, or one of the terminal ones.
STATUSES = ["evaluating", *TERMINAL]
#: Event time after a key's last mark until it is forgotten.
LIVES_MS = 24 * 3600 * 1000
#: Shards that keys are dealt into by hash. A batch reads and writes whole each shard that it touches. It can't be changed for a checkpoint that is there.
SHARDS = 1024
#: Keys that are told in one row.
TOLD_AT_ONCE = 10_000
#: A shard: its keys with (status, at, event, marks, moves, refused), pickled, and when its timer is due (-1: it has none).
STATE = T.StructType([T.StructField("keys", T.BinaryType()), T.StructField("due", T.LongType())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StatusMachine(StatefulProcessor):
    """Moves the keys of a shard from mark to mark (shard, key, seen, at, event, status); tells a row of arrays for many keys."""

    def __init__(self, keys: int, barred: frozenset[tuple[str, str]], lives_ms: int | None) -> None:
        self.barred, self.lives_ms = barred, lives_ms
        self.told = Row(*[f"k{i}" for i in range(keys)], "status", "marks", "moves", "refused", "expired")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shard", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = defaultdict(list)
        for row in rows:
            new[row[1:-4]].append(row[-3:])
        held, due = self._held()
        for k, found in new.items():
            held[k] = self._moved(held.get(k), found)
        self._keep(held, due)
        yield from self._tell(((k, held[k]) for k in new), False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        held, _ = self._held()
        past = timerValues.getCurrentWatermarkInMs() - self.lives_ms
        gone = {k: s for k, s in held.items() if 0 <= s[1] <= past}
        self._keep({k: s for k, s in held.items() if k not in gone} if len(gone) < len(held) else {}, -1)  # a timer that fires is removed
        yield from self._tell(gone.items(), True)

    def _moved(self, state: tuple | None, found: list[tuple]) -> tuple:
        status, at, event, marks, moves, refused = state or (None, -1, -1, 0, 0, 0)
        for mark in sorted(found, key=lambda m: m[:2]):
            marks += 1
            if mark[:2] <= (at, event) or mark[2] not in STATUSES or (status, mark[2]) in self.barred:
                refused += 1
                continue
            moves += status is not None and status != mark[2]
            at, event, status = mark
        return status, at, event, marks, moves, refused

    def _held(self) -> tuple[dict[tuple, tuple], int]:
        keys, due = self.state.get() or (None, -1)
        return (pickle.loads(keys) if keys else {}), due

    def _keep(self, held: dict[tuple, tuple], due: int) -> None:
        """Writes the shard; its timer is due when the first of its keys is to be forgotten."""
        first = -1
        if self.lives_ms is not None:
            first = min((s[1] for s in held.values() if s[1] >= 0), default=-1 - self.lives_ms) + self.lives_ms
            if first != due:
                if due >= 0:
                    self.handle.deleteTimer(due)
                if first >= 0:
                    self.handle.registerTimer(first)
        if held:
            self.state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL), first))
        else:
            self.state.clear()

    def _tell(self, found: Iterable[tuple[tuple, tuple]], expired: bool) -> Iterator[Row]:
        found = list(found)
        for i in range(0, len(found), TOLD_AT_ONCE):
            some = found[i : i + TOLD_AT_ONCE]
            status, _, _, *counts = map(list, zip(*[s for _, s in some]))
            yield self.told(*map(list, zip(*[k for k, _ in some])), status, *counts, [expired] * len(some))

    def close(self) -> None:
        pass


def statuses(
    marks: DataFrame, key: list[str], ts: str, event: str, status: str = "status", barred: list[tuple[str, str]] | None = None,
    late: str = "1 hour", lives_ms: int | None = LIVES_MS, shards: int = SHARDS,
) -> DataFrame:
    """(key, status, marks, moves, refused, expired) of a stream of marks, in update mode: a row for each key that a batch has touched.

    Order is by time, then event number; a status may be null and is refused. ``barred`` are transitions (from, to) that are refused; a key may
    otherwise go anywhere, also from one terminal status to another. Keys are not null, and no arrays or structs. Start it within rocksdb().
    """
    shaped = marks.select(
        F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(ts).cast("timestamp").alias("seen"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("at"), F.col(event).cast("long").alias("event"), F.col(status).alias("status"),
    )
    kinds = [f"k{i} array<{shaped.schema[f'k{i}'].dataType.simpleString()}>" for i in range(len(key))]
    out = ", ".join([*kinds, "status array<string>, marks array<long>, moves array<long>, refused array<long>, expired array<boolean>"])
    machine = StatusMachine(len(key), frozenset(barred or []), lives_ms)
    grouped = shaped.withWatermark("seen", late).groupBy("shard")
    mode = "EventTime" if lives_ms is not None else "None"
    told = grouped.transformWithState(machine, out, outputMode="Update", timeMode=mode)
    return told.select(F.inline(F.arrays_zip(*told.columns))).withColumnsRenamed({f"k{i}": k for i, k in enumerate(key)})


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB while a stream is started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def latest(updates: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key of a table of updates; a key that came back after it was forgotten has its last life."""
    last = F.max_by(F.struct("status", "marks", "moves", "refused", "expired"), F.struct("batch", "marks", "expired")).alias("s")
    return updates.groupBy(*key).agg(last).select(*key, "s.*")
