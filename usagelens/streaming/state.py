"""Running a stream that keeps state by key.

State lives in RocksDB on the executors and is saved to the progress folder with
every batch, so a lost executor loads it again and goes on from the last batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Generator, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Settings that a query with state by key needs; they are read when it starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def arriving(stream: DataFrame, arrival: str, disorder: str) -> DataFrame:
    """Sets the clock of a stream by arrival seconds; files may be out of order by ``disorder``."""
    return stream.withColumn("arrived", F.timestamp_seconds(arrival)).withWatermark("arrived", disorder)


class Mapped:
    """A map state read at once and written back by difference."""

    def __init__(self, state):
        self.state = state
        self.now = {k[0]: tuple(v) for k, v in state.iterator()}
        self.then = dict(self.now)

    def save(self) -> None:
        for key in self.then.keys() - self.now.keys():
            self.state.removeKey((key,))
        for key, value in self.now.items():
            if self.then.get(key) != value:
                self.state.updateValue((key,), value)


def plain(rows: Iterable) -> Iterator[dict]:
    for row in rows:
        yield row.asDict()


class Kept(StatefulProcessor):
    """State of one key that goes when the key was not seen for ``keep_s`` seconds."""

    def __init__(self, keep_s: float):
        self.keep_s = keep_s

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at double")

    def saw(self, at: float) -> None:
        if self.seen.exists() and at <= self.seen.get()[0]:
            return  # its timer is set
        self.seen.update((at,))
        self.handle.registerTimer(int((at + self.keep_s) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists() and (self.seen.get()[0] + self.keep_s) * 1000 < timerValues.getCurrentWatermarkInMs():
            self.seen.clear()
            self.forget()
        yield from ()

    def close(self) -> None:
        pass


#: Groups that many small keys are kept in.
GROUPS = 4096


def group_of(key: Column) -> Column:
    """The group of a key, for state that ``Shared`` keeps."""
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")


class Shared(StatefulProcessor):
    """State of the many small keys of one group; a key's part goes when it was not seen for ``keep_s`` seconds.

    Each call of state is a message between processes, so a group's state is read and
    written as whole lists, a few messages for all of its keys. ``KEY`` is the column of
    the key, ``LISTS`` the lists and their columns; ``step`` takes the rows of one key and
    its part of each list, which it may change, and returns when it was seen.
    """

    KEY: str
    LISTS: dict[str, str]

    def __init__(self, keep_s: float):
        self.keep_s = keep_s

    def init(self, handle) -> None:
        self.handle = handle
        self.lists = {name: handle.getListState(name, "_key string, " + columns) for name, columns in self.LISTS.items()}
        self.seen = handle.getListState("seen", "_key string, at double")

    def step(self, key: str | None, rows: list[dict], held: dict[str, list[tuple]]) -> Generator[Row, None, float]:
        raise NotImplementedError

    def _load(self) -> tuple[dict, dict]:
        held = {name: defaultdict(list) for name in self.lists}
        for name, state in self.lists.items():
            for key, *values in state.get():
                held[name][key].append(tuple(values))
        return held, {key: at for key, at in self.seen.get()}

    def _save(self, held: dict, seen: dict) -> None:
        for name, state in (*self.lists.items(), ("seen", self.seen)):
            told = list(seen.items()) if name == "seen" else [(key, *v) for key, values in held[name].items() for v in values]
            if told:
                state.put(told)
            else:
                state.clear()
        if seen:
            self.handle.registerTimer(int((min(seen.values()) + self.keep_s) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = defaultdict(list)
        for r in plain(rows):
            arrived[r[self.KEY]].append(r)
        held, seen = self._load()
        for one, new in arrived.items():
            own = {name: held[name][one] for name in held}
            at = yield from self.step(one, new, own)
            for name in held:
                held[name][one] = own[name]
            seen[one] = max(at, seen.get(one, at))
        self._save(held, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, seen = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        for one in [k for k, at in seen.items() if (at + self.keep_s) * 1000 < now]:
            del seen[one]
            for parts in held.values():
                parts.pop(one, None)
        self._save(held, seen)
        yield from ()

    def close(self) -> None:
        pass
