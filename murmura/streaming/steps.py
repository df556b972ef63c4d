"""A session's rows folded step by step, as keyed state of a stream.

Steps (passes, blocks) are numbered.  One is complete when a row of a later one comes, so the rows of the last step wait in the state; a row
without an embedding ends the session, and so does, if asked for, a time without any row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Steps(StatefulProcessor):
    """Subclasses name their columns and give ``states``, ``load``, ``save`` and ``step``."""

    #: Of the rows behind the key: the step first; then the result's.
    names: list[str]
    schema: str
    #: What orders the rows of a step.
    order: list[str]
    columns: list[str]
    dtypes: dict[str, str] = {}

    def __init__(self, idle_seconds: float | None = None, ttl_hours: float | None = None):
        self.idle, self.ttl = idle_seconds, ttl_hours

    def states(self, handle: StatefulProcessorHandle, ttl: int | None) -> list:
        """The session's own state variables."""
        raise NotImplementedError

    def load(self):
        raise NotImplementedError

    def save(self, state) -> None:
        raise NotImplementedError

    def step(self, state, number: int, rows: pd.DataFrame, final: bool) -> list[tuple]:
        """Fold one step into ``state``; the result's rows without the key."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.ttl is None else int(self.ttl * 3_600_000)
        self.open = handle.getListState("open", self.schema, ttl)
        self.all = [self.open, *self.states(handle, ttl)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # By place: a computed column reaches a stateful processor without its name.
        given = pd.concat([r.iloc[:, 1:].set_axis(self.names, axis=1) for r in rows], ignore_index=True)
        ended = bool(given["embedding"].isna().any())
        given = pd.concat([self.waiting(), given[given["embedding"].notna()]], ignore_index=True)
        given = given.sort_values([self.names[0], *self.order], kind="stable")
        numbers, state, out = given[self.names[0]].unique().tolist(), self.load(), []
        for number in numbers if ended else numbers[:-1]:
            out += self.step(state, number, given[given[self.names[0]] == number], ended and number == numbers[-1])
        if ended:
            self.forget()
        else:
            self.save(state)
            self.wait(given[given[self.names[0]] == numbers[-1]])
        self.wake(timerValues, None if ended else self.idle)
        yield self.result(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: the open step was the last one."""
        rows = self.waiting()
        out = self.step(self.load(), int(rows[self.names[0]].iloc[0]), rows, True) if len(rows) else []
        self.forget()
        yield self.result(key, out)

    def result(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=self.columns).astype(self.dtypes)

    def waiting(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.open.get()] if self.open.exists() else [], columns=self.names)

    def wait(self, rows: pd.DataFrame) -> None:
        plain = lambda v: v.item() if hasattr(v, "item") and getattr(v, "size", 1) == 1 and not hasattr(v, "__len__") else [float(x) for x in v] if hasattr(v, "__len__") else v
        put(self.open, [tuple(map(plain, r)) for r in rows.itertuples(index=False)])

    def forget(self) -> None:
        for state in self.all:
            state.clear()

    def wake(self, timerValues, seconds: float | None) -> None:
        """One timer a session, ``seconds`` from now."""
        if self.idle is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if seconds is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(seconds * 1000))

    def close(self) -> None:
        pass

    @property
    def time_mode(self) -> str:
        return "None" if self.idle is None and self.ttl is None else "ProcessingTime"


def put(state, rows: list[tuple]) -> None:
    """The whole of a list state; an empty list can't be put."""
    if rows:
        state.put(rows)
    else:
        state.clear()


def use_rocksdb(spark) -> None:
    """Stateful processors need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
