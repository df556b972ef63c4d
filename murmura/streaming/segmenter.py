"""Cutting a stream of speech flags into segments, one session at a time.

A segment begins at the first frame of speech, with the few frames before it.  It ends after a
silence, at the first quiet frame once it is long, or at the longest length.  The same fold
serves the batch (sessions stream through a task in order) and Structured Streaming (the fold's
state is kept by key).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from murmura.session import ship

SCHEMA = "session_id long, start double, end double, reason string"
STATE = "consumed long, open boolean, begin long, silent long, idle long"


@dataclass(frozen=True)
class Rule:
    """All lengths in frames of ``seconds``."""

    seconds: float = 0.03
    before: int = 8
    silence: int = 10
    soft: int = 116
    longest: int = 300
    least: int = 10


def fold(state: tuple, flag: bool, rule: Rule) -> tuple[tuple, tuple | None]:
    """The next state, and (first frame, end, reason) of a segment that this frame ends.

    The state is (frames consumed, whether a segment is open, its first frame, silent frames at its end, idle frames before now).
    """
    n, is_open, begin, silent, idle = state
    n += 1
    if not is_open:
        return ((n, True, n - 1 - min(idle, rule.before), 0, 0) if flag else (n, False, 0, 0, min(idle + 1, rule.before))), None
    silent = 0 if flag else silent + 1
    length = n - begin
    reason = "silence" if silent >= rule.silence else "soft_gap" if length >= rule.soft and not flag else "max_len" if length >= rule.longest else None
    if reason is None:
        return (n, True, begin, silent, 0), None
    return (n, False, 0, 0, 0), (begin, n, reason) if length >= rule.least else None


EMPTY = (0, False, 0, 0, 0)


def flush(state: tuple, rule: Rule) -> tuple | None:
    """What the end of the stream closes."""
    n, is_open, begin, *_ = state
    return (begin, n, "flush") if is_open and n - begin >= rule.least else None


def _rows(session: int, found: list[tuple], rule: Rule) -> pd.DataFrame:
    return pd.DataFrame([(session, round(a * rule.seconds, 6), round(b * rule.seconds, 6), r) for a, b, r in found], columns=["session_id", "start", "end", "reason"])


def segments(flags: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Segments of whole sessions of frames (session_id, frame, is_speech); a session streams through one task in order."""
    ship(flags.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, EMPTY
        for batch in batches:
            found: list[pd.DataFrame] = []
            for s, flag in zip(batch["session_id"].tolist(), batch["is_speech"].tolist(), strict=True):
                if s != session:
                    if session is not None and (rest := flush(state, rule)):
                        found.append(_rows(session, [rest], rule))
                    session, state = s, EMPTY
                state, done = fold(state, bool(flag), rule)
                if done:
                    found.append(_rows(s, [done], rule))
            yield pd.concat(found) if found else _rows(0, [], rule)
        if session is not None and (rest := flush(state, rule)):
            yield _rows(session, [rest], rule)

    return flags.select("session_id", "frame", "is_speech").repartition("session_id").sortWithinPartitions("session_id", "frame").mapInPandas(run, SCHEMA)


def stream_segments(flags: DataFrame, rule: Rule = Rule(), idle_seconds: float | None = 10.0) -> DataFrame:
    """The same over a stream, whose frames arrive in order; so much idle processing time ends a session.

    A query with such a timeout runs until it is stopped, for it waits for sessions to end. For a replay that is to stop by
    itself (``availableNow``) give None: no session times out, and what is open at the end stays in the state.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(flags.sparkSession)
    timeout = GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, found = (tuple(state.get) if state.exists else EMPTY), []
        if state.hasTimedOut:
            rest = flush(now, rule)
            state.remove()
            yield _rows(key[0], [rest] if rest else [], rule)
            return
        frames = pd.concat(list(batches)).sort_values("frame")
        for flag in frames["is_speech"].tolist():
            now, done = fold(now, bool(flag), rule)
            if done:
                found.append(done)
        state.update(now)
        if idle_seconds is not None:
            state.setTimeoutDuration(int(idle_seconds * 1000))
        yield _rows(key[0], found, rule)

    return flags.groupBy("session_id").applyInPandasWithState(step, SCHEMA, STATE, "append", timeout)
