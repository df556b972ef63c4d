"""Stitching local speakers of successive blocks into lasting identities, one session at a time.

Blocks arrive in order.  Each block's local voices are matched one-to-one with the known
identities at least total cosine distance; matches farther than ``gate`` don't count.  A voice without a match opens a
new identity, or, if a fixed number of speakers is given and so many are established, is nobody known (identity -1).  An identity is a
candidate until it was heard for long and often enough; a row is named after its own evidence has been added.

``stitch`` runs over stored blocks, ``stream`` is the same with the identities as keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from murmura.functions.assign import assignment
from murmura.session import ship
from murmura.streaming.steps import Steps, put

SCHEMA = "session_id long, block long, local_speaker int, identity int, established boolean, name string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
# The names that a reader of the result relies on.
CANDIDATE, UNKNOWN, VOICE = "CANDIDATE_SPEAKER", "UNKNOWN_SPEAKER", "Unknown_Voice_"


@dataclass(frozen=True)
class Stitch:
    """``most``: a fixed number of speakers, 0 for any."""

    gate: float = 0.50
    seconds: float = 3.0
    observations: int = 2
    most: int = 0


@dataclass
class Identity:
    """What is known of one: the sum of its vectors, seconds and observations."""

    total: np.ndarray
    seconds: float = 0.0
    observations: int = 0

    def established(self, rule: Stitch) -> bool:
        return self.seconds > rule.seconds and self.observations >= rule.observations


@dataclass
class Known:
    rule: Stitch
    identities: list[Identity] = field(default_factory=list)

    def match(self, voices: np.ndarray) -> list[int]:
        """The identity of each of a block's voices; new ones are opened as the rule allows."""
        found = [-1] * len(voices)
        if self.identities:
            cents = np.stack([i.total for i in self.identities])
            cost = 1 - (voices @ cents.T) / np.maximum(np.outer(np.linalg.norm(voices, axis=1), np.linalg.norm(cents, axis=1)), 1e-9)
            for r, c in assignment(cost):
                if cost[r, c] <= self.rule.gate:
                    found[r] = c
        full = 0 < self.rule.most <= sum(i.established(self.rule) for i in self.identities)
        for r, voice in enumerate(voices):
            if found[r] < 0 and not full:
                found[r] = len(self.identities)
                self.identities.append(Identity(np.zeros(len(voice))))
        return found

    def block(self, rows: pd.DataFrame) -> list[tuple]:
        """(local_speaker, identity, established, name) of a block's rows; a local speaker may have several."""
        local = rows.drop_duplicates("local_speaker")
        who = dict(zip(local["local_speaker"], self.match(np.stack([np.asarray(v, float) for v in local["embedding"]])), strict=True))
        out = []
        for speaker, seconds, voice in zip(rows["local_speaker"], rows["seconds"], rows["embedding"], strict=True):
            k = who[speaker]
            if k < 0:
                out.append((int(speaker), -1, False, UNKNOWN))
                continue
            i = self.identities[k]
            i.total, i.seconds, i.observations = i.total + np.asarray(voice, float), i.seconds + float(seconds), i.observations + 1
            sure = i.established(self.rule)
            out.append((int(speaker), k, sure, f"{VOICE}{k}" if sure else CANDIDATE))
        return out


def inputs(blocks: DataFrame) -> DataFrame:
    return blocks.selectExpr("session_id", "CAST(block AS LONG) AS block", "CAST(local_speaker AS INT) AS local_speaker", "CAST(seconds AS DOUBLE) AS seconds", "CAST(embedding AS ARRAY<DOUBLE>) AS embedding")


def stitch(blocks: DataFrame, rule: Stitch = Stitch()) -> DataFrame:
    """Identities of rows (session_id, block, local_speaker, seconds, embedding); a session streams through one task in order."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, known, held = None, Known(rule), pd.DataFrame()

        def close(key: tuple, rows: pd.DataFrame) -> list[tuple]:
            nonlocal session, known
            if key[0] != session:
                session, known = key[0], Known(rule)
            return [(*key, *r) for r in known.block(rows)]

        for batch in batches:
            rows = pd.concat([held, batch], ignore_index=True)
            out, groups = [], list(rows.groupby(["session_id", "block"], sort=True))
            for key, part in groups[:-1]:  # the last block may go on in the next batch
                out += close(key, part)
            held = groups[-1][1] if groups else rows
            yield pd.DataFrame(out, columns=COLUMNS)
        if len(held):
            yield pd.DataFrame(close((held["session_id"].iloc[0], held["block"].iloc[0]), held), columns=COLUMNS)

    return inputs(blocks).repartition("session_id").sortWithinPartitions("session_id", "block", "local_speaker").mapInPandas(run, SCHEMA)


class Stitcher(Steps):
    """A session in a stream: its identities are the state."""

    names = ["block", "local_speaker", "seconds", "embedding"]
    schema = "block long, local_speaker int, seconds double, embedding array<double>"
    order = ["local_speaker"]
    columns = COLUMNS

    def __init__(self, rule: Stitch, idle_seconds: float | None = None):
        super().__init__(idle_seconds)
        self.rule = rule

    def states(self, handle: StatefulProcessorHandle, ttl: int | None) -> list:
        self.identities = handle.getListState("identities", "total array<double>, seconds double, observations int", ttl)
        return [self.identities]

    def load(self) -> Known:
        rows = list(self.identities.get()) if self.identities.exists() else []
        return Known(self.rule, [Identity(np.array(v, float), s, n) for v, s, n in rows])

    def save(self, known: Known) -> None:
        put(self.identities, [(i.total.tolist(), i.seconds, i.observations) for i in known.identities])

    def step(self, known: Known, number: int, rows: pd.DataFrame, final: bool) -> list[tuple]:
        return [(number, *r) for r in known.block(rows)]


def stream(blocks: DataFrame, rule: Stitch = Stitch(), idle_seconds: float | None = None) -> DataFrame:
    """``stitch`` over a stream of blocks; a row without an embedding ends its session.  Needs the RocksDB state store."""
    ship(blocks.sparkSession)
    stitcher = Stitcher(rule, idle_seconds)
    return inputs(blocks).groupBy("session_id").transformWithStateInPandas(stitcher, SCHEMA, "Append", stitcher.time_mode)
