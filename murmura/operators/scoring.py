"""Scoring a speaker timeline against a reference: pieces of time, collar, mapping, error rate.

Times are whole steps of ``STEP`` seconds.  Nothing is unfolded into frames: the bounds of turns and
collars cut a session into pieces on which both speakers are constant, and pieces count by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.assign import assignment
from murmura.session import ship

#: Seconds in a step of the scoring grid.
STEP = 0.01


def _spans(turns: DataFrame, side: int, step: float, reach: int | None = None) -> DataFrame:
    """(session_id, side, speaker, run, a, b) of turns in steps, b not included; empty ones left out.  With ``reach`` the collars around all starts and ends as well, as side 2."""
    a, b = (F.rint(F.col(c) / step).cast("long") for c in ("start", "end"))
    span = lambda k, x, y: F.struct(F.lit(k).alias("side"), x.alias("a"), y.alias("b"))
    collars = [] if reach is None else [span(2, e - reach, e + reach + 1) for e in (a, b)]
    rows = turns.select("session_id", F.col("speaker").cast("long").alias("speaker"), F.col("run_id").cast("long").alias("run"), F.explode(F.array(span(side, a, b), *collars)).alias("s"))
    return rows.select("session_id", "s.side", "speaker", "run", "s.a", "s.b").filter("a < b")


def pieces(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25, step: float = STEP, stretch: float = 600.0) -> DataFrame:
    """(session_id, ref, hyp, n): pieces outside of the collar with their speakers and length in steps; null is silence.

    Where turns of one side overlap the one of the largest run_id counts.  Turns and collars are cut where a ``stretch`` of seconds ends, so that
    each stretch of a session is swept by itself, with all that is open in it, and a long session is many tasks'.  A sweep goes over the bounds in order;
    each side keeps the open turns as a map of run_id, as long as turns overlap.
    """
    width = max(1, round(stretch / step))

    rows = _spans(reference, 0, step, round(collar / step)).unionByName(_spans(hypothesis, 1, step))
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    rows = rows.withColumns({"a": F.greatest(F.col("a"), F.col("part") * width), "b": F.least(F.col("b"), (F.col("part") + 1) * width)})
    ends = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("open")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("open")))).alias("m")
    both = rows.select("session_id", "part", "side", "speaker", "run", ends).select("session_id", "part", "side", "speaker", "run", "m.at", "m.open")
    schema = "session_id long, ref long, hyp long, n long"
    ship(reference.sparkSession)

    def sweep(batches):
        stretch, at, turns, depth = None, 0, ({}, {}), 0
        for batch in batches:
            out = []
            for s, part, side, speaker, run, t, opens in zip(*(batch[c].tolist() for c in ("session_id", "part", "side", "speaker", "run", "at", "open")), strict=True):
                if (s, part) != stretch:
                    stretch, at, turns, depth = (s, part), t, ({}, {}), 0
                if t > at:
                    now = [max(x.items())[1] if x else None for x in turns]
                    if not depth and now != [None, None]:
                        out.append((s, *now, t - at))
                    at = t
                if side == 2:
                    depth += opens
                elif opens > 0:
                    turns[side][run] = speaker
                else:
                    turns[side].pop(run, None)
            done = pd.DataFrame(out, columns=["session_id", "ref", "hyp", "n"]).astype({"session_id": "int64", "ref": "Int64", "hyp": "Int64", "n": "int64"})
            yield done.groupby(["session_id", "ref", "hyp"], dropna=False, as_index=False).sum()

    ordered = both.repartition("session_id", "part").sortWithinPartitions("session_id", "part", "at", "open", "side", "run")
    return ordered.mapInPandas(sweep, schema)


def contingency(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25) -> DataFrame:
    """Steps by session, reference and guessed speaker."""
    return pieces(reference, hypothesis, collar).groupBy("session_id", "ref", "hyp").agg(F.sum("n").alias("n"))


def _pairs(cells: np.ndarray) -> list[tuple[int, int, int]]:
    """The pairs (ref, hyp, n) of the best one-to-one mapping for a table's cells (ref, hyp, n), those that never agree left out."""
    refs, r = np.unique(cells[:, 0], return_inverse=True)
    hyps, h = np.unique(cells[:, 1], return_inverse=True)
    n = np.zeros((len(refs), len(hyps)))
    np.add.at(n, (r, h), cells[:, 2])
    return [(int(refs[i]), int(hyps[j]), int(n[i, j])) for i, j in assignment(-n) if n[i, j] > 0]


def _tables(counts: DataFrame, **more: Column) -> DataFrame:
    """One row a session: its cells with both speakers as an array, and aggregates of all its counts."""
    cell = F.when(F.col("ref").isNotNull() & F.col("hyp").isNotNull(), F.struct("ref", "hyp", "n"))
    ship(counts.sparkSession)
    return counts.groupBy("session_id").agg(F.collect_list(cell).alias("cells"), *(c.alias(k) for k, c in more.items()))


def _solved(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int]]]:
    lists = batch.column("cells")
    flat = lists.flatten()
    cells = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
    upto = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    for b, e in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True):
        yield _pairs(cells[b:e]) if e > b else []


def best_mapping(counts: DataFrame) -> DataFrame:
    """(session_id, ref, hyp, n): the one-to-one mapping of speakers on which reference and guess agree most, pairs that never agree left out.

    Any number of speakers on either side; a session's table is as large as its speakers are many, and sessions are solved batch by batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, *p) for s, pairs in zip(batch.column("session_id").to_pylist(), _solved(batch), strict=True) for p in pairs]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["session_id", "ref", "hyp", "n"])

    return _tables(counts).select("session_id", "cells").mapInArrow(run, "session_id long, ref long, hyp long, n long")


def error_rate(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.25) -> DataFrame:
    """Seconds correct, confused, missed and falsely alarmed of each session, and the error rate.

    Totals and table of a session are one row, so the sweep is made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agreed = pa.array([sum(n for _, _, n in pairs) for pairs in _solved(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), agreed], names=[*names, "agreed"])

    total: dict[str, Column] = {
        "both": F.sum(F.when(F.col("ref").isNotNull() & F.col("hyp").isNotNull(), F.col("n")).otherwise(0)),
        "missed": F.sum(F.when(F.col("hyp").isNull(), F.col("n")).otherwise(0)),
        "false_alarm": F.sum(F.when(F.col("ref").isNull(), F.col("n")).otherwise(0)),
    }
    names = ["session_id", *total]
    sums = _tables(contingency(reference, hypothesis, collar), **total).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "agreed"]))
    speech = F.col("both") + F.col("missed")
    wrong = F.col("both") - F.col("agreed") + F.col("missed") + F.col("false_alarm")
    seconds = lambda c: F.bround(c * STEP, 2)
    return sums.select(
        "session_id",
        seconds(F.col("agreed")).alias("correct"),
        seconds(F.col("both") - F.col("agreed")).alias("confusion"),
        seconds(F.col("missed")).alias("missed"),
        seconds(F.col("false_alarm")).alias("false_alarm"),
        F.when(speech == 0, 0.0).otherwise(F.bround(wrong / speech, 6)).alias("error_rate"),
    )


def reconcile(counts: DataFrame) -> DataFrame:
    """Candidates (session_id, candidate, speakers, confidence): the anchor is the surest; do the others count as many speakers?"""
    w = Window.partitionBy("session_id")
    df = counts.withColumn("anchor", F.max_by("speakers", F.struct("confidence", F.col("candidate"))).over(w))
    return df.groupBy("session_id").agg(F.max("anchor").alias("anchor_speakers"), F.count_if(F.col("speakers") != F.col("anchor")).alias("n_disagree")).withColumn("agreed", F.col("n_disagree") == 0)
