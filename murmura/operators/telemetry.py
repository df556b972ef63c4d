"""Telemetry: counters, percentiles, heartbeats, sessions, histograms, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def nearest_rank(values: Column, percent: float) -> Column:
    """The element at round(p / 100 * (n - 1)) of a sorted array; halves go to the even place."""
    return F.element_at(values, (F.rint(F.lit(percent) / 100 * (F.size(values) - 1)).cast("int") + 1))


def latest_percentiles(events: DataFrame, key: str, value: str, order: list[str], last: int = 512) -> DataFrame:
    """p50, p95 and p99 of the last values of each key."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    recent = events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    values = recent.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return values.select(key, F.size("v").cast("long").alias("n"), *(nearest_rank(F.col("v"), p).alias(f"p{p}") for p in (50, 95, 99)))


def counters(events: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One count for each kind of event."""
    return events.groupBy(key).agg(*tallies(kind, kinds))


def tallies(kind: str, kinds: list[str]) -> list[Column]:
    return [*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds), F.count("*").alias("n")]


def observed(events: DataFrame, kind: str, kinds: list[str]) -> tuple[DataFrame, Observation]:
    """``events`` as they are, and the counts of each kind that whatever reads them leaves behind: no second scan.

    ``Observation.get`` has the counts once an action over the frame has ended.
    """
    seen = Observation()
    return events.observe(seen, *tallies(kind, kinds)), seen


def observed_live(events: DataFrame, name: str, kind: str, kinds: list[str]) -> DataFrame:
    """The same for a stream: every micro-batch reports its counts under ``name``, which ``totals`` adds up."""
    return events.observe(name, *tallies(kind, kinds))


def totals(query: StreamingQuery, name: str) -> dict[str, int]:
    """The counts of all micro-batches that the query still remembers (spark.sql.streaming.numRecentProgressUpdates)."""
    out: dict[str, int] = {}
    for progress in query.recentProgress:
        row = progress["observedMetrics"].get(name)
        for k, v in (row.asDict() if hasattr(row, "asDict") else row or {}).items():
            out[k] = out.get(k, 0) + (v or 0)
    return out


def heartbeats(events: DataFrame, key: str, every: str) -> DataFrame:
    """Events by key and tumbling window."""
    return events.groupBy(key, F.window("ts", every)).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(key, F.col("window.start").alias("begin"), "n", F.bround("value", 6).alias("value"))


def user_sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions that end after a gap."""
    return events.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("finish"), "n")


def flips(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """How often a value changes along each key's rows, its least, most and last."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_f", F.col(value) != F.lag(value).over(w)).groupBy(key).agg(
        F.count_if("_f").alias("n_flips"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, F.struct(*order)).alias("final")
    )


def bucket(value: Column, edges: list[float]) -> Column:
    """The name of the half-open bucket a value falls in, null outside of all."""
    out = F.when(F.lit(False), "")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((value >= a) & (value < b), f"{a:g}-{b:g}")
    return out


def first_match(line: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern, in the order given, that a line matches; null if none does."""
    out = F.when(F.lit(False), "")
    for name, pattern in patterns:
        out = out.when(line.rlike(pattern), name)
    return out
