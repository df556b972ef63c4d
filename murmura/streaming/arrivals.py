"""Rows as they arrive: repeats and late ones dropped, beats counted, in event time.

The time of a row is its session's start plus the seconds of sound before it.  A row that is later than ``lateness`` behind the newest one is dropped by the
watermark; a repeat within that time is dropped by its key.  Spark keeps keys and open windows only as long as the watermark allows, so state is
bounded by the rate of arrival and not by the length of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def event_time(started_at: Column, seconds: Column) -> Column:
    """The time at which sound was heard."""
    return F.timestamp_micros((F.unix_micros(started_at) + F.bround(seconds * 1_000_000)).cast("long"))


def fresh(rows: DataFrame, time: str, key: list[str], lateness: str = "10 seconds") -> DataFrame:
    """``rows`` once each by ``key``, without those that come too late."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def beats(rows: DataFrame, time: str, key: str, every: str = "10 seconds") -> DataFrame:
    """(key, begin, n): rows of each key in each stretch of ``every``; a stretch is given out once the watermark has passed its end."""
    return rows.groupBy(key, F.window(time, every)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("begin"), "n")


def dropped(query: StreamingQuery) -> dict[str, int]:
    """Rows that a query has dropped so far: late by the watermark, and repeated ones.

    Counts the progress that the query still remembers (spark.sql.streaming.numRecentProgressUpdates).
    """
    late = repeated = 0
    for p in query.recentProgress:
        for s in p["stateOperators"]:
            late += s["numRowsDroppedByWatermark"]
            repeated += s["customMetrics"].get("numDroppedDuplicateRows", 0)
    return {"late": late, "repeated": repeated}
