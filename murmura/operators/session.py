"""Rows of a session in order: clocks, caps, contexts, diffs between snapshots, trusted windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(order: list[str], key: str = "session_id") -> Window:
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds fed (seconds of sound so far) and covered (how far what has come so far reaches) to rows with start and end."""
    w = _so_far(order)
    return rows.withColumns({"fed": F.sum(F.col("end") - F.col("start")).over(w), "covered": F.max("end").over(w)})


def within_cap(rows: DataFrame, limits: DataFrame, order: list[str]) -> DataFrame:
    """The rows of each session that begin before its organisation's cap in minutes is used up; no known cap, no limit.

    ``limits`` has organization_id and max_minutes.
    """
    w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = rows.join(limits.select("organization_id", "max_minutes"), "organization_id", "left")
    df = df.withColumn("used", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)))
    return df.filter(F.col("max_minutes").isNull() | (F.col("used") < F.col("max_minutes") * 60)).drop("max_minutes")


def rolling_context(rows: DataFrame, text: str, order: list[str], last: int = 3, most: int = 1200) -> DataFrame:
    """Adds context: the last few texts that aren't empty before each row, the end of them if they are long."""
    w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.col(text))
    # Accepted texts are numbered, so that the frame reaches back over those alone and stays small.
    numbered = rows.withColumn("_n", F.coalesce(F.count(said).over(w), F.lit(0)))
    before = Window.partitionBy("session_id").orderBy("_n").rangeBetween(-last, -1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct(*order, F.col(text).alias("_said")))).over(before)), lambda s: s["_said"]), " ")
    return numbered.withColumn("context", F.right(joined, F.lit(most))).drop("_n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """What turns one snapshot into the next: added, removed and changed rows by key."""
    row = F.struct(*fields)
    both = old.select(*key, row.alias("o")).join(new.select(*key, row.alias("n")), key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*key, "change")


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose session, start and end, in whole milliseconds, aren't among those seen."""
    ms = {"_a": F.rint(F.col("start") * 1000).cast("long"), "_b": F.rint(F.col("end") * 1000).cast("long")}
    keys = ["session_id", *ms]
    return rows.withColumns(ms).join(seen.withColumns(ms).select(*keys).distinct(), keys, "left_anti").drop(*ms)


def trusted(windows: DataFrame, pure: Column, least: float = 1.8) -> DataFrame:
    """Adds trusted: long and pure windows; where a session has fewer than two of these, all long ones."""
    long_enough = F.col("end") - F.col("start") >= least
    w = Window.partitionBy("session_id")
    both = F.count_if(pure & long_enough).over(w)
    return windows.withColumn("trusted", F.when(both >= 2, pure & long_enough).otherwise(long_enough))


def largest(clusters: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` clusters of each session with the most seconds (the rule of a session's cap)."""
    w = Window.partitionBy("session_id").orderBy(F.col("seconds").desc(), "cluster")
    return clusters.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def unexplained(windows: DataFrame, best: str, far: float, least: float = 5.0, session: float = 10.0) -> DataFrame:
    """Seconds of each session that no known speaker explains, and whether they call for a new derivation."""
    seconds = F.col("end") - F.col("start")
    df = windows.groupBy("session_id").agg(F.sum(F.when(F.col(best) > far, seconds).otherwise(0.0)).alias("unexplained"), F.sum(seconds).alias("total"))
    return df.withColumn("rederive", (F.col("unexplained") >= least) & (F.col("total") >= session))


def hold_back(regions: DataFrame, buffered: Column, closed: Column, least: float = 0.9) -> DataFrame:
    """Regions that are long enough and can't grow any more: those that end before the buffer does, or lie in what is closed."""
    return regions.filter((F.col("end") - F.col("start") >= least) & ((F.col("end") < buffered) | (F.col("end") <= closed)))


def with_context(records: DataFrame, contexts: DataFrame, fields: list[str]) -> DataFrame:
    """Log records with their session's ids; a record's own value comes first, emails never enter."""
    own = {c: F.col(f"r.{c}") for c in records.columns}
    joined = records.alias("r").join(contexts.select("session_id", *fields).alias("c"), "session_id", "left")
    return joined.select("session_id", *(own[c].alias(c) for c in own if c not in (*fields, "session_id", "email")), *(F.coalesce(own[f], F.col(f"c.{f}")).alias(f) if f in own else F.col(f"c.{f}") for f in fields))


def tumbling_buffers(chunks: DataFrame, order: list[str], seconds: float = 20.0) -> DataFrame:
    """Adds buffer: chunks fill one buffer after another by the sound before them, without an overlap."""
    w = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("buffer", F.floor(F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)) / seconds))
