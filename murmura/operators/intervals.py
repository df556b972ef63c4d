"""Operators on time intervals: who speaks in a chunk, where to cut it, regions, windows, concurrency.

All joins carry session_id.  Where one session may be very long, ``overlap_join`` adds a time
bucket as a second key: each interval goes to the buckets it touches and a pair is kept in the
bucket where its overlap begins, so a long session is spread over many tasks and no pair is doubled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators.transcript import islands


def overlap_join(left: DataFrame, right: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Pairs whose intervals (session_id, start, end) overlap; the right side's columns get the prefix ``r_``."""
    r = right.select("session_id", *(F.col(c).alias(f"r_{c}") for c in right.columns if c != "session_id"))

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.filter(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))

    pairs = dealt(left, "start", "end").join(dealt(r, "r_start", "r_end"), ["session_id", "_b"])
    begins = F.floor(F.greatest("start", "r_start") / bucket)
    return pairs.filter("start < r_end AND r_start < end").filter(begins == F.col("_b")).drop("_b")


def overlap() -> Column:
    return F.least("end", "r_end") - F.greatest("start", "r_start")


def label_intervals(chunks: DataFrame, timeline: DataFrame) -> DataFrame:
    """Chunks with the speaker of the largest overlap (``hit``; the earlier begun on a tie, null without any)."""
    spoken = overlap_join(chunks.select("session_id", "chunk_id", "start", "end"), timeline.select("session_id", "start", "end", "speaker"))
    sums = spoken.groupBy("session_id", "chunk_id", F.col("r_speaker").alias("speaker")).agg(F.round(F.sum(overlap()), 6).alias("seconds"), F.min("r_start").alias("since"))
    best = sums.groupBy("session_id", "chunk_id").agg(F.max_by("speaker", F.struct("seconds", -F.col("since"))).alias("hit"))
    return chunks.join(best, ["session_id", "chunk_id"], "left")


def relabel(chunks: DataFrame, timeline: DataFrame) -> DataFrame:
    """Labels, where nothing is heard the last label of the recording, else the old speaker."""
    w = Window.partitionBy("session_id", "recording").orderBy("start", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return label_intervals(chunks, timeline).withColumn("speaker", F.coalesce(F.col("hit"), F.last("hit", ignorenulls=True).over(w), F.col("speaker")))


def speaker_before(chunks: DataFrame) -> DataFrame:
    """As-of join backwards: each chunk's last earlier chunk with a speaker that ended by its start; 0 without any.

    A chunk's start and the others' ends are merged into one line of events and the answer is carried along it.
    """
    asks = chunks.select("session_id", "chunk_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("speaker"))
    says = chunks.filter("speaker IS NOT NULL").select("session_id", "chunk_id", F.col("end").alias("at"), F.lit(0).alias("kind"), F.col("speaker").cast("int").alias("speaker"))
    w = Window.partitionBy("session_id").orderBy("at", "kind", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    known = F.max(F.when(F.col("kind") == 0, F.struct("chunk_id", "speaker"))).over(w)
    return asks.unionByName(says).withColumn("known", known).filter("kind = 1").select("session_id", "chunk_id", F.coalesce("known.speaker", F.lit(0)).alias("speaker"))


def unsplit(chunks: DataFrame, timeline: DataFrame, edge: float = 0.35) -> DataFrame:
    """Chunks that, shortened by ``edge`` at both ends, meet more than one speaker."""
    inner = chunks.filter("trim(text) <> ''").select("session_id", "chunk_id", (F.col("start") + edge).alias("start"), (F.col("end") - edge).alias("end"))
    met = overlap_join(inner, timeline.select("session_id", "start", "end", "speaker"))
    found = met.groupBy("session_id", "chunk_id").agg(F.countDistinct("r_speaker").alias("n_speakers")).filter("n_speakers > 1")
    return found.join(chunks.select("session_id", "chunk_id", (F.col("end") - F.col("start")).alias("seconds")), ["session_id", "chunk_id"])


def spaced(cuts: Column, least: float) -> Column:
    """The sorted cuts that lie at least ``least`` after the last one kept."""
    none = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(cuts), none, lambda kept, c: F.when((F.size(kept) == 0) | (c - F.element_at(kept, -1) >= least), F.array_append(kept, c)).otherwise(kept))


def split_points(chunks: DataFrame, timeline: DataFrame, edge: float = 0.35) -> DataFrame:
    """(session_id, chunk_id, cuts): where the speaker changes inside a chunk, cuts close to the last kept one left out."""
    met = overlap_join(chunks.select("session_id", "chunk_id", "start", "end"), timeline.select("session_id", "start", "end", "speaker"))
    w = Window.partitionBy("session_id", "chunk_id").orderBy("r_start", "r_end", "r_speaker")
    changes = met.withColumn("before", F.lag("r_speaker").over(w)).filter((F.col("before") != F.col("r_speaker")) & (F.col("r_start") > F.col("start") + edge) & (F.col("r_start") < F.col("end") - edge))
    cuts = changes.groupBy("session_id", "chunk_id").agg(F.collect_list(F.col("r_start").cast("double")).alias("cuts"))
    return cuts.withColumn("cuts", spaced(F.col("cuts"), edge))


def segments(chunks: DataFrame, cuts: DataFrame, before: float = 0.10, after: float = 0.15, least: float = 0.3) -> DataFrame:
    """Chunks cut at their points, each piece padded within its chunk; short pieces go, a chunk with none left stays whole."""
    bounds = F.flatten(F.array(F.array("start"), F.coalesce("cuts", F.array().cast("array<double>")), F.array("end")))
    df = chunks.join(cuts, ["session_id", "chunk_id"], "left").withColumn("bounds", bounds)
    pieces = F.zip_with(F.slice("bounds", F.lit(1), F.size("bounds") - 1), F.slice("bounds", F.lit(2), F.size("bounds") - 1), lambda a, b: F.struct(F.greatest(F.col("start"), a - before).alias("start"), F.least(F.col("end"), b + after).alias("end")))
    kept = F.filter(pieces, lambda p: p["end"] - p["start"] >= least)
    whole = F.array(F.struct("start", "end"))
    df = df.withColumn("pieces", F.when(F.size(kept) > 0, kept).otherwise(whole))
    return df.select("session_id", "chunk_id", F.posexplode("pieces").alias("piece", "p")).select("session_id", "chunk_id", "piece", F.round("p.start", 3).alias("start"), F.round("p.end", 3).alias("end"))


def speech_regions(flags: DataFrame, step: float = 0.03, bridge: float = 0.20, least: float = 0.30) -> DataFrame:
    """Regions of speech from frames (session_id, frame, is_speech): short gaps are bridged, short regions dropped."""
    w = Window.partitionBy("session_id").orderBy("frame")
    speech = flags.filter("is_speech").withColumn("gap", F.col("frame") - F.lag("frame").over(w) - 1)
    speech = speech.withColumn("island", F.sum(F.when(F.round(F.col("gap") * step, 6) > bridge, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = speech.groupBy("session_id", "island").agg(F.round(F.min("frame") * step, 6).alias("start"), F.round((F.max("frame") + 1) * step, 6).alias("end"))
    return runs.filter(F.round(F.col("end") - F.col("start"), 6) >= least).select("session_id", "start", "end")


def hop_windows(regions: DataFrame, size: float = 2.0, hop: float = 0.75, least: float = 0.9) -> DataFrame:
    """Overlapping windows inside each region, the last one cut at its end; rests under ``least`` are left out."""
    number = F.ceil((F.col("end") - F.col("start")) / hop).cast("int")
    w = regions.filter(F.round(F.col("end") - F.col("start"), 6) >= least).select("session_id", F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), number))).alias("n"))
    start = F.round(F.col("a") + F.col("n") * hop, 6)
    end = F.round(F.least(F.col("b"), start + size), 6)
    # Once a window reaches the region's end there is no further one.
    reached = (F.col("n") > 0) & (F.round(F.least(F.col("b"), F.col("a") + (F.col("n") - 1) * hop + size), 6) >= F.round(F.col("b") - 0.05, 6))
    return w.filter(~reached).select("session_id", F.col("a").alias("region"), "n", start.alias("start"), end.alias("end")).filter(F.round(F.col("end") - F.col("start"), 6) >= least)


def drop_late(windows: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Windows that begin after all before them in order of (start, end), by more than ``tolerance``."""
    w = Window.partitionBy("session_id").orderBy("start", "end", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("_latest", F.max("start").over(w)).filter(F.col("_latest").isNull() | (F.col("start") > F.col("_latest") + tolerance)).drop("_latest")


def concurrency(spans: DataFrame, key: str) -> DataFrame:
    """The most intervals (``key``, begin, finish) open at once, by key; one that ends as another begins isn't open any more."""
    steps = spans.select(key, F.col("begin").alias("at"), F.lit(1).alias("step")).unionByName(spans.select(key, F.col("finish").alias("at"), F.lit(-1).alias("step")))
    w = Window.partitionBy(key).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("step").over(w)).groupBy(key).agg(F.max("open").alias("peak"), F.count_if(F.col("step") == 1).alias("n"))


def runs(frames: DataFrame, order: str, value: str) -> DataFrame:
    """Run-length encoding of frames by session: first and last frame and value of each run; negative values break runs and go."""
    marked = islands(frames, [value], Window.partitionBy("session_id").orderBy(order))
    return marked.groupBy("session_id", "island", value).agg(F.min(order).cast("long").alias("first"), F.max(order).cast("long").alias("last")).filter(F.col(value) >= 0).drop("island")
