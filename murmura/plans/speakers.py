"""Queries that fold over a session or cluster it; SQL can't express most of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.operators import clustering, discovery, signal, vectors
from murmura.sources import adapters as src
from murmura.streaming import registry, segmenter, stitching


def vad_segments(spark, sf_dir):
    return segmenter.segments(src.speech_flags(spark, sf_dir))


def change_points(spark, sf_dir):
    return clustering.change_points(src.windows(spark, sf_dir)).select("session_id", F.bround("at", 3).alias("at"), F.bround("distance", 6).alias("distance"))


def cluster_speakers(spark, sf_dir):
    """All windows, however many: mixed ones demoted, clusters refined over all trusted windows, small ones remapped."""
    found = clustering.speakers(src.windows(spark, sf_dir))
    return found.select("session_id", "window_id", "cluster", F.bround("best", 6).alias("best"), F.bround("margin", 6).alias("margin"))


def speaker_timeline(spark, sf_dir):
    return clustering.speaker_timeline(src.windows(spark, sf_dir))


def stitch_identities(spark, sf_dir):
    w = src.windows(spark, sf_dir)
    blocks = w.select("session_id", F.floor(F.col("start") / 6).alias("block"), F.col("window_id").cast("int").alias("local_speaker"), F.lit(2.0).alias("seconds"), "embedding")
    return stitching.stitch(blocks)


def music_features(spark, sf_dir):
    """The measures of the bytes of whole texts as sound."""
    measured = signal.gate(signal.features(src.read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("pcm")), rate=1000))
    return measured.select("doc_id", "verdict", "confident", *(F.bround(c, 6).alias(c) for c in ("rms", "seconds", "low_energy", "syllables", "crossings", "flux", "music")))


def greedy_speakers(spark, sf_dir):
    return discovery.greedy(src.windows(spark, sf_dir))


def new_voices(spark, sf_dir):
    """Voices beside the first two labels; these embeddings have no voices, so ``far`` alone decides."""
    rows = src.windows(spark, sf_dir)
    known = vectors.centroids(rows.filter("label < 2"), "label").withColumnRenamed("label", "cluster")
    found = discovery.discover(rows, known, discovery.Discovery(far=0.97))
    return found.select("session_id", "windows", "path")


def speaker_registry(spark, sf_dir):
    """The passes of live sessions, eight windows each; the sound decides how many speakers there are."""
    rows = src.windows(spark, sf_dir).withColumn("pass", F.floor(F.col("start") / 6.0))
    found = registry.passes(rows)
    return found.select("session_id", "pass", "action", "established", "speakers", "voices", F.bround("silhouette", 6).alias("silhouette"), F.bround("closest", 6).alias("closest"), "near_miss")


def fixed_speakers(spark, sf_dir):
    """The same sessions with three speakers expected: what the last pass leaves."""
    rows = src.windows(spark, sf_dir).withColumn("pass", F.floor(F.col("start") / 6.0))
    found = registry.passes(rows, registry.Rules(expected=3))
    return found.groupBy("session_id").agg(F.max_by("speakers", "pass").alias("speakers"), F.max("pass").alias("last_pass"))


def fresh_windows(spark, sf_dir):
    """Windows as they come from passes that overlap: every fifth begins before the one in front of it."""
    rows = src.windows(spark, sf_dir).withColumn("start", F.when(F.col("window_id") % 50 >= 40, F.col("start") - 1.5).otherwise(F.col("start")))
    return discovery.fresh_windows(rows).select("session_id", "window_id")


def resampled(spark, sf_dir):
    samples = src.windows(spark, sf_dir).select("session_id", "window_id", F.col("embedding").alias("samples"))
    out = discovery.resample(samples, 48000, 16000)
    return out.select("session_id", "window_id", F.posexplode("samples").alias("i", "x")).select("session_id", "window_id", "i", F.bround("x", 6).alias("x"))


QUERIES = {f.__name__: f for f in (vad_segments, change_points, cluster_speakers, speaker_timeline, stitch_identities, music_features, greedy_speakers, new_voices, speaker_registry, fixed_speakers, fresh_windows, resampled)}
SQL: dict[str, str] = {
    "fixed_speakers": src.with_sql("windows", "SELECT session_id, least(3, count(*))::INT AS speakers, max(floor(start / 6e0))::BIGINT AS last_pass FROM windows GROUP BY session_id"),
    "fresh_windows": src.with_sql("windows", """WITH a AS (SELECT session_id, window_id, CASE WHEN window_id % 50 >= 40 THEN start - 1.5e0 ELSE start END AS start FROM windows),
b AS (SELECT *, max(start) OVER (PARTITION BY session_id ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM a)
SELECT session_id, window_id FROM b WHERE latest IS NULL OR start > latest + 0.001e0"""),
    "resampled": src.with_sql("windows", "SELECT session_id, window_id, i::INT AS i, round_even(embedding[3 * i + 1]::DOUBLE, 6) AS x FROM windows, range(21) AS r(i)"),
}
