"""Queries over time intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmura.operators import intervals as op
from murmura.sources import adapters as src


def chunks(spark, sf_dir):
    return src.chunks(spark, sf_dir).withColumn("speaker", F.col("role_speaker"))


def label_intervals(spark, sf_dir):
    return op.label_intervals(chunks(spark, sf_dir), src.timeline(spark, sf_dir)).select("session_id", "chunk_id", F.col("hit").alias("speaker"))


def relabel_locf(spark, sf_dir):
    return op.relabel(chunks(spark, sf_dir), src.timeline(spark, sf_dir)).select("session_id", "chunk_id", "speaker")


def asof_speaker_fallback(spark, sf_dir):
    return op.speaker_before(chunks(spark, sf_dir))


def unsplit_chunks(spark, sf_dir):
    """Against a timeline that is late by another 0.6 s."""
    late = src.timeline(spark, sf_dir).withColumns({"start": F.round(F.col("start") + 0.6, 3), "end": F.round(F.col("end") + 0.6, 3)})
    return op.unsplit(chunks(spark, sf_dir), late).select("session_id", "chunk_id", "n_speakers", F.bround("seconds", 3).alias("seconds"))


def split_points(spark, sf_dir):
    cuts = op.split_points(chunks(spark, sf_dir), src.timeline(spark, sf_dir))
    return cuts.select("session_id", "chunk_id", F.posexplode("cuts").alias("n", "cut"))


def split_segments(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return op.segments(rows.select("session_id", "chunk_id", "start", "end"), op.split_points(rows, src.timeline(spark, sf_dir)))


def speech_regions(spark, sf_dir):
    return op.speech_regions(src.speech_flags(spark, sf_dir))


def hop_windows(spark, sf_dir):
    return op.hop_windows(op.speech_regions(src.speech_flags(spark, sf_dir)))


def late_window_drop(spark, sf_dir):
    shaken = src.windows(spark, sf_dir).withColumns({"start": F.col("start") - (F.col("window_id") % 3) * 0.75, "end": F.col("end") - (F.col("window_id") % 3) * 0.75})
    return op.drop_late(shaken).select("session_id", "window_id", "start")


def concurrent_sessions(spark, sf_dir):
    begin = F.unix_timestamp(F.col("started_at").cast("timestamp"))
    spans = src.sessions(spark, sf_dir).select("organization_id", begin.alias("begin"), (begin + F.ceil(F.col("minutes") * 60)).alias("finish"))
    return op.concurrency(spans, "organization_id")


def timeline_islands(spark, sf_dir):
    """Runs of equal return flags along each order: the interval machinery on the largest table."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = src.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.row_number().over(line).alias("n"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(-1).alias("value"))
    return op.runs(items, "n", "value")


_LABELS = """
ov AS (
  SELECT c.session_id, c.chunk_id, t.speaker, round(sum(least(c."end", t."end") - greatest(c.start, t.start)), 6) AS seconds, min(t.start) AS since
  FROM chunks c JOIN timeline t ON c.session_id = t.session_id AND t.start < c."end" AND c.start < t."end" GROUP BY ALL
), hit AS (
  SELECT session_id, chunk_id, arg_max(speaker, (seconds, -since)) AS hit FROM ov GROUP BY session_id, chunk_id
)"""

_CUTS = """
met AS (
  SELECT c.session_id, c.chunk_id, c.start, c."end" AS e, t.start AS cut, t.speaker, lag(t.speaker) OVER (PARTITION BY c.session_id, c.chunk_id ORDER BY t.start, t."end", t.speaker) AS before
  FROM chunks c JOIN timeline t ON c.session_id = t.session_id AND t.start < c."end" AND c.start < t."end"
), pts AS (
  SELECT session_id, chunk_id, list(cut ORDER BY cut) AS cuts FROM met WHERE before <> speaker AND cut > start + 0.35e0 AND cut < e - 0.35e0 GROUP BY session_id, chunk_id
), cut AS (
  SELECT session_id, chunk_id, list_reduce(list_transform(cuts, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[len(a)] >= 0.35e0 THEN list_concat(a, b) ELSE a END) AS cuts FROM pts
)"""

_REGIONS = """
sp AS (SELECT session_id, frame, frame - lag(frame) OVER (PARTITION BY session_id ORDER BY frame) - 1 AS gap FROM flags WHERE is_speech
), ir AS (SELECT *, sum(CASE WHEN round(gap * 0.03e0, 6) > 0.2e0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM sp
), ru AS (SELECT session_id, round(min(frame) * 0.03e0, 6) AS start, round((max(frame) + 1) * 0.03e0, 6) AS "end" FROM ir GROUP BY session_id, island
), regions AS (SELECT * FROM ru WHERE round("end" - start, 6) >= 0.3e0)"""

QUERIES = {f.__name__: f for f in (label_intervals, relabel_locf, asof_speaker_fallback, unsplit_chunks, split_points, split_segments, speech_regions, hop_windows, late_window_drop, concurrent_sessions, timeline_islands)}

SQL = {
    "label_intervals": src.with_sql("chunks timeline", f"WITH {_LABELS.strip()} SELECT c.session_id, c.chunk_id, hit AS speaker FROM chunks c LEFT JOIN hit USING (session_id, chunk_id)"),
    "relabel_locf": src.with_sql("chunks timeline", f"""WITH {_LABELS.strip()}
SELECT c.session_id, c.chunk_id, coalesce(hit, last_value(hit IGNORE NULLS) OVER (PARTITION BY session_id, recording ORDER BY start, chunk_id ROWS UNBOUNDED PRECEDING), role_speaker)::INT AS speaker
FROM chunks c LEFT JOIN hit USING (session_id, chunk_id)"""),
    "asof_speaker_fallback": src.with_sql("chunks", """SELECT c.session_id, c.chunk_id, coalesce(arg_max(p.role_speaker, p.chunk_id), 0)::INT AS speaker
FROM chunks c LEFT JOIN chunks p ON p.session_id = c.session_id AND p.role_speaker IS NOT NULL AND p."end" <= c.start GROUP BY c.session_id, c.chunk_id"""),
    "unsplit_chunks": src.with_sql("chunks timeline", """SELECT c.session_id, c.chunk_id, count(DISTINCT t.speaker) AS n_speakers, round_even(any_value(c."end" - c.start), 3) AS seconds
FROM chunks c JOIN timeline t ON c.session_id = t.session_id AND round(t.start + 0.6e0, 3) < c."end" - 0.35e0 AND c.start + 0.35e0 < round(t."end" + 0.6e0, 3)
WHERE trim(c.text) <> '' GROUP BY c.session_id, c.chunk_id HAVING count(DISTINCT t.speaker) > 1"""),
    "split_points": src.with_sql("chunks timeline", f"WITH {_CUTS.strip()} SELECT session_id, chunk_id, (generate_subscripts(cuts, 1) - 1)::INT AS n, unnest(cuts) AS cut FROM cut"),
    "split_segments": src.with_sql("chunks timeline", f"""WITH {_CUTS.strip()}, b AS (
  SELECT c.session_id, c.chunk_id, c.start, c."end" AS e, list_concat(list_concat([c.start], coalesce(cuts, [])), [c."end"]) AS bounds FROM chunks c LEFT JOIN cut USING (session_id, chunk_id)
), p AS (
  SELECT *, list_filter(list_transform(range(1, len(bounds)), lambda i: [greatest(start, bounds[i] - 0.1e0), least(e, bounds[i + 1] + 0.15e0)]), lambda x: x[2] - x[1] >= 0.3e0) AS kept FROM b
), q AS (SELECT session_id, chunk_id, CASE WHEN len(kept) > 0 THEN kept ELSE [[start, e]] END AS kept FROM p
), u AS (SELECT session_id, chunk_id, (generate_subscripts(kept, 1) - 1)::INT AS piece, unnest(kept) AS k FROM q)
SELECT session_id, chunk_id, piece, round(k[1], 3) AS start, round(k[2], 3) AS "end" FROM u"""),
    "speech_regions": src.with_sql("flags", f'WITH {_REGIONS.strip()} SELECT session_id, start, "end" FROM regions'),
    "hop_windows": src.with_sql("flags", f"""WITH {_REGIONS.strip()}, w AS (
  SELECT session_id, start AS a, "end" AS b, unnest(range(0, ceil(("end" - start) / 0.75e0)::INT + 1)) AS n FROM regions WHERE round("end" - start, 6) >= 0.9e0
), x AS (
  SELECT session_id, a AS region, n::INT AS n, round(a + n * 0.75e0, 6) AS start, round(least(b, round(a + n * 0.75e0, 6) + 2e0), 6) AS "end",
         n > 0 AND round(least(b, a + (n - 1) * 0.75e0 + 2e0), 6) >= round(b - 0.05e0, 6) AS reached FROM w
)
SELECT session_id, region, n, start, "end" FROM x WHERE NOT reached AND round("end" - start, 6) >= 0.9e0"""),
    "late_window_drop": src.with_sql("windows", """WITH s AS (SELECT session_id, window_id, start - (window_id % 3) * 0.75e0 AS start, "end" - (window_id % 3) * 0.75e0 AS e FROM windows),
m AS (SELECT *, max(start) OVER (PARTITION BY session_id ORDER BY start, e, window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM s)
SELECT session_id, window_id, start FROM m WHERE latest IS NULL OR start > latest + 0.001e0"""),
    "concurrent_sessions": src.with_sql("sessions", """WITH b AS (SELECT organization_id, epoch(started_at)::BIGINT AS s, epoch(started_at)::BIGINT + ceil(minutes * 60)::BIGINT AS f FROM sessions),
e AS (SELECT organization_id, s AS moment, 1 AS step FROM b UNION ALL SELECT organization_id, f, -1 FROM b),
o AS (SELECT *, sum(step) OVER (PARTITION BY organization_id ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS open FROM e)
SELECT organization_id, max(open)::BIGINT AS peak, count(*) FILTER (WHERE step = 1) AS n FROM o GROUP BY organization_id"""),
    "timeline_islands": """
WITH f AS (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS value FROM lineitem),
b AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY session_id ORDER BY n) THEN 0 ELSE 1 END AS brk FROM f),
i AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT session_id, value, min(n) AS first, max(n) AS last FROM i WHERE value >= 0 GROUP BY session_id, island, value""",
}
