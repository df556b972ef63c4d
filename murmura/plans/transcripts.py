"""Queries over transcripts."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import transcript as op
from murmura.sources import adapters as src


def chunk_language() -> Column:
    """``ext`` for chunks with one accented letter to thirty plain ones or more, else ``base``."""
    return F.when(T.letters(F.col("text"), T.OTHER) * 30 >= T.letters(F.col("text"), T.BASE), "ext").otherwise("base")


def chunks(spark, sf_dir):
    return src.chunks(spark, sf_dir).withColumn("speaker", F.col("pair_speaker")).withColumn("language", chunk_language())


SPOKEN = r"""
spoken AS (
  SELECT *, pair_speaker AS speaker,
         CASE WHEN len(regexp_extract_all(text, '[À-ÖØ-öø-ɏ]')) * 30 >= len(regexp_extract_all(text, '[A-Za-z]')) THEN 'ext' ELSE 'base' END AS language
  FROM chunks WHERE trim(text) <> ''
), marked AS (
  SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND lag(recording) OVER w IS NOT DISTINCT FROM recording AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS brk
  FROM spoken WINDOW w AS (PARTITION BY session_id ORDER BY start, chunk_id)
), isl AS (
  SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY start, chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM marked
)"""

PARAS = SPOKEN + r""", langs AS (
  SELECT session_id, island, string_agg(language, '+' ORDER BY s, c) AS language FROM (
    SELECT session_id, island, language, min(start) AS s, min(chunk_id) AS c FROM isl GROUP BY ALL) GROUP BY ALL
), paras AS (
  SELECT session_id, arg_min(chunk_id, (start, chunk_id)) AS paragraph_id, arg_max(seg_id, (start, chunk_id)) AS segment_id,
         round_even(min(start), 2) AS start, round_even(arg_max("end", (start, chunk_id)), 2) AS "end", 'Speaker ' || (speaker + 1) AS speaker, recording,
         string_agg(text, ' ' ORDER BY start, chunk_id) AS text, any_value(langs.language) AS language, count(*) AS n_chunks
  FROM isl JOIN langs USING (session_id, island) GROUP BY session_id, island, speaker, recording
)"""


def transcript_paragraphs(spark, sf_dir):
    return op.paragraphs(chunks(spark, sf_dir)).withColumn("recording", F.col("recording").cast("long"))


def transcript_export_lines(spark, sf_dir):
    return op.export_lines(op.paragraphs(chunks(spark, sf_dir)))


def paragraph_spans_rebased(spark, sf_dir):
    return op.rebased_spans(chunks(spark, sf_dir))


def transcript_diff_modes(spark, sf_dir):
    """Between the transcript without the last two chunks of each session and the whole."""
    rows = chunks(spark, sf_dir)
    last = F.max("chunk_id").over(Window.partitionBy("session_id"))
    early = rows.withColumn("last", last).filter("chunk_id <= last - (2 - session_id % 3)").drop("last")
    keep = ["session_id", "paragraph_id", "start", "end", "speaker", "text"]
    return op.diff_modes(op.paragraphs(early).select(*keep), op.paragraphs(rows).select(*keep))


def session_summary(spark, sf_dir):
    return op.session_summary(chunks(spark, sf_dir))


def recording_epochs(spark, sf_dir):
    """Each system turn begins a new recording."""
    w = Window.partitionBy("session_id").orderBy("start", "chunk_id")
    rows = op.epochs(chunks(spark, sf_dir), F.coalesce(F.col("role") == "system", F.lit(False)), w)
    return rows.groupBy("session_id", "epoch").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.bround(F.max("end") - F.min("start"), 3).alias("seconds"))


def repeat_guard(spark, sf_dir):
    return op.repeat_guard(chunks(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.col("repeated").cast("long")).alias("n_repeated"))


def rolling_context(spark, sf_dir):
    return op.rolling_context(chunks(spark, sf_dir), 2, 120).select("session_id", "chunk_id", "context")


def language_spans(spark, sf_dir):
    docs = src.read(spark, sf_dir, "documents").select("doc_id", "text")
    return op.language_spans(docs, token_language(), ["doc_id"], "base")


def token_language() -> Column:
    return F.when(F.col("token").rlike(T.OTHER), "ext").when(F.col("token").rlike(T.BASE), "base")


def code_switch_counts(spark, sf_dir):
    spans = language_spans(spark, sf_dir)
    return spans.groupBy("doc_id").agg(F.greatest(F.lit(0), F.count("*") - 1).cast("long").alias("n_switches"), F.array_join(F.array_sort(F.collect_set("language")), "+").alias("languages"))


SPANS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS token, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS n,
         unnest(regexp_extract_all(text, '\s*\S+')) AS padded FROM d
), o AS (
  SELECT doc_id, n, token, sum(length(padded)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e,
         CASE WHEN regexp_matches(token, '[À-ÖØ-öø-ɏ]') THEN 'ext' WHEN regexp_matches(token, '[A-Za-z]') THEN 'base' END AS own FROM t
), l AS (
  SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING),
                     first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'base') AS language FROM o
), b AS (
  SELECT *, CASE WHEN lag(language) OVER (PARTITION BY doc_id ORDER BY n) IS NOT DISTINCT FROM language THEN 0 ELSE 1 END AS brk FROM l
), s AS (
  SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS span FROM b
), spans AS (
  SELECT doc_id, span::INT AS span, language, min(e - length(token))::INT AS start_char, max(e)::INT AS end_char FROM s GROUP BY doc_id, span, language
)
"""

QUERIES = {f.__name__: f for f in (transcript_paragraphs, transcript_export_lines, paragraph_spans_rebased, transcript_diff_modes, session_summary, recording_epochs, repeat_guard, rolling_context, language_spans, code_switch_counts)}

SQL = {
    "transcript_paragraphs": src.with_sql("chunks", "WITH " + PARAS.strip() + " SELECT * FROM paras"),
    "transcript_export_lines": src.with_sql("chunks", "WITH " + PARAS.strip() + r"""
SELECT session_id, paragraph_id,
       printf('[%d:%02d – %d:%02d] ', floor(start)::INT // 60, floor(start)::INT % 60, floor("end")::INT // 60, floor("end")::INT % 60) || speaker || ' (' || language || E'):\n' || text AS line
FROM paras"""),
    "paragraph_spans_rebased": src.with_sql("chunks", r"WITH squeezed AS (SELECT * REPLACE (trim(regexp_replace(text, '\s+', ' ', 'g')) AS text) FROM chunks), " + SPOKEN.strip().replace("FROM chunks", "FROM squeezed") + r""",
o AS (
  SELECT *, sum(length(text) + 1) OVER (PARTITION BY session_id, island ORDER BY start, chunk_id ROWS UNBOUNDED PRECEDING) - length(text) - 1 AS shift,
         CASE WHEN lag(language) OVER (PARTITION BY session_id, island ORDER BY start, chunk_id) IS NOT DISTINCT FROM language THEN 0 ELSE 1 END AS nb FROM isl
), s AS (
  SELECT *, sum(nb) OVER (PARTITION BY session_id, island ORDER BY start, chunk_id ROWS UNBOUNDED PRECEDING) - 1 AS span FROM o
)
SELECT session_id, island::INT AS paragraph, span::INT AS span, language, min(shift)::INT AS start_char, max(shift + length(text))::INT AS end_char FROM s GROUP BY session_id, island, span, language"""),
    "transcript_diff_modes": src.with_sql("chunks", r"""WITH spoken AS (SELECT *, pair_speaker AS speaker, max(chunk_id) OVER (PARTITION BY session_id) AS last FROM chunks),
v AS (SELECT 1 AS new, * FROM spoken UNION ALL SELECT 0 AS new, * FROM spoken WHERE chunk_id <= last - (2 - session_id % 3)),
m AS (
  SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND lag(recording) OVER w IS NOT DISTINCT FROM recording AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS brk
  FROM v WHERE trim(text) <> '' WINDOW w AS (PARTITION BY new, session_id ORDER BY start, chunk_id)
), i AS (SELECT *, sum(brk) OVER (PARTITION BY new, session_id ORDER BY start, chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM m
), p AS (
  SELECT new, session_id, min(chunk_id) AS paragraph_id, min(start) AS start, max("end") AS e, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY start, chunk_id) AS text FROM i GROUP BY new, session_id, island
), a AS (SELECT * FROM p WHERE new = 0), b AS (SELECT * FROM p WHERE new = 1),
c AS (
  SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.paragraph_id, b.paragraph_id) AS paragraph_id, b.session_id IS NULL AS gone
  FROM a FULL JOIN b ON a.session_id = b.session_id AND a.paragraph_id = b.paragraph_id
  WHERE (a.start, a.e, a.speaker, a.text) IS DISTINCT FROM (b.start, b.e, b.speaker, b.text)
), l AS (SELECT session_id, arg_max(paragraph_id, (start, paragraph_id)) AS last_id FROM b GROUP BY session_id
), n AS (SELECT session_id, count(*) AS n, max(paragraph_id) AS one, bool_or(gone) AS gone FROM c GROUP BY session_id)
SELECT session_id, coalesce(n, 0) AS n_changed, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN n = 1 AND NOT gone AND one = last_id THEN 'append' ELSE 'refresh' END AS mode FROM l LEFT JOIN n USING (session_id)"""),
    "session_summary": src.with_sql("chunks", "WITH " + SPOKEN.strip() + r"""
SELECT session_id, count(DISTINCT speaker) AS n_speakers, count(*) AS n_segments,
       sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')))::BIGINT AS n_words,
       round_even(sum("end" - start), 3) AS total_seconds, string_agg(DISTINCT language, ',' ORDER BY language) AS languages
FROM spoken GROUP BY session_id"""),
    "recording_epochs": src.with_sql("chunks", """WITH e AS (
  SELECT *, (1 + sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start, chunk_id ROWS UNBOUNDED PRECEDING))::INT AS epoch FROM chunks)
SELECT session_id, epoch, count(*) AS n_chunks, min(chunk_id) AS first_chunk, round_even(max("end") - min(start), 3) AS seconds FROM e GROUP BY session_id, epoch"""),
    "repeat_guard": src.with_sql("chunks", """WITH c AS (SELECT session_id, chunk_id, start, text FROM chunks WHERE trim(text) <> ''),
r AS (SELECT *, coalesce(length(text) > 25 AND text = lag(text) OVER (PARTITION BY session_id ORDER BY start, chunk_id), false) AS repeated FROM c)
SELECT session_id, count(*) AS n, sum(repeated::INT)::BIGINT AS n_repeated FROM r GROUP BY session_id"""),
    "rolling_context": src.with_sql("chunks", """WITH c AS (SELECT *, lag(text, 1) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM chunks WHERE trim(text) <> '' WINDOW w AS (PARTITION BY session_id ORDER BY start, chunk_id))
SELECT session_id, chunk_id, right(CASE WHEN p2 IS NOT NULL THEN p2 || ' ' || p1 ELSE coalesce(p1, '') END, 120) AS context FROM c"""),
    "language_spans": SPANS_SQL + "SELECT * FROM spans",
    "code_switch_counts": SPANS_SQL + "SELECT doc_id, greatest(0, count(*) - 1)::BIGINT AS n_switches, string_agg(DISTINCT language, '+' ORDER BY language) AS languages FROM spans GROUP BY doc_id",
}
