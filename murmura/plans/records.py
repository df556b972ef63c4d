"""Queries over logs, reports, messages, settings and sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.operators import records as R
from murmura.operators import signal
from murmura.operators import scoring
from murmura.plans.operations import _RUNS, _pick, runs
from murmura.plans.services import SQL as SERVICES
from murmura.plans.services import events
from murmura.sources import adapters as src

# Fixed values of the queries: one line of each kind, and one of none; %d is the event's segment.
LINES = [
    "session_started (expected_speakers=0)", "segment %d: 1.5-4.25s (2.75s, silence) rms=812", "segment %d split into 2 turn(s) at 2.5 (1 cut(s) refused", "clusters: 12 trusted (x) -> 3 speaker(s) (silhouette=0.41, closest centroids=0.62)",
    "timeline: 40 window(s) -> %d speaker(s)", "asr_completed  [session_id=s1 segment_id=%d latency=3]", "ASR timeout after 30s, retry segment_id=%d", "ASR rate limited, waiting segment_id=%d",
    "segment backlog full (64) — dropped segment %d", "segment %d gated: rms=55", "rate guard: 9.1 words/s, dropping", "content guard: dropping loop of ok [segment_id=%d]",
    "dropped segment %d: lang=fr", "repeat guard: segment %d dropped", "ASR capacity reached — segment %d dropped", "session done: {'n': %d}", "nothing of note",
]


def log_lines(spark, sf_dir):
    """A log for each user: lines of all kinds, mostly of segments created and completed."""
    k = F.col("event_id")
    which = F.when(k % 3 == 0, 1).when(k % 3 == 1, 5).otherwise(F.floor(k / 3) % 17).cast("int")
    line = F.array(*map(F.lit, LINES))[which]
    return events(spark, sf_dir).select(F.col("user_id").alias("log_id"), k.alias("line_no"), F.replace(line, F.lit("%d"), (F.floor(k / 3) % 5).cast("string")).alias("line"))


def log_kinds(spark, sf_dir):
    parsed = R.parse_log(log_lines(spark, sf_dir))
    return parsed.select("log_id", "line_no", "kind", F.col("fields")["id"].cast("int").alias("segment"), F.col("fields")["k"].cast("int").alias("speakers"), F.col("fields")["detail"].alias("detail"))


def log_report(spark, sf_dir):
    return R.log_report(R.parse_log(log_lines(spark, sf_dir)))


def score_report(spark, sf_dir):
    return R.score_report(scoring.error_rate(src.truth(spark, sf_dir), src.timeline(spark, sf_dir))).select("session_id", "report")


def run_table(spark, sf_dir):
    return R.run_lines(runs(spark, sf_dir)).select("run_id", "line")


def pass_stats(spark, sf_dir):
    k = F.col("event_id")
    rows = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), k.alias("at"), (k % 17).alias("ms"), (k % 5).alias("windows"), (k % 4).alias("speakers"), (k / 8.0).alias("covered"), (k % 3).alias("hits"), (k % 2).alias("misses"))
    return R.pass_stats(rows)


def live_snapshot(spark, sf_dir):
    return R.snapshot(src.sessions(spark, sf_dir), 10_000)


def scenario_backends(spark, sf_dir):
    return R.scenarios_by_backend(src.read(spark, sf_dir, "customer").select("c_custkey"), ["auto", "embedding"])


def offline_candidates(spark, sf_dir):
    k = F.col("event_id")
    turns = F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1), k % 6 + 1))
    rows = events(spark, sf_dir).select(k.alias("session_id"), _pick(k, "a", "b", "c").alias("candidate"), F.when(k % 9 == 0, "failed").alias("error"), turns.alias("turns"))
    return R.gathered(rows)


def outbound_messages(spark, sf_dir):
    return R.outbound(src.chunks(spark, sf_dir), ["chunk_id"]).select("session_id", "chunk_id", "sent")


def client_view(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when(k % 40 == 0, "refresh").when(k % 7 == 0, "speakers").otherwise("transcript")
    return R.client_view(events(spark, sf_dir).select(F.col("user_id").alias("session_id"), k.alias("seq"), kind.alias("type"), F.when(k % 7 != 0, k % 23).alias("paragraph_id"), F.concat(F.lit("t"), k).alias("text")))


def close_codes(spark, sf_dir):
    decision = _pick(F.col("event_id"), "accept", "platform_full", "unknown_organization", "organization_inactive", "quota_exceeded")
    return events(spark, sf_dir).select("event_id", R.close_code(decision).alias("code"))


def fenced_answers(spark, sf_dir):
    k = F.col("event_id")
    body = F.concat(F.lit('{"text":"w'), k, F.lit('","n":'), k % 10, F.lit("}"))
    text = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("```"), body, F.lit("```"))).when(k % 4 == 2, body).otherwise("no json")
    got = R.fenced_json(text, "text string, n int")
    return events(spark, sf_dir).select("event_id", got["text"].alias("text"), got["n"].alias("n"))


def covered_segments(spark, sf_dir):
    return R.covered(src.chunks(spark, sf_dir), src.timeline(spark, sf_dir).filter("run_id % 5 <> 0")).select("session_id", "chunk_id", "covered")


def finished_labels(spark, sf_dir):
    final = src.timeline(spark, sf_dir).filter("run_id % 4 <> 0").select("session_id", F.col("run_id").alias("chunk_id"), "speaker")
    return R.finished(src.chunks(spark, sf_dir).select("session_id", "chunk_id", F.col("role_speaker").alias("speaker")), final, ["session_id", "chunk_id"], "speaker")


def windows_concatenated(spark, sf_dir):
    rows = src.windows(spark, sf_dir).select("session_id", "window_id")
    return R.concatenated(rows.filter("window_id % 3 = 0"), rows.filter("window_id % 3 = 1").select("window_id", "session_id"), rows.filter("window_id % 3 = 2"))


def band_in_force(spark, sf_dir):
    k = F.col("event_id")
    return events(spark, sf_dir).select("event_id", R.in_force(k % 3 != 0, F.when(k % 2 == 0, (k % 50) / 100.0), F.lit(0.5)).alias("same_max"))


def settings(spark, sf_dir):
    k = F.col("c_custkey")
    return R.settings(src.read(spark, sf_dir, "customer").select(k.cast("string").alias("name"), F.when(k % 3 == 0, F.concat(F.lit(" e"), k)).when(k % 3 == 1, " ").alias("environment"), F.when(k % 2 == 0, F.concat(F.lit("p"), k)).alias("profile"), F.lit("b").alias("base")))


def sign_in_candidates(spark, sf_dir):
    k = F.col("c_custkey")
    return R.sign_in_candidates(src.read(spark, sf_dir, "customer").select((k % 97).alias("email"), k.alias("user_id"), (k * 37 % 101).alias("created_at")))


def founded_organizations(spark, sf_dir):
    """Suppliers in threes: the first and the second own the first's organisation, the third its own, the second's has no owner."""
    supplier, k = src.read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    owners = supplier.select((k - (k % 3 == 2).cast("int")).alias("organization_id"), k.alias("user_id"))
    return R.founded(supplier.select(k.alias("organization_id"), F.col("s_name").alias("name")), owners)


def pcm(spark, sf_dir):
    """The bytes of whole texts as sound."""
    return src.read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("pcm"))


def pcm_samples(spark, sf_dir):
    # Once for each piece of sound, before its samples become rows.
    each = R.with_samples(pcm(spark, sf_dir), "pcm", "samples").select("doc_id", R.pcm_seconds(F.col("pcm"), 8000).alias("seconds"), R.content_key(F.col("pcm")).alias("key"), "samples")
    rows = each.select("doc_id", "seconds", "key", F.explode_outer("samples").alias("x"))
    return rows.groupBy("doc_id", "seconds", "key").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.sum(R.to_pcm(F.col("x"))).alias("back"))


def sound_levels(spark, sf_dir):
    """Energy and length of the same sound; music is let through."""
    found = signal.gate(signal.features(pcm(spark, sf_dir), rate=1000), least_rms=24_000.0, mode="off")
    return found.select("doc_id", F.bround("rms", 3).alias("rms"), "seconds", "confident", "verdict")


def length_batches(spark, sf_dir):
    """Batches of 64 documents of like length as windows; equal texts are one."""
    rows = src.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "n_chars")
    found = R.length_batches(rows, "key", "n_chars", 500, 20)
    return found.groupBy("bucket", "batch").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("batches"), F.sum("n").alias("windows"), F.max("n").alias("largest"))


QUERIES = {
    f.__name__: f
    for f in (
        log_kinds, log_report, score_report, run_table, pass_stats, live_snapshot, scenario_backends, offline_candidates, outbound_messages, client_view, close_codes, fenced_answers, covered_segments,
        finished_labels, windows_concatenated, band_in_force, settings, sign_in_candidates, founded_organizations, pcm_samples, sound_levels, length_batches,
    )
}

_LIST = ", ".join("'" + x.replace("'", "''") + "'" for x in LINES)
_PARSED = f"""l AS (
  SELECT user_id AS log_id, event_id AS line_no, event_id // 3 % 5 AS seg, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE event_id // 3 % 17 END AS w, replace(([{_LIST}])[CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE event_id // 3 % 17 END + 1], '%d', (event_id // 3 % 5)::VARCHAR) AS line FROM events
), p AS (SELECT *, CASE """ + " ".join(f"WHEN regexp_matches(line, '{x}') THEN '{n}'" for n, _, x in R.LOG_KINDS) + " END AS kind FROM l)"
_DER = SERVICES["der_score"]
#: b(doc_id, text) and x(doc_id, x), the samples of the texts' bytes.
_SAMPLES = """b AS (SELECT doc_id, text FROM documents), h AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS c FROM b),
u AS (SELECT doc_id, unnest(list_transform(range(0, len(c) // 2), lambda i: ('0x' || c[2 * i + 2] || c[2 * i + 1])::INT)) AS u FROM h), x AS (SELECT doc_id, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS x FROM u)"""

SQL = {
    "log_kinds": f"""WITH {_PARSED} SELECT log_id, line_no, kind, CASE WHEN kind IN ('segment', 'split', 'completed', 'timeout', 'ratelimit', 'backlog', 'gated', 'langdrop', 'repeat', 'queuefull') THEN seg END::INT AS segment,
  CASE kind WHEN 'clusters' THEN 3 WHEN 'timeline' THEN seg END::INT AS speakers, CASE kind WHEN 'rateguard' THEN '9.1 words/s' WHEN 'contentguard' THEN 'loop of ok' END AS detail FROM p WHERE kind IS NOT NULL""",
    "log_report": f"""WITH {_PARSED}, f AS (SELECT *, CASE WHEN kind = 'timeline' THEN seg <> lag(seg) OVER (PARTITION BY log_id, kind ORDER BY line_no) END AS flip FROM p WHERE kind IS NOT NULL),
u AS (SELECT log_id, count(*) AS unfinished FROM (SELECT log_id, seg FROM p WHERE kind = 'segment' EXCEPT SELECT log_id, seg FROM p WHERE kind = 'completed') GROUP BY log_id)
SELECT log_id, CASE WHEN bool_or(kind = 'session') THEN '0' END AS ceiling, arg_max(seg, line_no) FILTER (WHERE kind = 'timeline')::INT AS final_speakers, min(seg) FILTER (WHERE kind = 'timeline')::INT AS fewest, max(seg) FILTER (WHERE kind = 'timeline')::INT AS most,
  count(*) FILTER (WHERE flip) AS flips, (count(DISTINCT seg) FILTER (WHERE kind = 'segment'))::INT AS created, count(*) FILTER (WHERE kind = 'completed') AS completions, coalesce(any_value(unfinished), 0)::INT AS unfinished,
  2 * count(DISTINCT seg) FILTER (WHERE kind = 'split') AS pieces, count(DISTINCT seg) FILTER (WHERE kind = 'split') AS refused, count(*) FILTER (WHERE kind IN ({', '.join(f"'{k}'" for k in R.LOSSY)})) AS losses, count(*) FILTER (WHERE kind IN ('timeout', 'ratelimit')) AS delays,
  CASE WHEN NOT bool_or(kind = 'session') THEN 2 WHEN coalesce(any_value(unfinished), 0) > 0 OR bool_or(kind IN ({', '.join(f"'{k}'" for k in R.LOSSY)})) THEN 1 ELSE 0 END::INT AS status
FROM f LEFT JOIN u USING (log_id) GROUP BY log_id""",
    "score_report": f"""WITH d AS ({_DER}), s AS (SELECT *, correct + confusion + missed AS sp FROM d)
SELECT session_id, printf('scored      %9.2fs', sp) || chr(10) || """ + " || chr(10) || ".join(f"printf('{n:<12}%9.2fs  %6.1f%%', {c}, CASE WHEN sp > 0 THEN {c} * 100 / sp ELSE 0e0 END)" for n, c in (("correct", "correct"), ("confusion", "confusion"), ("missed", "missed"), ("false alarm", "false_alarm"))) + " || chr(10) || printf('error rate  %9.1f%%', error_rate * 100) AS report FROM s",
    "run_table": f"""WITH {_RUNS} SELECT run_id, CASE WHEN status IN ('missing', 'error') THEN rpad(run_id::VARCHAR, 12, ' ') || ' ' || upper(status)
  ELSE rpad(run_id::VARCHAR, 12, ' ') || lpad(true_speakers::VARCHAR, 4, ' ') || lpad(speakers::VARCHAR, 4, ' ') || lpad(coalesce(printf('%.1f%%', error_rate * 100), '-'), 9, ' ') END AS line FROM runs""",
    "pass_stats": """SELECT user_id AS session_id, count(*) AS passes, sum(event_id % 5)::BIGINT AS windows, arg_max(event_id % 4, event_id) AS speakers, round_even(avg(event_id % 17), 1) AS average_ms, round_even(max(event_id / 8e0), 2) AS covered_until,
  sum(event_id % 3) || '/' || (sum(event_id % 3) + sum(event_id % 2)) AS cache FROM events GROUP BY user_id""",
    "live_snapshot": src.with_sql("sessions", """WITH n AS (SELECT count(*) FILTER (WHERE status = 'active') AS live, count(DISTINCT organization_id) FILTER (WHERE status = 'active') AS organizations, count(*) FILTER (WHERE status = 'failed') AS failed FROM sessions)
SELECT *, CASE WHEN live >= 10000 THEN 'full' WHEN live >= 9000 THEN 'busy' ELSE 'ok' END AS state FROM n"""),
    "scenario_backends": "SELECT c_custkey, b AS backend FROM customer, (VALUES ('auto'), ('embedding')) AS x(b)",
    "offline_candidates": "SELECT event_id AS session_id, (['a', 'b', 'c'])[event_id % 3 + 1] AS candidate, (event_id % 6 + 1)::INT AS n_turns FROM events WHERE event_id % 9 <> 0 AND event_id % 4 <> 0",
    "outbound_messages": src.with_sql("chunks", "SELECT session_id, chunk_id, row_number() OVER (PARTITION BY session_id ORDER BY chunk_id)::INT AS sent FROM chunks"),
    "client_view": """WITH m AS (SELECT user_id AS session_id, event_id AS seq, event_id % 40 = 0 AS r, event_id % 23 AS p FROM events WHERE event_id % 40 = 0 OR event_id % 7 <> 0),
s AS (SELECT session_id, coalesce(max(seq) FILTER (WHERE r), -1) AS since FROM m GROUP BY session_id)
SELECT session_id, p AS paragraph_id, 't' || max(seq) AS text FROM m JOIN s USING (session_id) WHERE seq >= since AND seq % 7 <> 0 GROUP BY ALL""",
    "close_codes": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1013 WHEN 4 THEN 1013 ELSE 1008 END::INT AS code FROM events",
    "fenced_answers": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'w' || event_id END AS text, CASE WHEN event_id % 4 < 3 THEN event_id % 10 END::INT AS n FROM events",
    "covered_segments": src.with_sql("chunks timeline", """WITH u AS (SELECT session_id, max("end") AS u FROM timeline WHERE run_id % 5 <> 0 GROUP BY ALL) SELECT session_id, chunk_id, coalesce(u >= "end", false) AS covered FROM chunks LEFT JOIN u USING (session_id)"""),
    "finished_labels": src.with_sql("chunks timeline", """SELECT c.session_id, chunk_id, coalesce(t.speaker, role_speaker)::INT AS speaker, t.speaker IS NOT NULL AND t.speaker IS DISTINCT FROM role_speaker AS changed
FROM chunks c LEFT JOIN timeline t ON t.session_id = c.session_id AND t.run_id = chunk_id AND t.run_id % 4 <> 0"""),
    "windows_concatenated": src.with_sql("windows", "SELECT session_id, window_id FROM windows"),
    "band_in_force": "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN (event_id % 50) / 100e0 ELSE 0.5e0 END AS same_max FROM events",
    "settings": """SELECT c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 3 = 0 THEN 'e' || c_custkey WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey ELSE 'b' END AS value,
  CASE WHEN c_custkey % 3 = 0 THEN 'environment' WHEN c_custkey % 2 = 0 THEN 'profile' ELSE 'base' END AS origin FROM customer""",
    "sign_in_candidates": "SELECT c_custkey % 97 AS email, c_custkey AS user_id, c_custkey * 37 % 101 AS created_at, row_number() OVER (PARTITION BY c_custkey % 97 ORDER BY c_custkey * 37 % 101, c_custkey)::INT AS place FROM customer",
    "founded_organizations": "WITH o AS (SELECT s_suppkey - (s_suppkey % 3 = 2)::INT AS organization_id, min(s_suppkey) AS owner_id FROM supplier GROUP BY ALL HAVING count(*) = 1) SELECT s_suppkey AS organization_id, s_name AS name, owner_id FROM supplier JOIN o ON organization_id = s_suppkey",
    "pcm_samples": rf"""WITH {_SAMPLES}
SELECT b.doc_id, octet_length(encode(text)) / 2 / 8000e0 AS seconds, sha256(text) AS key, count(x) AS n, sum(x / 32768e0) AS total, sum(trunc(x / 32768e0 * CASE WHEN x < 0 THEN 32768 ELSE 32767 END)::INT)::BIGINT AS back FROM b LEFT JOIN x USING (doc_id) GROUP BY b.doc_id, text""",
    "sound_levels": rf"""WITH {_SAMPLES}, l AS (SELECT b.doc_id, coalesce(sqrt(avg(x::DOUBLE * x)), 0e0) AS rms, count(x) AS n FROM b LEFT JOIN x USING (doc_id) GROUP BY b.doc_id)
SELECT doc_id, round_even(rms, 3) AS rms, n / 1000e0 AS seconds, n >= 1500 AS confident, CASE WHEN rms < 24000 THEN 'quiet' ELSE 'keep' END AS verdict FROM l""",
    "length_batches": """WITH o AS (SELECT sha256(text) AS key, min(n_chars) AS n FROM documents WHERE n_chars >= 20 GROUP BY ALL), c AS (SELECT n // 500 AS bucket, count(*) AS windows FROM o GROUP BY ALL)
SELECT bucket, ceil(windows / 64)::BIGINT AS batches, windows, least(64, windows) AS largest FROM c""",
}
