"""Queries over a service's sessions, logs and scored runs: parameters, clocks, diffs, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.functions import service as S
from murmura.operators import reports, session, tenancy
from murmura.plans.services import _ORGS, _PLANS, _USERS, events, organizations, users
from murmura.sources import adapters as src

# --- parameters and predicates --------------------------------------------------------


def _pick(key, *values):
    """values[key % len(values)]"""
    out = F.when(F.lit(False), F.lit(values[0]))
    for k, v in enumerate(values):
        out = out.when(key % len(values) == k, F.lit(v))
    return out


def session_parameters(spark, sf_dir):
    k = F.col("c_custkey")
    asked = src.read(spark, sf_dir, "customer").select(k, _pick(k, "3", "-2", "abc", " 12 ", None).alias("speakers"), _pick(k, "fixed", "auto", "other").alias("mode"), _pick(k, "Sortformer", "auto", "x", None).alias("backend"))
    count = S.speaker_count(F.col("speakers"))
    return asked.select(k, count.alias("expected"), S.speaker_mode(F.col("mode"), count).alias("mode"), S.speaker_cap(count).alias("cap"), S.backend(F.col("backend")).alias("backend"))


def sign_in_decisions(spark, sf_dir):
    """A user of a closed organisation, or of none, is refused, then one that isn't active."""
    status = F.when(F.col("organization_id") % 6 == 5, "closed").otherwise(F.col("status"))
    known = organizations(spark, sf_dir).filter("organization_id <> 7").select("organization_id", status.alias("status"))
    mine = F.when(F.col("user_id") % 7 == 0, "disabled").otherwise("active")
    return users(spark, sf_dir).join(known, "organization_id", "left").select("user_id", S.may_sign_in(F.col("status"), mine).alias("decision"))


def window_predicates(spark, sf_dir):
    k = F.col("window_id")
    margin, best, seconds = (k % 10) / 10.0, (k % 7) / 10.0, F.when(k % 4 == 0, 0.5).otherwise(2.0)
    vector = S.embeddable(seconds, F.col("embedding"))
    return src.windows(spark, sf_dir).select("session_id", "window_id", S.is_clean(margin, best, 0.25, 0.45).alias("is_clean"), F.coalesce(F.size(vector), F.lit(0)).alias("dimensions"))


def meters(spark, sf_dir):
    k = F.col("event_id")
    error = _pick(k, "HTTP 429", "RESOURCE_EXHAUSTED: later", "other", None)
    return events(spark, sf_dir).select(
        "event_id", S.is_rate_limit(error).alias("rate_limited"), S.level((k % 1000) / 1e6).alias("level"), S.bar(k % 97, F.lit(96)).alias("bar"), S.percent((k % 201) / 200.0).alias("percent"),
        S.backoff(k % 6).alias("backoff"), S.cooldown(k % 7).alias("cooldown"), F.bround(S.real_time((k % 11).cast("double"), (k % 5).cast("double")), 6).alias("real_time"),
    )


def identifiers(spark, sf_dir):
    k = F.col("event_id")
    made = events(spark, sf_dir).select("event_id", S.make_id(F.lit("evt"), F.lit(1_700_000_000_000) + k * 1000, F.lower(F.hex(k))).alias("id"))
    return made.select("event_id", "id", *(c.alias(n) for n, c in S.id_parts(F.col("id")).items()))


TIMINGS = '[{"text":"a","start_offset":"0.10s","end_offset":"0.5"},{"text":"b","start_offset":"x","end_offset":"1.0s"},{"text":"c","start_offset":"1.25s","end_offset":"2"}]'


def word_timings(spark, sf_dir):
    turns = src.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(S.word_timings(F.lit(TIMINGS), F.col("turn") * 10.0)).alias("w"))
    return turns.select("conv_id", "turn", "w.text", F.bround("w.start", 3).alias("start"), F.bround("w.end", 3).alias("finish"))


# --- sessions -------------------------------------------------------------------------


def session_clocks(spark, sf_dir):
    return session.clocks(src.chunks(spark, sf_dir), ["chunk_id"]).select("session_id", "chunk_id", F.bround("fed", 3).alias("fed"), F.bround("covered", 3).alias("covered"))


def capped_sound(spark, sf_dir):
    limits = organizations(spark, sf_dir).filter("organization_id % 3 <> 2").select("organization_id", F.when(F.col("organization_id") % 3 == 0, 0.2101).otherwise(0.5003).alias("max_minutes"))
    rows = src.chunks(spark, sf_dir).withColumn("organization_id", (F.col("session_id") % 25).cast("int"))
    return session.within_cap(rows, limits, ["chunk_id"]).select("session_id", "chunk_id", F.bround("used", 3).alias("used"))


def rolling_context(spark, sf_dir):
    rows = src.chunks(spark, sf_dir).withColumn("text", F.when(F.col("chunk_id") % 5 != 2, F.col("text")))
    return session.rolling_context(rows, "text", ["chunk_id"], 2, 60).select("session_id", "chunk_id", "context")


def snapshot_diff(spark, sf_dir):
    rows = src.chunks(spark, sf_dir)
    old = rows.filter("chunk_id % 3 <> 0").withColumn("speaker", F.col("role_speaker"))
    new = rows.filter("chunk_id % 5 <> 0").withColumn("speaker", F.col("pair_speaker"))
    return session.snapshot_diff(old, new, ["session_id", "chunk_id"], ["speaker", "text"])


def unseen_windows(spark, sf_dir):
    rows = src.windows(spark, sf_dir)
    seen = rows.filter("window_id % 2 = 0").withColumns({"start": F.col("start") + 0.0003, "end": F.col("end") + 0.0003})
    return session.unseen(rows, seen).select("session_id", "window_id")


def trusted_windows(spark, sf_dir):
    rows = src.windows(spark, sf_dir).withColumn("end", F.col("start") + F.when(F.col("window_id") % 4 == 0, 1.0).otherwise(2.0))
    return session.trusted(rows, (F.col("session_id") % 2 == 0) & (F.col("label") % 3 != 0)).select("session_id", "window_id", "trusted")


def top_clusters(spark, sf_dir):
    sums = src.windows(spark, sf_dir).groupBy("session_id", F.col("label").alias("cluster")).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return session.largest(sums, 3)


def unexplained_sound(spark, sf_dir):
    rows = src.windows(spark, sf_dir).withColumn("best", (F.col("window_id") % 100) / 100.0)
    return session.unexplained(rows, "best", 0.6)


def held_back(spark, sf_dir):
    """The regions that a pass may hand on when 25 s are buffered and 10 s are closed."""
    return session.hold_back(src.chunks(spark, sf_dir), F.lit(25.003), F.lit(10.001)).select("session_id", "chunk_id")


def tumbling_buffers(spark, sf_dir):
    return session.tumbling_buffers(src.chunks(spark, sf_dir), ["chunk_id"], 7.0313).select("session_id", "chunk_id", "buffer")


def log_context(spark, sf_dir):
    own = F.when(F.col("event_id") % 4 == 0, F.col("user_id"))
    records = events(spark, sf_dir).select(F.col("event_id").alias("session_id"), "event_id", own.alias("user_id"), F.lit("someone@example.org").alias("email"))
    return session.with_context(records, src.sessions(spark, sf_dir), ["organization_id", "user_id"])


def seeded_users(spark, sf_dir):
    rows = users(spark, sf_dir).select("user_id", "organization_id")
    return tenancy.insert_absent(rows.filter("user_id % 2 = 0"), rows.filter("user_id % 3 = 0").withColumn("organization_id", F.lit(-1)), "user_id")


# --- reports --------------------------------------------------------------------------


def cluster_purity(spark, sf_dir):
    return reports.purity(src.windows(spark, sf_dir).withColumn("guess", F.col("window_id") % 3), "label", "guess")


def runs(spark, sf_dir):
    k = F.col("event_id")
    rows = events(spark, sf_dir).select(
        k.alias("run_id"), "event_type", (k % 10 != 0).alias("has_audio"), F.when(k % 13 == 0, "failed").alias("error"), F.when(k % 7 != 0, (k % 50) / 100.0).alias("error_rate"), (k % 3).alias("speakers"), (k % 4).alias("true_speakers")
    )
    return reports.run_status(rows)


def run_summary(spark, sf_dir):
    return reports.summary(runs(spark, sf_dir), "event_type", 0.45)


def problem_runs(spark, sf_dir):
    return reports.problem_runs(runs(spark, sf_dir)).select("run_id", "status", "problem")


def candidate_comparison(spark, sf_dir):
    k = F.col("event_id")
    rows = events(spark, sf_dir).select(F.floor(k / 3).alias("run_id"), _pick(k, "a", "b", "c").alias("candidate"), F.when(k % 11 != 0, (k * 37 % 101) / 100.0).alias("error_rate"))
    return reports.comparison(rows, ["a", "b", "c"])


def run_verdicts(spark, sf_dir):
    k = F.col("event_id")
    kind, note = reports.verdict((k % 40) / 100.0, (k * 7 % 60) / 100.0)
    return events(spark, sf_dir).select("event_id", kind.alias("verdict"), note.alias("gap_note"))


def lost_speech(spark, sf_dir):
    k = F.col("event_id")
    kind = F.when((k % 2 == 0) | (k % 7 == 0), "created").otherwise("finished")
    rows = events(spark, sf_dir).select((k % 400).cast("long").alias("session_id"), F.floor(k / 2).alias("segment_id"), kind.alias("kind"), F.when(k % 31 == 0, "repetition").alias("reason"))
    return reports.lost_speech(rows, ["repetition", "timeout"])


def stretched_sessions(spark, sf_dir):
    k = F.col("event_id")
    return reports.stretched(events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts", "event_id", (k % 10 / 10.0).alias("silhouette"), (k % 7 / 10.0).alias("closest")), ["ts", "event_id"])


def session_snapshot(spark, sf_dir):
    return reports.snapshot(src.chunks(spark, sf_dir).withColumn("speaker", F.col("role_speaker")))


def utilisation(spark, sf_dir):
    live = src.sessions(spark, sf_dir).filter("status = 'active'").groupBy("organization_id").agg(F.count("*").alias("live"))
    return reports.utilisation(live, tenancy.with_plan(organizations(spark, sf_dir), tenancy.plan_table(spark)), "organization_id")


def json_log_lines(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("reason", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return reports.json_lines(rows, ["event_id", "user_id", "reason"])


def band_blend(spark, sf_dir):
    k = F.col("event_id")
    return reports.band_blend(events(spark, sf_dir).select(F.col("user_id").alias("session_id"), k.alias("pass"), F.when(k % 3 != 0, (k % 50) / 100.0).alias("near"), F.when(k % 4 != 0, (k % 70) / 100.0).alias("far")))


def straddling_windows(spark, sf_dir):
    rows = src.windows(spark, sf_dir)
    marks = rows.filter("window_id % 7 = 0").select("session_id", (F.col("start") + 1.1).alias("at"))
    return reports.straddling(rows, marks).select("session_id", "window_id", "straddles")


QUERIES = {
    f.__name__: f
    for f in (
        session_parameters, sign_in_decisions, window_predicates, meters, identifiers, word_timings, session_clocks, capped_sound, rolling_context, snapshot_diff, unseen_windows, trusted_windows,
        top_clusters, unexplained_sound, held_back, tumbling_buffers, log_context, seeded_users, cluster_purity, run_summary, problem_runs, candidate_comparison, run_verdicts, lost_speech,
        stretched_sessions, session_snapshot, utilisation, json_log_lines, band_blend, straddling_windows,
    )
}

_BEFORE = "(PARTITION BY session_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UNTIL = "(PARTITION BY session_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_RUNS = """runs AS (
  SELECT event_id AS run_id, event_type, CASE WHEN event_id % 7 <> 0 THEN (event_id % 50) / 100e0 END AS error_rate, event_id % 3 AS speakers, event_id % 4 AS true_speakers,
         CASE WHEN event_id % 10 = 0 THEN 'missing' WHEN event_id % 13 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'counted' ELSE 'ok' END AS status FROM events)"""

SQL = {
    "session_parameters": """
WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 3 THEN 12 ELSE 0 END AS expected, CASE c_custkey % 3 WHEN 0 THEN 'fixed' ELSE 'auto' END AS m, c_custkey % 4 AS b FROM customer)
SELECT c_custkey, expected, CASE WHEN m = 'fixed' AND expected > 0 THEN 'fixed' ELSE 'auto' END AS mode, CASE WHEN expected = 3 THEN 3 ELSE 8 END AS cap, CASE b WHEN 0 THEN 'sortformer' WHEN 1 THEN 'auto' ELSE 'embedding' END AS backend FROM a""",
    "sign_in_decisions": f"""WITH {_USERS}, {_ORGS}
SELECT user_id, CASE WHEN u.organization_id = 7 OR u.organization_id % 6 = 5 THEN 'organization_closed' WHEN user_id % 7 = 0 THEN 'user_inactive' ELSE 'accept' END AS decision FROM u LEFT JOIN org USING (organization_id)""",
    "window_predicates": src.with_sql("windows", """
SELECT session_id, window_id, (window_id % 10) / 10e0 >= 0.25e0 AND (window_id % 7) / 10e0 <= 0.45e0 AS is_clean, CASE WHEN window_id % 4 = 0 THEN 0 ELSE len(embedding) END::INT AS dimensions FROM windows"""),
    "meters": """
SELECT event_id, event_id % 4 < 2 AS rate_limited, least(100, round_even(sqrt((event_id % 1000) / 1e6) * 260, 0))::INT AS level, repeat('█', round_even((event_id % 97) * 24 / 96e0, 0)::BIGINT) AS bar,
       round_even((event_id % 201) / 200e0 * 100, 0)::BIGINT || '%' AS percent, least(pow(2e0, event_id % 6), 8e0) AS backoff,
       CASE WHEN event_id % 7 > 0 THEN least(pow(2e0, event_id % 7 - 1) * 2, 30e0) ELSE 0e0 END AS cooldown, CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE round_even((event_id % 11)::DOUBLE / (event_id % 5), 6) END AS real_time FROM events""",
    "identifiers": """
WITH a AS (SELECT event_id, 1700000000000 + event_id * 1000 AS at_ms, lower(printf('%x', event_id)) AS random FROM events)
SELECT event_id, 'evt_' || at_ms || '_' || random AS id, 'evt' AS prefix, at_ms, random FROM a""",
    "word_timings": """
SELECT conv_id, turn, w.t AS text, round_even(w.a + turn * 10e0, 3) AS start, round_even(w.b + turn * 10e0, 3) AS finish FROM conversations, (VALUES ('a', 0.1e0, 0.5e0), ('c', 1.25e0, 2e0)) AS w(t, a, b)""",
    "session_clocks": src.with_sql("chunks", f"""
SELECT session_id, chunk_id, round_even(sum("end" - start) OVER {_UNTIL}, 3) AS fed, round_even(max("end") OVER {_UNTIL}, 3) AS covered FROM chunks"""),
    "capped_sound": src.with_sql("chunks", f"""WITH a AS (SELECT *, session_id % 25 AS o, coalesce(sum("end" - start) OVER {_BEFORE}, 0e0) AS used FROM chunks)
SELECT session_id, chunk_id, round_even(used, 3) AS used FROM a WHERE o % 3 = 2 OR used < 60 * CASE o % 3 WHEN 0 THEN 0.2101e0 ELSE 0.5003e0 END"""),
    "rolling_context": src.with_sql("chunks", r"""WITH a AS (SELECT session_id, chunk_id, text, chunk_id % 5 <> 2 AND trim(coalesce(text, '')) <> '' AS ok FROM chunks),
b AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY session_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM a)
SELECT x.session_id, x.chunk_id, right(coalesce(string_agg(y.text, ' ' ORDER BY y.chunk_id), ''), 60) AS context
FROM b x LEFT JOIN b y ON y.session_id = x.session_id AND y.ok AND y.n BETWEEN x.n - 2 AND x.n - 1 GROUP BY ALL"""),
    "snapshot_diff": src.with_sql("chunks", """SELECT session_id, chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'added' WHEN chunk_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM chunks
WHERE (chunk_id % 3 <> 0 OR chunk_id % 5 <> 0) AND (chunk_id % 3 = 0 OR chunk_id % 5 = 0 OR role_speaker IS DISTINCT FROM pair_speaker)"""),
    "unseen_windows": src.with_sql("windows", "SELECT session_id, window_id FROM windows WHERE window_id % 2 <> 0"),
    "trusted_windows": src.with_sql("windows", """WITH a AS (SELECT *, window_id % 4 <> 0 AS long, session_id % 2 = 0 AND label % 3 <> 0 AS pure FROM windows), b AS (SELECT *, count(*) FILTER (WHERE long AND pure) OVER (PARTITION BY session_id) AS n FROM a)
SELECT session_id, window_id, CASE WHEN n >= 2 THEN long AND pure ELSE long END AS trusted FROM b"""),
    "top_clusters": src.with_sql("windows", """WITH a AS (SELECT session_id, label AS cluster, sum("end" - start) AS seconds FROM windows GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, cluster)::INT AS rank FROM a) WHERE rank <= 3"""),
    "unexplained_sound": src.with_sql("windows", """WITH a AS (SELECT session_id, coalesce(sum("end" - start) FILTER (WHERE (window_id % 100) / 100e0 > 0.6e0), 0e0) AS unexplained, sum("end" - start) AS total FROM windows GROUP BY session_id)
SELECT *, unexplained >= 5 AND total >= 10 AS rederive FROM a"""),
    "held_back": src.with_sql("chunks", "SELECT session_id, chunk_id FROM chunks WHERE \"end\" - start >= 0.9e0 AND (\"end\" < 25.003e0 OR \"end\" <= 10.001e0)"),
    "tumbling_buffers": src.with_sql("chunks", f"SELECT session_id, chunk_id, floor(coalesce(sum(\"end\" - start) OVER {_BEFORE}, 0e0) / 7.0313e0)::BIGINT AS buffer FROM chunks"),
    "log_context": src.with_sql("sessions", """SELECT e.event_id AS session_id, e.event_id, s.organization_id, CASE WHEN e.event_id % 4 = 0 THEN e.user_id ELSE s.user_id END AS user_id FROM events e LEFT JOIN sessions s ON s.session_id = e.event_id"""),
    "seeded_users": f"WITH {_USERS} SELECT user_id, CASE WHEN user_id % 2 = 0 THEN organization_id ELSE -1 END::INT AS organization_id FROM u WHERE user_id % 2 = 0 OR user_id % 3 = 0",
    "cluster_purity": src.with_sql("windows", """WITH a AS (SELECT session_id, window_id % 3 AS g, label, count(*) AS n FROM windows GROUP BY ALL), b AS (SELECT session_id, g, max(n) AS best, sum(n) AS n FROM a GROUP BY ALL)
SELECT session_id, round_even(sum(best) / sum(n), 6) AS purity, count(*) AS clusters FROM b GROUP BY session_id"""),
    "run_summary": f"""WITH {_RUNS}
SELECT event_type, round_even(avg(error_rate) FILTER (WHERE status = 'ok'), 6) AS mean_error, count(*) FILTER (WHERE status IN ('ok', 'counted') AND speakers <> true_speakers) AS n_wrong,
       count(*) FILTER (WHERE status = 'missing') AS n_missing, coalesce(bool_or(status = 'ok' AND error_rate > 0.45e0), false) AS over_limit FROM runs GROUP BY event_type""",
    "problem_runs": f"WITH {_RUNS} SELECT run_id, status, CASE WHEN status IN ('missing', 'error') THEN status ELSE 'wrong_count' END AS problem FROM runs WHERE status IN ('missing', 'error') OR speakers <> true_speakers",
    "candidate_comparison": """
WITH r AS (SELECT event_id // 3 AS run_id, event_id % 3 AS c, CASE WHEN event_id % 11 <> 0 THEN (event_id * 37 % 101) / 100e0 END AS e FROM events),
p AS (SELECT run_id, min(e) FILTER (WHERE c = 0) AS a, min(e) FILTER (WHERE c = 1) AS b, min(e) FILTER (WHERE c = 2) AS c FROM r WHERE e IS NOT NULL GROUP BY run_id),
l AS (SELECT *, list_sort(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS v FROM p)
SELECT run_id, a, b, c, CASE v[1] WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END AS best, round_even(v[2] - v[1], 6) AS lead FROM l""",
    "run_verdicts": """
WITH a AS (SELECT event_id, (event_id % 40) / 100e0 AS f, (event_id * 7 % 60) / 100e0 AS l FROM events)
SELECT event_id, CASE WHEN f <= 0.2e0 AND l <= 0.2e0 THEN 'both_ok' WHEN f <= 0.2e0 THEN 'stitching' WHEN l > 0.2e0 THEN 'model' ELSE 'odd' END AS verdict, abs(f - l) >= 0.05e0 AS gap_note FROM a""",
    "lost_speech": """
WITH a AS (SELECT event_id % 400 AS session_id, event_id // 2 AS segment_id, event_id % 2 = 0 OR event_id % 7 = 0 AS c, event_id % 31 = 0 AS l FROM events),
s AS (SELECT session_id, segment_id, bool_or(c) AS c, bool_or(NOT c) AS f, bool_or(l) AS l FROM a GROUP BY ALL)
SELECT session_id, count(*) FILTER (WHERE c) AS created, count(*) FILTER (WHERE c AND NOT f) AS unfinished, bool_or(l OR (c AND NOT f)) AS lost FROM s GROUP BY session_id""",
    "stretched_sessions": """
SELECT user_id AS session_id, arg_max(event_id % 10 / 10e0, (ts, event_id)) < arg_min(event_id % 10 / 10e0, (ts, event_id)) * 0.7e0 AND arg_max(event_id % 7, (ts, event_id)) > arg_min(event_id % 7, (ts, event_id)) AS stretched FROM events GROUP BY user_id""",
    "session_snapshot": src.with_sql("chunks", """
SELECT session_id, count(*) AS chunks, count(DISTINCT recording) AS recordings, count(DISTINCT role_speaker) AS speakers, sum(length(coalesce(text, '')))::BIGINT AS chars, round_even(max("end") - min(start), 3) AS seconds FROM chunks GROUP BY session_id"""),
    "utilisation": src.with_sql("sessions", f"""WITH {_ORGS}, {_PLANS}, n AS (SELECT organization_id, count(*) AS live FROM sessions WHERE status = 'active' GROUP BY ALL)
SELECT organization_id, coalesce(live, 0) AS live, max_sessions, round_even(coalesce(live, 0) / max_sessions::DOUBLE, 3) AS utilisation FROM lim LEFT JOIN n USING (organization_id)"""),
    "json_log_lines": """
SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || CASE WHEN event_id % 3 <> 0 THEN ',"reason":"' || event_type || '"' ELSE '' END || '}' AS json,
       'event_id=' || event_id || ' user_id=' || user_id || CASE WHEN event_id % 3 <> 0 THEN ' reason=' || event_type ELSE '' END AS console FROM events""",
    "band_blend": """
WITH a AS (SELECT user_id AS session_id, list((event_id % 50) / 100e0 ORDER BY event_id) FILTER (WHERE event_id % 3 <> 0) AS n, list((event_id % 70) / 100e0 ORDER BY event_id) FILTER (WHERE event_id % 4 <> 0) AS f FROM events GROUP BY user_id)
SELECT session_id, round_even(list_reduce(n, lambda x, y: x * 0.75e0 + y * 0.25e0), 6) AS near, round_even(list_reduce(f, lambda x, y: x * 0.75e0 + y * 0.25e0), 6) AS far FROM a""",
    "straddling_windows": src.with_sql("windows", """WITH m AS (SELECT session_id, start + 1.1e0 AS at FROM windows WHERE window_id % 7 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM windows)
SELECT session_id, window_id, n >= 8 AND EXISTS (SELECT 1 FROM m WHERE m.session_id = n.session_id AND m.at > n.start + 0.4e0 AND m.at < n."end" - 0.4e0) AS straddles FROM n"""),
}
