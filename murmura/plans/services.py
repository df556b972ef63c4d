"""Queries over scores, tenants and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmura.functions import text as T
from murmura.operators import scoring, telemetry, tenancy
from murmura.session import ship
from murmura.sources import adapters as src


# --- scoring --------------------------------------------------------------------------


def frame_contingency(spark, sf_dir):
    return scoring.contingency(src.truth(spark, sf_dir), src.timeline(spark, sf_dir))


def der_score(spark, sf_dir):
    return scoring.error_rate(src.truth(spark, sf_dir), src.timeline(spark, sf_dir))


def reconcile_counts(spark, sf_dir):
    def counted(df, name, confidence):
        return df.groupBy("session_id").agg(F.countDistinct("speaker").alias("speakers")).select("session_id", F.lit(name).alias("candidate"), "speakers", F.lit(confidence).alias("confidence"))

    return scoring.reconcile(counted(src.truth(spark, sf_dir), "truth", 0.9).unionByName(counted(src.timeline(spark, sf_dir), "timeline", 0.6)))


# --- tenancy --------------------------------------------------------------------------


def users(spark, sf_dir):
    return src.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("organization_id"), F.concat(F.lit(" User"), F.col("c_custkey") % 40, F.lit("@Example.org ")).alias("email"), "c_acctbal")


def organizations(spark, sf_dir):
    plan = F.when(F.col("n_nationkey") % 4 == 0, "business").when(F.col("n_nationkey") % 4 == 1, "enterprise").when(F.col("n_nationkey") % 4 == 2, "starter").otherwise("legacy")
    status = F.when(F.col("n_nationkey") % 5 == 0, "suspended").when(F.col("n_nationkey") % 5 == 1, "trial").otherwise("active")
    return src.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organization_id"), F.col("n_name").alias("name"), plan.alias("plan"), status.alias("status"))


def scoped_lookup(spark, sf_dir):
    """User 42 as seen from each organisation: one of them gets a row."""
    scope = organizations(spark, sf_dir).select("organization_id")
    return users(spark, sf_dir).filter("user_id = 42").join(scope, "organization_id", "left_semi").select("user_id", "organization_id", tenancy.normal_email(F.col("email")).alias("email"))


def email_collisions(spark, sf_dir):
    return tenancy.email_collisions(users(spark, sf_dir))


def orphan_users(spark, sf_dir):
    """Users whose organisation isn't active or on trial any more."""
    live = organizations(spark, sf_dir).filter("status IN ('active', 'trial')").select("organization_id")
    return users(spark, sf_dir).join(live, "organization_id", "left_anti").select("user_id", "organization_id")


def plan_limits(spark, sf_dir):
    return tenancy.with_plan(organizations(spark, sf_dir), tenancy.plan_table(spark)).select("organization_id", "plan", "max_sessions", "monthly_minutes")


def admission_decisions(spark, sf_dir):
    """Each active session asks again while those of its organisation before it are live."""
    w = Window.partitionBy("organization_id").orderBy("started_at", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    asks = src.sessions(spark, sf_dir).filter("status <> 'completed'").select("session_id", "organization_id", F.count("*").over(w).alias("live"), (F.col("session_id") % 160).alias("platform_live"))
    asks = asks.withColumn("organization_id", F.when(F.col("session_id") % 11 == 0, 99).otherwise(F.col("organization_id")))
    limits = tenancy.with_plan(organizations(spark, sf_dir), tenancy.plan_table(spark))
    return tenancy.admissions(asks, limits, 150).select("session_id", "decision", "retry_after")


def monthly_minutes(spark, sf_dir):
    return tenancy.monthly_minutes(src.sessions(spark, sf_dir))


def upsert_users(spark, sf_dir):
    old = users(spark, sf_dir).filter("user_id % 3 <> 0")
    new = users(spark, sf_dir).filter("user_id % 2 = 0").withColumn("email", F.concat(F.lit("new"), F.col("user_id"), F.lit("@example.org"))).withColumn("c_acctbal", F.lit(0.0))
    return tenancy.upsert(old, new, "user_id", ["c_acctbal"])


def rejected_writes(spark, sf_dir):
    new = users(spark, sf_dir).filter("user_id % 7 = 0").withColumn("organization_id", F.col("organization_id") + F.when(F.col("user_id") % 14 == 0, 20).otherwise(0))
    return tenancy.rejected_writes(new, users(spark, sf_dir).filter("user_id % 7 <> 0"), organizations(spark, sf_dir))


def login_limiter(spark, sf_dir):
    ship(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    attempts = src.read(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("key"), at.alias("at"), F.col("event_id").alias("attempt_id"))
    return tenancy.limit_logins(attempts, most=3, seconds=3600.0).groupBy("key").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


# --- telemetry ------------------------------------------------------------------------

KINDS = ["click", "view", "purchase"]
EDGES = [0, 1, 2, 3, 5, 7, 99]
PATTERNS = [("slow", r"value=\d{3,}\."), ("purchase", "type=purchase"), ("user", r"user=\d0\b"), ("click", "type=click")]


def events(spark, sf_dir):
    return src.read(spark, sf_dir, "events")


def event_counters(spark, sf_dir):
    return telemetry.counters(events(spark, sf_dir), "user_id", "event_type", KINDS)


def latency_percentiles(spark, sf_dir):
    return telemetry.latest_percentiles(events(spark, sf_dir), "event_type", "value", ["ts", "event_id"])


def heartbeats(spark, sf_dir):
    return telemetry.heartbeats(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "1 day").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


def user_sessions(spark, sf_dir):
    df = telemetry.user_sessions(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "6 hours")
    return df.select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


def trajectory_flips(spark, sf_dir):
    return telemetry.flips(events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"])


def duration_histogram(spark, sf_dir):
    seconds = (F.col("end") - F.col("start")) / 4
    rows = src.chunks(spark, sf_dir).select(telemetry.bucket(seconds, EDGES).alias("bucket"))
    return rows.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def never_completed(spark, sf_dir):
    """Orders without a delivered line."""
    done = src.read(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return src.read(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def log_line_parse(spark, sf_dir):
    line = F.concat(F.lit("user="), F.col("user_id"), F.lit(" type="), F.col("event_type"), F.lit(" value="), F.format_string("%.2f", "value"))
    rows = events(spark, sf_dir).select("event_id", line.alias("line"))
    return rows.select("event_id", telemetry.first_match(F.col("line"), PATTERNS).alias("kind"), F.regexp_extract("line", r"user=(\d+)", 1).cast("long").alias("user_id"))


def word_frequencies(spark, sf_dir):
    """The twenty most frequent tokens by language (a top-k report)."""
    words = src.read(spark, sf_dir, "documents").select("lang", F.explode(T.tokens(F.lower("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "token"))
    return words.withColumn("rank", rank).filter("rank <= 20")


QUERIES = {
    f.__name__: f
    for f in (
        frame_contingency, der_score, reconcile_counts, scoped_lookup, email_collisions, orphan_users, plan_limits, admission_decisions, monthly_minutes, upsert_users,
        rejected_writes, login_limiter, event_counters, latency_percentiles, heartbeats, user_sessions, trajectory_flips, duration_histogram, never_completed, log_line_parse, word_frequencies,
    )
}

_USERS = "u AS (SELECT c_custkey AS user_id, c_nationkey AS organization_id, ' User' || (c_custkey % 40) || '@Example.org ' AS email, c_acctbal FROM customer)"
_ORGS = """org AS (SELECT n_nationkey AS organization_id, CASE n_nationkey % 4 WHEN 0 THEN 'business' WHEN 1 THEN 'enterprise' WHEN 2 THEN 'starter' ELSE 'legacy' END AS plan0,
  CASE n_nationkey % 5 WHEN 0 THEN 'suspended' WHEN 1 THEN 'trial' ELSE 'active' END AS status FROM nation)"""
_PLANS = "plans(plan, max_sessions, monthly_minutes) AS (VALUES " + ", ".join(f"('{p}', {s}, {m})" for p, s, _, m, _ in tenancy.PLANS) + "), lim AS (SELECT org.*, p.* FROM org JOIN plans p ON p.plan = CASE WHEN plan0 IN (SELECT plan FROM plans) THEN plan0 ELSE 'starter' END)"
_FRAMES = """
rf AS (SELECT session_id, frame, arg_max(speaker, run_id) AS ref FROM (SELECT *, unnest(range(round_even(start / 0.01e0, 0)::BIGINT, round_even("end" / 0.01e0, 0)::BIGINT)) AS frame FROM truth) GROUP BY ALL),
hf AS (SELECT session_id, frame, arg_max(speaker, run_id) AS hyp FROM (SELECT *, unnest(range(round_even(start / 0.01e0, 0)::BIGINT, round_even("end" / 0.01e0, 0)::BIGINT)) AS frame FROM timeline) GROUP BY ALL),
ed AS (SELECT session_id, round_even(start / 0.01e0, 0)::BIGINT AS e FROM truth UNION SELECT session_id, round_even("end" / 0.01e0, 0)::BIGINT FROM truth),
col AS (SELECT DISTINCT session_id, unnest(range(e - 25, e + 26)) AS frame FROM ed),
fr AS (SELECT session_id, frame, ref, hyp FROM rf FULL JOIN hf USING (session_id, frame) ANTI JOIN col USING (session_id, frame)),
ct AS (SELECT session_id, ref, hyp, count(*) AS n FROM fr GROUP BY ALL)"""

SQL = {
    "frame_contingency": src.with_sql("chunks timeline truth", f"WITH {_FRAMES.strip()} SELECT * FROM ct"),
    "der_score": src.with_sql("chunks timeline truth", f"""WITH {_FRAMES.strip()}, s AS (
  SELECT session_id, sum(n) FILTER (WHERE ref IS NOT NULL AND hyp IS NOT NULL) AS both_, coalesce(sum(n) FILTER (WHERE hyp IS NULL), 0) AS mi, coalesce(sum(n) FILTER (WHERE ref IS NULL), 0) AS fa,
         greatest(coalesce(sum(n) FILTER (WHERE ref = hyp), 0), coalesce(sum(n) FILTER (WHERE ref = 1 - hyp), 0)) AS ok FROM ct GROUP BY session_id
), t AS (SELECT session_id, coalesce(both_, 0) AS bo, mi, fa, ok FROM s)
SELECT session_id, round_even(ok * 0.01e0, 2) AS correct, round_even((bo - ok) * 0.01e0, 2) AS confusion, round_even(mi * 0.01e0, 2) AS missed, round_even(fa * 0.01e0, 2) AS false_alarm,
       CASE WHEN bo + mi = 0 THEN 0e0 ELSE round_even((bo - ok + mi + fa) / (bo + mi), 6) END AS error_rate FROM t"""),
    "reconcile_counts": src.with_sql("chunks timeline truth", """WITH a AS (SELECT session_id, count(DISTINCT speaker) AS t FROM truth GROUP BY ALL), b AS (SELECT session_id, count(DISTINCT speaker) AS h FROM timeline GROUP BY ALL)
SELECT session_id, t AS anchor_speakers, (t <> h)::BIGINT AS n_disagree, t = h AS agreed FROM a JOIN b USING (session_id)"""),
    "scoped_lookup": f"WITH {_USERS} SELECT user_id, organization_id, lower(trim(email)) AS email FROM u WHERE user_id = 42 AND organization_id IN (SELECT n_nationkey FROM nation)",
    "email_collisions": f"WITH {_USERS} SELECT organization_id, lower(trim(email)) AS email, count(*) AS n_users, min(user_id) AS first_user FROM u GROUP BY ALL HAVING count(*) > 1",
    "orphan_users": f"WITH {_USERS}, {_ORGS} SELECT user_id, organization_id FROM u WHERE organization_id NOT IN (SELECT organization_id FROM org WHERE status IN ('active', 'trial'))",
    "plan_limits": f"WITH {_ORGS}, {_PLANS} SELECT organization_id, plan, max_sessions, monthly_minutes FROM lim",
    "admission_decisions": src.with_sql("sessions", f"""WITH {_ORGS}, {_PLANS}, a AS (
  SELECT session_id, organization_id, count(*) OVER (PARTITION BY organization_id ORDER BY started_at, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live, session_id % 160 AS pl FROM sessions WHERE status <> 'completed'
), r AS (SELECT session_id, CASE WHEN session_id % 11 = 0 THEN 99 ELSE organization_id END AS organization_id, live, pl FROM a
), d AS (SELECT session_id, CASE WHEN pl >= 150 THEN 'platform_full' WHEN status IS NULL THEN 'unknown_organization' WHEN status NOT IN ('active', 'trial') THEN 'organization_inactive' WHEN live >= max_sessions THEN 'quota_exceeded' ELSE 'accept' END AS decision
  FROM r LEFT JOIN lim USING (organization_id))
SELECT session_id, decision, CASE decision WHEN 'platform_full' THEN 15 WHEN 'quota_exceeded' THEN 30 END::INT AS retry_after FROM d"""),
    "monthly_minutes": src.with_sql("sessions", """SELECT organization_id, strftime(started_at, '%Y-%m') AS month, round_even(sum(minutes), 6) AS minutes, count(*) AS n_sessions, grouping_id(organization_id, strftime(started_at, '%Y-%m')) AS level
FROM sessions WHERE status = 'completed' GROUP BY ROLLUP (organization_id, strftime(started_at, '%Y-%m'))"""),
    "upsert_users": f"WITH {_USERS} SELECT user_id, organization_id, CASE WHEN user_id % 2 = 0 THEN 'new' || user_id || '@example.org' ELSE email END AS email, CASE WHEN user_id % 3 <> 0 THEN c_acctbal ELSE 0e0 END AS c_acctbal FROM u WHERE user_id % 3 <> 0 OR user_id % 2 = 0",
    "rejected_writes": f"""WITH {_USERS}, n AS (SELECT user_id, organization_id + CASE WHEN user_id % 14 = 0 THEN 20 ELSE 0 END AS organization_id, lower(trim(email)) AS email FROM u WHERE user_id % 7 = 0)
SELECT user_id, organization_id::INT AS organization_id, CASE WHEN organization_id NOT IN (SELECT n_nationkey FROM nation) THEN 'unknown organization' ELSE 'email in use' END AS reason FROM n
WHERE organization_id NOT IN (SELECT n_nationkey FROM nation) OR EXISTS (SELECT 1 FROM u WHERE u.user_id % 7 <> 0 AND u.organization_id = n.organization_id AND lower(trim(u.email)) = n.email)""",
    "event_counters": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in KINDS) + ", count(*) AS n FROM events GROUP BY user_id",
    "latency_percentiles": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), v AS (SELECT event_type, list(value ORDER BY value) AS v FROM r WHERE r <= 512 GROUP BY event_type)
SELECT event_type, len(v) AS n, """ + ", ".join(f"v[round_even({p / 100!r}::DOUBLE * (len(v) - 1), 0)::INT + 1] AS p{p}" for p in (50, 95, 99)) + " FROM v",
    "heartbeats": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS begin, count(*) AS n, round_even(sum(value), 6) AS value FROM events GROUP BY ALL",
    "user_sessions": """
WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOURS AS finish, count(*) AS n FROM s GROUP BY user_id, s""",
    "trajectory_flips": """
WITH f AS (SELECT *, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events)
SELECT user_id, count(*) FILTER (WHERE f) AS n_flips, min(event_type) AS least, max(event_type) AS most, arg_max(event_type, (ts, event_id)) AS final FROM f GROUP BY user_id""",
    "duration_histogram": src.with_sql("chunks", "WITH s AS (SELECT (\"end\" - start) / 4 AS s FROM chunks), b AS (SELECT CASE " + " ".join(f"WHEN s >= {a} AND s < {b} THEN '{a}-{b}'" for a, b in zip(EDGES, EDGES[1:], strict=False)) + " END AS bucket FROM s) SELECT bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY bucket"),
    "never_completed": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')",
    "log_line_parse": r"""
WITH l AS (SELECT event_id, user_id, 'user=' || user_id || ' type=' || event_type || ' value=' || printf('%.2f', value) AS line FROM events)
SELECT event_id, CASE """ + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in PATTERNS) + " END AS kind, user_id FROM l",
    "word_frequencies": r"""
WITH t AS (SELECT lang, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS token FROM documents), c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, token, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 20""",
}
