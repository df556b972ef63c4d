"""Records of a service: parsed logs and their report, text reports, messages, sound as bytes, settings, batches by length."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import tenths
from murmura.session import ship

# --- logs -----------------------------------------------------------------------------

# The kinds of log lines in the order in which they are tried, the names of the groups, and the patterns.
LOG_KINDS = [
    ("session", "cap", r"session_started \(expected_speakers=(\w+)"),
    ("segment", "id a b dur reason rms", r"segment (\d+): ([\d.]+)-([\d.]+)s \(([\d.]+)s, (\w+)\) rms=(\d+)"),
    ("split", "id n at refused", r"segment (\d+) split into (\d+) turn\(s\) at (.+?) \((\d+) cut\(s\) refused"),
    ("clusters", "win k sil dmin", r"clusters: (\d+) trusted.*?-> (\d+) speaker\(s\) \(silhouette=([\d.-]+), closest centroids=([\d.]+)\)"),
    ("timeline", "win k", r"timeline: (\d+) window\(s\) -> (\d+) speaker"),
    ("completed", "id", r"asr_completed\s+\[session_id=\S+ segment_id=(\d+)"),
    ("timeout", "sec id", r"ASR timeout after (\d+)s.*segment_id=(\d+)"),
    ("ratelimit", "id", r"ASR rate limited.*segment_id=(\d+)"),
    ("backlog", "id", r"segment backlog full \(\d+\) — dropped segment (\d+)"),
    ("gated", "id rms", r"segment (\d+) gated: rms=(\d+)"),
    ("rateguard", "detail", r"rate guard: (.+?), dropping"),
    ("contentguard", "detail", r"content guard: dropping (.+?)\s*\["),
    ("langdrop", "id lang", r"dropped segment (\d+): lang=(\w+)"),
    ("repeat", "id", r"repeat guard: segment (\d+) dropped"),
    ("queuefull", "id", r"ASR capacity reached — segment (\d+) dropped"),
    ("done", "stats", r"session done: (\{.+\})"),
]
# The kinds that mean that speech is lost.
LOSSY = ["queuefull", "backlog", "gated", "langdrop", "repeat", "rateguard", "contentguard"]


def parse_log(lines: DataFrame) -> DataFrame:
    """Adds kind and fields (a map) to rows with ``line``: the first kind that matches counts, rows of none are left out."""
    line = F.coalesce("line", F.lit(""))
    kind, fields = F.when(F.lit(False), ""), F.when(F.lit(False), F.create_map().cast("map<string,string>"))
    for name, groups, pattern in LOG_KINDS:
        hit = line.rlike(pattern)
        parts = [x for k, g in enumerate(groups.split(), 1) for x in (F.lit(g), F.regexp_extract(line, pattern, k))]
        kind, fields = kind.when(hit, name), fields.when(hit, F.create_map(*parts))
    return lines.withColumns({"kind": kind, "fields": fields}).filter("kind IS NOT NULL")


def log_report(parsed: DataFrame) -> DataFrame:
    """One row a log (log_id, line_no, kind, fields): the ceiling, the course of the count, coverage, losses, and whether there is a problem.

    Segments count once by their number, of a segment that was split more than once the last line counts; of the counts over time the last is final,
    and a flip is a change from one to the next.
    """
    of = lambda k, f: F.when(F.col("kind") == k, F.col("fields")[f])
    w = Window.partitionBy("log_id", "kind").orderBy("line_no")
    df = parsed.withColumn("_k", of("timeline", "k").cast("int")).withColumn("_flip", F.col("_k") != F.lag("_k").over(w))
    # Numbers, so that "07" and "7" are one segment.
    segment = F.col("fields")["id"].cast("long")
    df = df.withColumn("_id", segment).withColumn("_newest", F.col("line_no") == F.max("line_no").over(Window.partitionBy("log_id", "kind", "_id")))
    split = lambda f: F.coalesce(F.sum(F.when(F.col("_newest"), of("split", f).cast("int"))), F.lit(0))
    at = F.when(F.col("_k").isNotNull(), F.col("line_no"))
    made, ended = (F.collect_set(F.when(F.col("kind") == k, F.col("_id"))) for k in ("segment", "completed"))
    out = df.groupBy("log_id").agg(
        F.max_by(of("session", "cap"), F.when(F.col("kind") == "session", F.col("line_no"))).alias("ceiling"),
        F.max_by("_k", at).alias("final_speakers"), F.min("_k").alias("fewest"), F.max("_k").alias("most"), F.count_if("_flip").alias("flips"),
        made.alias("made"), ended.alias("ended"), F.count(of("completed", "id")).alias("completions"),
        split("n").alias("pieces"), split("refused").alias("refused"),
        F.count_if(F.col("kind").isin(*LOSSY)).alias("losses"), F.count_if(F.col("kind").isin("timeout", "ratelimit")).alias("delays"),
    )
    hard = F.coalesce(F.try_to_number("ceiling", F.lit("999999999")) > 0, F.lit(False))
    lost = F.size(F.array_except("made", "ended"))
    status = F.when(F.col("ceiling").isNull(), 2).when(hard | (lost > 0) | (F.col("losses") > 0), 1).otherwise(0)
    return out.select("log_id", "ceiling", "final_speakers", "fewest", "most", "flips", F.size("made").alias("created"), "completions", lost.alias("unfinished"), "pieces", "refused", "losses", "delays", status.alias("status"))


# --- reports --------------------------------------------------------------------------


def score_report(scores: DataFrame) -> DataFrame:
    """Adds report, a text of several lines, to rows as ``scoring.error_rate`` gives them."""
    speech = F.col("correct") + F.col("confusion") + F.col("missed")
    part = lambda c: F.format_string("%6s%%", tenths(F.when(speech > 0, F.col(c) * 100 / speech).otherwise(0.0)))
    rows = [("correct", "correct"), ("confusion", "confusion"), ("missed", "missed"), ("false alarm", "false_alarm")]
    lines = [F.concat(F.format_string("%-12s%9.2fs  ", F.lit(name), F.col(c)), part(c)) for name, c in rows]
    return scores.withColumn("report", F.concat_ws("\n", F.format_string("%-12s%9.2fs", F.lit("scored"), speech), *lines, F.format_string("%-12s%9s%%", F.lit("error rate"), tenths(F.col("error_rate") * 100))))


def run_lines(runs: DataFrame) -> DataFrame:
    """Adds line, a row of a table of fixed widths, to scenario runs with a status: what is missing says so, what isn't known is a dash."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    rate = F.when(F.col("error_rate").isNull(), "-").otherwise(F.concat(tenths(F.col("error_rate") * 100), F.lit("%")))
    whole = F.concat(F.rpad(F.col("run_id").cast("string"), 12, " "), F.lpad(number("true_speakers"), 4, " "), F.lpad(number("speakers"), 4, " "), F.lpad(rate, 9, " "))
    return runs.withColumn("line", F.when(F.col("status").isin("missing", "error"), F.concat(F.rpad(F.col("run_id").cast("string"), 12, " "), F.lit(" "), F.upper("status"))).otherwise(whole))


def pass_stats(passes: DataFrame) -> DataFrame:
    """Passes (session_id, at, ms, windows, speakers, covered, hits, misses) as one row a session: counts, the mean time, the last state."""
    last = lambda c: F.max_by(c, "at").alias(c)
    return passes.groupBy("session_id").agg(
        F.count("*").alias("passes"), F.sum("windows").alias("windows"), last("speakers"), F.bround(F.avg("ms"), 1).alias("average_ms"), F.bround(F.max("covered"), 2).alias("covered_until"),
        F.concat_ws("/", F.sum("hits"), F.sum("hits") + F.sum("misses")).alias("cache"),
    )


def snapshot(sessions: DataFrame, most: int, busy: float = 0.9) -> DataFrame:
    """One row of a live view over all sessions: how many, of which organisations, and whether there is room."""
    live = F.count_if(F.col("status") == "active")
    state = F.when(live >= most, "full").when(live >= busy * most, "busy").otherwise("ok")
    return sessions.agg(live.alias("live"), F.countDistinct(F.when(F.col("status") == "active", F.col("organization_id"))).alias("organizations"), F.count_if(F.col("status") == "failed").alias("failed"), state.alias("state"))


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields and all, in as many files as there are partitions."""
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def scenarios_by_backend(scenarios: DataFrame, backends: list[str]) -> DataFrame:
    """Every scenario with every back end: an explode of the few back ends, no join."""
    return scenarios.withColumn("backend", F.explode(F.array(*map(F.lit, backends))))


def gathered(candidates: DataFrame) -> DataFrame:
    """The candidates (session_id, candidate, error, turns) that gave something: failed and empty ones drop out."""
    return candidates.filter("error IS NULL AND size(turns) > 0").select("session_id", "candidate", F.size("turns").alias("n_turns"))


# --- messages -------------------------------------------------------------------------


def outbound(messages: DataFrame, order: list[str]) -> DataFrame:
    """Adds sent, the number of each message of its session from 1 on."""
    return messages.withColumn("sent", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))


def client_view(messages: DataFrame) -> DataFrame:
    """What a client shows after all messages (session_id, seq, type, paragraph_id, text): a refresh replaces everything, a transcript puts its paragraph in.

    A refresh's paragraphs are rows of one seq.
    """
    kept = messages.filter("type IN ('refresh', 'transcript')")
    since = F.max(F.when(F.col("type") == "refresh", F.col("seq"))).over(Window.partitionBy("session_id"))
    kept = kept.withColumn("_since", since).filter("_since IS NULL OR seq >= _since").filter("paragraph_id IS NOT NULL")
    return kept.groupBy("session_id", "paragraph_id").agg(F.max_by("text", "seq").alias("text"))


def close_code(decision: Column) -> Column:
    """The code with which a socket is closed after a refusal: try again later where only room is wanting, else policy."""
    return F.when(decision == "accept", F.lit(None).cast("int")).when(decision.isin("platform_full", "quota_exceeded"), 1013).otherwise(1008)


def fenced_json(text: Column, schema: str) -> Column:
    """JSON that may stand between fences of a Markdown block; what can't be read is null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


# --- sessions -------------------------------------------------------------------------


def covered(segments: DataFrame, timeline: DataFrame) -> DataFrame:
    """Adds covered: whether the session's timeline reaches the segment's end."""
    until = timeline.groupBy("session_id").agg(F.max("end").alias("_until"))
    return segments.join(until, "session_id", "left").withColumn("covered", F.coalesce(F.col("_until") >= F.col("end"), F.lit(False))).drop("_until")


def finished(live: DataFrame, final: DataFrame, key: list[str], value: str) -> DataFrame:
    """``live`` with the values of the final pass where it has one, and changed, whether that is another."""
    new = final.select(*key, F.col(value).alias("_new"))
    joined = live.join(new, key, "left").withColumn("changed", F.coalesce(F.col("_new") != F.col(value), F.col("_new").isNotNull() & F.col(value).isNull()))
    return joined.withColumn(value, F.coalesce("_new", value)).drop("_new")


def concatenated(*parts: DataFrame) -> DataFrame:
    """All rows of tables with the same columns, in whatever order those stand."""
    return reduce(DataFrame.unionByName, parts)


def in_force(enabled: Column, measured: Column, fixed: Column) -> Column:
    """The measured band if measuring is on and there is one, else the fixed one."""
    return F.when(enabled, F.coalesce(measured, fixed)).otherwise(fixed)


def settings(names: DataFrame) -> DataFrame:
    """Rows (name, environment, profile, base) with the value that counts: the environment's, unless blank, then the profile's, then the base."""
    said = F.when(F.trim("environment") != "", F.trim("environment"))
    return names.select("name", F.coalesce(said, F.col("profile"), F.col("base")).alias("value"), F.when(said.isNotNull(), "environment").when(F.col("profile").isNotNull(), "profile").otherwise("base").alias("origin"))


def sign_in_candidates(users: DataFrame) -> DataFrame:
    """The accounts of each email (email, user_id, created_at) in the order in which they are tried: the oldest first."""
    return users.withColumn("place", F.row_number().over(Window.partitionBy("email").orderBy("created_at", "user_id")))


def founded(organizations: DataFrame, owners: DataFrame) -> DataFrame:
    """New organisations with their owner, as one row each, so that both are written or neither; those without an owner, or with several, are left out.

    Where they are two tables, ``sources.versions`` publishes both with one manifest.
    """
    one = owners.groupBy("organization_id").agg(F.count("*").alias("_n"), F.min("user_id").alias("owner_id")).filter("_n = 1").drop("_n")
    return organizations.join(one, "organization_id")


# --- sound ----------------------------------------------------------------------------


def with_samples(sound: DataFrame, pcm: str, name: str) -> DataFrame:
    """Adds the 16-bit little-endian samples of a binary column as numbers from -1 up to 1; an odd last byte is left, null has none."""
    ship(sound.sparkSession)

    @F.arrow_udf("array<double>")
    def decode(column: pa.Array) -> pa.Array:
        raw = [x or b"" for x in column.to_pylist()]
        upto = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int32)
        whole = b"".join(x[: len(x) // 2 * 2] for x in raw)
        return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.frombuffer(whole, "<i2") / 32768.0))

    return sound.withColumn(name, decode(pcm))


def to_pcm(sample: Column) -> Column:
    """A number from -1 to 1 as a 16-bit sample: the two signs have different ranges."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sample))
    return F.when(x < 0, x * 0x8000).otherwise(x * 0x7FFF).cast("int")


def pcm_seconds(pcm: Column, rate: int = 16000) -> Column:
    return F.octet_length(pcm) / 2 / rate


def content_key(pcm: Column) -> Column:
    """A key by which equal sound is found again."""
    return F.sha2(pcm, 256)


def length_batches(windows: DataFrame, key: str, length: str, bucket: int, least: int, most: int = 64) -> DataFrame:
    """(bucket, batch, key, width) of the distinct windows of ``least`` samples or more: batches of at most ``most`` of one bucket of lengths, cut to the shortest.

    Equal keys are embedded once.  Rows are numbered in parts of a bucket (by the key's hash) with offsets, so a bucket that holds most rows isn't one task's.
    """
    one = windows.filter(F.col(length) >= least).groupBy(key).agg(F.min(length).alias(length)).withColumn("bucket", F.floor(F.col(length) / bucket)).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(256)))
    sizes = one.groupBy("bucket", "_part").agg(F.count("*").alias("_m"))
    sizes = sizes.withColumn("_offset", F.sum("_m").over(Window.partitionBy("bucket").orderBy("_part")) - F.col("_m")).drop("_m")
    within = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy(key)) - 1
    placed = one.withColumn("_n", within).join(sizes, ["bucket", "_part"]).withColumn("batch", F.floor((F.col("_n") + F.col("_offset")) / most))
    widths = placed.groupBy("bucket", "batch").agg(F.min(length).alias("width"))
    return placed.join(widths, ["bucket", "batch"]).select("bucket", "batch", key, "width")
