"""The driver's tables as the library's entities: chunks, timelines, windows, sessions, tenants.

Each adapter returns a DataFrame; ``SQL`` holds the same as DuckDB text for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.functions.text import word_count


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as text chunks on a clock: 2.5 words a second, 0.4 s between chunks."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    dur = F.greatest(F.lit(1.0), word_count(F.col("text")) / 2.5)
    df = read(spark, sf_dir, "conversations").withColumn("dur", dur)
    start = F.round(F.coalesce(F.sum(F.col("dur") + 0.4).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 3)
    return df.select(
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("chunk_id"),
        (F.col("turn") + 1).alias("seg_id"),
        "role",
        "text",
        F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).cast("int").alias("role_speaker"),
        (F.floor(F.col("turn") / 2) % 2).cast("int").alias("pair_speaker"),
        (F.floor(F.col("turn") / 4) + 1).cast("int").alias("recording"),
        start.alias("start"),
        F.round(start + F.col("dur"), 3).alias("end"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diarizer's guess at who speaks when: the turns half a second late, with some speakers swapped."""
    flip = (F.col("session_id") + F.col("chunk_id") - 1) % 7 == 0
    speaker = F.coalesce("role_speaker", F.lit(0))
    return chunks(spark, sf_dir).select(
        "session_id",
        F.col("chunk_id").alias("run_id"),
        F.round(F.col("start") + 0.5, 3).alias("start"),
        F.round(F.col("end") + 0.5, 3).alias("end"),
        F.when(flip, 1 - speaker).otherwise(speaker).cast("int").alias("speaker"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who really speaks when."""
    return chunks(spark, sf_dir).select("session_id", F.col("chunk_id").alias("run_id"), "start", "end", F.coalesce("role_speaker", F.lit(0)).alias("speaker"))


def windows(spark: SparkSession, sf_dir: str, length: int = 50) -> DataFrame:
    """Embeddings as overlapping windows of sessions of ``length`` windows: 2 s each, one every 0.75 s.

    So the number of sessions grows with the table, and their length doesn't.
    """
    session = F.floor(F.col("vec_id") / length).alias("session_id")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("vec_id")) - 1
    df = read(spark, sf_dir, "embeddings").select("vec_id", session, F.col("embedding").cast("array<double>").alias("embedding"), "label")
    df = df.withColumn("start", rank * 0.75)
    return df.select("session_id", F.col("vec_id").alias("window_id"), "start", (F.col("start") + 2.0).alias("end"), "embedding", "label")


def speech_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 ms frames of each user: events in order of time, speech unless the event is of another kind."""
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), frame.alias("frame"), F.col("event_type").isin("click", "view", "purchase").alias("is_speech"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions of an organisation (the customer's nation)."""
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("organization_id"))
    minutes = F.col("o_totalprice") / 1000
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("failed")
    return read(spark, sf_dir, "orders").join(customer, "o_custkey").select(
        F.col("o_orderkey").alias("session_id"), "organization_id", F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), minutes.alias("minutes")
    )


#: The adapters as DuckDB common table expressions.
SQL = {
    "chunks": r"""
chunks AS (
  SELECT conv_id AS session_id, turn + 1 AS chunk_id, turn + 1 AS seg_id, role, text,
         CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS role_speaker,
         (turn // 2) % 2 AS pair_speaker, turn // 4 + 1 AS recording,
         round(coalesce(sum(dur + 0.4e0) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 3) AS start,
         round(round(coalesce(sum(dur + 0.4e0) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 3) + dur, 3) AS "end"
  FROM (SELECT *, greatest(1e0, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) / 2.5e0) AS dur FROM conversations)
)""",
    "timeline": r"""
timeline AS (
  SELECT session_id, chunk_id AS run_id, round(start + 0.5e0, 3) AS start, round("end" + 0.5e0, 3) AS "end",
         CASE WHEN (session_id + chunk_id - 1) % 7 = 0 THEN 1 - coalesce(role_speaker, 0) ELSE coalesce(role_speaker, 0) END AS speaker
  FROM chunks
)""",
    "truth": """
truth AS (SELECT session_id, chunk_id AS run_id, start, "end", coalesce(role_speaker, 0) AS speaker FROM chunks)""",
    "windows": """
windows AS (
  SELECT session_id, window_id, start, start + 2e0 AS "end", embedding, label FROM (
    SELECT vec_id // 50 AS session_id, vec_id AS window_id, (row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1) * 0.75e0 AS start,
           embedding::DOUBLE[] AS embedding, label FROM embeddings)
)""",
    "flags": """
flags AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type IN ('click', 'view', 'purchase') AS is_speech FROM events
)""",
    "sessions": """
sessions AS (
  SELECT o_orderkey AS session_id, c_nationkey AS organization_id, o_custkey AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'failed' END AS status, o_orderdate AS started_at, o_totalprice / 1000 AS minutes
  FROM orders JOIN customer ON c_custkey = o_custkey
)""",
}


def with_sql(names: str, rest: str) -> str:
    """An oracle's text: the adapters it names, then its own."""
    head = "WITH " + ",".join(SQL[n] for n in names.split())
    rest = rest.strip()
    return f"{head},\n{rest[5:]}" if rest.startswith("WITH ") else f"{head}\n{rest}"
