"""Streams against the batch operators: restarts, replays, late and repeated rows; and writes of several tables as one."""

import json
import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmura.operators import records, transcript
from murmura.plans import transcripts
from murmura.sources import versions
from murmura.streaming import publishing
from murmura.streaming.steps import use_rocksdb

CHUNKS = "session_id long, recording long, chunk_id long, start double, end double, speaker int, text string"


def finish(query, seconds=180):
    assert query.awaitTermination(seconds) and query.exception() is None


def talked(spark, small):
    rows = transcripts.chunks(spark, small).filter("session_id < 12").selectExpr("session_id", "CAST(recording AS LONG) recording", "CAST(chunk_id AS LONG) chunk_id", "start", "end", "CAST(speaker AS INT) speaker", "text")
    return rows.toPandas()


def test_published_transcripts(spark, small, tmp_path):
    """Chunks in six micro-batches, relabelled and late ones among them, over three runs: the client ends with the batch's paragraphs."""
    use_rocksdb(spark)
    rows = talked(spark, small)
    rng = np.random.default_rng(0)
    early = rows.assign(speaker=np.where(rng.random(len(rows)) < 0.3, 5, rows.speaker), part=np.minimum(3, rows.groupby("session_id").cumcount() // 3))
    late = early["chunk_id"] % 5 == 2
    early.loc[late, "part"] = 4
    versions_ = pd.concat([early, rows.assign(part=5)[(rows.chunk_id % 2 == 0) | (early.speaker == 5)]])
    for parts in ([0, 1], [2, 3], [4, 5]):
        for p in parts:
            some = versions_[versions_.part == p].drop(columns="part")
            spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in some.itertuples(index=False)], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = publishing.messages(source).writeStream.foreachBatch(versions.each_batch(str(tmp_path / "out"), "messages"))
        finish(out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    sent = versions.read(spark, str(tmp_path / "out"), "messages")
    got = {(r.session_id, r.paragraph_id): r.text for r in records.client_view(sent).collect()}
    final = spark.createDataFrame(rows).withColumns({"language": F.lit("en"), "seg_id": F.col("chunk_id")})
    want = {(r.session_id, r.paragraph_id): r.text for r in transcript.paragraphs(final).collect()}
    assert got == want and len(got) > 20
    numbers = sent.groupBy("session_id").agg(F.sort_array(F.collect_set("seq")).alias("n")).collect()
    assert all(list(r.n) == list(range(1, len(r.n) + 1)) for r in numbers)
    assert {r.type for r in sent.select("type").distinct().collect()} == {"transcript", "refresh", "speakers"}


@pytest.mark.parametrize(
    ("old", "new", "mode"),
    [
        ([(0, 1, "a")], [(0, 1, "a")], "none"),
        ([(0, 1, "a")], [(0, 1, "a"), (0, 2, "b")], "transcript"),
        ([(0, 1, "a"), (0, 2, "b")], [(0, 1, "a"), (0, 2, "b c")], "transcript"),
        ([(0, 1, "a"), (0, 2, "b")], [(0, 1, "x"), (0, 2, "b")], "refresh"),
        ([(0, 1, "a"), (0, 2, "b")], [(0, 1, "a")], "refresh"),
        ([(0, 1, "a")], [], "refresh"),
        ([(0, 1, "a")], [(0, 1, "b"), (0, 2, "c")], "refresh"),
    ],
)
def test_what_is_due(old, new, mode):
    as_paragraphs = lambda rows: [(r, k, 0.0, 1.0, 0, t) for r, k, t in rows]
    sent = publishing.due(as_paragraphs(old), {})[1]
    assert publishing.due(as_paragraphs(new), sent)[0] == mode


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root, rows = str(tmp_path), spark.range(3).toDF("x")
    write = versions.each_batch(root, "t")
    write(rows, 0), write(rows, 1), write(rows, 1), write(rows, 0)
    assert versions.read(spark, root, "t").count() == 6 and versions.manifest(spark, root)["number"] == 2
    versions.compact(spark, root, "t")
    assert versions.read(spark, root, "t").count() == 6 and len(versions.manifest(spark, root)["tables"]["t"]) == 1
    write(rows, 1), write(rows, 2)
    assert versions.read(spark, root, "t").count() == 9


def test_two_tables_are_one_write(spark, tmp_path):
    """A writer that dies between the tables, or before the manifest, leaves the old version; of two writers at once one fails."""
    root = str(tmp_path)
    tables = lambda n: {"organizations": spark.range(n).toDF("id"), "owners": spark.range(n).toDF("id")}
    versions.commit(spark, root, tables(2))
    broken = tables(5)
    broken["owners"] = broken["owners"].select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        versions.commit(spark, root, broken)
    assert versions.read(spark, root, "organizations").count() == versions.read(spark, root, "owners").count() == 2
    versions.commit(spark, root, tables(5))
    assert versions.read(spark, root, "organizations").count() == versions.read(spark, root, "owners").count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        versions._publish(spark, root, {"number": 2, "tag": None, "tables": {}})
    assert json.loads((tmp_path / "manifests" / f"{2:012d}").read_text())["tables"].keys() == {"organizations", "owners"}


# --- identities -------------------------------------------------------------------------

BLOCKS = "session_id long, block long, local_speaker int, seconds double, embedding array<double>"


def blocks_of(seed, plan, sessions=(1, 2)):
    """Rows of blocks; ``plan`` names the voices (of orthogonal ones) that speak in each, in the order of their local numbers."""
    rng = np.random.default_rng(seed)
    own = np.linalg.qr(rng.normal(size=(16, 6)))[0].T
    return [(s, b, i, 2.0, [float(x) for x in own[w] + 0.02 * rng.normal(size=16)]) for s in sessions for b, who in enumerate(plan) for i, w in enumerate(who)]


def plain_stitch(rows, most, gate=0.5):
    """All pairs by hand, for voices so far apart that the nearest identity is the match."""
    out, known = [], {}
    for s in sorted({r[0] for r in rows}):
        known = []
        for b in sorted({r[1] for r in rows if r[0] == s}):
            full = most and sum(k[1] > 3 and k[2] >= 2 for k in known) >= most
            for r in sorted(r for r in rows if r[:2] == (s, b)):
                v = np.array(r[4])
                d = [1 - v @ k[0] / np.linalg.norm(v) / np.linalg.norm(k[0]) for k in known]
                at = int(np.argmin(d)) if d and min(d) <= gate else -1
                if at < 0 and full:
                    out.append((s, b, r[2], -1, False, "UNKNOWN_SPEAKER"))
                    continue
                if at < 0:
                    at = len(known)
                    known.append([np.zeros(16), 0.0, 0])
                k = known[at]
                k[0], k[1], k[2] = k[0] + v, k[1] + r[3], k[2] + 1
                sure = k[1] > 3 and k[2] >= 2
                out.append((s, b, r[2], at, sure, f"Unknown_Voice_{at}" if sure else "CANDIDATE_SPEAKER"))
    return sorted(out)


PLAN = [[0, 1], [1, 0], [0, 2, 1], [2], [1, 0], [3, 0], [3, 1]]


@pytest.mark.parametrize("most", [0, 2, 3])
def test_identities_with_a_fixed_number(spark, most):
    from murmura.streaming import stitching

    rows = blocks_of(1, PLAN)
    got = sorted(map(tuple, stitching.stitch(spark.createDataFrame(rows, BLOCKS).repartition(3), stitching.Stitch(most=most)).collect()))
    assert got == plain_stitch(rows, most)
    names = {r[5] for r in got}
    assert ("UNKNOWN_SPEAKER" in names) == (most > 0) and {"CANDIDATE_SPEAKER", "Unknown_Voice_0", "Unknown_Voice_1"} <= names


def test_identities_as_stream(spark, tmp_path):
    from murmura.streaming import stitching

    use_rocksdb(spark)
    rows, rule = blocks_of(1, PLAN), stitching.Stitch(most=3)
    want = sorted(map(tuple, stitching.stitch(spark.createDataFrame(rows, BLOCKS), rule).collect()))
    for part in (rows[:7], rows[7:12], rows[12:] + [(s, None, None, None, None) for s in (1, 2)]):
        spark.createDataFrame(part, BLOCKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(BLOCKS).parquet(str(tmp_path / "in"))
        finish(stitching.stream(source, rule).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(stitching.COLUMNS).collect())) == want


# --- arrivals ---------------------------------------------------------------------------

FRAMES = "session_id long, frame long, started_at timestamp"


def test_late_and_repeated_frames(spark, tmp_path):
    """Frames of 30 ms in three micro-batches, with repeats within and across them and some far too late: rows, beats and dropped rows are all as counted by hand."""
    from murmura.streaming import arrivals

    batches = [
        [(s, k) for s in (1, 2) for k in range(700)] + [(1, 5), (1, 5), (2, 699)],
        [(1, k) for k in range(690, 1500)] + [(2, k) for k in range(700, 1400)],
        [(1, 3), (2, 10), (1, 1499)] + [(s, k) for s in (1, 2) for k in range(1500, 2400)],
    ]
    start = datetime(2026, 1, 1)
    for k, rows in enumerate(batches):
        spark.createDataFrame([(s, f, start) for s, f in rows], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
        time.sleep(0.05)
    source = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    heard = source.withColumn("at", arrivals.event_time(F.col("started_at"), F.col("frame") * 0.03))
    kept = arrivals.fresh(heard, "at", ["session_id", "frame"], "5 seconds")
    query = arrivals.beats(kept, "at", "session_id").writeStream.format("memory").queryName("beats_seen").outputMode("append").trigger(availableNow=True).start()
    finish(query)
    # The watermark of a batch is the newest time of the batches before, less five seconds.
    seen, mark, newest, late, repeated = set(), -1e9, 0.0, 0, 0
    for rows in batches:
        for r in rows:
            if r[1] * 0.03 < mark:
                late += 1
            elif r in seen:
                repeated += 1
            else:
                seen.add(r)
        newest = max([newest, *(f * 0.03 for _, f in rows)])
        mark = newest - 5
    assert arrivals.dropped(query) == {"late": late, "repeated": repeated} and late == 2 and repeated >= 13
    want = {}
    for s, f in seen:
        begin = int(f * 0.03 // 10) * 10
        if begin + 10 <= mark:
            want[s, begin] = want.get((s, begin), 0) + 1
    got = {(r.session_id, round((r.begin - start).total_seconds())): r.n for r in spark.table("beats_seen").collect()}
    assert got == want and len(want) >= 10


# --- counts on the way --------------------------------------------------------------------

KINDS = ["click", "view", "purchase"]


def test_counts_on_the_way(spark, small, tmp_path):
    """What an action and a stream count while they read equals the aggregate."""
    from murmura.operators import telemetry

    events = spark.read.parquet(f"{small}/events.parquet")
    want = events.agg(*telemetry.tallies("event_type", KINDS)).first().asDict()
    frame, seen = telemetry.observed(events, "event_type", KINDS)
    frame.filter("user_id % 2 = 0").write.parquet(str(tmp_path / "even"))
    assert seen.get == want
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = telemetry.observed_live(source, "kinds", "event_type", KINDS)
    query = live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    finish(query)
    assert telemetry.totals(query, "kinds") == want and want["n"] > 0
