"""What was mended after a review: each of these failed before."""

import re
import tracemalloc
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from murmura.functions import guards as guard_functions
from murmura.functions import text as T
from murmura.llm import passages
from murmura.operators import records, scoring, transcript
from murmura.plans import catalogue


def test_tenths_like_printf(spark):
    rng = np.random.default_rng(7)
    values = [29.15, 50.55, 18.45, 0.15, 0.25, 0.35, 0.05, 12.25, 12.75, 99.95, 100.0, 0.0, -2.45, 1e9 + 0.25, None]
    values += (rng.integers(0, 1_000_000, 3000) / 10_000 * 100).tolist() + (rng.integers(0, 20_000, 3000) / 20).tolist() + rng.uniform(0, 100, 500).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", T.tenths(F.col("x")).alias("text"))
    assert [r.text for r in df.collect()] == [None if v is None else f"{v:.1f}" for v in values]


def test_score_report_rounds_like_printf(spark):
    """29.15 % is a little less in binary: 29.1."""
    df = spark.createDataFrame([(1, 44.5, 17.25, 0.72, 0.24, 0.2915)], "session_id long, correct double, confusion double, missed double, false_alarm double, error_rate double")
    assert records.score_report(df).first().report.endswith(f"error rate  {0.2915 * 100:9.1f}%")


def test_der_score_sweeps_once(spark, small):
    """One sweep and one reading of each side, no group of rows a session, and the mapping solved for many sessions at once."""
    plan = catalogue.QUERIES["der_score"](spark, small)._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("\n\n")[0]
    assert len(re.findall(r"[-+:] .*MapInPandas", tree)) <= 1 and "FlatMapGroups" not in plan and tree.count("FileScan parquet") <= 2


def test_best_mapping_of_many_sessions(spark):
    """Against all one-to-one mappings, with cells in pieces, sessions without a pair and empty input."""
    rng = np.random.default_rng(3)
    rows = [(s, None if r < 0 else r, None if h < 0 else h, int(n)) for s in range(60) for r, h, n in zip(rng.integers(-1, 4, s % 9), rng.integers(-1, 3, s % 9), rng.integers(0, 9, s % 9))]
    df = spark.createDataFrame([(s, None if r is None else int(r), None if h is None else int(h), n) for s, r, h, n in rows], "session_id long, ref long, hyp long, n long")
    got = Counter()
    for r in scoring.best_mapping(df).collect():
        got[r.session_id] += r.n
    for s in range(60):
        n = Counter()
        for x, r, h, k in rows:
            if x == s and r is not None and h is not None:
                n[r, h] += k
        assert got[s] == max(sum(n[p[h], h] for h in range(3)) for p in permutations(range(4), 3))
    assert scoring.best_mapping(df.filter("false")).count() == 0


def test_context_echo_is_one_arrow_pass(spark, small):
    """The tokens of text and context are compared in Arrow batches, not by lambdas over arrays; slices count both columns' bytes."""
    plan = catalogue.QUERIES["context_echo"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    batch = pa.record_batch({"text": ["a b c"] * 4, "context": ["x" * (guard_functions.SLICE // 2)] * 4})
    assert all(b.num_rows <= 2 for b in guard_functions.slices(batch, "text", "context"))


def test_language_spans_without_shuffle(spark):
    """Spans of texts that go over Arrow batches, with all kinds of white space and tokens without a language, as a loop finds them; no exchange."""
    rng = np.random.default_rng(9)
    words, gaps = ["ab", "ñu", "12", "é.", "cd!", "--", "…", "xé"], [" ", "  ", "\n", " ", "\t  "]
    made = lambda n: "".join(rng.choice(gaps) + rng.choice(words) for _ in range(n)) + str(rng.choice(["", " "]))
    texts = [made(n) for n in (0, 1, 2, 3, 30, 500, 1, 40, 7)] + ["12 --", "", "   ", None, "12 ab", " 7 é 8"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    lang = F.when(F.col("token").rlike(T.OTHER), "x").when(F.col("token").rlike(T.BASE), "b")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        spans = transcript.language_spans(df, lang, ["k"], "none")
        got = [tuple(r) for r in spans.orderBy("k", "span").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for k, text in enumerate(texts):
        tokens = [(m.start(), m.end(), "x" if re.search(T.OTHER, m[0]) else "b" if re.search(T.BASE, m[0]) else None) for m in re.finditer(r"\S+", text or "")]
        known = next((t[2] for t in tokens if t[2]), "none")
        mine: list = []
        for a, b, own in tokens:
            known = own or known
            if mine and mine[-1][2] == known:
                mine[-1][4] = b
            else:
                mine.append([k, len(mine), known, a, b])
        want += map(tuple, mine)
    assert got == want
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()


def test_new_voices_in_few_steps(spark, small):
    """Both paths go through the same joins and sums; windows aren't multiplied by centroids, so a task holds few sorts at a time."""
    plan = catalogue.QUERIES["new_voices"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin ", plan)) <= 4


def test_repeated_passages_work_on_little_at_once():
    """Anchors of 2 MB of text, and contexts of a task's batch, take less than 25 MB beside them."""
    data = np.random.default_rng(1).integers(97, 123, 1 << 21).astype(np.uint8)
    starts = np.arange(0, 1 << 21, 2048)

    def peak(work):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    rule = passages.Repeat()
    anchors = lambda: [passages.anchors(data[starts[i] : starts[j - 1] + 2048], starts[i:j] - starts[i], starts[i:j] + 2048 - starts[i], rule) for i, j in passages.slices(starts, starts + 2048, passages.SLICE)][:0]
    refined = lambda: passages.repeated_windows(data[: passages.AT_ONCE], np.full(passages.AT_ONCE // 2048, 2048), rule)
    assert peak(anchors) < 25e6 and peak(refined) < 25e6
