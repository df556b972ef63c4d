"""Operators on small fixtures, against plain restatements of their rules."""

import io
import json
import math
import time
import wave
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmura.functions import guards as guard_functions
from murmura.functions import service as S
from murmura.functions import text as T
from murmura.functions import voices as V
from murmura.functions.assign import assignment, gated, linkage_cuts
from murmura.operators import clustering, discovery, intervals, records, scoring, signal, telemetry, tenancy, transcript, vectors
from murmura.plans import guards, transcripts
from murmura.sources import annotations
from murmura.streaming import registry, segmenter, steps, stitching

SINHALA, TAMIL, THAANA = "[ක-ෆඅ-ඖ]", "[அ-ஹ]", "[ހ-ޥ]"


def ask(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


# --- text -----------------------------------------------------------------------------


def test_tokens_and_counts(spark):
    got = ask(spark, ["a b  c", "", None, " x "], T.word_count(F.col("text")), T.dense_chars(F.col("text")))
    assert got == [(3, 3), (0, 0), (0, 0), (1, 1)]


def test_scripts(spark):
    mixed = "ආයුබෝවන් hello ވފ"
    scripts = {"si": SINHALA, "ta": TAMIL, "en": T.BASE}
    inside, outside = T.script_profile(F.col("text"), "[A-Za-zඅ-ෆ]")
    got = ask(spark, [mixed, "2024", "ok அக", ""], T.dominant_language(F.col("text"), scripts, "en"), inside, outside)
    assert got[0][0] == "si" and got[0][2] == 2
    assert got[1] == (None, 0, 0) and got[2][0] == "ta" and got[3] == (None, 0, 0)


def test_strip_foreign(spark):
    got = ask(spark, ["keep ވފވ 12 abވ", "ވފ", None], T.strip_foreign(F.col("text")))
    assert got == [("keep 12 abވ",), ("",), ("",)]


@pytest.mark.parametrize(
    ("text", "loop"),
    [("ok ok ok ok", True), ("yes. yes. yes. Yes", True), ("no no I meant the other one", False), ("very very very good", False), ("a b c " * 5, True), ("2024", False), ("", False), ("... ... ... ...", False)],
)
def test_repetition(spark, text, loop):
    assert guard_functions.guarded(spark.createDataFrame([(text,)], "text string"), "text", strip=False).first().degenerate == loop


def test_guards_in_one_pass(spark):
    """Against plain loops: what is kept, repetition and echo, over null, blank and long texts and Unicode space."""
    rng = np.random.default_rng(0)
    some = ["ok", "OK", "Straße", "strasse", "no.", "...", "ab\u0d85", "\u0d85\u0d86", "12", "the", "cat", "sat"]
    texts = [None, "", " \u2003 ", "a\u00a0b\u3000c", "x " * 50_000] + [" ".join(rng.choice(some, int(rng.integers(1, 40)))) for _ in range(150)]
    rows = [(i, t, texts[i - 1] if i % 3 else t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string, context string, kept_before int").repartition(3)
    got = {r.i: r for r in guard_functions.guarded(df, "text", "context").collect()}
    fold = lambda t: [x.lower().replace("ß", "ss") for x in t]
    grams = lambda t: [tuple(t[k : k + 3]) for k in range(len(t) - 2)]
    for i, text, context, _ in rows:
        toks = [t for t in (text or "").split() if sum(c.isascii() and c.isalpha() for c in t) >= 0.5 * sum(c.isalpha() for c in t)]
        low = fold(toks)
        run = best = 0
        last = None
        for k in (x.strip(".,!?…:;") for x in low):
            run = run + 1 if k and k == last else 1 if k else 0
            best, last = max(best, run), k
        top = max(Counter(grams(low)).values(), default=0)
        ratio = len(set(low)) / len(low) if low else 1.0
        given = set(grams(fold((context or "").split())))
        share = sum(g in given for g in grams(low)) / len(grams(low)) if len(low) > 2 else 0.0
        r = got[i]
        assert (r.kept, r.n_tokens, r.top_trigram, r.kept_before) == (" ".join(toks), len(toks), top, 7) and r.unique_ratio == pytest.approx(ratio)
        assert r.degenerate == (best >= 4 or len(low) >= 12 and (ratio < 0.45 or top >= 3))
        assert r.echo_share == pytest.approx(share) and r.echo == (len(low) >= 5 and bool(given) and share >= 0.8)
    assert guard_functions.guarded(spark.createDataFrame([], "i int, text string"), "text").count() == 0


def test_echo(spark):
    rows = [("a b c d e f g h", "x a b c d e f g h y"), ("a b", "a b c d"), ("new words that nobody has said", "a b c d e f"), ("yes", "yes yes yes")]
    df = spark.createDataFrame(rows, "text string, context string")
    assert [r.echo for r in T.with_echo(df, "text", "context").collect()] == [True, False, False, False]


def echo_share(text, context):
    """The share of the text's 3-grams that the context has, by counting."""
    own, given = ([" ".join(t[i : i + 3]) for i in range(len(t) - 2)] for t in ((x or "").lower().split() for x in (text, context)))
    return round(sum(g in set(given) for g in own) / len(own), 6) if own else 0.0


def test_echo_counts_each_gram(spark):
    """Few and many shared 3-grams, repeated ones too, all, none, no context."""
    rng = np.random.default_rng(5)
    words = [" ".join(rng.choice(list("abcdefg"), n)) for n in (3, 40, 400, 3000)]
    rows = [(x, y) for x in words for y in [*words, "", None, " ".join("tuvwxyz" * 9)]] + [(None, "a b c")]
    df = spark.createDataFrame(rows, "text string, context string")
    got = [(r.text, r.context, round(r.echo_share, 6)) for r in T.with_echo(df, "text", "context").collect()]
    assert got == [(*r, echo_share(*r)) for r in rows] and len({x for *_, x in got}) > 6


def test_context_echo_judges_whole_texts(spark, tmp_path):
    """An echo that begins after 300 characters, contexts across ranges of ids, languages apart, a null language."""
    rng = np.random.default_rng(7)
    filler = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**9, n))
    rows, last = [], {}
    for i in range(1, 1300):
        lang = ["en", "en", "de", None][i % 4]
        before = last.get(lang, "")
        text = filler(60) + " " + before[-500:] if i % 3 else filler(20)
        rows.append((i * 7, text, lang, len(text)))
        last[lang] = text
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want, last = {}, {}
    for i, text, lang, _ in rows:
        want[i] = echo_share(text, text if i % 5 == 0 else last.get(lang, "")[-1200:])
        last[lang] = text
    got = {r.doc_id: r.share for r in guards.context_echo(spark, str(tmp_path)).collect()}
    assert got == want and 0.2 < want[rows[3][0]] < 1


def test_repeat_guard_compares_whole_texts(spark, tmp_path):
    """Turns that share 40 characters and differ then, a true repeat, and a text that is blank at first."""
    opening = "x" * 40
    turns = [opening + " one", opening + " two", opening + " two", " " * 40 + "spoken after all"]
    rows = [(1, k, "user", t) for k, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in transcripts.repeat_guard(spark, str(tmp_path)).collect()] == [(1, 4, 1)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a.", "B", "..."]), max_size=12))
def test_longest_run_and_trigrams(spark, toks):
    best = run = 0
    last = None
    for t in toks:
        k = t.strip(".,!?…:;").casefold()
        run = run + 1 if k and k == last else 1 if k else 0
        best, last = max(best, run), k
    grams = Counter(tuple(toks[i : i + 3]) for i in range(len(toks) - 2))
    got = ask(spark, [" ".join(toks)], T.longest_run(T.tokens(F.col("text"))), T.most_frequent(T.ngrams(T.tokens(F.col("text")))))
    assert got == [(best, max(grams.values(), default=0))]


def test_formats(spark):
    assert ask(spark, ["1.5", " 1.500s ", "x", "2ss"], T.seconds(F.col("text"))) == [(1.5,), (1.5,), (None,), (None,)]
    assert ask(spark, ["59.9", "61", "3600"], T.clock(F.col("text").cast("double"))) == [("0:59",), ("1:01",), ("60:00",)]


# --- transcript -----------------------------------------------------------------------

CHUNKS = "session_id long, chunk_id long, seg_id long, start double, end double, text string, speaker int, recording int, language string"


def test_paragraphs_in_place(spark):
    """A, B, A with B arriving last; the same whatever the order of arrival."""
    rows = [(1, 1, 1, 0.0, 1.0, "hello", 0, 1, "en"), (1, 3, 3, 2.0, 3.0, "again", 0, 1, "si"), (1, 2, 2, 1.0, 2.0, "yes", 1, 1, "en"), (1, 4, 4, 3.0, 4.0, "more", None, 1, "en"), (1, 5, 5, 4.0, 5.0, " ", 1, 1, "en"), (1, 6, 6, 5.0, 6.0, "end", 0, 2, "en")]
    got = [(r.paragraph_id, r.speaker, r.text, r.language, r.n_chunks) for r in transcript.paragraphs(spark.createDataFrame(rows, CHUNKS)).orderBy("paragraph_id").collect()]
    assert got == [(1, "Speaker 1", "hello", "en", 1), (2, "Speaker 2", "yes", "en", 1), (3, "Speaker 1", "again more", "si+en", 2), (6, "Speaker 1", "end", "en", 1)]
    back = transcript.paragraphs(spark.createDataFrame(rows[::-1], CHUNKS)).orderBy("paragraph_id").collect()
    assert [(r.paragraph_id, r.text) for r in back] == [(g[0], g[2]) for g in got]


def test_spans_exact(spark):
    text = "12  ab  ñu é. cd"
    df = spark.createDataFrame([(0, text), (1, "12 !"), (2, "")], "k int, text string")
    lang = F.when(T.letters(F.col("token"), T.OTHER) > 0, "x").when(T.letters(F.col("token"), T.BASE) > 0, "b")
    got = [(r.k, r.language, text[r.start_char : r.end_char] if r.k == 0 else None) for r in transcript.language_spans(df, lang, ["k"], "b").orderBy("k", "span").collect()]
    assert got == [(0, "b", "12  ab"), (0, "x", "ñu é."), (0, "b", "cd"), (1, "b", None)]


# --- intervals ------------------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30)), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30), st.integers(0, 2)), max_size=8))
def test_overlap_and_labels(spark, chunks, turns):
    c = spark.createDataFrame([(1, i, float(a), float(a + n)) for i, (a, n) in enumerate(chunks)], "session_id long, chunk_id long, start double, end double")
    t = spark.createDataFrame([(1, float(a), float(a + n), s) for a, n, s in turns], "session_id long, start double, end double, speaker int")
    pairs = [(i, j) for i, (a, n) in enumerate(chunks) for j, (b, m, _) in enumerate(turns) if b < a + n and a < b + m]
    assert intervals.overlap_join(c, t, bucket=7.0).count() == len(pairs)
    got = {r.chunk_id: r.hit for r in intervals.label_intervals(c, t).collect()}
    for i, (a, n) in enumerate(chunks):
        sums, since = Counter(), {}
        for b, m, s in turns:
            if b < a + n and a < b + m:
                sums[s] += min(a + n, b + m) - max(a, b)
                since[s] = min(since.get(s, 99), b)
        tied = {s for s in sums if (sums[s], -since[s]) == max((sums[x], -since[x]) for x in sums)}
        assert got[i] in (tied or {None})


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=12))
def test_cuts(spark, cuts):
    kept = []
    for c in sorted(cuts):
        if not kept or c / 10 - kept[-1] >= 0.35:
            kept.append(c / 10)
    df = spark.createDataFrame([([c / 10 for c in cuts],)], "c array<double>")
    assert df.select(intervals.spaced(F.col("c"), 0.35)).first()[0] == kept


def test_fallback_is_as_of(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, float(rng.integers(50)), 0.0, int(rng.integers(2)) if rng.random() < 0.7 else None) for i in range(40)]
    rows = [(s, i, a, a + float(rng.integers(1, 9)), sp) for s, i, a, _, sp in rows]
    got = {r.chunk_id: r.speaker for r in intervals.speaker_before(spark.createDataFrame(rows, "session_id long, chunk_id long, start double, end double, speaker int")).collect()}
    assert got == {i: max(((j, s2) for _, j, _, e, s2 in rows if s2 is not None and e <= a), default=(0, 0))[1] for _, i, a, _, _ in rows}


# --- numeric helpers ------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m))
    got = assignment(cost)
    wide = cost if n <= m else cost.T
    best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
    assert len(got) == min(n, m) and math.isclose(sum(cost[r, c] for r, c in got), best)


def test_linkage():
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])
    cuts = linkage_cuts(np.abs(x[:, None] - x), 3)
    assert cuts[3].tolist() == [0, 0, 0, 1, 1, 2] and cuts[2].tolist() == [0, 0, 0, 1, 1, 1] and cuts[1].tolist() == [0] * 6


def voices(n, turns, seed=0, mix=0.45):
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    common = unit(rng.normal(size=256))
    own = [unit(mix * common + unit(rng.normal(size=256))) for _ in range(n)]
    rows, t = [], 0.0
    for k, who in enumerate(turns):
        for _ in range(8):
            rows.append((1, len(rows), t, t + 2.0, unit(own[who] + 0.5 * unit(rng.normal(size=256))).tolist(), who))
            t += 0.75
        t += 2.0
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_speakers_are_found(spark, n):
    rows = voices(n, [i % n for i in range(2 * n + 2)], seed=n)
    df = spark.createDataFrame(rows, "session_id long, window_id long, start double, end double, embedding array<double>, who int")
    got = {r.window_id: r.cluster for r in clustering.cluster_windows(df).collect()}
    assert len(set(got.values())) == n
    assert len({(got[r[1]], r[5]) for r in rows}) == n
    runs = clustering.speaker_timeline(df).orderBy("start").collect()
    assert len({r.speaker for r in runs}) == n and all(a.end <= b.start for a, b in zip(runs, runs[1:], strict=False))


def test_sample_bound(spark):
    df = spark.range(2500).selectExpr("id % 2 AS session_id", "id AS window_id", "CAST(id AS DOUBLE) AS start")
    got = clustering.sample(df, 100).groupBy("session_id").agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("start").alias("b")).collect()
    assert all(95 <= r.n <= 101 and r.a < 2 and r.b > 2450 for r in got)


def test_short_runs_absorbed(spark):
    frames = [0] * 10 + [1] * 2 + [0] * 8 + [2] * 9
    df = spark.createDataFrame([(1, i, c, 1.0) for i, c in enumerate(frames)], "session_id long, frame int, cluster int, votes double")
    got = [(r.first, r.last, r.cluster) for r in clustering.absorb_short(df).orderBy("first").collect()]
    assert got == [(0, 19, 0), (20, 28, 2)]


# --- scoring --------------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [0.5, 7.0, 1e6])
def test_pieces_of_stretches(spark, stretch):
    """However a session is cut into stretches, each hundredth of a second counts once, as judged by hand."""
    rng = np.random.default_rng(7)
    made = lambda n, seed: [(s, k, *sorted(np.round(rng.uniform(0, 40, 2), 2).tolist()), int(rng.integers(0, 3))) for s in (1, 2) for k in range(n)]
    turns = "session_id long, run_id long, start double, end double, speaker int"
    ref, hyp = made(9, 0), made(7, 1)
    got = scoring.pieces(spark.createDataFrame(ref, turns), spark.createDataFrame(hyp, turns), stretch=stretch).groupBy("session_id", "ref", "hyp").agg(F.sum("n").alias("n")).collect()
    want = Counter()
    for s in (1, 2):
        edges = [round(t * 100) for r in ref if r[0] == s for t in r[2:4] if r[2] < r[3]]
        for t in range(4001):
            now = [max([(r[1], r[4]) for r in side if r[0] == s and round(r[2] * 100) <= t < round(r[3] * 100)], default=(0, None))[1] for side in (ref, hyp)]
            if now != [None, None] and not any(e - 25 <= t < e + 26 for e in edges):
                want[s, now[0], now[1]] += 1
    assert {(r.session_id, r.ref, r.hyp): r.n for r in got} == want


def test_error_rate(spark):
    turns = "session_id long, run_id long, start double, end double, speaker int"
    ref = spark.createDataFrame([(1, 1, 0.0, 4.0, 0), (1, 2, 4.0, 8.0, 1)], turns)
    same = spark.createDataFrame([(1, 1, 0.0, 4.0, 1), (1, 2, 4.0, 8.0, 0)], turns)
    late = spark.createDataFrame([(1, 1, 0.0, 6.0, 0), (1, 2, 6.0, 7.0, 1), (1, 3, 9.0, 10.0, 1)], turns)
    assert scoring.error_rate(ref, same).first()[1:] == (6.98, 0.0, 0.0, 0.0, 0.0)
    r = scoring.error_rate(ref, late).first()
    assert (r.confusion, r.missed, r.false_alarm) == (1.74, 0.75, 1.0) and r.error_rate == pytest.approx(3.49 / 6.98, abs=1e-6)


def brute_error(ref, hyp, collar=25):
    """Frames of 10 ms in dictionaries, all one-to-one mappings."""
    grid = lambda turns: {f: s for _, a, b, s in sorted(turns) for f in range(round(a * 100), round(b * 100))}
    r, h = grid(ref), grid(hyp)
    near = {f for _, a, b, _ in ref for e in (round(a * 100), round(b * 100)) for f in range(e - collar, e + collar + 1)}
    frames = [(r.get(f), h.get(f)) for f in (r.keys() | h.keys()) - near]
    rs, hs = sorted({x for x, _ in frames if x is not None}), sorted({y for _, y in frames if y is not None})
    n = Counter(frames)
    rs += [-1] * max(0, len(hs) - len(rs))
    agreed = max((sum(n[x, y] for x, y in zip(p, hs, strict=False)) for p in permutations(rs, len(hs))), default=0)
    both, missed = sum(v for (x, y), v in n.items() if None not in (x, y)), sum(v for (x, y), v in n.items() if y is None)
    return tuple(round(v / 100, 2) for v in (agreed, both - agreed, missed, sum(v for (x, _), v in n.items() if x is None)))


def test_error_rate_any_number_of_speakers(spark):
    """1 to 7 speakers on either side, more of them guessed than there are and the other way round, with overlaps."""
    rng = np.random.default_rng(4)
    refs, hyps, want = [], [], {}
    for s in range(14):
        k, m = 1 + s % 7, 1 + (s * 3) % 7
        make = lambda n: [(i, round(float(t), 2), round(float(t + d), 2), int(rng.integers(n) * 5)) for i, (t, d) in enumerate(zip(np.cumsum(rng.uniform(0.5, 3, 25)), rng.uniform(0.3, 4, 25), strict=True))]
        r, h = make(k), make(m)
        refs, hyps = refs + [(s, *t) for t in r], hyps + [(s, *t) for t in h]
        want[s] = brute_error(r, h)
    turns = "session_id long, run_id long, start double, end double, speaker int"
    got = scoring.error_rate(spark.createDataFrame(refs, turns).repartition(3), spark.createDataFrame(hyps, turns))
    assert {r.session_id: tuple(r)[1:5] for r in got.collect()} == want
    none = spark.createDataFrame([], turns)
    assert scoring.error_rate(none, none).count() == 0
    silent = scoring.error_rate(spark.createDataFrame(refs, turns), none).collect()
    assert all(r.correct == 0 and r.error_rate == 1 for r in silent if r.missed)


# --- streaming ------------------------------------------------------------------------


def plain_segments(flags, rule):
    """The rules of the segmenter, restated with lists."""
    out, before, seg, n = [], [], None, 0
    for f in flags:
        n += 1
        if seg is None:
            if f:
                seg, start, before = before + [f], n - 1 - len(before), []
            else:
                before = (before + [f])[-rule.before :]
            continue
        seg.append(f)
        quiet = len(seg) - max((i + 1 for i, x in enumerate(seg) if x), default=0)
        why = "silence" if quiet >= rule.silence else "soft_gap" if len(seg) >= rule.soft and not f else "max_len" if len(seg) >= rule.longest else None
        if why:
            out += [(start, n, why)] if len(seg) >= rule.least else []
            seg = None
    if seg and len(seg) >= rule.least:
        out.append((start, n, "flush"))
    return out


RULE = segmenter.Rule(before=2, silence=3, soft=8, longest=12, least=4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=80))
def test_segment_fold(flags):
    state, found = segmenter.EMPTY, []
    for f in flags:
        state, done = segmenter.fold(state, f, RULE)
        found += [done] if done else []
    rest = segmenter.flush(state, RULE)
    assert found + ([rest] if rest else []) == plain_segments(flags, RULE)


def frames_of(seed):
    rng = np.random.default_rng(seed)
    return [(s, i, bool(f)) for s in range(5) for i, f in enumerate(np.repeat(rng.random(40) < 0.6, rng.integers(1, 6, 40)))]


def test_segments_batch(spark):
    rows = frames_of(1)
    df = spark.createDataFrame(rows, "session_id long, frame long, is_speech boolean").repartition(3)
    got = sorted((r.session_id, round(r.start / 0.03), round(r.end / 0.03), r.reason) for r in segmenter.segments(df, RULE).collect())
    assert got == sorted((s, *x) for s in range(5) for x in plain_segments([f for k, _, f in rows if k == s], RULE))


def test_segments_stream_as_batch(spark, tmp_path):
    rows = pd.DataFrame(frames_of(2), columns=["session_id", "frame", "is_speech"])
    for part in range(3):
        cut = rows[(rows.frame // 40).clip(upper=2) == part]
        (tmp_path / "in").mkdir(exist_ok=True)
        cut.to_json(tmp_path / "in" / f"{part}.json", orient="records", lines=True)
        import os

        os.utime(tmp_path / "in" / f"{part}.json", (1e9 + part, 1e9 + part))
    stream = spark.readStream.schema("session_id long, frame long, is_speech boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = segmenter.stream_segments(stream, RULE, None).writeStream.format("memory").queryName("segments_seen").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.session_id, round(r.start / 0.03), round(r.end / 0.03), r.reason) for r in spark.table("segments_seen").collect()}
    want = {(s, *x) for s in range(5) for x in plain_segments(rows[rows.session_id == s].is_speech.tolist(), RULE) if x[2] != "flush"}
    assert got == want


def test_idle_sessions_end(spark, tmp_path):
    rows = pd.DataFrame([(7, k, True) for k in range(RULE.least + 5)], columns=["session_id", "frame", "is_speech"])
    (tmp_path / "in").mkdir()
    rows.to_json(tmp_path / "in" / "0.json", orient="records", lines=True)
    stream = spark.readStream.schema("session_id long, frame long, is_speech boolean").json(str(tmp_path / "in"))
    query = segmenter.stream_segments(stream, RULE, 1.0).writeStream.format("memory").queryName("idle_seen").outputMode("append").start()
    try:
        until = time.monotonic() + 60
        while not spark.table("idle_seen").count() and time.monotonic() < until:
            time.sleep(0.5)
        assert "flush" in {r.reason for r in spark.table("idle_seen").collect()}
    finally:
        query.stop()


def test_stitching(spark):
    rng = np.random.default_rng(0)
    own = np.linalg.qr(rng.normal(size=(16, 3)))[0].T
    rows = []
    for b in range(6):
        order = rng.permutation(3)
        rows += [(1, b, i, 2.0, (own[w] + 0.02 * rng.normal(size=16)).tolist(), int(w)) for i, w in enumerate(order)]
    df = spark.createDataFrame(rows, "session_id long, block long, local_speaker int, seconds double, embedding array<double>, who int").repartition(4)
    got = {(r.block, r.local_speaker): (r.identity, r.established) for r in stitching.stitch(df).collect()}
    assert len({(got[b, i][0], w) for _, b, i, _, _, w in rows}) == 3
    assert not any(got[0, i][1] for i in range(3)) and all(got[b, i][1] for b in range(1, 6) for i in range(3))


def mixed_voices(spark, plan, seed=3):
    """Windows (session, voice, number) of orthogonal voices with a little noise, 2 s each."""
    rng = np.random.default_rng(seed)
    own = np.linalg.qr(rng.normal(size=(16, 16)))[0].T
    rows, k = [], 0
    for session, voice, n in plan:
        for _ in range(n):
            rows.append((session, k, k * 0.75, k * 0.75 + 2.0, (own[voice] + 0.01 * rng.normal(size=16)).tolist(), voice))
            k += 1
    known = spark.createDataFrame([(s, v, own[v].tolist()) for s in {s for s, _, _ in plan} for v in (0, 1)], "session_id long, cluster int, embedding array<double>")
    return spark.createDataFrame(rows, "session_id long, window_id long, start double, end double, embedding array<double>, voice int"), known


def test_new_voices(spark):
    # Session 4 has many voices once each: far from all that is known, and from one another.
    once = [(4, v, 1) for v in range(2, 16)]
    rows, known = mixed_voices(spark, [(1, 0, 5), (1, 1, 5), (1, 2, 4), (2, 0, 5), (2, 2, 3), (3, 0, 5), (3, 1, 5), *once, (5, 3, 1)])
    got = {r.session_id: (r.path, r.windows) for r in discovery.discover(rows, known).collect()}
    assert got == {1: ("strict", 4), 2: ("short", 3)}


def test_greedy(spark):
    rows, _ = mixed_voices(spark, [(1, 0, 4), (1, 1, 4), (1, 0, 3), (1, 2, 4), (2, 5, 2), (2, 4, 2)])
    got = {r.window_id: r.cluster for r in discovery.greedy(rows).collect()}
    first: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.window_id):
        assert got[r.window_id] == first.setdefault((r.session_id, r.voice), got[r.window_id])
    assert first == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (2, 5): 0, (2, 4): 1}


@pytest.mark.parametrize(("source", "target"), [(48000, 16000), (44100, 16000), (8000, 16000)])
def test_resample(spark, source, target):
    x = np.sin(np.arange(50) / 3).tolist()
    df = spark.createDataFrame([(0, x), (1, []), (2, [1.0])], "key long, samples array<double>")
    got = {r.key: r.samples for r in discovery.resample(df, source, target).collect()}
    at = np.arange(int(50 // (source / target))) * (source / target)
    assert np.allclose(got[0], np.interp(at, np.arange(50), x)) and got[1] == []


def test_wav_round_trip(spark, tmp_path):
    pcm = np.arange(-500, 500, dtype=np.int16).tobytes()
    (row,) = discovery.wav_bytes(spark.createDataFrame([(bytearray(pcm),)], "pcm binary")).collect()
    (tmp_path / "a.wav").write_bytes(row.wav)
    (back,) = annotations.wav(spark, str(tmp_path)).collect()
    assert bytes(back.pcm) == pcm and back.seconds == 1000 / 16000


def test_messages(spark):
    row = spark.range(1).select(S.message("status", state=F.lit("live"), error=F.lit(None).cast("string")).alias("m"), S.id_parts(F.lit("no-id"))["at_ms"].alias("a"))
    assert [tuple(r) for r in row.collect()] == [('{"type":"status","state":"live"}', None)]


# --- tenancy, telemetry ---------------------------------------------------------------


def test_login_limit(spark):
    rng = np.random.default_rng(4)
    rows = [("k", float(t), i) for i, t in enumerate(np.sort(rng.random(200) * 3000))]
    recent, want = [], {}
    for _, t, i in rows:
        recent = [x for x in recent if t - x < 300]
        want[i] = len(recent) < 10
        recent += [t] * want[i]
    got = {r.attempt_id: r.allowed for r in tenancy.limit_logins(spark.createDataFrame(rows, "key string, at double, attempt_id long").repartition(3)).collect()}
    assert got == want and not all(want.values())


def test_percentiles_and_buckets(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(600)], "k string, i int, v double")
    r = telemetry.latest_percentiles(df, "k", "v", ["i"]).first()
    assert (r.n, r.p50, r.p99) == (512, 88.0 + round(0.5 * 511), 88.0 + round(0.99 * 511))
    got = ask(spark, ["0", "1", "4.9", "99", "-1"], telemetry.bucket(F.col("text").cast("double"), [0, 1, 2, 3, 5, 7, 99]))
    assert got == [("0-1",), ("1-2",), ("3-5",), (None,), (None,)]


# --- sources, sound -------------------------------------------------------------------


def test_annotations(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 0.5 2.0 <NA> <NA> ann <NA> <NA>\nSPEAKER f 1 x 2.0 <NA> <NA> bob <NA>\nLEXEME f 1 0 1\nSPEAKER f 1 3 1 <NA> <NA> bob <NA>\n")
    (tmp_path / "b.txt").write_text("# times\n0.0 4.0 Ann B\n4.0,8.5,Carl\n9\t12\tAnn B # late\nbad line here\n")
    got = sorted((r.file.rsplit("/", 1)[1], r.start, r.end, r.speaker) for r in annotations.annotations(spark, str(tmp_path)).collect())
    assert got == [("a.rttm", 0.5, 2.5, "ann"), ("a.rttm", 3.0, 4.0, "bob"), ("b.txt", 0.0, 4.0, "Ann B"), ("b.txt", 4.0, 8.5, "Carl"), ("b.txt", 9.0, 12.0, "Ann B")]


def test_manifest_logs_and_wav(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"scenarios": [{"id": "a", "true_speakers": 2}, {"id": "b", "true_speakers": 3}]}, indent=1))
    assert sorted((r.id, r.true_speakers) for r in annotations.manifest(spark, str(tmp_path / "m.json")).collect()) == [("a", 2), ("b", 3)]
    (tmp_path / "x.log").write_bytes(b"one\nt\xffwo\n")
    assert annotations.log_lines(spark, str(tmp_path / "x.log")).count() == 2
    (tmp_path / "wav").mkdir()
    for name, rate in (("good", 16000), ("other", 8000)):
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(b"\1\0" * 16000)
        (tmp_path / "wav" / f"{name}.wav").write_bytes(buffer.getvalue())
    (tmp_path / "wav" / "bad.wav").write_bytes(b"no sound")
    got = annotations.wav(spark, str(tmp_path / "wav")).collect()
    assert [(r.path.endswith("good.wav"), r.seconds, len(r.pcm)) for r in got] == [(True, 1.0, 32000)]


def test_gate(spark):
    got = {r.kind: r for r in signal.gate(signal.features(signal.tones(spark, 3))).collect()}
    assert got["silence"].verdict == "quiet" and got["chord"].verdict == "music" and got["voice"].music < got["chord"].music
    short = signal.measure(b"\0\1" * 100, 16000)
    assert not short["confident"] and signal.measure(None, 16000)["rms"] == 0.0


# --- the registry of a live session -----------------------------------------------------


def made_up_voices(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=dim) / 8
    return [v / np.linalg.norm(v) for v in 0.45 * common + rng.normal(size=(n, dim)) / 8]


def talk(spark, turns, seed=0, per_pass=3, jitter=0.5):
    """Windows of 2 s, one every 2 s, of the voice that each turn names."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, v in enumerate(turns):
        x = v + jitter * rng.normal(size=len(v)) / np.sqrt(len(v))
        rows.append((1, i // per_pass, i, 2.0 * i, 2.0 * i + 2.0, (x / np.linalg.norm(x)).tolist()))
    return spark.createDataFrame(rows, "session_id long, pass long, window_id long, start double, end double, embedding array<double>")


def last(df):
    return max(df.collect(), key=lambda r: r["pass"])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_registry_counts_speakers(spark, n):
    v = made_up_voices(n, n)
    got = sorted(registry.passes(talk(spark, [v[(i // 3) % n] for i in range(60)])).collect(), key=lambda r: r["pass"])
    assert got[-1].speakers == n and got[-1].action == "derive" and got[-1].established
    assert [r.action for r in got][1] in ("derive", "keep") and {"adapt"} <= {r.action for r in got}
    fixed = [r for r in got if r.established]
    assert all(set(a.voices) <= set(b.voices) or b.action in ("rederive", "derive") for a, b in zip(fixed, fixed[1:], strict=False))


def test_registry_forced_number(spark):
    v = made_up_voices(7, 3)
    for k in (1, 2, 3, 5):
        r = last(registry.passes(talk(spark, [v[(i // 4) % 3] for i in range(48)]), registry.Rules(expected=k)))
        assert r.speakers == k
    few = registry.passes(talk(spark, v[:2]), registry.Rules(expected=5))
    assert last(few).speakers == 2


def test_registry_new_voice_and_watchdog(spark):
    """A third voice after the registry stands: admitted as it comes, known under a key of its own, the old keys stay."""
    v = made_up_voices(9, 3)
    turns = [v[(i // 3) % 2] for i in range(30)] + [v[2]] * 12 + [v[i % 3] for i in range(12)]
    got = sorted(registry.passes(talk(spark, turns)).collect(), key=lambda r: r["pass"])
    before = next(r for r in got if r["pass"] == 9)
    assert before.speakers == 2 and got[-1].speakers == 3 and set(before.voices) < set(got[-1].voices)
    assert "rederive" in {r.action for r in got} and sum(r.action == "rederive" for r in got) <= 2


def test_registry_asks_and_fills():
    t = registry.Talk(registry.Rules(expected=3))
    assert t.asked(10, False) == 0 and t.asked(10, True) == 3 and t.asked(2, True) == 2
    t.figures.heard = 8.0
    assert t.asked(10, False) == 3
    x = np.eye(4)
    assert len(t.filled(x, x[:1], 3)) == 3 and len(t.filled(x[:1], x[:1], 3)) == 1


def test_registry_drops_small_clusters_and_remaps():
    """What a dropped cluster held goes to the nearest one that is left, and moves it."""
    t = registry.Talk(registry.Rules(most=2))
    x = np.vstack([np.tile(np.eye(4)[0], (6, 1)), np.tile(np.eye(4)[1], (5, 1)), V.unit(np.array([[0.1, 1.0, 0, 0.6]]))])
    t.sums, t.seconds, t.windows, t.first = x * 2.0, np.full(12, 2.0), np.ones(12, int), np.arange(12) * 2.0
    kept = t.survivors(x, np.vstack([np.eye(4)[:2], x[-1:]]))
    want = V.unit(np.vstack([x[:6].sum(0), x[6:].sum(0)]))
    assert np.allclose(kept, want)
    t.rules = registry.Rules(most=1)
    assert np.allclose(t.survivors(x, np.eye(4)[:2]), V.unit(x.sum(0, keepdims=True)))


def test_registry_remembers_groups_only():
    t = registry.Talk(registry.Rules(groups=8))
    rng = np.random.default_rng(0)
    for k in range(10):
        t.hear(rng.normal(size=(5, 4)), np.arange(5) * 2.0 + 10 * k, np.arange(5) * 2.0 + 10 * k + 2)
    assert len(t.sums) <= 8 and t.windows.sum() == 50 and t.seconds.sum() == pytest.approx(100) and t.figures.heard == pytest.approx(100)
    t.hear(np.ones((1, 4)), np.array([3.0]), np.array([5.0]))
    assert t.figures.heard == pytest.approx(100)  # a window from before isn't taken
    t.hear(np.ones((1, 4)), np.array([200.0]), np.array([200.5]))
    assert t.figures.heard == pytest.approx(100) and t.figures.latest == 200.0  # one that is too short isn't, either


def test_clusters_against_pairs():
    """Silhouette and separation from sums equal those from all pairs."""
    rng = np.random.default_rng(4)
    x, w, label = V.unit(rng.normal(size=(40, 5))), rng.uniform(0.5, 3, 40), rng.integers(0, 3, 40)
    d, total = 1 - x @ x.T, 0.0
    for i in range(40):
        mean = [np.average(d[i, m], weights=w[m]) for m in ((label == c) & (np.arange(40) != i) for c in range(3))]
        own, other = mean[label[i]], min(v for c, v in enumerate(mean) if c != label[i])
        total += w[i] * (other - own) / max(own, other)
    sums = V.Clusters.of(x, w, label, 3)
    assert sums.silhouette(x, w, label) == pytest.approx(total / w.sum())
    c = [V.unit((x[label == k] * w[label == k, None]).sum(0)) for k in range(3)]
    assert sums.closest == pytest.approx(min(1 - c[a] @ c[b] for a in range(3) for b in range(a)))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 4), st.integers(0, 4))
def test_gated_pairs(seed, n, m):
    """As many pairs as possible, then the cheapest, against all pairings."""
    cost = np.random.default_rng(seed).uniform(0, 1, (n, m))
    got = gated(cost, 0.5)
    options = [()]
    for r in range(n):
        options += [o + ((r, c),) for o in options for c in range(m) if cost[r, c] <= 0.5 and c not in {x[1] for x in o}]
    best = min(options, key=lambda o: (-len(o), sum(cost[r, c] for r, c in o)))
    assert len(got) == len(best) and sum(cost[r, c] for r, c in got.items()) == pytest.approx(sum(cost[r, c] for r, c in best))


SESSION_ROWS = "session_id long, pass long, window_id long, start double, end double, embedding array<double>"


def test_registry_as_stream(spark, tmp_path):
    """Micro-batches that cut passes in two, a restart from the checkpoint between them: the rows of the batch."""
    v = made_up_voices(9, 3)
    turns = [v[(i // 3) % 2] for i in range(30)] + [v[2]] * 12 + [v[i % 3] for i in range(12)]
    one = talk(spark, turns).toPandas()
    two = talk(spark, [v[(i // 3) % 3] for i in range(40)], seed=5).toPandas().assign(session_id=2)
    rows = pd.concat([one, two], ignore_index=True)
    want = sorted(map(repr, registry.passes(spark.createDataFrame(rows)).collect()))
    rows["part"] = (rows["start"] // 28).astype(int)
    end = pd.DataFrame([(s, None, None, None, None, None) for s in (1, 2)], columns=list(rows.columns[:6]))
    last_part = int(rows["part"].max())
    steps.use_rocksdb(spark)

    def run(parts):
        for p in parts:
            some = rows[rows["part"] == p].drop(columns="part")
            spark.createDataFrame([tuple(r) for r in some.itertuples(index=False)] + ([tuple(r) for r in end.astype(object).where(end.notna(), None).itertuples(index=False)] if p == last_part else []), SESSION_ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(SESSION_ROWS).parquet(str(tmp_path / "in"))
            query = registry.stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            assert query.awaitTermination(180) and query.exception() is None

    # Each run is a new query that goes on from the checkpoint.
    run(range(last_part + 1))
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).select(registry.COLUMNS).collect()))
    assert got == want and last_part >= 3


def test_registry_stream_ends_idle_sessions(spark, tmp_path):
    v = made_up_voices(9, 2)
    steps.use_rocksdb(spark)
    df = talk(spark, [v[(i // 3) % 2] for i in range(30)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(map(repr, registry.passes(df).collect()))
    source = spark.readStream.schema(SESSION_ROWS).parquet(str(tmp_path / "in"))
    query = registry.stream(source, idle_seconds=1.0).writeStream.format("memory").queryName("idle_registry").outputMode("append").start()
    try:
        until = time.monotonic() + 90
        while spark.table("idle_registry").count() < len(want) and time.monotonic() < until:
            time.sleep(0.5)
        assert sorted(map(repr, spark.table("idle_registry").collect())) == want
    finally:
        query.stop()


@pytest.mark.parametrize("parts", [1, 2, 3, 4])
def test_registry_count_never_falls(spark, parts):
    """Voices that come one after another are admitted, and none is lost by a live pass."""
    v = made_up_voices(20 + parts, parts)
    got = sorted(registry.passes(talk(spark, [x for x in v for _ in range(18)], per_pass=4)).collect(), key=lambda r: r["pass"])
    live = [r.speakers for r in got[:-1] if r.established]
    assert live == sorted(live) and got[-1].speakers == parts


# --- neighbours in blocks ---------------------------------------------------------------


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6))
    x[5] = x[6]
    rows = [(i % 2, i, v.tolist()) for i, v in enumerate(x)] + [(7, 500, [1.0] * 6)]
    df = spark.createDataFrame(rows, "session_id long, window_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    want = {(i, j) for i in range(90) for j in sorted((k for k in range(90) if k != i and k % 2 == i % 2), key=lambda k: (d[i, k], k))[:5]}
    for block in (1000, 8):
        got = vectors.nearest_neighbours(df, 5, block).collect()
        assert {(r.a, r.b) for r in got} == want and all(abs(r.distance - d[r.a, r.b]) < 1e-9 for r in got)


def test_speakers_label_every_window(spark):
    """More windows than are sampled: all get a speaker, the right one."""
    v = made_up_voices(3, 2)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1800):
        x = v[(i // 10) % 2] + 0.5 * rng.normal(size=64) / 8
        rows.append((1, i, 0.75 * i, 0.75 * i + 2, (x / np.linalg.norm(x)).tolist()))
    got = clustering.speakers(spark.createDataFrame(rows, "session_id long, window_id long, start double, end double, embedding array<double>")).collect()
    assert len(got) == 1800 and all(r.cluster == (r.window_id // 10) % 2 for r in got)


def test_write_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "x")], "run_id int, error string")
    records.write_json(rows, str(tmp_path / "runs"))
    assert sorted(line for f in (tmp_path / "runs").glob("part-*") for line in f.read_text().splitlines()) == ['{"run_id":1,"error":null}', '{"run_id":2,"error":"x"}']
