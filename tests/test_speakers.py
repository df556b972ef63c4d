"""Speakers of sessions end to end: how many there are, mixed windows, refinement, pruning and remapping against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from murmura.functions.voices import unit
from murmura.operators import clustering, vectors

SCHEMA = "session_id long, window_id long, start double, end double, embedding array<double>"


def made_up(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=dim) / 8
    return [v / np.linalg.norm(v) for v in 0.45 * common + rng.normal(size=(n, dim)) / 8]


def talk(session, turns, seed, jitter=0.5, length=2.0, hop=0.75):
    """Windows over turns (voice, seconds) without pauses: a window holds the voices in it by their share, and some noise."""
    rng = np.random.default_rng(seed)
    ends = np.cumsum([s for _, s in turns])
    rows, t = [], 0.0
    while t + length <= ends[-1] + 1e-9:
        shares = [max(0.0, min(t + length, e) - max(t, e - s)) for (_, s), e in zip(turns, ends, strict=True)]
        x = unit(sum(w * v for w, (v, _) in zip(shares, turns, strict=True)) / length)
        x = unit(x + jitter * rng.normal(size=len(x)) / np.sqrt(len(x)))
        who = int(np.argmax(shares))
        rows.append((session, len(rows), t, t + length, x.tolist(), who, max(shares) >= length - 1e-9))
        t += hop
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r[:5] for r in rows], SCHEMA)


def test_one_to_five_speakers(spark):
    """Sessions of one to five voices, and of six with room for four: each gets its number, each voice one label."""
    rows, truth = [], {}
    for n in (1, 2, 3, 4, 5):
        v = made_up(100 + n, n)
        turns = [(v[i % n], 9.0) for i in range(2 * n + 1)]
        mine = talk(n, turns, seed=n)
        rows += mine
        truth |= {(n, r[1]): r[5] % n for r in mine if r[6]}
    got = {(r.session_id, r.window_id): r.cluster for r in clustering.speakers(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for n in (1, 2, 3, 4, 5):
        assert {c for (s, _), c in got.items() if s == n} == set(range(n))
        pairs = pd.Series([(truth[k], got[k]) for k in truth if k[0] == n]).value_counts()
        best = {}
        for (a, b), m in pairs.items():
            best.setdefault(a, (b, m))
        assert sum(m for _, m in best.values()) >= 0.9 * pairs.sum()
    # Numbered by who is heard first.
    assert all(got[n, 0] == 0 for n in (1, 2, 3, 4, 5))


def test_no_more_than_the_cap(spark):
    v = made_up(150, 6)
    rows = talk(1, [(x, 8.0) for x in v], seed=3)
    assert clustering.speakers(frame(spark, rows), cap=4).select("cluster").distinct().count() <= 4


def test_mixed_windows_do_not_define_speakers(spark):
    """Three-second turns: the windows across changes are demoted, and the two voices are told apart."""
    a, b = made_up(171, 2)
    rows = talk(1, [(x, 3.0) for _ in range(14) for x in (a, b)], seed=5, jitter=0.35)
    df = frame(spark, rows)
    marked = {r.window_id: r.trusted for r in clustering.with_trust(df, clustering.change_points(df)).collect()}
    mixed = [r[1] for r in rows if not r[6]]
    assert sum(not marked[i] for i in mixed) >= 0.8 * len(mixed)
    assert sum(marked[r[1]] for r in rows if r[6]) >= 0.8 * sum(r[6] for r in rows)
    got = {r.window_id: r.cluster for r in clustering.speakers(df).collect()}
    assert set(got.values()) == {0, 1}
    pure = [(r[5] % 2, got[r[1]]) for r in rows if r[6]]
    assert sum(x == y for x, y in pure) >= 0.95 * len(pure)


def test_a_monologue_has_no_changes(spark):
    (a,) = made_up(5, 1)
    df = frame(spark, talk(1, [(a, 60.0)], seed=8, jitter=0.3))
    assert clustering.change_points(df).count() == 0
    assert clustering.with_trust(df, clustering.change_points(df)).filter("trusted").count() == df.count()


@pytest.mark.parametrize("points", [[0.5, 1.0, 3.0], [], [2.0]])
def test_trust_against_loops(spark, points):
    spans = [(0.75 * i, 0.75 * i + (2.0 if i % 4 else 1.0)) for i in range(12)]
    windows = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(spans)] + [(2, i, s, e) for i, (s, e) in enumerate(spans[:5])], "session_id long, window_id long, start double, end double")
    marks = spark.createDataFrame([(s, p) for s in (1, 2) for p in points], "session_id long, at double")
    got = {(r.session_id, r.window_id): r.trusted for r in clustering.with_trust(windows, marks).collect()}
    for s, n in ((1, 12), (2, 5)):
        pure = [e - b >= 1.8 and not (n >= 8 and any(b <= p < e for p in points)) for b, e in spans[:n]]
        want = pure if sum(pure) >= 2 else [e - b >= 1.8 for b, e in spans[:n]]
        assert [got[s, i] for i in range(n)] == want


def plain_round(x, w, cents, margin, outlier):
    """One round of refinement by hand."""
    d = np.round(1 - x @ cents.T, 9)
    label, best = d.argmin(1), d.min(1)
    gap = np.sort(d, 1)[:, 1] - best if len(cents) > 1 else np.ones(len(x))
    clear = (gap >= margin) & (best <= outlier)
    if clear.sum() < 2 * len(cents):
        return cents, label, clear
    return np.stack([unit((x[m] * w[m, None]).sum(0)) if (m := clear & (label == c)).any() else cents[c] for c in range(len(cents))]), label, clear


def test_refinement_and_remap_against_loops(spark):
    rng = np.random.default_rng(11)
    rows, start = [], {}
    for s in (1, 2, 3):
        v = unit(rng.normal(size=(4, 12)))
        n = 90 if s < 3 else 5  # the third has too few clear windows
        who = rng.choice(4, n, p=[0.5, 0.3, 0.18, 0.02])
        x = unit(v[who] + 0.5 * rng.normal(size=(n, 12)) / np.sqrt(12))
        rows += [(s, i, 2.0 * i, 2.0 * i + 1.8 + 0.2 * (i % 3), x[i].tolist()) for i in range(n)]
        start[s] = unit(v + 0.3 * rng.normal(size=(4, 12)))
    df = spark.createDataFrame(rows, SCHEMA)
    cents = spark.createDataFrame([(s, c, v.tolist()) for s, vs in start.items() for c, v in enumerate(vs)], "session_id long, cluster int, embedding array<double>")
    bands = spark.createDataFrame([(s, 0.03, 0.6) for s in (1, 2, 3)], "session_id long, ambiguous_margin double, outlier_max double")
    once = clustering.refined(df, cents, bands)
    got = {(r.session_id, r.cluster): np.array(r.embedding) for r in once.collect()}
    kept = {(r.session_id, r.cluster): np.array(r.embedding) for r in clustering.remapped(df, once, bands, least=4.0, share=0.05, few=3, cap=2).collect()}
    for s in (1, 2, 3):
        mine = [r for r in rows if r[0] == s]
        x, w = np.array([r[4] for r in mine]), np.array([r[3] - r[2] for r in mine])
        c = start[s]
        for _ in range(2):
            c, *_ = plain_round(x, w, c, 0.03, 0.6)
        assert all(np.allclose(got[s, k], c[k]) for k in range(4))
        _, label, clear = plain_round(x, w, c, 0.03, 0.6)
        seconds = [w[clear & (label == k)].sum() for k in range(4)]
        big = [k for k in range(4) if seconds[k] >= max(4.0, 0.05 * sum(seconds)) and (label == k).sum() >= 3] or [int(np.argmax(seconds))]
        big = sorted(sorted(big, key=lambda k: -seconds[k])[:2])
        want, *_ = plain_round(x, w, c[big], 0.03, 0.6)
        assert sorted(k for t, k in kept if t == s) == big and all(np.allclose(kept[s, k], want[i]) for i, k in enumerate(big))


def test_strides_of_sessions(spark):
    """2 s every 0.75 s is three on, 1.4 s two, windows that don't overlap one; a lone window has none to meet."""
    rows = [(s, i, h * i, h * i + n, [1.0, float(i % 2)]) for s, n, h in ((1, 2.0, 0.75), (2, 1.4, 0.75), (3, 1.0, 1.0), (4, 2.0, 0.5)) for i in range(9)] + [(5, 0, 0.0, 2.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.session_id: r.stride for r in vectors.strides(df).collect()} == {1: 3, 2: 2, 3: 1, 4: 4, 5: 1}
    curve = vectors.session_curve(df).groupBy("session_id").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max("distance").alias("d")).collect()
    got = {r.session_id: (r.n, round(r.at, 3), round(r.d, 3)) for r in curve}
    assert got == {1: (6, 2.125, 0.293), 2: (7, 1.45, 0.0), 3: (8, 1.0, 0.293), 4: (5, 2.0, 0.0)}
