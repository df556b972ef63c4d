"""Fill-in-middle, mixing and phrases against plain versions, and on the odd inputs: nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from murmura.llm import infill, mixing, phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def draw(*parts):
    return hashlib.sha256(":".join(parts).encode()).hexdigest()


def plain_infill(doc_id, text, unit=None):
    """The form, the two lengths and the output of one document."""
    text = text or ""
    units = [m[0] for m in re.finditer(f"{unit}|.", text, re.S)] if unit else list(text)
    h = draw("1", "" if doc_id is None else str(doc_id))
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    return "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def odd_texts():
    long = "ab\tcé \U0001f600\n" * 9000
    return [None, "", "x", "a\nb\r\n c", "\U0001f600é\U0001f601", "has <M> in it", "<P", long, "x" * 1024, "y" * 1025, " \t\n ", "tail \U0001f600"] + [f"text {i} of some words, more" for i in range(60)]


@pytest.mark.parametrize("unit", [None, r"\s*\S+", r"[a-z]{1,3}|\s"])
def test_infill_against_slices(spark, monkeypatch, odd_texts, unit):
    if unit:
        monkeypatch.setattr(infill, "RUN", 5)
    rows = [(i, t, 1, 2, "x", "y") for i, t in enumerate(odd_texts)] + [(7, "another text of one id", 0, 0, "", "")] * 3 + [(None, "no id", 0, 0, "", ""), (None, None, 0, 0, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int, size int, key string, prefix string").repartition(3)
    out = infill.transform(df, unit=unit or infill.CODE_POINT)
    got = Counter((r.doc_id, r.text, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == Counter((r[0], r[1] or "", *plain_infill(r[0], r[1], unit)) for r in rows)
    back = out.select("text", infill.restore(out["output"], out["form"]).alias("again")).collect()
    assert all(r.text == r.again for r in back)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}


def test_infill_of_nothing(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_mix(rows, weights=(1, 2, 3), most=3, worth=None):
    """(doc_id, source, size, target, taken) of rows (doc_id, source, size[, worth])."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full, total = set(), sum(size.values())
    while True:
        free = sum(weight[s] for s in sources if s not in full)
        rate = Fraction(total - sum(most * size[s] for s in full), free) if free else 0
        above = {s for s in sources if s not in full and rate * weight[s] > most * size[s]}
        if not above:
            break
        full |= above
    target = {s: most * size[s] if s in full else rate * weight[s] for s in sources}
    out = []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        value = [r[3] if worth else 1 for r in mine]
        # Each document's copies: in proportion to its worth, at most ``most``.
        top, m = set(), [Fraction(0)] * len(mine)
        while size[s]:
            free = sum(Fraction(v).limit_denominator(1000) * r[2] for i, (v, r) in enumerate(zip(value, mine, strict=True)) if i not in top)
            per = (target[s] - sum(most * mine[i][2] for i in top)) / free if free else 0
            m = [Fraction(most) if i in top else per * Fraction(v).limit_denominator(1000) for i, v in enumerate(value)]
            above = {i for i, x in enumerate(m) if x > most}
            if not above:
                break
            top |= above
        seen, part = Counter(), []
        for r, x in zip(mine, m, strict=True):
            seen[r[:3]] += 1
            p = int((x - int(x)) * 10**9)
            u = (int(draw("1", "" if r[0] is None else str(r[0]), str(seen[r[:3]]))[:13], 16) + 0.5) / 2.0**52
            q = p / 1e9
            rank = (u / (1 - u)) / (q / (1 - q)) if p else None
            part.append([r, int(x), p, (rank, r[0] is not None, r[0] or 0, seen[r[:3]]), False])
        sample, lacks = sum(x[2] * x[0][2] for x in part), 0
        for large in (True, False):
            stratum = sorted((x for x in part if x[2] and (x[0][2] * 256 * 10**9 > sample) == large), key=lambda x: x[3])
            goal, ahead = sum(x[2] * x[0][2] for x in stratum) + lacks, 0
            for x in stratum:
                x[4] = (2 * ahead + x[0][2]) * 10**9 <= 2 * goal
                ahead += x[0][2]
            lacks = goal - sum(x[0][2] * 10**9 for x in stratum if x[4])
        useful = [x for x in part if x[2] and x[4] == (lacks < 0) and 0 < x[0][2] * 10**9 < 2 * abs(lacks)]
        if useful:
            x = min(useful, key=lambda x: (abs(x[0][2] * 10**9 - abs(lacks)), x[3]))
            x[4] = not x[4]
        out += [(x[0][0], s, x[0][2], float(target[s]), (x[1] + x[4]) * x[0][2]) for x in part]
    return out


@pytest.fixture(scope="module")
def to_mix():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        source = [None, "a", "b", "cé", "\U0001f600", "Z", "hot"][int(rng.integers(0, 6))] if i % 3 else "hot"
        size = int(rng.integers(0, 30)) if i % 29 else 900
        rows.append((i if i % 50 else None, source, size, float(rng.integers(0, 5)) / 2))
    return rows + [(7, "b", 11, 1.0)] * 5 + [(9, "tiny", 1, 1.0), (10, "empty", 0, 1.0)]


def compared(got, want):
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[4])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3], rel=1e-12)


@pytest.mark.parametrize("worth", [None, "w"])
def test_mix_against_a_plain_version(spark, to_mix, worth):
    rows = [(d, s, " ".join(["w"] * n), v, 1, "x") for d, s, n, v in to_mix]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, w double, n int, target string").repartition(4)
    out = mixing.mix(df, worth=worth).collect()
    got = [(r.doc_id, r.source, r.size, r.target, r.taken) for r in out]
    compared(got, plain_mix(to_mix, worth=worth))
    assert all(r.taken <= 3 * r.size for r in out)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(sum(r.size for r in out))


def test_mix_comes_near_its_targets(spark, to_mix):
    df = spark.createDataFrame([(d, s, " ".join(["w"] * n)) for d, s, n, _ in to_mix], "doc_id long, source string, text string")
    out = mixing.mix(df).collect()
    for source in {r.source for r in out}:
        mine = [r for r in out if r.source == source]
        # Documents are taken whole: with two of 900 words among few small ones no choice comes nearer.
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(1, 0.01 * mine[0].target, max(r.size for r in mine) / 4)
    assert sorted(out, key=str) == sorted(mixing.mix(df.repartition(7)).collect(), key=str)


def test_mix_draws_by_inclusion_odds(spark):
    """Over many seeds a document is taken about as often as its worth says."""
    rows = [(i, "s", "w w w w", 0.5 if i % 2 else 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, v double")
    found = mixing.mix(df.withColumn("v", df.v), worth="v", most=3).collect()
    taken = {odd: sum(r.taken for r in found if r.doc_id % 2 == odd) / (4 * 200) for odd in (0, 1)}
    assert taken[0] == pytest.approx(1.5, abs=0.1) and taken[1] == pytest.approx(0.5, abs=0.1)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "a", ""), (None, "a", " \n")], "doc_id long, source string, text string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


def plain_phrases(rows, rules):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, rules.longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = words[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= rules.least}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        for p, a in candidates.items():
            score, k = min((rules.scale * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < rules.percent * a:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[: rules.top])]
    return out


@pytest.fixture(scope="module")
def talk():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "en", "de", "a", "b", "café", "\U0001f600", "x1", "|", "the's", "Rare"] + [f"w{i}" for i in range(30)]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(120):
        w = rng.choice(vocabulary, int(rng.integers(0, 60)), p=share / share.sum())
        text = "".join(x + str(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " New York "])) for x in w)
        rows.append(([None, "en", "de", "und"][i % 4], text))
    return rows + [("en", None), ("de", ""), ("fr", "a a a a a a a a a a a"), ("fr", "a b a b a b a b a b a b a b"), ("de", "the of " * 400), (None, "same row"), (None, "same row"), (None, "Same ROW")]


@pytest.mark.parametrize(
    "rules",
    [
        phrases.Mining(least=3),
        phrases.Mining(least=2, hot=4, block=64, most=256, bucket=50),
        phrases.Mining(least=3, hot=1 << 40, most=40),
        phrases.Mining(least=4, percent=80, top=7),
        phrases.Mining(least=2, shortest=3, longest=4),
    ],
)
def test_phrases_against_plain_counts(spark, talk, rules):
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in talk], "lang string, text string, n int, phrase string").repartition(5)
    got = [tuple(r) for r in phrases.collocations(df, rules).collect()]
    if rules.shortest == 2:
        assert sorted(got) == sorted(plain_phrases(talk, rules))
    else:
        want = {(r[0], r[2]): r[3] for r in plain_phrases(talk, phrases.Mining(least=2, longest=4, percent=10**9))}
        assert got and all(want[r[0], r[2]] == r[3] and 3 <= len(r[2].split(" ")) <= 4 for r in got)


def test_phrases_score_beyond_64_bits(spark):
    p = spark.createDataFrame([("x", "a b", 3 * 10**12)], "lang string, phrase string, n long")
    w = spark.createDataFrame([("x", "a", 4 * 10**12), ("x", "b", 5 * 10**12 + 1)], "lang string, word string, n long")
    t = spark.createDataFrame([("x", 10**15 + 7)], "lang string, total long")
    (r,) = phrases.scored(p, w, t, phrases.Mining()).collect()
    assert r.score == 1000 * (3 * 10**12) * (10**15 + 7) // (4 * 10**12 * (5 * 10**12 + 1))


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0
