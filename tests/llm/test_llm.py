"""Each operator against a brute-force version of it, and on the odd inputs: nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmura.llm import chat, decontaminate, html_text, licenses, near_dedup, passages, pieces, quality, shards, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "the cat and the dog went to the house of the man that was in it for a day with this one or that one by the river as on all days".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(PROSE) + ("".join(rng.choice(list("abcdefgh"), 3)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    changed = base.split()
    changed[60] = "other"
    passage = prose(2, 130)
    return [
        base, base, " ".join(changed), base.upper(), None, "", "  \t ", "one", "One", "one two", prose(3, 5), passage + " " + prose(4, 60), prose(5, 60) + "\n" + passage, "x" * 900, "é" * 500, prose(6, 4000),
        "line\nline\n\nline\nother", "Licensed under the MIT License. mit license mit license CC BY 4.0", "SPDX-License-Identifier: GPL-2.0-only; GNU General Public License version 2 or later",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("source", "slot").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    comp = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sets, comp


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, words, percent):
    sets, comp = components(texts, words, percent)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, near_dedup.Near(words, percent)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_near_duplicates_odd_ids(spark, none):
    assert near_dedup.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_near_duplicates_keep_columns(docs):
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} >= {0, 4, 5, 6} and 1 not in {r.doc_id for r in out.collect()}


def test_pipeline_keeps_one_of_repeated_rows(spark):
    """Rows with one doc_id and text, or null ids, leave one row; the stage after doesn't erase it."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{k}{i}word" for i in range(90)) for k in "abcd")
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, c), (2, c), (None, c), (3, c), (4, d), (4, b), (4, ""), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = corpus_pipeline.one_of_each_group(spark, df, "")
    got = Counter(map(tuple, one.collect()))
    assert got == Counter([(1, a), (2, c), (4, d), (4, b), (4, ""), (None, None), (None, None)])
    assert Counter(map(tuple, corpus_pipeline.without_repeats(spark, one, "").collect())) == got


def test_blocks_of_a_long_list(spark, monkeypatch):
    """Lists in many blocks give the same links as in one."""
    words = prose(9, 200).split()
    rows = []
    for i in range(60):
        w = words[:]
        for k in range(i % 7):
            w[(i * 13 + k * 29) % 200] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = near_dedup.Near(3, 85)
    one = sorted(map(tuple, near_dedup.near_duplicates(df, near).collect()))
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 9)
    assert sorted(map(tuple, near_dedup.near_duplicates(df, near).collect())) == one
    _, comp = components([t for _, t in rows], 3, 85)
    assert {r[0]: r[2] for r in one} == comp


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 30), (50, 50)] + [(100 + i, 99) for i in range(30)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {31: 30, 40: 30} | {100 + i: 99 for i in range(30)}


# --- repeated passages ----------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[: len(r)]).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, texts):
    got = {r[0]: tuple(r)[1:] for r in passages.digests(passages.repeats(docs)).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))


def test_repeats_go_from_400_bytes_on(spark):
    """Passages of over 50 words that stand in two documents: one of 399 bytes stays, one of 400 goes, clean documents are left alone."""
    rng = np.random.default_rng(8)
    own = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n))
    short, long = ("é" + own(60)[: n - 2] for n in (399, 400))
    assert [(len(p.encode()), len(p.split()) > 50) for p in (short, long)] == [(399, True), (400, True)]
    texts = [f"{own(30)}({p}){own(30)}" if k else f"[{p}]{own(40)}" for p in (short, long, own(60)) for k in (0, 1)]
    texts[-1] = own(90)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.digests(passages.repeats(df)).collect()}
    left = [t.replace(long, "") for t in texts]
    gone = [0, 0, 400, 400, 0, 0]
    assert got == {i: (len(t.encode()), gone[i], int(gone[i] > 0), hashlib.sha256(left[i].encode()).hexdigest()) for i, t in enumerate(texts)}


def test_repeats_counted_and_small(spark, none, monkeypatch):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcd"), 3)) for _ in range(8)]
    many = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)] + ["aaaa" * 20, "abab" * 20]
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    rule = passages.Repeat(length=32, gram=8)
    want = dict(enumerate(brute_repeats(many, 32)))
    assert {r[0]: tuple(r)[1:] for r in passages.digests(passages.repeats(df, rule)).collect()} == want
    monkeypatch.setattr(passages, "MOST", 2)
    monkeypatch.setattr(passages, "AT_ONCE", 64)
    assert {r[0]: tuple(r)[1:] for r in passages.digests(passages.repeats(df, rule)).collect()} == want
    assert passages.repeats(none).count() == 0


def test_pipeline_cuts_passages_of_51_words(spark):
    """Short words, under 400 bytes, other white space between them; 50 words stay, and so do clean documents."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), n))
    own = lambda n: " ".join(word(9) for _ in range(n))
    for size in (1, 3):
        passage, short = [word(size) for _ in range(51)], [word(size) for _ in range(50)]
        a, b, c, d = own(40), own(30), own(20), own(70)
        texts = [f"{a} {' '.join(passage)} {b}", f"{c}\n{chr(10).join(passage)}", f"{own(9)} {' '.join(short)} {own(9)}", f"{' '.join(short)} {own(9)}", d, None]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, df, "").collect()}
        assert got == dict(enumerate([f"{a}  {b}", f"{c}\n", *texts[2:]]))


def test_repeats_cut_whole_characters(docs, texts):
    out = passages.drop_repeats(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns
    assert 0 not in rows and 1 not in rows and rows[4].text is None and rows[5].text == ""
    assert all(r.n_chars == len(r.text or "") for r in rows.values())
    assert rows[13 + 2].text == texts[15]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=4))
def test_bucket_refinement(parts):
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    sizes = np.array([len(p) for p in parts if p], np.int64)
    seen = Counter(p[i : i + 8] for p in parts for i in range(len(p) - 7))
    want = [i + 8 <= len(p) and seen[p[i : i + 8]] > 1 for p in parts for i in range(len(p))]
    if len(data):
        assert passages.repeated_windows(data, sizes, passages.Repeat(8, 2)).tolist() == want


# --- quality --------------------------------------------------------------------------


def test_quality(docs, texts, none):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(k) for k in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert got[0].kept and not got[13].kept
    assert quality.quality(none).count() == 0
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {i for i, r in got.items() if r.kept}


def test_quality_held_out(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{data}/documents.parquet")).join(labels, "doc_id").filter("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.05


def test_quality_references(spark):
    """The references against plain medians and means over the same documents."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()
    got = quality.references(spark.createDataFrame(rows, "text string, lang string"), quality.Limits(prior_docs=0, least_share=0.0))
    kinds = [lambda c: c.islower() or ord(c) > 127, str.isupper, str.isdigit, lambda c: c in " \t\n\v\f\r", lambda c: c in ".,;:!?'\"()-"]
    for k, name in enumerate(got.languages[:4]):
        shares, words = [], []
        for r in (r for r in rows if r.lang == name):
            w = WORD.findall(r.text)
            grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            repeated = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            if len(w) < 40 or len(r.text) < 80 or 100 * len(repeated) > 30 * len(w):
                continue
            found = [next((i for i, f in enumerate(kinds) if f(c)), 5) if ord(c) < 128 else 0 for c in r.text]
            shares.append(np.bincount(found, minlength=6) / len(found))
            low = [x.translate(LOWER)[: -1 if x[-1] in ".,;:!?" else None] for x in w]
            words.append(sum(x in quality.COMMON_WORDS[name].split() for x in low) / len(low))
        median = np.median(np.array(shares), 0)
        assert np.abs(got.classes[k] - median / median.sum()).max() < 2e-3
        assert 1 - got.words[k][-1] == pytest.approx(np.mean(words))


def test_quality_other_languages(spark, none):
    """Clean text in a language or script without a reference stays, and so does text of a language that the table itself measures."""
    rng = np.random.default_rng(0)
    make = lambda letters, n=120: " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(n)) + "."
    russian, junk = "абвгдежзиклмнопрст", "ab cd### $$$ 12 %%% &&& " * 3
    chinese = " ".join("".join(rng.choice(list("一二三四五六七八九十百千天地人"), 9)) for _ in range(60))
    rows = [(0, make(russian), "ru"), (1, make(russian), None), (2, chinese, "zh"), (3, make("abcdefghij"), "xx"), (4, "".join(f"x{i}### $$$ %%% " for i in range(60)), "en"), (5, prose(3, 200), "ru"), (6, None, None), (7, make(russian), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {0, 1, 2, 3, 5, 7}
    many = spark.createDataFrame([(100 + i, make(russian), "ru") for i in range(120)], df.schema)
    odd = spark.createDataFrame([(8, "".join(f"ж{i} ### 77 $$$ %%% " for i in range(60)), "ru")], df.schema)
    both = many.unionByName(odd).unionByName(df)
    assert "ru" in quality.references(both).languages
    assert {r.doc_id for r in quality.keep_good(both).collect()} == {0, 1, 2, 3, 5, 7, *range(100, 220)}
    assert quality.keep_good(none).count() == 0 and quality.references(none).languages == tuple(quality.COMMON_WORDS)
    bare = df.select("doc_id", "text").withColumn("kept", quality.F.lit(1)).withColumn("classes", quality.F.lit("x"))
    assert quality.keep_good(bare).columns == bare.columns


def test_js_distance():
    p = np.array([[1, 0], [1, 1], [0, 0]])
    assert quality.js_distance(p, np.array([0.5, 0.5]))[1:].tolist() == [0, 1]
    assert 0 < quality.js_distance(p, np.array([0.5, 0.5]))[0] < 1


# --- licenses -------------------------------------------------------------------------


def test_licenses(docs, texts):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate(LOWER))
        hits = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None)
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[17].n_base == 4 and "cc-by-4.0" in got[17].labels.split(",")
    assert got[18].labels == "gpl,gpl-2.0-only,gpl-2.0-or-later"


def brute_scan(text):
    """Labels and score by plain loops over the rules: all places, those inside another of the same or a higher priority left out."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    padded = " " + " ".join(word.findall((text or "").translate(LOWER))) + " "
    places = set()
    for priority, label, keyword, expression in licenses.rules():
        if keyword in padded:
            places |= {(m.start(), m.end(), priority, label) for m in re.finditer(f"(?<= )(?:{expression})(?= )", padded)}
    kept = [p for p in places if not any(q[0] <= p[0] and q[1] >= p[1] and q[2] >= p[2] and q[:3] != p[:3] for q in places)]
    # Equal places of equal priority keep the first label by name.
    labels = {min(q[3] for q in kept if q[:3] == p[:3]) for p in kept}
    labels |= {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in padded}
    covered = set().union(*(range(p[0], p[1]) for p in kept)) if kept else set()
    return ",".join(sorted(labels)), min(1.0, len(covered) / max(1, len(padded) - 2))


def test_license_labels_and_score(spark, texts, small):
    own = ["apache license version 2.0", "cc by-nc 4.0 and CC BY", "GNU General Public License version 3 or any later version", "gpl v2 gpl-2.0", "x" * 50_000 + " MIT license", "", None, "mit license mit mit license", "SPDX-License-Identifier: CC-BY-SA-4.0"]
    some = own + texts + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumn("labels", licenses.F.lit("mine")).repartition(4)
    for r in licenses.scan(df).collect():
        labels, score = brute_scan(some[r.doc_id])
        assert (r.labels, r.score) == (labels, pytest.approx(score)), some[r.doc_id][:200]
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_suppression(spark):
    """A short detection inside a longer one of its priority or higher is suppressed; base labels stay."""
    df = spark.createDataFrame([(0, "apache license version 2.0"), (1, "cc by-nc 4.0"), (2, "gnu gpl")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == {0: "apache,apache-2.0", 1: "cc-by,cc-by-nc-4.0", 2: "gpl"}


# --- urls -----------------------------------------------------------------------------

URLS = ["http://A.Example.net/en/x?y", "http://example.net", "https://net/", "x", None, "", "http://m.example.com/de/1#t", "http://www.example.org/fr/9", "http://spam.org/fr/", "ftp://sub.spam.org/q", "a://b.net://c/en/"]


def brute_verdict(url, rules, own):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)

    def best(some):
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in some if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else None

    a, b = best(rules), best(own)
    return host, path, a and a[0], a[1] if a else b[1] if b else "allow"


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_BYTES", most)
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, rule int")
    own = [("spam.org", "", "block")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.BASE_RULES, own).collect()}
    assert got == {i: brute_verdict(u, urls.BASE_RULES, own) for i, u in enumerate(URLS)}


def test_digest_collisions(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: len(s))
    d = urls.DigestArray({"ab": "1", "cd": "2", "efg": "3"})
    assert [d.values[k] if k >= 0 else None for k in d.find(["cd", "ab", "xy", "efg"])] == ["2", "1", None, "3"]
    assert urls.DigestArray({}).find(["a"]).tolist() == [-1]


# --- shards ---------------------------------------------------------------------------


def test_shards(docs, texts, none, spark):
    rows = docs.unionByName(docs.filter("doc_id = 2")).unionByName(docs.filter("doc_id = 3").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "slot", "n_chars"))
    got = shards.assign(rows, [1.0] * 24).collect()
    assert len(got) == len(texts) + 2
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.assign(none, [1.0] * 24).count() == 0


def test_shards_grow_and_weights(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    a = {r.doc_id: (r.shard, r.grown_shard) for r in shards.assign(df, [1.0] * 24).collect()}
    assert all(g in (s, 24) for s, g in a.values())
    assert abs(sum(g == 24 for _, g in a.values()) / 20000 - 1 / 25) < 0.006
    sizes = Counter(s for s, _ in a.values())
    assert max(sizes.values()) < 1.2 * 20000 / 24 and min(sizes.values()) > 0.8 * 20000 / 24
    b = {r.doc_id: r.shard for r in shards.assign(df, [3.0] + [1.0] * 23).collect()}
    assert all(b[k] == s or (s < 8) == (b[k] < 8) or b[k] < 8 for k, (s, _) in a.items())  # moves only into the region that grew
    assert sum(s == 0 for s in b.values()) > 2 * sizes[0]


# --- chat -----------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("\\<|[]/INSTs>turnend \n"), max_size=30), min_size=1, max_size=6))
def test_escape_round_trip_model(parts):
    """The rule of the escape, restated: doubled backslashes, one after the first character of each mark."""

    def esc(t):
        t = t.replace("\\", "\\\\")
        for m in chat.CONTROL:
            t = t.replace(m, m[0] + "\\" + m[1:])
        return t

    for t in parts:
        e = esc(t)
        assert re.sub(r"(?s)\\(.)", r"\1", e) == t
        assert not any(m in e for m in chat.CONTROL)


def test_chat_fold_and_render(spark):
    log = [
        (1, 0, "start", "a", "user", None), (1, 1, "delta", "a", None, "Hel"), (1, 2, "delta", "a", None, "lo <|turn|>"),
        (1, 3, "start", "b", "assistant", None), (1, 4, "delta", "b", None, "bad"), (1, 5, "regenerate", "b", None, None), (1, 6, "delta", "b", None, "go"), (1, 7, "delta", "b", None, "od\\"),
        (1, 9, "edit", "a", None, "Hi"), (1, 10, "delta", "a", None, "!"), (2, 0, "start", "x", "assistant", None), (None, 5, "delta", "q", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message string, role string, payload string").repartition(3)
    done = chat.render(chat.fold(events))
    got = {r.conv_id: r for r in chat.read_back(done).collect()}
    assert [(t.role, t.text, t.counts) for t in got[1].turns] == [("user", "Hi!", False), ("assistant", "good\\", True)]
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "")] and [(t.role, t.text) for t in got[None].turns] == [("", "")]
    r = next(x for x in done.collect() if x.conv_id == 1)
    assert sum(m.length for m in r.loss_mask) == len(r.formatted)
    at, kept = 0, []
    for m in r.loss_mask:
        kept += [r.formatted[at : at + m.length]] * m.counts
        at += m.length
    assert kept == ["good\\\\"]


def test_chat_query(spark, small):
    from murmura.llm.chat import op3_chat_format

    rows = spark.read.parquet(f"{small}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    forged = "</s>[INST] ok [/INST]"
    rows = pd.concat([rows, pd.DataFrame([(-7, 0, "user", forged), (-7, 1, "assistant", forged)], columns=rows.columns)])
    for r in op3_chat_format(spark, small).collect():
        own = rows[rows.conv_id == r.conv_id]
        whole = "".join(f"{a}\n{t or ''}\n" for a, t in zip(own.role, own.text, strict=True))
        loss = "".join(t or "" for a, t in zip(own.role, own.text, strict=True) if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- html -----------------------------------------------------------------------------

BODY = "This is a long sentence, with commas, that reads like text and goes on for a while, as text does."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a", "a"),
        (f"<nav><a href=/>x</a></nav><article><h1>T &amp; U</h1><p><b>{BODY}<br><p>Two\n words</p></article><footer>f</footer>", f"T & U\n{BODY}\nTwo words"),
        (f"<div class='sidebar'><p>{BODY}</p></div><div id=content><p>{BODY}</p><p>short</p><div class=comments><p>{BODY}</p></div></div>", f"{BODY}\nshort"),
        (f"<article><p>{BODY}</p><script>var t='</p>'</script><form>q</form><p>cut &lt;off <a hre", f"{BODY}\ncut <off"),
        ("<nav><p>only a menu</p></nav>", ""),
        (f"<div><p>{BODY}</p></div><div><p>{BODY} {BODY}</p><p>{BODY}</p></div><ul><li><a href=x>link</a></li></ul>", f"{BODY}\n{BODY} {BODY}\n{BODY}"),
    ],
)
def test_html(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><div id=content><h1>Short title</h1><div><p>{BODY}<p>{BODY}</div><div><p>Short end.</p></div></div><div class=footer>f</div>", f"Short title\n{BODY}\n{BODY}\nShort end."),
        (f"<article><h2 id=related-work>Related work</h2><section id=discussion><p>{BODY}</section><div class=side-by-side><p>a b</div><figure><figcaption>A picture</figcaption></figure></article>", f"Related work\n{BODY}\na b\nA picture"),
        (f"<body><div class=row><div class=left><a href=x>menu one</a> <a href=y>menu two</a></div><div class=mid><p>{BODY}<p>{BODY}</div></div>", f"{BODY}\n{BODY}"),
        (f"<main><p>{BODY}<div class='comments-area'><p>{BODY}</div><div id=related><p>x</div><div class='cookie-notice'>c</div><div role=search>s</div></main>", BODY),
        (f"<body><div class=part><p>{BODY}</div><div class=part><p>{BODY}</div>", f"{BODY}\n{BODY}"),
        ("<div>" * 3000 + f"<p>{BODY}" + "</div>" * 3000, BODY),
        (f"<article>{'<blockquote>' * 2000}<p>{BODY}</article>", BODY),
        ("<article><p>tie, a<p>tie, b</article><article><p>tie, c<p>tie, d</article>", "tie, a\ntie, b"),
    ],
)
def test_html_whole_article(html, want):
    assert html_text.main_text(html) == want


class Plain(HTMLParser):
    """The text of articles by the standard library's parser; what stands in elements of ``OUT`` is left out."""

    OUT = {"script", "style", "nav", "footer", "header", "form"}
    INLINE = {"a", "b", "i", "em", "strong", "span"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out += tag in self.OUT
        self.blocks[-1] += " " if tag == "br" else ""
        if tag not in self.INLINE | {"br"}:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.blocks.append("")
        self.inside -= tag == "article"
        self.out -= tag in self.OUT

    def handle_data(self, data):
        if self.inside and not self.out:
            self.blocks[-1] += data


def test_html_against_another_parser(spark, small):
    """The whole table, whose pages all have an article."""
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{small}/../sf0.01/pages.parquet").collect()}
    for r in html_text.op4_html_text(spark, f"{small}/../sf0.01").collect():
        plain = Plain()
        plain.feed(rows[r.page_id] or "")
        plain.close()
        assert r.text == "\n".join(filter(None, (" ".join(x.split()) for x in plain.blocks)))


def test_html_columns(spark):
    """Repeated rows, names that clash with the output's, and a long page."""
    rows = [(1, "u", f"<p>{BODY}", "mine"), (1, "u", f"<p>{BODY}", "mine"), (None, None, None, None), (2, "v", "<article>" + f"<p>{BODY}</p>" * 20_000, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got[:3]) == [(0, None, "", 0), (1, "u", BODY, len(BODY)), (1, "u", BODY, len(BODY))]
    assert got[3].text == "\n".join([BODY] * 20_000)


def test_html_pages(spark, small):
    got = html_text.op4_html_text(spark, small).collect()
    assert all(r.n_chars == len(r.text) for r in got) and all("track(" not in r.text and "©" not in r.text for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- decontamination ------------------------------------------------------------------


def brute_edits(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [row[0] + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=20))
def test_edits(pattern, text):
    assert decontaminate.edits_within(pattern, text)[0] == brute_edits(pattern, text) == least_edits(pattern, text)


def test_leaks_recall(spark, small):
    """Items planted with edits in a fifth of their words are found; clean documents are left alone."""
    rng = np.random.default_rng(3)
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = bench.toPandas()
    rows = []
    for k, t in zip(items.item_id, items.text, strict=True):
        w = re.findall(r"\w+", t.upper())
        for _ in range(int(0.2 * len(w))):
            w[rng.integers(len(w))] = "edited"
        rows.append((int(k), prose(int(k), 40) + " " + ", ".join(w) + " " + prose(int(k) + 1000, 40)))
        rows.append((10_000 + int(k), prose(int(k) + 2000, 80)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    want = {(int(k), int(k)) for k in items.item_id}
    assert len(got & want) >= 0.9 * len(want) and not {d for d, _ in got} - {d for d, _ in want}
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == {r[0] for r in rows} - {d for d, _ in got}


@pytest.mark.parametrize("length", [8, 10, 15, 30, 70])
@pytest.mark.parametrize("kind", ["substitute", "insert", "delete", "mixed"])
def test_leaks_recall_by_length(length, kind):
    """A fifth of an item's words edited in each of the three ways, or in all: 0.9 at least are found."""
    rng = np.random.default_rng(length)
    vocabulary = [f"w{i}" for i in range(30_000)]
    items = [list(rng.choice(vocabulary, length)) for _ in range(60)]
    index = decontaminate.Items([" ".join(x) for x in items], decontaminate.Lsh())
    found = 0
    for k, item in enumerate(items):
        w = list(item)
        for e in range(int(0.2 * length)):
            at, how = rng.integers(len(w)), kind if kind != "mixed" else ["substitute", "insert", "delete"][e % 3]
            w[at : at + (how != "insert")] = [] if how == "delete" else [f"edit{e}"]
        data = np.frombuffer(" ".join([*rng.choice(vocabulary, 30), *w, *rng.choice(vocabulary, 30)]).encode(), np.uint8)
        hashes, row = decontaminate.words(data, np.zeros(1, np.int64), np.array([len(data)]))
        found += k in {item for _, item, *_ in index.leaks(hashes, row)}
    assert found >= 0.9 * len(items)


def least_edits(a, b):
    """The same as ``brute_edits``, a row of the table at a time."""
    b, steps = np.array(b, object), np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, int)
    for x in a:
        new = np.concatenate([[row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


LEAK_WORD = re.compile(r"[\u3040-\u9fff\u0e00-\u0e7f]|[a-z0-9à-öø-ÿ]+")


def brute_leaks(texts, items):
    """(document, item, edits): all pairs, by edit distance over whole texts; short items word for word."""
    out = set()
    items = [(k, LEAK_WORD.findall((x or "").lower())) for k, x in items]
    for i, t in enumerate(texts):
        w = LEAK_WORD.findall((t or "").lower())
        for k, p in items:
            if not p:
                continue
            edits = least_edits(p, w) if len(p) >= 8 else 0 if any(w[j : j + len(p)] == p for j in range(len(w))) else 1
            if edits <= (int(0.2 * len(p)) if len(p) >= 8 else 0):
                out.add((i, k, edits))
    return out


def test_leaks_against_brute_force(spark, small):
    """Whole tables of the small data, with short items and a script without spaces besides."""
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    docs = [t for t in docs if len(t) < 3000] + ["Er sagte: YES, two-words!", "no two words here, two", "一二三四五六七八九十。", "x 一二三四五X六七八九十 y", None, "ÄRGER und Ärger"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items += [(901, "yes"), (902, "two words"), (903, "一二三四五六七八九十"), (904, "…"), (905, None), (906, "ärger UND ärger"), (907, "三四")]
    got = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == brute_leaks(docs, items)


def test_leaks_edges(spark, none, docs, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, prose(1, 120)), (4, prose(1, 120)), (5, prose(6, 3000))], "item_id long, text string")
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    want = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    assert [(d, i) for d, i, *_ in want] == [(0, 4), (0, 4), (1, 4), (1, 4), (2, 4), (2, 4), (3, 4), (3, 4), (15, 5)]
    monkeypatch.setattr(decontaminate, "MOST_CHARS", 8000)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect())) == want
    odd = docs.selectExpr("doc_id AS item_id", "text", "doc_id", "'x' AS edits", "1 AS spans")
    kept = decontaminate.drop_leaks(odd, bench.selectExpr("CAST(item_id AS STRING) AS item_id", "text"))
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == set(range(4, 19)) - {15}
    assert {r.item_id for r in decontaminate.find_leaks(docs, bench.selectExpr("CAST(item_id AS STRING) AS item_id", "text")).collect()} == {"4", "5"}


# --- SentencePiece --------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.load_model(pieces.MODEL))


def encode(model, some):
    import pyarrow as pa

    data, starts, ends = pieces.text_view(pa.array(some, pa.string()))
    ids, counts = model.encode(data, starts, ends)
    raw, sizes = model.decode(ids, counts)
    assert sizes.tolist() == (ends - starts).tolist() and raw.tobytes() == data.tobytes()
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="▁\0"), max_size=80), min_size=1, max_size=5))
def test_pieces_as_the_library(model, some):
    import sentencepiece as sp

    assert encode(model, some) == sp.SentencePieceProcessor(model_file=pieces.MODEL).encode(some)


def test_pieces_documents(model, spark, small, docs, texts):
    import sentencepiece as sp

    lib = sp.SentencePieceProcessor(model_file=pieces.MODEL)
    some = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ["x" * 3000, " " * 80 + "y", "日本語" * 60]
    assert encode(model, some) == lib.encode(some)
    got = {r.doc_id: r for r in pieces.tokenize(docs, pieces.MODEL).collect()}
    assert all(r.round_trip and r.ids == lib.encode(texts[i] or "") and r.n_tokens == len(r.ids) for i, r in got.items())
    back = {r.doc_id: r.text for r in pieces.detokenize(pieces.tokenize(docs, pieces.MODEL), pieces.MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_viterbi():
    """A unigram model's best path, against all segmentations."""
    vocab = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -4.0, "ba": -2.2, "▁ab": -6.5, "aba": -9.0}
    names = [f"<0x{i:02X}>" for i in range(256)]
    p = pieces.Pieces(pieces.Model((*vocab, *names), (*vocab.values(), *[0.0] * 256), "n" * len(vocab) + "b" * 256, False))

    def best(s):
        if not s:
            return 0.0, []
        return max((vocab[s[:n]] + best(s[n:])[0], [s[:n], *best(s[n:])[1]]) for n in range(1, len(s) + 1) if s[:n] in vocab)

    for s in ["▁a", "▁abab", "▁babbaab", "abaabab"]:
        ids = p.encode_segments([s])[0]
        assert sum(p.model.scores[i] for i in ids) == pytest.approx(best(s)[0]) and "".join(p.model.pieces[i] for i in ids) == s


# --- pipeline -------------------------------------------------------------------------


def brute_cut(texts, length, words):
    """The texts without the bytes of repeated strings of ``length`` bytes and of repeated runs of ``words`` words; only whole characters go."""
    raw = [(t or "").encode() for t in texts]
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raw]
    runs = [[tuple(r[b:e] for b, e in w[i : i + words]) for i in range(len(w) - words + 1)] for r, w in zip(raw, found, strict=True)]
    often, seen = Counter(x for row in runs for x in row), Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r, w, row in zip(raw, found, runs, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        for i, x in enumerate(row):
            if often[x] > 1:
                gone[w[i][0] : w[i + words - 1][1]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)]))).tolist()
        kept, at = [], 0
        for b, e in zip(edge[::2], edge[1::2], strict=True):
            while b < e and r[b] & 0xC0 == 0x80:
                b += 1
            while b < e < len(r) and r[e] & 0xC0 == 0x80:
                e -= 1
            kept.append(r[at:b])
            at = e
        out.append(b"".join([*kept, r[at:]]).decode())
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns = df.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = df.toPandas()
        stage(spark, df, sf).write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        after = df.toPandas()
        if k == 1:
            _, comp = components(before.text.tolist(), 5, 80)
            ids = before.doc_id.tolist()
            want = {d for i, d in enumerate(ids) if min((ids[j] for j in comp if comp[j] == comp[i]), default=d) == d}
            assert set(after.doc_id) == want
        if k == 2:
            want = brute_cut(before.text.tolist(), 400, 51)
            assert dict(zip(after.doc_id, after.text, strict=True)) == {d: t for d, t, old in zip(before.doc_id, want, before.text, strict=True) if t or not old}
        if k < len(names) - 1:
            assert df.columns == columns
    assert set(after.doc_id) <= set(before.doc_id) and after.round_trip.all()
