"""Cases that were wrong once: names in attributes, short blocks, long benchmark items, loss masks, and the place of each key."""

import math
import struct
import tracemalloc

import numpy as np
import pytest
import xxhash

from murmura.llm import chat, decontaminate, html_text, passages, shards

LONG = "A sentence that is long enough, with commas, to be the best part of a page, as the text of an article is."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<article><p data-id="menu">Kept?</p><div data-role="share">Kept 2?</div><div data-class="ad">Kept 3?</div><p>One.</p></article>', "Kept?\nKept 2?\nKept 3?\nOne."),
        ('<article><div class="ok" class="menu">first name counts</div><p aria-role="menu">a</p><div xml:id="menu">b</div></article>', "first name counts\na\nb"),
        ("<article><div title=\"say class='menu' or id=menu\"><p>in a value</p></div><div data-src='?id=menu'>c</div><div class=menu>gone</div></article>", "in a value\nc"),
        ("<article><div class='menu>gone</div>", ""),
        (f"<div id=x><div class=a><p>{LONG}</p></div><p>Short end.</p></div>", f"{LONG}\nShort end."),
        (f"<div id=x><p>Short start.</p><div class=a><p>{LONG}</p></div><div>Tail.</div><ul><li><a href=q>only a link</a></li></ul></div>", f"Short start.\n{LONG}\nTail."),
        ("<main><article>A</article><article>B</article><article><a href=q>C</a></article></main>", "A\nB"),
        (f"<body><div><p>{LONG}</p></div><p>Imprint</p></body>", LONG),
    ],
)
def test_html_keeps_what_is_the_article(html, want):
    assert html_text.main_text(html) == want


def test_index_of_a_long_item_is_small():
    """Ten thousand short items and one of 50,000 words: the index grows with the words, not with items times the longest."""
    rng = np.random.default_rng(1)
    some = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 30)) for _ in range(10_000)]
    tracemalloc.start()
    decontaminate.Items([*some, " ".join(f"v{x}" for x in rng.integers(0, 50_000, 50_000))], decontaminate.Lsh())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_long_items_are_found(spark):
    rng = np.random.default_rng(2)
    item = [f"w{x}" for x in rng.integers(0, 3000, 4000)]
    edited = [f"new{i}" if i % 7 == 3 else w for i, w in enumerate(item)]
    missing = item[:500] + item[1200:]
    far = [f"new{i}" if i % 3 == 0 else w for i, w in enumerate(item)]
    other = [f"x{x}" for x in rng.integers(0, 3000, 6000)]
    docs = spark.createDataFrame([(1, " ".join(other[:900] + edited + other[900:])), (2, " ".join(missing)), (3, " ".join(far)), (4, " ".join(other)), (5, " ".join(item))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (8, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.item_words) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, 9): (sum(i % 7 == 3 for i in range(4000)), 4000), (2, 9): (700, 4000), (5, 9): (0, 4000)}


def test_mask_decides_what_counts(spark):
    """The loss text is cut by the mask: lengths that are off give another text, whatever the marks say."""
    messages = spark.createDataFrame([(1, 0, 0, "user", "hello"), (1, 1, 1, "assistant", "<|end|> fine" + "x" * 100_000), (2, 0, 0, "assistant", "")], "conv_id long, at long, message long, role string, text string")
    done = chat.render(messages)
    texts = {r.conv_id: [(t.role, t.text, t.counts) for t in r.turns] for r in chat.read_back(done).collect()}
    assert texts == {1: [("user", "hello", False), ("assistant", "<|end|> fine" + "x" * 100_000, True)], 2: [("assistant", "", True)]}
    off = done.selectExpr("conv_id", "formatted", "transform(loss_mask, (m, i) -> named_struct('length', m.length - CAST(i = 1 AS INT), 'counts', NOT m.counts)) AS loss_mask")
    cut = {r.conv_id: [(t.text, t.counts) for t in r.turns] for r in chat.read_back(off).collect()}
    assert cut[1][0] == ("hell", True) and not cut[1][1][1]


def test_chat_log_of_nothing_and_of_ties(spark):
    schema = "conv_id long, turn long, role string, text string"
    through = lambda rows: chat.read_back(chat.render(chat.fold(chat.as_events(spark.createDataFrame(rows, schema))))).collect()
    assert through([]) == []
    got = through([(1, 0, "b", "y"), (1, 0, "b", "x"), (1, 0, "a", "z"), (1, 0, "b", "x"), (1, None, None, None), (None, 3, "u", "n")])
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == {1: [("", ""), ("a", "z"), ("b", "x"), ("b", "x"), ("b", "y")], None: [("u", "n")]}


def plain_place(doc_id, layout):
    """The shard of a key by a walk down the tree."""
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
    weight = lambda n: sum(map(weight, n)) if isinstance(n, list) else n[1]
    node, path = [r for r in layout if weight(r) > 0], ""
    while isinstance(node, list):
        draws = []
        for i, child in enumerate(node):
            u = ((xxhash.xxh64_intdigest(f"{path}/{i}".encode(), seed) >> 11) + 1) / 2**53
            draws.append((-math.log(u) / weight(child), f"{path}/{i}", i))
        at = min(draws)[2] if len(node) > 1 else 0
        node, path = node[at], f"{path}/{at}"
    return node[0]


@pytest.mark.parametrize("weights", [[1.0] * 24, [3.0, 0.5, 1.0] * 5, [2.0]])
def test_shards_against_a_walk(spark, weights):
    ids = [*range(-50, 400), 2**62, None]
    df = spark.createDataFrame([(i, "t" * 100_000 if i == 7 else None, 1, "b", 3) for i in ids], "doc_id long, text string, n int, bucket string, first int")
    mean = sum(weights) / len(weights)
    for r in shards.assign(df, weights).collect():
        assert r.shard == plain_place(r.doc_id, shards.tree(weights)) and r.grown_shard == plain_place(r.doc_id, shards.tree(weights, [mean]))


@pytest.mark.parametrize("words", [None, 51])
def test_repeats_leave_other_columns_alone(spark, words):
    passage = " ".join(f"shared{i}word" for i in range(80))
    names = ["k1", "k2", "spans", "runs", "gram", "own_0", "c1", "start", "K3", "row"]
    rows = [(i, f"{t} {passage} {t}", *(f"{n}{i}" for n in names), 5) for i, t in enumerate(("one", "two", "three"))] + [(3, None, *names, 0), (3, None, *names, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names) + ", n_chars int")
    out = passages.drop_repeats(df, words=words)
    assert out.columns == df.columns
    got = sorted((r.doc_id, *(r[n] for n in names)) for r in out.collect())
    assert got == sorted((r[0], *r[2:-1]) for r in rows)
    assert all(r.text is None or len(r.text) < 20 and r.n_chars == len(r.text) for r in out.collect() if r.doc_id < 3)
