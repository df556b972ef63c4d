"""Phrase collocations by pivot partitioning.

An n-gram's pivot is its rarest word (the first place of it, if it stands there twice).  Texts are rewritten for each pivot: a fragment is
a pivot with at most four words on either side, cut where a word is rarer than the pivot or infrequent, so that it holds exactly the n-grams
that the pivot owns.  Equal fragments of a block of text are counted once, pivots are dealt into buckets by hash, and what a
task has for one bucket travels there as one row.  There the n-grams that hold a fragment's pivot are counted, and nothing else; every occurrence of an n-gram has the same
pivot, so counts are complete where they are mined and infrequent n-grams end there.

"Rarest" is judged by a table of ``SLOTS`` numbers, the counts of the frequent words hashed into them (a fixed size, whatever the vocabulary);
ties go by hash.  Any fixed order of words gives the same counts, this one keeps the buckets even.  A pivot with over ``hot``
occurrences is split by the word next to it: n-grams that go on behind the pivot go by the next word, those that end with it by the word
before.  A bucket that exceeds ``most`` bytes is mined in parts, and all of its partial counts are added up.

Frequent n-grams (at most tokens / threshold) are scored as DataFrames: every cut of a phrase is joined to the counts of its two parts, in
exact decimals; phrases inside an equally frequent longer one go.  It is enough to look at phrases one word longer, since a count never
grows with a longer phrase.  N-grams of a bucket and fragments of a block are told apart by 64-bit hashes; two of them count as one
with a probability of 2**-64 a pair.

Edge cases: a null text has no words, a null language is ``und``; phrases never cross the marks that end a piece; overlapping occurrences
count each; very long texts are read in slices that end at such marks (a piece without any is read whole); repeated rows count each; ties
in rank go by count and phrase; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import LOWER, cut, mix, table, text_view, word_bounds, word_hashes
from murmura.session import ship

SLOTS = 1 << 20

PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\f\r"]] = True
ENDS = PIECE_ENDS.copy()
ENDS[[9, 32]] = True


@dataclass(frozen=True)
class Mining:
    """At least ``least`` occurrences, phrases of ``shortest`` to ``longest`` words; a phrase inside a longer one with ``percent`` of its count goes.

    ``hot``: occurrences from which a pivot is split by neighbours; ``block`` and ``most``: bytes of text that are rewritten and bytes of fragments that
    are mined at once; ``bucket``: words of the corpus to a bucket of pivots.  These four change no result.
    """

    least: int = 100
    shortest: int = 2
    longest: int = 5
    percent: int = 100
    scale: int = 1000
    top: int = 2000
    hot: int = 1 << 18
    block: int = 2 << 20
    most: int = 16 << 20
    bucket: int = 1 << 16


@dataclass
class Words:
    """The words of a block: where they stand, what they hash to, and whether a word continues the piece of the one before."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    code: np.ndarray
    lang: np.ndarray
    joined: np.ndarray


def blocks(langs: pa.Array, texts: pa.Array, block: int) -> Iterator[tuple[list[str], Words]]:
    """The words of some rows in blocks of about ``block`` bytes, with the names of their languages; a long row is sliced where pieces end."""
    names = langs.fill_null("und").dictionary_encode()
    which, known = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
    salt = np.array([hash_of(n) for n in known], np.uint64)
    data, starts, ends = text_view(texts)
    data = LOWER[data]
    s, e, r = [], [], []
    for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while b - a > block:
            stop = np.flatnonzero(PIECE_ENDS[data[a : a + block]])
            if not len(stop):
                stop = np.flatnonzero(PIECE_ENDS[data[a:b]])
            if not len(stop):
                break
            after = a + int(stop[-1] if stop[-1] < block else stop[0]) + 1
            s.append(a), e.append(after), r.append(row)
            a = after
        s.append(a), e.append(b), r.append(row)
    s, e, r = np.array(s, np.int64), np.array(e, np.int64), np.array(r, np.int64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + block, "right")))
        part = data[s[i] : e[j - 1]]
        begin, end, row = word_bounds(part, s[i:j] - s[i], e[i:j] - s[i], ENDS)
        lang = which[r[i + row]]
        ended = np.concatenate([[0], np.cumsum(PIECE_ENDS[part])])
        joined = np.zeros(len(begin), bool)
        joined[1:] = (ended[begin[1:]] == ended[begin[:-1]]) & (row[1:] == row[:-1])
        yield known, Words(part, begin, end, mix(word_hashes(part, begin, end) ^ salt[lang]) if len(begin) else np.zeros(0, np.uint64), lang, joined)
        i = j


def hash_of(lang: str) -> np.uint64:
    """What sets a language's words apart; no word hashes to it, since none holds a line end."""
    raw = np.frombuffer(f"\n{lang}".encode(), np.uint8)
    return word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes data[begin:end] of each item side by side, each closed by its byte of ``closing``; and where each item ends, the closing byte included."""
    size = end - begin + 1
    upto = np.cumsum(size)
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - size), size)
    out = np.append(data, np.uint8(0))[at]
    out[upto - 1] = closing
    return out, upto


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([bytes(data[b:e]).decode("utf-8") for b, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())


def word_counts(docs: DataFrame, block: int = Mining.block) -> DataFrame:
    """(lang, word, n) of all texts, counted in blocks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, w in blocks(batch.column(0), batch.column(1), block):
                _, first, n = np.unique(w.code, return_index=True, return_counts=True)
                lang = pa.array([known[k] for k in w.lang[first].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([lang, strings(w.data, w.begin[first], w.end[first]), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def slot_table(frequent: DataFrame) -> np.ndarray:
    """The counts of the frequent words (lang, word, n), summed by slot: at most ``SLOTS`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch.column("lang").to_pylist(), batch.column("word")
            data, begin, end = text_view(words)
            salt = {n: hash_of(n) for n in set(langs)}
            code = mix(word_hashes(data, begin, end) ^ np.array([salt[n] for n in langs], np.uint64)) if len(begin) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((code % np.uint64(SLOTS)).astype(np.int32)), batch.column("n")], names=["slot", "n"])

    rows = frequent.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def fragments(w: Words, counts: np.ndarray, reach: int, hot: int) -> dict[str, np.ndarray]:
    """The pivots of a block with how many words before (``left``) and behind (``right``) belong to them, where they go (``key``) and whether they are split."""
    often = counts[(w.code % np.uint64(SLOTS)).astype(np.int64)]
    # The order of words: by count, then by hash; 0 is no frequent word.
    order = np.where(often > 0, np.minimum(often, (1 << 31) - 1) << 32 | (w.code & np.uint64(0xFFFFFFFF)).astype(np.int64), 0)
    n = len(order)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # A word equal to the pivot may stand behind it, not before: the first one owns.
    on = order > 0
    for d in range(1, min(reach, n)):
        on = on[1:] & w.joined[1 : n - d + 1] & (order[: n - d] > order[d:]) if d > 1 else on[1:] & w.joined[1:] & (order[:-1] > order[1:])
        left[d:] += on
    on = order > 0
    for d in range(1, min(reach, n)):
        on = on[: n - d] & w.joined[d:] & (order[d:] >= order[: n - d])
        right[: n - d] += on
    at = np.flatnonzero(left + right > 0)
    left, right, code = left[at], right[at], w.code[at]
    split = often[at] > hot
    ways = np.maximum(1, often[at] // hot).astype(np.uint64)
    forward, backward = ~split | (right > 0), split & (left > 0)
    after = np.where(split, mix(w.code[np.minimum(at + 1, n - 1)]) % ways + np.uint64(1), np.uint64(0))
    before = mix(w.code[np.maximum(at - 1, 0)] ^ np.uint64(1)) % ways + np.uint64(1)
    return {
        "at": np.concatenate([at[forward], at[backward]]),
        "left": np.concatenate([left[forward], left[backward]]),
        "right": np.concatenate([right[forward], np.zeros(backward.sum(), np.int64)]),
        "key": np.concatenate([mix(code[forward] + after[forward]), mix(code[backward] ^ (before[backward] << np.uint64(32)))]),
        "split": np.concatenate([split[forward], np.ones(backward.sum(), bool)]),
    }


def packed(known: list[str], w: Words, f: dict[str, np.ndarray], buckets: int) -> Iterator[tuple[tuple[int, bool, str], bytes]]:
    """For each bucket of keys (with whether they are split, and the language) its distinct fragments, a line each.

    A line is the number of words before the pivot, the count (nothing for 1, else digits of base 64 from ``@`` on, the lowest first), a space and the words.
    """
    words = f["left"] + f["right"] + 1
    same = f["left"].astype(np.uint64)
    for d in range(int(words.max(initial=0))):
        inside = d < words
        same[inside] = mix(same[inside] * np.uint64(0x9E3779B97F4A7C15) + w.code[f["at"][inside] - f["left"][inside] + d])
    if not len(same):
        return
    same = mix(same ^ f["key"])
    # Bucket, language and whether it is split as one number.
    group = ((f["key"] % np.uint64(buckets)).astype(np.int64) * len(known) + w.lang[f["at"]]) * 2 + f["split"]
    order = np.lexsort((same, group))
    group, same = group[order], same[order]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (same[1:] != same[:-1])
    first = np.flatnonzero(new)
    one = order[first]
    group, start, words = group[first], (f["at"] - f["left"])[one], words[one]
    # The heads of lines stand behind the text as further words.
    heads, head = np.unique(np.diff(np.append(first, len(order))) * 8 + f["left"][one], return_inverse=True)
    spelled = [head_of(int(h) & 7, int(h) >> 3) for h in heads]
    data = np.concatenate([w.data, np.frombuffer(b"".join(spelled), np.uint8)])
    ends = len(w.data) + np.cumsum([len(x) for x in spelled])
    begin, end = np.concatenate([w.begin, ends - [len(x) for x in spelled]]), np.concatenate([w.end, ends])
    upto = np.cumsum(words + 1)
    index = np.arange(upto[-1]) + np.repeat(start - 1 - (upto - words - 1), words + 1)
    index[upto - words - 1] = len(w.begin) + head
    closing = np.full(len(index), 32, np.uint8)
    closing[upto - 1] = 10
    lines, stop = gather(data, begin[index], end[index], closing)
    stop, lines = stop[upto - 1], lines.tobytes()
    rows = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    last = np.append(rows[1:], len(group)) - 1
    for g, b, e in zip(group[rows].tolist(), np.append(0, stop[last[:-1]]).tolist(), stop[last].tolist(), strict=True):
        yield (g // 2 // len(known), g % 2 == 1, known[g // 2 % len(known)]), lines[b:e]


def head_of(left: int, count: int) -> bytes:
    out = [48 + left]
    while count > 1 or len(out) > 1 and count:
        out.append(64 + count % 64)
        count //= 64
    return bytes(out)


def rows_of(held: dict[tuple[int, bool, str], list[bytes]]) -> pa.RecordBatch:
    """A row (key, body) for each key; a body begins with whether it is split, and the language behind its length."""
    bodies = []
    for (_, split, lang), lines in held.items():
        name = lang.encode()
        bodies.append(bytes([split]) + len(name).to_bytes(4, "little") + name + b"".join(lines))
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array(bodies, pa.binary())], names=["key", "body"])


def read_row(body: bytes) -> tuple[bool, str, bytes]:
    n = int.from_bytes(body[1:5], "little")
    return body[0] == 1, body[5 : 5 + n].decode(), body[5 + n :]


def mined(bodies: list[bytes], rules: Mining, whole: bool) -> pa.RecordBatch:
    """(lang, phrase, n): the n-grams of some rows that hold the pivot; of ``whole`` buckets the frequent ones only."""
    splits, langs, texts = zip(*map(read_row, bodies), strict=True)
    data = np.frombuffer(b"".join(texts), np.uint8)
    stop = np.flatnonzero((data == 32) | (data == 10))
    begin, end = np.concatenate([[0], stop[:-1] + 1]), stop
    line_end = np.flatnonzero(data[stop] == 10)
    first = np.concatenate([[0], line_end[:-1] + 1])
    row = np.searchsorted(np.cumsum([len(x) for x in texts]), begin[first], "right")
    names = sorted(set(langs))
    lang, split = np.array([names.index(x) for x in langs])[row], np.array(splits)[row]
    left = data[begin[first]].astype(np.int64) - 48
    digits = end[first] - begin[first] - 1
    count = (digits == 0).astype(np.int64)
    for d in range(int(digits.max())):
        more = digits > d
        count[more] += (data[begin[first[more]] + 1 + d].astype(np.int64) - 64) << (6 * d)
    pivot = first + 1 + left
    right = line_end - pivot
    parts = []
    for s in range(rules.longest):
        for e in range(rules.longest - s):
            if s + e + 1 >= rules.shortest:
                # What ends with the pivot of a split fragment went another way, if the fragment goes on.
                parts.append((np.flatnonzero((s <= left) & (e <= right) & (~split | (e > 0) | (right == 0))), s, e))
    which = np.concatenate([p[0] for p in parts])
    b = np.concatenate([begin[pivot[x] - s] for x, s, _ in parts])
    e = np.concatenate([end[pivot[x] + t] for x, _, t in parts])
    salt = np.array([hash_of(x) for x in names], np.uint64)
    code = mix(word_hashes(data, b, e) ^ salt[lang[which]]) if len(b) else np.zeros(0, np.uint64)
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[which[order]], at) if len(at) else np.zeros(0, np.int64)
    if whole:
        at, total = at[total >= rules.least], total[total >= rules.least]
    one = order[at]
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in lang[which[one]].tolist()], pa.string()), strings(data, b[one], e[one]), pa.array(total, pa.int64())], names=["lang", "phrase", "n"])


def frequent_phrases(docs: DataFrame, counts: np.ndarray, buckets: int, rules: Mining) -> DataFrame:
    """(lang, phrase, n) of the frequent n-grams of ``docs`` (lang, text); pivots are dealt into ``buckets``."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the blocks of a task have for one bucket goes as one row, as far as memory allows.
        held: dict[tuple[int, bool, str], list[bytes]] = {}
        size = 0
        for batch in batches:
            for known, w in blocks(batch.column(0), batch.column(1), rules.block):
                for key, lines in packed(known, w, fragments(w, shared.value, rules.longest, rules.hot), buckets):
                    held.setdefault(key, []).append(lines)
                    size += len(lines) + 100
                if size > rules.most * 4:
                    yield rows_of(held)
                    held, size = {}, 0
        if held:
            yield rows_of(held)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size, partial = 0, False
        bodies = lambda rows: [r[1] for r in rows]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and (partial or size >= rules.most // 4):
                    yield mined(bodies(held), rules, not partial)
                    held, size, partial = [], 0, False
                elif held and size >= rules.most:
                    # One bucket (and what small ones came before it) is too much to hold: those before are whole, its own counts are partial.
                    before = [r for r in held if r[0] != row[0]]
                    if before:
                        yield mined(bodies(before), rules, True)
                    if len(before) < len(held):
                        yield mined(bodies(held[len(before) :]), rules, False)
                        partial = True
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield mined(bodies(held), rules, not partial)

    routed = docs.select("lang", "text").mapInArrow(rewrite, "key long, body binary")
    found = routed.repartition("key").sortWithinPartitions("key").mapInArrow(mine, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= rules.least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, rules: Mining) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases (lang, phrase, n) that aren't inside an equally frequent longer one.

    ``words`` are the frequent words (lang, word, n), ``totals`` the words of each language (lang, total).
    """
    parts = phrases.unionByName(words.select("lang", F.col("word").alias("phrase"), "n"))
    tokens = F.split("phrase", " ")
    join = lambda words, start, n: F.array_join(F.slice(words, start, n), " ")
    each = phrases.select("lang", "phrase", F.col("n").alias("a"), tokens.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    each = each.select("lang", "phrase", "a", "k", join(F.col("w"), F.lit(1), F.col("k")).alias("head"), join(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    side = lambda name, value: parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    each = each.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr(f"CAST(CAST(CAST(a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(19,0)) AS DECIMAL(38,0)) * {rules.scale} AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)) AS DECIMAL(38,0))")
    best = each.withColumn("score", score).groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # Whatever is inside a longer phrase is inside one that is a word longer, and that one is as frequent.
    longer = phrases.filter(F.size(tokens) > rules.shortest).select("lang", "n", tokens.alias("w"))
    inside = longer.select("lang", "n", F.explode(F.array(join(F.col("w"), F.lit(1), F.size("w") - 1), join(F.col("w"), F.lit(2), F.size("w") - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < rules.percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, rules: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first ``top`` phrases."""
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = word_counts(docs, rules.block)
    # The frequent words, and one row a language for all others together.
    words = cut(words.groupBy("lang", F.when(F.col("n") >= rules.least, F.col("word")).alias("word")).agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.filter("word IS NOT NULL")
    n = totals.agg(F.sum("total")).first()[0] or 0
    phrases = cut(frequent_phrases(docs, slot_table(frequent), n // rules.bucket + 1, rules))
    out = scored(phrases, frequent, totals, rules)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of each part of a language first, so that no task ranks all of it.
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= rules.top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= rules.top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS r(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE c >= 100 AND k > 1
), s AS (
  SELECT c.lang, c.phrase, c.k, a, n, j, x.c AS l, y.c AS r, (1000::HUGEINT * a * n) // (x.c::HUGEINT * y.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ') AND x.k = j
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 : c.k], ' ') AND y.k = c.k - j
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM s
), inner_ AS (
  SELECT DISTINCT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, a AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand))
), o AS (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b WHERE best = 1 AND NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 100 * b.a)
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
