"""Benchmark decontamination: near copies of benchmark items inside documents.

Items and documents are read as words (letters and digits in lower case), so case,
punctuation and layout don't count; in scripts without spaces every character is a word.  The CGK
random walk embeds a word sequence: at each step it writes the word under its pointer, and a
random bit of that word says whether the pointer moves on.  Two sequences a small edit distance apart
soon walk in step again, so their embeddings are a small Hamming distance apart.  Each table of the
LSH has its own walk and samples some of its steps as a key.

Windows are sized to the item: an item gives one from each of its offsets to its end, in classes
of 4, 8, 16 ... words (the largest that fits into the rest of the item, ``Lsh.longest`` at most), and a walk over a window of
n words takes 2 n steps, with one sample in each equal part of them.  Windows of a document begin
where a word pair of an item stands.  A document's walk goes on only while the samples so far are those of
some item window, so long walks are rare.  Windows with an equal key in some table are candidates;
they are verified exactly by the edit distance in words between the whole item and the best
item-sized part of the document there.

A miss needs every offset of the item to differ in every table.  ``tests/llm`` measures the recall by
length of item with substitutions, insertions and deletions in up to a fifth of the words.  Items of
fewer than ``min_words`` words are too short for an edit to mean anything; they are found where all
their words stand in a row, by a hash of the whole sequence that is confirmed word by word.

Documents are read once and nothing is shuffled.  The items' keys are broadcast; above
``MOST_CHARS`` characters the items go in blocks, each against all documents.

Edge cases: null texts are empty and hold nothing; items without a word are in no document; equal
items are reported each; a document that holds an item more than once is reported once, with the
place of fewest edits (the first on a tie); repeated documents are reported each; very long items and texts
are walked and verified whole; extra columns are ignored by ``find_leaks`` and kept by
``drop_leaks``, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from murmura.llm.common import LOWER, mix, slices, small_batches, table, text_view, word_hashes

#: Characters of items in one broadcast; an index takes about 80 bytes for each.
MOST_CHARS = 1 << 20

NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


@dataclass(frozen=True)
class Lsh:
    """``edits``: the largest share of an item's words that may be edited; ``advance``: words a walk must have passed for its key to count, since a walk that stands still says nothing;
    ``longest``: words of the largest windows, a power of two.  A longer item gives windows of that size from each offset, so that its index grows with its length."""

    tables: int = 8
    samples: int = 4
    advance: int = 3
    edits: float = 0.2
    min_words: int = 8
    longest: int = 256
    seed: int = 20


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are no part of a word, and which begin a character of a script without spaces (three bytes each)."""
    blank, alone = NOT_WORD[data], np.zeros(len(data), bool)
    if len(data) > 2 and data.max() >= 0xC2:
        one, two = data[:-2], data[1:-1]
        alone[:-2] = ((one >= 0xE3) & (one <= 0xE9)) | ((one == 0xE0) & (two >= 0xB8) & (two <= 0xBB)) | ((one == 0xE1) & (((two >= 0x80) & (two <= 0x82)) | (two == 0x9E) | (two == 0x9F)))
        # Marks of General Punctuation and of Chinese and Japanese, and their full-width forms.
        last = data[2:]
        mark = ((one == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((one == 0xE3) & (two == 0x80)) | ((one == 0xEF) & (two == 0xBC) & (last <= 0x8F))
        alone[:-2] &= ~mark
        for k in range(3):
            blank[k : len(data) - 2 + k] |= mark
        # No-break space to inverted question mark.
        mark = (data[:-1] == 0xC2) & (data[1:] >= 0xA0)
        blank[:-1] |= mark
        blank[1:] |= mark
    return blank, alone


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, in lower case (A-Z and the accented letters of Latin-1)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank, alone = _marks(data)
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1] | alone[1:]
    last[:-1] &= blank[1:] | alone[1:]
    if alone.any():  # the byte after such a character begins a word, its last byte ends one
        first[3:] |= ~blank[3:] & alone[:-3]
        last[2:] |= alone[:-2]
    full = np.flatnonzero(ends > starts)
    first[starts[full]] = ~blank[starts[full]]
    last[ends[full] - 1] = ~blank[ends[full] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = LOWER[data]
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][accented] += 32
    return word_hashes(low, begin, end), full[np.searchsorted(starts[full], begin, "right") - 1]


@dataclass(frozen=True)
class Walk:
    """One table's random walk over windows of one class: its symbols' key and the steps it samples."""

    salt: np.uint64
    steps: tuple[int, ...]

    @staticmethod
    def make(number: int, size: int, lsh: Lsh) -> Walk:
        rng = np.random.default_rng((lsh.seed, number, size))
        parts = np.array_split(np.arange(2 * size), lsh.samples)
        return Walk(np.uint64(rng.integers(1 << 62)), tuple(int(rng.integers(p[0], p[-1] + 1)) for p in parts))

    def keys(self, hashes: np.ndarray, at: np.ndarray, seen: list[Filter] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The windows at ``at`` that are walked to the end (as places in ``at``), the keys after each sample, and the words passed.

        With ``seen``, filters for the first samples, windows whose key isn't in them are left.  ``hashes`` goes on behind the last window.
        """
        which, p, key, keys, step = np.arange(len(at)), at.copy(), np.full(len(at), self.salt), [], 0
        for n, stop in enumerate(self.steps):
            while step < stop:
                p += ((mix(hashes[p] ^ self.salt) >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
                step += 1
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + hashes[p])
            if seen is None:
                keys.append(key)
            elif n < len(seen):
                stay = seen[n].holds(key)
                which, p, key = which[stay], p[stay], key[stay]
        return which, keys or [key], p - at[which]


class Filter:
    """What may be among some 64-bit hashes: a table of bits, 16 for each hash."""

    def __init__(self, hashes: np.ndarray):
        size = min(26, max(12, (16 * len(hashes)).bit_length()))
        self.shift = np.uint64(64 - size)
        self.bits = np.zeros(1 << size, bool)
        self.bits[(hashes >> self.shift).astype(np.int64)] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[(hashes >> self.shift).astype(np.int64)]


def edits_within(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance between ``pattern`` and any part of ``text``, and where the first such part ends (bit-parallel)."""
    m, bits = len(pattern), {}
    for i, w in enumerate(pattern):
        bits[w] = bits.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, (m, 0)
    for j, w in enumerate(text):
        eq = bits.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & mask
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus, minus = mh | ~(xv | ph) & mask, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def _pair(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * np.uint64(3) + hashes[1:])


def _rows_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : k + len(out)])
    return out


class Items:
    """The items' words and the LSH tables over their windows."""

    def __init__(self, texts: list[str], lsh: Lsh):
        self.lsh, self.words = lsh, []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            self.words.append(words(data, np.zeros(1, np.int64), np.array([len(data)]))[0])
        usable = [k for k, w in enumerate(self.words) if len(w) >= lsh.min_words]
        #: Items too short for edits, by length: sorted hashes of their whole sequence, and which they are.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words if 0 < len(w) < lsh.min_words}):
            which = np.array([k for k, w in enumerate(self.words) if len(w) == n])
            whole = np.array([_rows_of(self.words[k], n)[0] for k in which])
            order = np.argsort(whole, kind="stable")
            self.short[n] = (whole[order], which[order])
        rests = {k: len(self.words[k]) - np.arange(len(self.words[k]) - 3) for k in usable}
        size = {k: np.minimum(lsh.longest, 1 << np.floor(np.log2(r)).astype(np.int64)) for k, r in rests.items()}
        #: Words that a walk may need behind the last one: each item gets as many as its own largest window needs.
        rooms = [2 * int(size[k].max()) for k in usable]
        self.room = max(rooms, default=0)
        flat = np.concatenate([x for k, room in zip(usable, rooms, strict=True) for x in (self.words[k], np.zeros(room, np.uint64))] or [np.zeros(0, np.uint64)])
        base = np.cumsum([0] + [len(self.words[k]) + room for k, room in zip(usable, rooms, strict=True)])
        at = np.concatenate([b + np.arange(len(rests[k])) for k, b in zip(usable, base, strict=False)] or [np.zeros(0, np.int64)])
        self.item = np.concatenate([np.full(len(rests[k]), k) for k in usable] or [np.zeros(0, np.int64)])
        self.offset = np.concatenate([np.arange(len(rests[k])) for k in usable] or [np.zeros(0, np.int64)])
        classes = np.concatenate([size[k] for k in usable] or [np.zeros(0, np.int64)])
        pairs = _pair(flat) if len(at) else at
        #: For each class: where its windows begin (pairs of words), its tables, and the keys after their first samples.
        self.classes = []
        for n in np.unique(classes).tolist():
            mine = np.flatnonzero(classes == n)
            tables, early = [], []
            for t in range(lsh.tables):
                walk = Walk.make(t, n, lsh)
                _, keys, passed = walk.keys(flat, at[mine])
                counts = passed >= lsh.advance
                order = np.flatnonzero(counts)[np.argsort(keys[-1][counts], kind="stable")]
                tables.append((walk, keys[-1][order], mine[order]))
                early.append([k[counts] for k in keys[:2]])
            self.classes.append((Filter(pairs[at[mine]]), tables, [Filter(np.concatenate(k)) for k in zip(*early, strict=True)]))
        self.begins = Filter(pairs[at]) if len(at) else None

    def candidates(self, hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(row, item, place of the item's first word) of all candidates, each once."""
        found = [np.zeros((0, 3), np.int64)]
        for n, (whole, which) in self.short.items():
            run = _rows_of(hashes, n)
            at = np.flatnonzero(row[: len(run)] == row[n - 1 :]) if len(run) else np.zeros(0, np.int64)
            start, entry = _matches(run[at], whole, at)
            found.append(np.column_stack([row[start], which[entry], start]))
        if len(hashes) > 1 and self.classes:
            pair = _pair(hashes)
            some = np.flatnonzero(self.begins.holds(pair) & (row[1:] == row[:-1]))
            padded = np.concatenate([hashes, np.zeros(self.room, np.uint64)])
            for begins, tables, seen in self.classes:
                at = some[begins.holds(pair[some])]
                for walk, keys, windows in tables:
                    left, key, passed = walk.keys(padded, at, seen)
                    counts = passed >= self.lsh.advance
                    start, entry = _matches(key[-1][counts], keys, at[left[counts]])
                    entry = windows[entry]
                    found.append(np.column_stack([row[start], self.item[entry], start - self.offset[entry]]))
        return np.unique(np.concatenate(found), axis=0)

    def leaks(self, hashes: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, words of the item, last word's place) of each verified pair."""
        first = np.searchsorted(row, np.arange(row[-1] + 2 if len(row) else 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        near: dict[tuple[int, int], int] = {}
        for r, k, start in self.candidates(hashes, row).tolist():
            pattern = self.words[k].tolist()
            most = int(self.lsh.edits * len(pattern))
            # A window of 2 * most more words on either side holds every place that candidates this close by could mean.
            if near.get((r, k), -1 << 60) + most >= start:
                continue
            near[r, k] = start
            lo = max(first[r], start - 2 * most - 1)
            edits, end = edits_within(pattern, hashes[lo : min(first[r + 1], start + len(pattern) + 3 * most + 1)].tolist())
            if edits <= most and (edits, lo - first[r] + end - 1) < best.get((r, k), (1 << 60, 0)):
                best[r, k] = (edits, int(lo - first[r] + end - 1))
        return [(r, k, e, len(self.words[k]), end) for (r, k), (e, end) in sorted(best.items())]


def _matches(wanted: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """at[i] and j of all equal wanted[i] and keys[j]; ``keys`` are sorted."""
    left, right = (np.searchsorted(keys, wanted, side) for side in ("left", "right"))
    n = right - left
    return np.repeat(at, n), np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())


def find_leaks(docs: DataFrame, benchmark: DataFrame, lsh: Lsh = Lsh()) -> DataFrame:
    """(doc_id, item_id, edits, item_words, last_word) of each document that holds an item."""
    return _apply(docs.select("doc_id", "text"), benchmark, lsh, True)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, lsh: Lsh = Lsh()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    return _apply(docs, benchmark, lsh, False)


def _apply(docs: DataFrame, benchmark: DataFrame, lsh: Lsh, report: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // MOST_CHARS))
    out = docs
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Items([x.text for x in block], lsh))
        ids = spark.sparkContext.broadcast([x.item_id for x in block])
        if report:
            part = docs.mapInArrow(_report(shared, ids, to_arrow_type(benchmark.schema["item_id"].dataType)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits int, item_words int, last_word long")
            out = part if b == 0 else out.unionAll(part)
        else:
            out = out.mapInArrow(_clean(shared), docs.schema)
    return out


def _found(items: Items, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    data, starts, ends = text_view(column)
    for i, j in slices(starts, ends):
        hashes, row = words(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        for r, *rest in items.leaks(hashes, row):
            yield i + r, *rest


def _report(shared, ids, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_found(shared.value, batch.column("text")))
            row, item, edits, n, last = zip(*found, strict=True) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array([ids.value[k] for k in item], kind), pa.array(edits, pa.int32()), pa.array(n, pa.int32()), pa.array(last, pa.int64())],
                names=["doc_id", "item_id", "edits", "item_words", "last_word"],
            )

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, *_ in _found(shared.value, batch.column("text"))]] = False
            yield batch.filter(pa.array(clean))

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
