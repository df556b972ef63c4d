"""Removal of repeated byte strings, by sorting suffixes with bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in another
document or in the same.  To find these strings without sorting every suffix of the corpus:

1. of the ``gram``-byte strings inside each window of ``length`` bytes, the one with the smallest hash is the
   window's anchor (the first on a tie).  Equal windows have equal anchors at equal offsets, so
   windows are sorted into buckets by their anchor's q-gram; about one position in 150 is
   an anchor.  Buckets of one anchor are final: nothing there repeats;
2. an anchor's context is the text of all windows it stands for.  Contexts that are equal, by a
   128-bit digest, repeat as a whole.  Of each such class one goes on as a partner;
3. where a bucket still holds different contexts, its windows are refined: each q-gram
   position gets its bucket's number, then positions are sorted by the pair of their bucket and the bucket at the later
   offset ``gram``, and the refined numbers serve again at twice the offset, until they stand
   for ``length`` bytes.  Positions alone in their bucket drop out of each round.  A window whose last
   bucket holds another repeats;
4. buckets of more than ``MOST`` contexts are refined by counting digests of their windows, so
   that no task has to hold one;
5. the windows' spans meet their texts, which lose the covered bytes.

Edge cases: a null text is empty; texts shorter than ``length`` lose nothing; overlapping
repeats in one document count (a long run of one character goes whole); repeated rows repeat
each other; equal doc_ids with different texts are told apart by a hash of the text; extra
columns are ignored by ``repeats`` and kept by ``drop_repeats``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import cut, mix, slices, small_batches, table, text_view, word_bounds, word_hashes

#: Contexts of one bucket that a task refines together.
MOST = 4000
#: Bytes of texts, and of contexts, that a task works on at once: a hash and what is sorted by it take tens of times as much.
SLICE = 1 << 18
AT_ONCE = 1 << 18
#: Bytes that stand for a word where runs are counted in words: a run in which one word differs counts
#: as equal with a probability of 2**-32.
CODE = 4

_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Repeat:
    length: int = 400
    gram: int = 100

    def __post_init__(self):
        if self.length % self.gram or (self.length // self.gram) & (self.length // self.gram - 1):
            raise ValueError("length must be gram times a power of two")


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of data[i : i + n] for each i, put together from those of powers of two."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    part, width = data.astype(np.uint64) + np.uint64(1), 1
    out, done = np.zeros(len(data) - n + 1, np.uint64), 0
    while done < n:
        if n & width:
            out *= np.uint64(pow(_BASE, width, 1 << 64))
            out += part[done : done + len(out)]
            done += width
        if 2 * width <= n:
            part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2
    return mix(out)


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: Repeat) -> dict[str, np.ndarray]:
    """row, pos, lo, hi and gram of each anchor of the rows of text at data[starts:ends].

    The anchor at ``pos`` stands for the windows that begin at lo..hi; places count from the row's start.
    """
    n = len(data) - rule.length + 1
    rows = np.flatnonzero(ends - starts >= rule.length)
    if n <= 0 or not len(rows):
        return {k: np.zeros(0, np.int64) for k in ("row", "pos", "lo", "hi")} | {"gram": np.zeros(0, np.uint64)}
    h = gram_hashes(data, rule.gram)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, rule.length - rule.gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = ends[rows] - starts[rows] - rule.length + 1
    row = np.repeat(rows, count)
    i = np.arange(count.sum()) + np.repeat(starts[rows] - np.cumsum(count) + count, count)
    at = at[i]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:], [len(i)]]) - 1
    row, base = row[first], starts[row[first]]
    return {"row": row, "pos": at[first] - base, "lo": i[first] - base, "hi": i[last] - base, "gram": h[at[first]]}


def repeated_windows(data: np.ndarray, sizes: np.ndarray, rule: Repeat) -> np.ndarray:
    """For contexts side by side in ``data``: at which positions a window begins that another position has, too.

    Only windows that lie in one context count.
    """
    ends = np.repeat(np.cumsum(sizes), sizes)
    room = ends - np.arange(len(data))

    def number(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bucket numbers from 1 on of the positions ``at``, sorted by key; 0 where a bucket holds one, and elsewhere."""
        out = np.zeros(len(data), np.int64)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        alone = new & np.concatenate([new[1:], [True]])[: len(new)]
        out[at] = np.where(alone, 0, np.cumsum(new))
        return out

    depth = rule.gram
    at = np.flatnonzero(room >= depth)
    bucket = number(gram_hashes(data, depth)[at], at) if len(at) else np.zeros(len(data), np.int64)
    while depth < rule.length:
        at = np.flatnonzero((bucket > 0) & (room >= 2 * depth))
        at = at[bucket[at + depth] > 0]
        bucket = number(bucket[at] << 32 | bucket[at + depth], at)
        depth *= 2
    return bucket > 0


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key (k1, k2) of a row's doc_id and text."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "k2": F.xxhash64("text")})


def _anchor_rows(texts: DataFrame, rule: Repeat, contexts: bool) -> DataFrame:
    """gram of each anchor of the keyed texts; with ``contexts`` its key, place and context digest (c1, c2) as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = text_view(batch.column("text"))
            for i, j in slices(starts, ends, SLICE):
                part, base = data[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
                found = anchors(part, base, ends[i:j] - starts[i], rule)
                gram = pa.array(found["gram"].view(np.int64))
                if not contexts:
                    yield pa.RecordBatch.from_arrays([gram], names=["gram"])
                    continue
                raw, at = part.tobytes(), base[found["row"]]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[b : e + rule.length]) for b, e in zip((at + found["lo"]).tolist(), (at + found["hi"]).tolist(), strict=True)), np.int64).reshape(-1, 2)
                row = pa.array(i + found["row"])
                yield pa.RecordBatch.from_arrays(
                    [gram, batch.column("k1").take(row), batch.column("k2").take(row), *(pa.array(found[k].astype(np.int32)) for k in ("pos", "lo", "hi")), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())],
                    names=["gram", "k1", "k2", "pos", "lo", "hi", "c1", "c2"],
                )

    if not contexts:
        return texts.select("text").mapInArrow(run, "gram long")
    return texts.select("k1", "k2", "text").mapInArrow(run, "gram long, k1 long, k2 long, pos int, lo int, hi int, c1 long, c2 long")


def _contexts(texts: DataFrame, wanted: DataFrame, rule: Repeat) -> DataFrame:
    """The wanted anchors (gram, k1, k2, lo, hi, copies) with the bytes of their contexts."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "lo", "hi", "copies")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, _ = text_view(batch.column("text"))
            want = batch.column("wanted")
            rows, raw = pa.array(np.repeat(np.arange(batch.num_rows), want.value_lengths().to_numpy())), data.tobytes()
            flat = want.flatten()
            gram, lo, hi, copies = (flat.field(k) for k in range(4))
            at = starts[rows.to_numpy()]
            context = [raw[b : e + rule.length] for b, e in zip((at + lo.to_numpy()).tolist(), (at + hi.to_numpy()).tolist(), strict=True)]
            for b in range(0, len(context), 4096):
                s = slice(b, b + 4096)
                yield pa.RecordBatch.from_arrays([gram[s], batch.column("k1").take(rows[s]), batch.column("k2").take(rows[s]), lo[s], copies[s], pa.array(context[s], pa.binary())], names=["gram", "k1", "k2", "lo", "copies", "context"])

    joined = texts.join(lists, ["k1", "k2"])
    return joined.mapInArrow(run, "gram long, k1 long, k2 long, lo int, copies long, context binary")


def _refined(contexts: DataFrame, rule: Repeat) -> DataFrame:
    """Spans (k1, k2, start, end) of the repeated windows of contexts that have one copy, bucket by bucket."""

    def solve(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(groups).combine_chunks()
        context = rows.column("context").to_pylist()
        sizes = np.array([len(c) for c in context])
        flag = repeated_windows(np.frombuffer(b"".join(context), np.uint8), sizes, rule)
        flag &= np.repeat(rows.column("copies").to_numpy() == 1, sizes)
        return _spans(flag, sizes, rows.column("k1"), rows.column("k2"), rows.column("lo").to_numpy(), rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            begin = int(np.argmax(gram == gram[-1]))  # of the last bucket, which may go on in the next batch
            complete = begin > 0 or held and held[-1].column("gram")[-1].as_py() != gram[-1]
            size += batch.column("context").nbytes
            if complete and size >= AT_ONCE:
                yield solve([*held, batch.slice(0, begin)])
                held, batch = [], batch.slice(begin)
                size = batch.column("context").nbytes
            held.append(batch)
        if held:
            yield solve(held)

    parts = contexts.repartition("gram").sortWithinPartitions("gram")
    return parts.mapInArrow(run, "k1 long, k2 long, start int, end int")


def _spans(flag: np.ndarray, sizes: np.ndarray, k1, k2, lo: np.ndarray, rule: Repeat) -> pa.RecordBatch:
    """The runs of flagged positions as spans; contexts end with positions that begin no window, so runs don't cross them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2] - 1
    row = np.searchsorted(np.cumsum(sizes), begin, "right")
    shift = lo[row] - (np.cumsum(sizes) - sizes)[row]
    at = pa.array(row)
    take = lambda c: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).take(at)
    return pa.RecordBatch.from_arrays([take(k1), take(k2), pa.array((begin + shift).astype(np.int32)), pa.array((end + shift + rule.length).astype(np.int32))], names=["k1", "k2", "start", "end"])


def _counted(contexts: DataFrame, rule: Repeat) -> DataFrame:
    """The same spans for buckets too large for a task: digests of all their windows are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                context, lo = batch.column("context")[k].as_py(), batch.column("lo")[k].as_py()
                n = len(context) - rule.length + 1
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(context[i : i + rule.length]) for i in range(n)), np.int64).reshape(-1, 2)
                fill = lambda c: pa.array([batch.column(c)[k].as_py()] * n, pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([fill("k1"), fill("k2"), fill("copies"), pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["k1", "k2", "copies", "start", "w1", "w2"])

    windows = contexts.mapInArrow(run, "k1 long, k2 long, copies long, start int, w1 long, w2 long")
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    return windows.filter("copies = 1").join(often, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + rule.length).alias("end"))


def spans(texts: DataFrame, rule: Repeat) -> DataFrame:
    """(k1, k2, spans): what is to go from each of the keyed texts that loses something, as unsorted spans."""
    # Aggregates are written before they are joined: a join of two plain exchanges can split a bucket with very many rows.
    often = cut(_anchor_rows(texts, rule, False).groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    found = cut(_anchor_rows(texts, rule, True).join(often, "gram"))
    context = ["gram", "before", "wide", "c1", "c2"]
    found = found.withColumns({"before": F.col("pos") - F.col("lo"), "wide": F.col("hi") - F.col("lo")})
    classes = cut(found.groupBy(*context).agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one")))
    whole = found.join(classes.filter("copies > 1").select(*context), context).select("k1", "k2", F.col("lo").alias("start"), (F.col("hi") + rule.length).alias("end"))
    mixed = cut(classes.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = classes.join(mixed, "gram").select("gram", "kinds", "copies", "one.*")
    refined = _refined(_contexts(texts, wanted.filter(F.col("kinds") <= MOST), rule), rule)
    counted = _counted(_contexts(texts, wanted.filter(F.col("kinds") > MOST), rule), rule)
    both = whole.unionByName(refined).unionByName(counted)
    return both.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _word_codes(texts: DataFrame) -> DataFrame:
    """The keyed texts with ``CODE`` bytes of hash for each word instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = text_view(batch.column("text"))
            codes = []
            for i, j in slices(starts, ends, SLICE):
                part, base = data[starts[i] : ends[j - 1]], starts[i]
                begin, end, row = word_bounds(part, starts[i:j] - base, ends[i:j] - base)
                raw, at = word_hashes(part, begin, end).astype(np.uint32).tobytes(), CODE * np.searchsorted(row, np.arange(j - i + 1))
                codes += [raw[b:e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(codes, pa.binary())], names=["k1", "k2", "text"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, text binary")


def word_runs(texts: DataFrame, words: int) -> DataFrame:
    """(k1, k2, runs): the runs of at least ``words`` words of the keyed texts that stand in more than one place, as unsorted spans of word codes.

    A string of ``words`` codes repeats where and only where the words do, whatever stands between them.
    The codes are made anew wherever they are read: that costs less than room for them on disk.
    """
    return spans(_word_codes(texts), Repeat(length=CODE * words, gram=words)).withColumnRenamed("spans", "runs")


def _word_cuts(raw: bytes, runs: list[dict]) -> list[tuple[int, int]]:
    """The bytes from the first word's start to the last word's end of each run of word codes."""
    data = np.frombuffer(raw, np.uint8)
    begin, end, _ = word_bounds(data, np.zeros(1, np.int64), np.array([len(data)]))
    whole = [(-(-r["start"] // CODE), r["end"] // CODE) for r in runs]
    return [(int(begin[b]), int(end[e - 1])) for b, e in whole if e > b]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for b, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _cuts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """The bytes and the merged spans of each row."""
    data, starts, ends = text_view(batch.column("text"))
    lists = batch.column("spans")
    count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    begin, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    raw, at = data.tobytes(), np.cumsum(count) - count
    for s, e, a, n in zip(starts.tolist(), ends.tolist(), at.tolist(), count.tolist(), strict=True):
        yield raw[s:e], _merged(begin[a : a + n], end[a : a + n]) if n else []


def _with_spans(docs: DataFrame, columns: list[str], rule: Repeat, words: int | None = None) -> DataFrame:
    small_batches(docs.sparkSession)
    texts = _keyed(docs.select(*columns))
    joined = texts.join(spans(texts, rule), ["k1", "k2"], "left")
    return joined.join(word_runs(texts, words), ["k1", "k2"], "left") if words else joined


def repeats(docs: DataFrame, rule: Repeat = Repeat()) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal run of bytes that goes, in order) and kept (the remaining bytes) of each row of ``docs``."""
    joined = _with_spans(docs, ["doc_id", "text"], rule).select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for raw, cuts in _cuts(batch):
                sizes.append(len(raw))
                gone.append([{"start": b, "end": e} for b, e in cuts])
                kept.append(b"".join(raw[b:e] for b, e in zip([0, *(e for _, e in cuts)], [*(b for b, _ in cuts), len(raw)], strict=True)))
            spans = pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), spans, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """The figures of what ``repeats`` has found: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, rule: Repeat = Repeat(), words: int | None = None) -> DataFrame:
    """``docs`` without the repeated bytes; only whole characters go, and rows that lose all their text go, too.

    With ``words``, runs of that many words that stand in more than one place go as well, however few
    bytes they have.  A column ``n_chars`` is set to the new length; all other columns are kept as they are, whatever their names.
    """
    columns = docs.columns
    # On the way the caller's columns have names that no column of this module has.
    carried = [c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(columns)]
    joined = _with_spans(docs.toDF(*carried), carried, rule, words).select(*carried, "spans", *(["runs"] if words else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            runs = batch.column("runs").to_pylist() if words else [None] * batch.num_rows
            for (raw, gone), more in zip(_cuts(batch), runs, strict=True):
                if more:
                    gone = _merged(*np.array([*gone, *_word_cuts(raw, more)], np.int64).reshape(-1, 2).T)
                parts, at = [], 0
                for b, e in gone:
                    while b < e and raw[b] & 0xC0 == 0x80:
                        b += 1
                    while b < e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    parts.append(raw[at:b])
                    at = e
                texts.append(b"".join([*parts, raw[at:]]).decode() if gone else None)
            changed = pa.array([t is not None for t in texts])
            text = pa.compute.if_else(changed, pa.array(texts, pa.string()), batch.column("text").cast(pa.string()))
            own = zip(columns, map(batch.column, carried), strict=True)
            out = [text if c == "text" else pa.compute.if_else(changed, pa.compute.utf8_length(text).cast(v.type), v) if c == "n_chars" else v for c, v in own]
            keep = pa.compute.invert(pa.compute.and_(changed, pa.compute.equal(pa.compute.fill_null(text, "-"), "")))
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(keep)

    return joined.mapInArrow(run, docs.schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeats(table(spark, sf_dir, "documents")))
