"""Near-duplicate documents by bottom-k sketches and exact Jaccard similarity.

A document is the set of its word shingles, as 64-bit hashes of one function; its sketch is the
``k`` smallest of them.  The steps:

1. documents with equal sets form a class, found by a 128-bit digest; only the class's smallest
   doc_id goes on, so exact copies cost one row each;
2. the sketches are turned into inverted lists of retained values.  A pair at the threshold
   shares at least ``least_shared`` values but for a probability of 1e-9, so a pair meets in a
   list even if each document enters only the lists of its rarest values (all but
   ``least_shared - 1`` of them).  Values that no other document has drop out at once;
3. lists that begin with the same document are merged, and long ones are cut into blocks whose
   pairs of blocks go to different tasks, so that no list has to fit in one;
4. a task counts the overlap of sketches, estimates similarity from the union's sketch, drops
   what can't reach the threshold, and verifies the rest on the full sets.  It returns a spanning forest of the
   links it found, not all pairs;
5. links are joined into components by alternating stars, with checkpoints.

Edge cases: a null text, or one without words, has an empty set and is linked with nothing;
with fewer words than a shingle has, the whole sequence is the one shingle; repeated rows and
equal texts share a class; rows with a null doc_id take part only as members of a class that
has an id (else component_id is null and they are kept); extra columns are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import LOWER, cut, mix, slices, small_batches, table, text_view, word_bounds, word_hashes

#: Documents and shingles in one block of a merged list; a task compares two blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 2000, 2_000_000


@dataclass(frozen=True)
class Near:
    """Words in a shingle, the least similarity in percent, values in a sketch."""

    words: int = 5
    percent: int = 80
    k: int = 32

    def least_shared(self) -> int:
        """The most values that a pair at the threshold shares but for a probability of 1e-9."""
        p, tail, c = self.percent / 100, 0.0, 0
        while True:
            tail += math.comb(self.k, c) * p**c * (1 - p) ** (self.k - c)
            if tail > 1e-9:
                return max(1, c)
            c += 1


# --- shingle sets ---------------------------------------------------------------------


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of text at data[starts:ends]."""
    begin, end, row = word_bounds(data, starts, ends)
    words = word_hashes(LOWER[data], begin, end)
    count = np.bincount(row, minlength=len(starts))
    at = np.cumsum(count) - count
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + len(h)]
    h = mix(h)
    none = np.zeros(0, np.uint64)
    out = []
    for a, c in zip(at.tolist(), count.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(h[a : a + c - n + 1]))
        elif c:
            short = np.zeros(1, np.uint64)
            for w in words[a : a + c]:
                short = short * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix(short + np.uint64(c)))
        else:
            out.append(none)
    return out


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    data, starts, ends = text_view(column)
    for i, j in slices(starts, ends):
        yield from shingle_sets(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], n)


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, digest (d1, d2), sketch and the text's hash of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, flat = [], [], []
            for s in _sets(batch.column("text"), near.words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                flat.append(s[: near.k])
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            bounds = np.cumsum([0, *map(len, flat)]).astype(np.int32)
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)), batch.column("text_hash")],
                names=["doc_id", "n_shingles", "d1", "d2", "sketch", "text_hash"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, text_hash long")


# --- candidates -----------------------------------------------------------------------


def merged_lists(classes: DataFrame, near: Near) -> DataFrame:
    """(hub, rep, n_shingles) : the inverted lists that hold two documents or more, those of one first document merged.

    ``classes`` has rep, n_shingles and sketch.
    """
    c = near.least_shared()
    values = classes.select("rep", F.explode("sketch").alias("value"))
    # Written, so that the join below stands on two plain exchanges and a value with very many rows can be split.
    often = cut(values.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1"))
    shared = values.join(often, "value").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("shared"))
    shared = shared.join(classes.select("rep", "n_shingles"), "rep")
    size = F.least(F.lit(near.k), F.col("n_shingles"))
    # What a partner must share at least, and so how many of the rarest values suffice.
    need = F.least(F.lit(c), F.ceil(F.col("n_shingles") * near.percent / 100))
    enter = F.greatest(F.lit(0), F.size("shared") - need + 1).cast("int")
    lists = cut(shared.filter(size >= need).select("rep", "n_shingles", F.explode(F.slice("shared", F.lit(1), enter)).alias("s")).select("rep", "n_shingles", F.col("s.value").alias("value")))
    hubs = cut(lists.groupBy("value").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("value", "hub"))
    return cut(lists.join(hubs, "value").select("hub", "rep", "n_shingles").distinct())


def blocked(lists: DataFrame) -> DataFrame:
    """rep and its places: an array of (hub, blocks of that hub)."""
    sizes = cut(lists.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    return lists.join(sizes, "hub").groupBy("rep").agg(F.collect_list(F.struct("hub", "blocks")).alias("places"))


# --- verification ---------------------------------------------------------------------


def _overlaps(rows: list[np.ndarray], n: int) -> np.ndarray:
    """How many values each pair of rows shares."""
    out = np.zeros((n, n), np.int32)
    if not rows:
        return out
    values = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    runs = np.flatnonzero(np.diff(edge) > 1)
    for b, e in zip(edge[runs].tolist(), edge[runs + 1].tolist(), strict=True):
        r = owner[b:e]
        out[r[:, None], r] += 1
    return out


def _union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Values of the union's sketch that both sketches hold."""
    union = np.union1d(a, b)[:k]
    return int((np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)).sum())


def forest(sets: list[np.ndarray], ids: list[int], side: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of side 0 and 1, or among all if all have side 0."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    tops = [s[: near.k] for s in sets]
    shared = _overlaps(tops, n)
    need = np.minimum(near.least_shared(), np.ceil(np.minimum.outer(size, size) * near.percent / 100))
    fits = 100 * np.minimum.outer(size, size) >= near.percent * np.maximum.outer(size, size)
    maybe = fits & (shared >= need) & (shared > 0)
    np.fill_diagonal(maybe, False)
    if side.any():
        maybe &= side[:, None] != side
    a, b = np.nonzero(np.triu(maybe))
    if len(a) <= 4 * n:
        link = np.zeros((n, n), bool)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if min(size[i], size[j]) > near.k and _union_estimate(tops[i], tops[j], near.k) < near.least_shared():
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            link[i, j] = link[j, i] = 100 * both >= near.percent * (size[i] + size[j] - both)
    else:  # many pairs: all overlaps of the full sets at once
        both = _overlaps(sets, n)
        link = maybe & (100 * both >= near.percent * (np.add.outer(size, size) - both))
    out, seen = [], np.zeros(n, bool)
    linked = link.any(1)
    for root in np.flatnonzero(linked).tolist():
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reach = np.flatnonzero(link[front].any(0) & ~seen)
            seen[reach] = True
            out += [(ids[root], ids[x]) for x in reach.tolist() if ids[x] != ids[root]]
            front = reach
    return out


def links(docs: DataFrame, places: DataFrame, near: Near) -> DataFrame:
    """(a, b): links that join all that is linked, among the documents that have places."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, where = batch.column("rep").to_pylist(), batch.column("places").to_pylist()
            out: list[tuple] = []
            for rep, spots, s in zip(reps, where, _sets(batch.column("text"), near.words), strict=True):
                own = int(mix(np.array([rep], np.int64).view(np.uint64))[0] >> np.uint64(1))
                for spot in spots:
                    g = spot["blocks"]
                    mine = own % g
                    out += [(spot["hub"], min(mine, o), max(mine, o), mine, rep, s.tobytes()) for o in range(g)]
                if len(out) > 2000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    def verify(group: pa.Table) -> pa.Table:
        first, second = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        ids = group.column("rep").to_pylist()
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        side = (np.array(group.column("own").to_pylist()) == second) & (first != second)
        pairs = forest(sets, ids, side, near)
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    joined = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(places, "rep")
    rows = joined.mapInArrow(expand, "hub long, x int, y int, own int, rep long, shingles binary")
    return rows.groupBy("hub", "x", "y").applyInArrow(verify, "a long, b long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["hub", "x", "y", "own", "rep", "shingles"])


# --- components -----------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b); a component is named after its smallest node.

    Alternating large and small stars; each round is checkpointed, and it ends when a round changes nothing.
    """
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    sign = (F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long")))
    before = None
    while (now := tuple(state.agg(*sign).first())) != before:
        before = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        state = cut(small.filter("u <> v").distinct())
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text)."""
    return _near_duplicates(docs, near).select("doc_id", "n_shingles", "component_id", "kept")


def _near_duplicates(docs: DataFrame, near: Near) -> DataFrame:
    """The same with the digest (d1, d2) of the row's set and the hash of its text."""
    small_batches(docs.sparkSession)
    rows = cut(sketches(docs, near))
    # A class's representative brings its sketch; repeated rows of it are alike.
    first = F.min_by(F.struct("n_shingles", "sketch"), "doc_id").alias("first")
    classes = cut(rows.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), first))
    chosen = classes.filter("rep IS NOT NULL").select("rep", "first.n_shingles", "first.sketch")
    members = rows.select("doc_id", "n_shingles", "d1", "d2", "text_hash")
    places = blocked(merged_lists(chosen, near))
    found = components(links(docs, places, near))
    named = classes.select("d1", "d2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = members.join(named, ["d1", "d2"], "left")
    own: Column = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "d1", "d2", "text_hash", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns; rows without words stay.

    Of the rows whose document is the first of its component one stays for each doc_id and set of shingles; of rows
    with a null doc_id one for each set, if no row with a doc_id has the same set.
    """
    found = _near_duplicates(docs, near).filter("n_shingles > 0").groupBy("doc_id", "d1", "d2", "text_hash").agg(F.first("kept").alias("kept"))
    found = cut(found)
    stay = found.filter("kept").groupBy("doc_id", "d1", "d2").agg(F.min("text_hash").alias("text_hash"))
    key = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    names = [*key, "_text"]
    stay = stay.withColumns(key).select(*key, F.col("text_hash").alias("_text"))
    gone = found.withColumns(key).select(*key, F.col("text_hash").alias("_text")).join(stay, names, "left_anti").withColumn("_gone", F.lit(True))
    rows = docs.withColumns(key | {"_text": F.xxhash64("text")}).join(gone, names, "left").filter("_gone IS NULL")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy("_text")))
    return rows.filter((F.col("_n") == 1) | wordless).select(*docs.columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * inter >= 85 * (x.n + y.n - inter)
), r(a, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""".replace("\\\\", "\\")
