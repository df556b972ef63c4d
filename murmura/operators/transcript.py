"""Transcripts from chunks: paragraphs, language spans, diffs, epochs, guards over rows.

Chunks have session_id, chunk_id, start, end, text, speaker, recording and where needed seg_id
and language.  They are ordered by (start, chunk_id), so late arrivals land in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from murmura.functions.text import squeeze
from murmura.session import ship

ORDER = ("start", "chunk_id")


def by_session(*more: str) -> Window:
    return Window.partitionBy("session_id", *more).orderBy(*ORDER)


def islands(df: DataFrame, same: list[str], window: Window, name: str = "island") -> DataFrame:
    """Numbers the runs of rows that agree in the columns ``same``."""
    agree = F.lit(True)
    for c in same:
        agree = agree & F.lag(c).over(window).eqNullSafe(F.col(c))
    first = F.row_number().over(window) == 1
    return df.withColumn("_new", F.when(first | ~agree, 1).otherwise(0)).withColumn(name, F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def spoken(chunks: DataFrame) -> DataFrame:
    """Chunks with text, the speaker filled in."""
    return chunks.filter("trim(text) <> ''").withColumn("speaker", F.coalesce("speaker", F.lit(0)))


def ordered(*columns: str) -> Column:
    """The group's rows in transcript order as an array of structs."""
    return F.array_sort(F.collect_list(F.struct(*ORDER, *columns)))


def paragraphs(chunks: DataFrame) -> DataFrame:
    """Consecutive chunks of one speaker and recording as one paragraph each."""
    rows = ordered("seg_id", "end", "text", "language")
    grouped = islands(spoken(chunks), ["speaker", "recording"], by_session()).groupBy("session_id", "island", "speaker", "recording").agg(rows.alias("rows"))
    first, last = F.col("rows")[0], F.element_at("rows", -1)
    return grouped.select(
        "session_id",
        first["chunk_id"].alias("paragraph_id"),
        last["seg_id"].alias("segment_id"),
        F.bround(first["start"], 2).alias("start"),
        F.bround(last["end"], 2).alias("end"),
        F.concat(F.lit("Speaker "), (F.col("speaker") + 1).cast("string")).alias("speaker"),
        F.col("recording"),
        F.array_join("rows.text", " ").alias("text"),
        F.array_join(F.array_distinct("rows.language"), "+").alias("language"),
        F.size("rows").cast("long").alias("n_chunks"),
    )


def token_languages(df: DataFrame, language: Column, keys: list[str]) -> DataFrame:
    """The tokens of ``text`` in order: keys, n (from 0), size and padded (its characters, and those with the white space before), own, its language or null.

    ``language`` is a Column over the column ``token``.
    """
    pieces = df.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)\s*\S+"), F.lit(0))).alias("n", "piece"))
    tokens = pieces.select(*keys, "n", F.char_length("piece").alias("padded"), F.regexp_replace("piece", r"(?U)^\s+", "").alias("token"))
    return tokens.select(*keys, "n", F.char_length("token").alias("size"), "padded", language.cast("string").alias("own"))


def _runs(n: np.ndarray, size: np.ndarray, padded: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the tokens of whole texts (``own`` is a language's number or -1): each span's first token, number in its text, language, start and end."""
    begin = np.flatnonzero(n == 0)
    text = np.cumsum(n == 0) - 1
    total = np.cumsum(padded)
    end = total - (total[begin] - padded[begin])[text]
    # A token without a language takes the last one's before it, those at the front the first one's after them.
    at = np.maximum.accumulate(np.where(own >= 0, np.arange(len(own)), -1))
    first = np.full(len(begin), -1)
    known = np.flatnonzero(own >= 0)
    which, where = np.unique(text[known], return_index=True)
    first[which] = own[known[where]]
    language = np.where(at >= begin[text], own[at], first[text])
    new = (n == 0) | np.concatenate([[True], language[1:] != language[:-1]])[: len(n)]
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(n)) - 1
    span = np.arange(len(start)) - np.searchsorted(start, begin)[text[start]]
    return start, span, language[start], end[start] - size[start], end[last]


def language_spans(df: DataFrame, language: Column, keys: list[str], fallback: str) -> DataFrame:
    """Spans of one language each: keys, span, language, start_char, end_char.  A text without any language is ``fallback``'s.

    Tokens follow one another as ``posexplode`` gives them, so a text's spans are found where the text is read, without a shuffle; a task
    holds the tokens' numbers of one text at least.
    """
    ship(df.sparkSession)
    tokens = token_languages(df, language, keys)
    schema = df.select(*keys).schema.add("span", "integer").add("language", "string").add("start_char", "integer").add("end_char", "integer")
    kinds = to_arrow_schema(schema)

    def solve(rows: pa.Table) -> pa.RecordBatch:
        own = rows.column("own").combine_chunks().dictionary_encode()
        code = pc.fill_null(own.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "size", "padded"))
        start, span, lang, a, b = _runs(*number, code)
        names = pc.fill_null(own.dictionary.take(pa.array(lang, mask=lang < 0)), fallback)
        of = pa.array(start)
        columns = [rows.column(k).combine_chunks().take(of) for k in keys] + [pa.array(span), names, pa.array(a), pa.array(b)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            heads = np.flatnonzero(batch.column("n").to_numpy() == 0)
            if len(heads):
                # All texts but the last one are whole.
                if held or heads[-1]:
                    yield solve(pa.Table.from_batches([*held, batch.slice(0, heads[-1])]))
                held, batch = [], batch.slice(heads[-1])
            held.append(batch)
        if sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held))

    return tokens.mapInArrow(run, schema)


def rebased_spans(chunks: DataFrame) -> DataFrame:
    """Language spans of paragraphs: the chunks' own, moved by the text before them, equal neighbours joined."""
    rows = islands(spoken(chunks.withColumn("text", squeeze(F.col("text")))), ["speaker", "recording"], by_session())
    inside = Window.partitionBy("session_id", "island").orderBy(*ORDER)
    length = F.char_length("text")
    shift = F.sum(length + 1).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - length - 1
    rows = rows.select("session_id", "island", *ORDER, "language", shift.cast("int").alias("start_char"), (shift + length).cast("int").alias("end_char"))
    runs = islands(rows, ["language"], inside, "span")
    spans = runs.groupBy("session_id", "island", "span", "language").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    return spans.select("session_id", F.col("island").cast("int").alias("paragraph"), (F.col("span") - 1).cast("int").alias("span"), "language", "start_char", "end_char")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two snapshots that differ, by key: added, removed or changed."""
    fields = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*fields).alias("old"))
    b = new.select(*key, F.struct(*fields).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select(*key, change.alias("change"))


def diff_modes(old: DataFrame, new: DataFrame) -> DataFrame:
    """How each session's transcript is published: none, append (only the last paragraph differs) or refresh."""
    changed = snapshot_diff(old, new, ["session_id", "paragraph_id"])
    last = new.groupBy("session_id").agg(F.max_by("paragraph_id", F.struct("start", "paragraph_id")).alias("last_id"))
    counts = changed.groupBy("session_id").agg(F.count("*").alias("n_changed"), F.max("paragraph_id").alias("one"), F.max((F.col("change") == "removed").cast("int")).alias("gone"))
    mode = F.when(F.coalesce("n_changed", F.lit(0)) == 0, "none").when((F.col("n_changed") == 1) & (F.col("gone") == 0) & (F.col("one") == F.col("last_id")), "append").otherwise("refresh")
    return last.join(counts, "session_id", "left").select("session_id", F.coalesce("n_changed", F.lit(0)).alias("n_changed"), mode.alias("mode"))


def export_lines(paras: DataFrame) -> DataFrame:
    """Paragraphs as lines of a text export."""
    from murmura.functions.text import clock

    line = F.concat(F.lit("["), clock(F.col("start")), F.lit(" – "), clock(F.col("end")), F.lit("] "), F.col("speaker"), F.lit(" ("), F.col("language"), F.lit("):\n"), F.col("text"))
    return paras.select("session_id", "paragraph_id", line.alias("line"))


def session_summary(chunks: DataFrame) -> DataFrame:
    """Speakers, words, seconds and languages of each session."""
    from murmura.functions.text import word_count

    return spoken(chunks).groupBy("session_id").agg(
        F.countDistinct("speaker").alias("n_speakers"),
        F.count("*").alias("n_segments"),
        F.sum(word_count(F.col("text"))).cast("long").alias("n_words"),
        F.bround(F.sum(F.col("end") - F.col("start")), 3).alias("total_seconds"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )


def epochs(df: DataFrame, control: Column, order: Window) -> DataFrame:
    """Numbers the recordings of a stream: each control row begins the next one."""
    return df.withColumn("epoch", (1 + F.sum(control.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))


def repeat_guard(chunks: DataFrame, least: int = 25) -> DataFrame:
    """Marks long texts that equal the accepted text before them.

    A dropped repeat equals the row before it, so comparing with that row is the same as with the accepted one.
    """
    w = by_session()
    repeated = (F.char_length("text") > least) & (F.col("text") == F.lag("text").over(w))
    return spoken(chunks).withColumn("repeated", F.coalesce(repeated, F.lit(False)))


def rolling_context(chunks: DataFrame, n: int = 2, last: int = 1200) -> DataFrame:
    """The ``n`` texts before each chunk, cut to the last characters."""
    before = F.array_join(F.collect_list("text").over(by_session().rowsBetween(-n, -1)), " ")
    return spoken(chunks).withColumn("context", F.right(before, F.lit(last)))
