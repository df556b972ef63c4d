"""Quality rules: how far a document's characters and common words stray from its language.

A document is described by two histograms, over classes of characters and over the common
words of a language (all other words fall in one bin).  Each is compared with references by
Jensen-Shannon distance (root of the divergence in bits, 0 to 1); the nearest reference counts, so a
wrong language column does little harm.  A histogram of too few characters or words says
nothing and isn't judged (the minimum-length guards).

The references are measured over all documents by their column ``lang``, of those that pass the base
rules and the guards, each document counting once however long it is: the median share of each class
of characters (so that junk, as long as it is the smaller part, says little) and the mean shares of words.  The languages of ``COMMON_WORDS`` begin with the shares below, as if ``prior_docs`` documents had them;
other languages have a reference if ``prior_docs`` documents and ``least_share`` of all say so (which bounds how many
there are).  Documents in a language without a reference, and those mostly in another than the Latin script whose
language has none, are judged by the base rules only.

Edge cases: a null text has no words and fails the base rules; an empty or very short text
does too; very long texts are counted whole; a null ``lang``, or no such column, leaves the nearest reference; repeated
rows and ties are judged each for itself; extra columns are ignored by ``quality`` and kept by ``keep_good``; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import LOWER, cut, mix, slices, small_batches, table, text_view, word_bounds, word_hashes

# Common words of each language, most frequent first, and a first guess at the share of the first.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was with on as by be this are at from or an not have",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an",
    "es": "de la que el en y a los se las del un por con no su una para es al lo como más",
    "fr": "de la le et les des en un du une que pour est par dans qui avec pas sur au il ne ce",
}
FIRST_SHARE = 0.057

# A first guess at the shares of character classes in prose: lower-case or non-ASCII, upper-case, digit, white space, punctuation, symbol.
CLASS_SHARES = (0.785, 0.025, 0.015, 0.155, 0.0195, 0.0005)


@dataclass(frozen=True)
class Limits:
    """``char_distance`` and ``word_distance`` are the largest distances that pass; ``other_script`` is the largest share of letters beyond the Latin script."""

    min_chars: int = 80
    min_words: int = 40
    char_distance: float = 0.18
    word_distance: float = 0.37
    other_script: float = 0.3
    prior_docs: int = 100
    least_share: float = 0.001
    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8


def _classes() -> np.ndarray:
    lut = np.zeros(256, np.int64)
    lut[65:91] = 1
    lut[48:58] = 2
    lut[[9, 10, 11, 12, 13, 32]] = 3
    lut[33:48] = lut[58:65] = lut[91:97] = lut[123:128] = 5
    lut[list(b".,;:!?'\"()-")] = 4
    lut[128:192] = -1  # the later bytes of a character
    return lut


CLASSES = _classes()
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?")] = True


def _dictionary() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sorted hashes of all common words, their bins, and the words by bin."""
    words = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    hashes = word_hashes(data, ends - [len(w) for w in raw], ends)
    order = np.argsort(hashes)
    return hashes[order], order, words


WORD_HASHES, WORD_IDS, WORDS = _dictionary()
#: Bins of a histogram of words; the last is for all other words.
BINS = len(WORDS) + 1


@dataclass(frozen=True)
class References:
    """By language: the shares of character classes and of words, and which bins of words the language tells apart."""

    languages: tuple[str, ...]
    classes: np.ndarray
    words: np.ndarray
    own: np.ndarray


def prior() -> References:
    """The first guess, for the languages of ``COMMON_WORDS``: words by rank."""
    words = np.zeros((len(COMMON_WORDS), BINS))
    for k, line in enumerate(COMMON_WORDS.values()):
        for rank, w in enumerate(line.split()):
            words[k, WORDS.index(w)] = FIRST_SHARE / (rank + 1) ** 0.8
    own = words > 0
    words[:, -1], own[:, -1] = 1 - words.sum(1), True
    return References(tuple(COMMON_WORDS), np.tile(CLASS_SHARES, (len(words), 1)), words, own)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from one reference; 1 where a row is all zero."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0, (left + right) / 2)), 1.0)


def _sum_by_row(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts]


def repeated_words(hashes: np.ndarray, row: np.ndarray, n_rows: int, window: int) -> np.ndarray:
    """For each row, its words that stand in a window of ``window`` words found twice or more in the row."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    key = mix(key ^ mix(row[:n].astype(np.uint64)))
    at = np.flatnonzero(row[:n] == row[window - 1 :])
    at = at[np.argsort(key[at], kind="stable")]
    same = key[at][1:] == key[at][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + window, -1)
    return np.bincount(row[np.cumsum(change)[:-1] > 0], minlength=n_rows)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _histograms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """What the base rules count, and the histograms, of the rows whose text lies at data[starts:ends]."""
    n = len(starts)
    begin, end, row = word_bounds(data, starts, ends)
    n_words = np.bincount(row, minlength=n)
    kinds = CLASSES[data]
    where = np.repeat(np.arange(n), ends - starts)
    classes = np.bincount(where[kinds >= 0] * 6 + kinds[kinds >= 0], minlength=n * 6).reshape(n, 6)
    bare = np.where(STOPS[data[end - 1]], end - 1, end) if len(end) else end
    low = word_hashes(LOWER[data], begin, bare)
    at = np.minimum(np.searchsorted(WORD_HASHES, low), len(WORD_HASHES) - 1)
    ids = np.where(WORD_HASHES[at] == low, WORD_IDS[at], BINS - 1)
    repeats = repeated_words(word_hashes(data, begin, end), row, n, limits.window)
    return {
        "n_words": n_words,
        "word_chars": classes.sum(1) - classes[:, 3],
        "n_symbols": _sum_by_row(SYMBOLS[data], starts, ends),
        "n_repeat_words": repeats,
        "base_failed": (n_words < limits.least_words) | (100 * repeats > limits.repeat_percent * n_words),
        "classes": classes,
        "words": np.bincount(row * BINS + ids, minlength=n * BINS).reshape(n, BINS),
        "other_script": _sum_by_row((data >= 0xCD).astype(np.int64), starts, ends),
    }


def measure(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, languages: list[str | None], known: References, limits: Limits) -> dict[str, np.ndarray]:
    """The figures and the verdict of the rows whose text lies at data[starts:ends]."""
    found = _histograms(data, starts, ends, limits)
    classes, words, n_words = found["classes"], found["words"], found["n_words"]
    char_js = np.min([js_distance(classes, reference) for reference in known.classes], axis=0)
    merged = lambda own: np.column_stack([np.where(own[:-1], words[:, :-1], 0), words[:, -1] + np.where(own[:-1], 0, words[:, :-1]).sum(1)])
    word_js = np.min([js_distance(merged(own), reference) for reference, own in zip(known.words, known.own, strict=True)], axis=0)
    strange = ((classes.sum(1) >= limits.min_chars) & (char_js > limits.char_distance)) | ((n_words >= limits.min_words) & (word_js > limits.word_distance))
    has = np.array([x is None or x in known.languages for x in languages], bool)
    listed = np.array([x is not None and x in known.languages and x not in COMMON_WORDS for x in languages], bool)
    foreign = found["other_script"] > limits.other_script * found["word_chars"]
    judged = has & (listed | ~foreign)
    return found | {"char_distance": char_js, "word_distance": word_js, "kept": ~found["base_failed"] & ~(judged & strange)}


#: Steps in which the shares of character classes are counted for their medians.
LEVELS = 2048


def references(docs: DataFrame, limits: Limits = Limits()) -> References:
    """The references, measured over all of ``docs`` (text, lang); one pass, of which a row for each language and bin comes to the driver."""
    small_batches(docs.sparkSession)
    n_classes = len(CLASS_SHARES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(1 + BINS))
        levels: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros((n_classes, LEVELS + 1)))
        for batch in batches:
            data, starts, ends = text_view(batch.column("text"))
            languages = batch.column("lang").to_pylist()
            for i, j in slices(starts, ends):
                h = _histograms(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], limits)
                use = ~h["base_failed"] & (h["classes"].sum(1) >= limits.min_chars) & (h["n_words"] >= limits.min_words)
                for k in np.flatnonzero(use).tolist():
                    c, w = h["classes"][k], h["words"][k]
                    words[languages[i + k]] += np.concatenate([[1], w / w.sum()])
                    levels[languages[i + k]][np.arange(n_classes), np.rint(c / c.sum() * LEVELS).astype(int)] += 1
            if len(words) > 200:
                yield rows(words, levels)
                words.clear()
                levels.clear()
        yield rows(words, levels)

    def rows(words: dict, levels: dict) -> pa.RecordBatch:
        """Bin 0: documents; then the classes of characters by level, then words."""
        out = [(x, b if b == 0 else b + n_classes, 0, v) for x, sums in words.items() for b, v in enumerate(sums.tolist()) if v]
        out += [(x, 1 + c, at, v) for x, table in levels.items() for c, at, v in zip(*(a.tolist() for a in np.nonzero(table)), table[table > 0].tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["lang", "bin", "level", "value"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    parts = docs.select("text", lang.alias("lang")).mapInArrow(run, "lang string, bin int, level int, value double").filter("lang IS NOT NULL")
    parts = parts.groupBy("lang", "bin", "level").agg(F.sum("value").alias("value"))
    summed = cut(parts.groupBy("lang", "bin").agg(F.sum("value").alias("value"), F.percentile("level", 0.5, F.col("value").cast("long")).alias("median")))
    total = summed.filter("bin = 0").agg(F.sum("value")).first()[0] or 0.0
    # Only languages of a least share of the documents come here, so few do.
    enough = summed.filter((F.col("bin") == 0) & ((F.col("value") >= total * limits.least_share) | F.col("lang").isin(*COMMON_WORDS))).select("lang")
    n, classes, words = defaultdict(float), defaultdict(lambda: np.zeros(n_classes)), defaultdict(lambda: np.zeros(BINS))
    for r in summed.join(enough, "lang").collect():
        if r.bin == 0:
            n[r.lang] = r.value
        elif r.bin <= n_classes:
            classes[r.lang][r.bin - 1] = r.median
        else:
            words[r.lang][r.bin - 1 - n_classes] = r.value
    first, out = prior(), []
    shares = lambda x: x / max(x.sum(), 1e-9)
    for k, name in enumerate(first.languages):
        new = n[name] / (n[name] + limits.prior_docs)
        out.append((name, (1 - new) * first.classes[k] + new * shares(classes[name]), (1 - new) * first.words[k] + new * shares(_merge_bins(words[name], first.own[k])), first.own[k]))
    every = np.ones(BINS, bool)
    out += [(name, shares(classes[name]), shares(words[name]), every) for name in sorted(n) if n[name] >= limits.prior_docs and name not in COMMON_WORDS]
    return References(*(f(x) for f, x in zip((tuple, np.array, np.array, np.array), zip(*out, strict=True), strict=True)))


def _merge_bins(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The words of other languages put into the last bin."""
    out = np.where(own, words, 0)
    out[-1] += words[~own].sum()
    return out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
_ORDER = [f.split()[0] for f in FIELDS.split(", ")]


def _measured(batch: pa.RecordBatch, languages: list[str | None], known: References, limits: Limits) -> dict[str, np.ndarray]:
    data, starts, ends = text_view(batch.column("text"))
    parts = [measure(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], languages[i:j], known, limits) for i, j in slices(starts, ends)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, bool) for k in (*_ORDER, "kept") if k != "n_dup_lines"}


def _languages(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("lang").cast(pa.string()).to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows


def quality(docs: DataFrame, limits: Limits = Limits(), known: References | None = None) -> DataFrame:
    """doc_id with the figures and the verdict of each row of ``docs``; no shuffle but of the references' sums."""
    small_batches(docs.sparkSession)
    known = known or references(docs, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _measured(batch, _languages(batch), known, limits)
            out["n_dup_lines"] = np.array([duplicate_lines(t) for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k]) for k in _ORDER)], names=["doc_id", *_ORDER])

    columns = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return docs.select(*columns).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def keep_good(docs: DataFrame, limits: Limits = Limits(), known: References | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)
    known = known or references(docs, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measured(batch, _languages(batch), known, limits)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", *[F.col(c) for c in _ORDER])
