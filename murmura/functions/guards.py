"""The guards that look at tokens, in one Arrow pass: foreign scripts stripped, repetition, echo of a context.

A batch's tokens become numbers by one dictionary; what is asked of a token (its letters, its folded form) is found once for each distinct
one, and what is asked of a text (distinct tokens, the most frequent 3-gram, the longest run, 3-grams shared with a context) by sorting
numbers.  Batches are taken in slices of about ``SLICE`` bytes; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from murmura.functions.text import BASE
from murmura.session import ship

SLICE = 8 << 20
#: Unicode white space.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@dataclass(frozen=True)
class Guard:
    """When repetition counts as a loop and shared 3-grams as an echo; which letters are allowed, and what share of others a token may have."""

    allowed: str = BASE
    share: float = 0.5
    run: int = 4
    least: int = 12
    ratio: float = 0.45
    repeats: int = 3
    echo_tokens: int = 5
    echo: float = 0.8


@dataclass
class Tokens:
    """The tokens of ``n`` texts in order: the text of each, and its number among ``values``."""

    n: int
    row: np.ndarray
    code: np.ndarray
    values: pa.Array

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        lists = pc.split_pattern_regex(pc.fill_null(texts, ""), SPACE)
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
        return cls(len(texts), row[full], code[full], coded.dictionary)

    def only(self, kept: np.ndarray) -> Tokens:
        """The tokens whose value is ``kept``."""
        use = kept[self.code]
        return Tokens(self.n, self.row[use], self.code[use], self.values)

    def joined(self) -> pa.Array:
        """The texts anew, with one space between tokens."""
        upto = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=self.n))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), self.values.take(pa.array(self.code))), " ")


def letters(values: pa.Array, script: str) -> np.ndarray:
    left = pc.replace_substring_regex(values, pattern=f"(?:{script})+", replacement="")
    return pc.subtract(pc.utf8_length(values), pc.utf8_length(left)).to_numpy(zero_copy_only=False)


def folded(*parts: Tokens) -> tuple[list[np.ndarray], list[str]]:
    """The tokens of all ``parts`` as numbers of their forms in one case, and these forms."""
    number: dict[str, int] = {}
    out = []
    for t in parts:
        forms = [number.setdefault(v.lower().replace("ß", "ss"), len(number)) for v in t.values.to_pylist()]
        out.append(np.array(forms, np.int64)[t.code] if forms else np.zeros(0, np.int64))
    return out, list(number)


def trigrams(row: np.ndarray, form: np.ndarray, forms: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each run of three tokens."""
    at = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    return row[at], (form[at] * forms + form[at + 1]) * forms + form[at + 2]


def repetition(t: Tokens, rule: Guard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unique_ratio, top_trigram and degenerate of each text."""
    (form,), forms = folded(t)
    count = np.bincount(t.row, minlength=t.n)
    distinct = np.bincount(np.unique(t.row * len(forms) + form) // max(1, len(forms)), minlength=t.n)
    ratio = np.where(count > 0, distinct / np.maximum(count, 1), 1.0)
    row, gram = trigrams(t.row, form, len(forms))
    grams, gram = np.unique(gram, return_inverse=True)
    both, often = np.unique(row * max(1, len(grams)) + gram, return_counts=True)
    top = np.zeros(t.n, np.int64)
    np.maximum.at(top, both // max(1, len(grams)), often)
    # A token of punctuation only ends a run and makes none.
    bare = [f.strip(".,!?…:;") for f in forms]
    number = {b: i for i, b in enumerate(dict.fromkeys(bare))}
    key = np.array([number[b] if b else -1 for b in bare], np.int64)[form] if forms else form
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (t.row[1:] != t.row[:-1])
    begin = np.flatnonzero(new)
    run = np.zeros(t.n, np.int64)
    np.maximum.at(run, t.row[begin], np.where(key[begin] >= 0, np.diff(np.append(begin, len(key))), 0))
    return ratio, top, (run >= rule.run) | (count >= rule.least) & ((ratio < rule.ratio) | (top >= rule.repeats))


def echo(t: Tokens, context: Tokens, rule: Guard) -> tuple[np.ndarray, np.ndarray]:
    """echo_share, the share of a text's 3-grams that its context has, and whether that makes it an echo."""
    (own, given), forms = folded(t, context)
    row, gram = trigrams(t.row, own, len(forms))
    there, other = trigrams(context.row, given, len(forms))
    grams, code = np.unique(np.concatenate([gram, other]), return_inverse=True)
    size = max(1, len(grams))
    shared = np.isin(row * size + code[: len(gram)], there * size + code[len(gram) :])
    count = np.bincount(row, minlength=t.n)
    share = np.bincount(row, shared, t.n) / np.maximum(count, 1)
    return share, (np.bincount(t.row, minlength=t.n) >= rule.echo_tokens) & (np.bincount(there, minlength=t.n) > 0) & (share >= rule.echo) & (count > 0)


def slices(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    upto = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE, "right")))
        yield batch.slice(i, j - i)
        i = j


def guarded(df: DataFrame, text: str, context: str | None = None, rule: Guard = Guard(), strip: bool = True) -> DataFrame:
    """Adds kept (the text without foreign tokens), n_tokens, unique_ratio, top_trigram and degenerate of what is kept, and with ``context`` echo_share and echo.

    Without ``strip`` all tokens are kept.  A null text has no tokens.  The context itself is left out of the result.
    """
    ship(df.sparkSession)
    own = [c for c in df.columns if c != context]
    more = "kept string, n_tokens long, unique_ratio double, top_trigram long, degenerate boolean" + (", echo_share double, echo boolean" if context else "")
    schema = df.select(*own).schema
    for field in more.split(", "):
        schema = schema.add(*field.split(" "))
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, *([context] if context else [])):
                t = Tokens.of(batch.column(text))
                if strip:
                    t = t.only(letters(t.values, rule.allowed) >= (1 - rule.share) * letters(t.values, r"\p{L}"))
                found = [t.joined(), np.bincount(t.row, minlength=t.n), *repetition(t, rule)]
                if context:
                    found += echo(t, Tokens.of(batch.column(context)), rule)
                columns = [batch.column(c) for c in own] + [x if isinstance(x, pa.Array) else pa.array(x) for x in found]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], names=kinds.names)

    return df.mapInArrow(run, schema)


def echoed(df: DataFrame, text: str, context: str, rule: Guard = Guard()) -> DataFrame:
    """Adds echo_share, the share of the text's 3-grams that the context has in one case, and echo, whether that makes the text an echo.

    Texts and contexts may be whole documents; nulls have no tokens.
    """
    ship(df.sparkSession)
    schema = df.select("*").schema.add("echo_share", "double").add("echo", "boolean")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, context):
                found = echo(Tokens.of(batch.column(text)), Tokens.of(batch.column(context)), rule)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *map(pa.array, found)], kinds, strict=True)], names=kinds.names)

    return df.mapInArrow(run, schema)
