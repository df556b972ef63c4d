"""SentencePiece encoding and decoding in numpy batches.

A text is cut into segments: the spaces before a word (written as U+2581) and the word.  No
piece of the models read here spans two segments, so segments are encoded one by one, each
distinct segment of a batch once.  Segments of equal length advance together as one matrix of
characters: all their substrings up to the longest piece are hashed and probed in the sorted piece keys,
which gives a table of scores, and numpy maxima over that table make the decisions:

- unigram models: Viterbi; at each character the maximum over all pieces that end there is
  kept with a backpointer to where that piece begins;
- BPE models: a piece's score is its merge rank and the best segmentation is the one greedy
  merging reaches, which Viterbi over scores doesn't give.  Here the maximum goes over the
  neighbouring pairs of each segment, and the best pair (the leftmost on a tie) is merged, in
  all segments at once, until none is left.

Characters without a piece become the pieces of their UTF-8 bytes.  Decoding gathers the bytes
of all pieces at once; encoding and decoding return every text that has no U+2581 (a text's own
U+2581 reads as a space, as the format has it).

Edge cases: null texts stay null in encoding (no pieces, length 0) and decode to the empty
text; empty texts have no pieces; segments over ``LONG`` characters are merged by a heap, one by one;
repeated rows are encoded each for itself; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from murmura.llm.common import mix, slices, small_batches, table, text_view, word_bounds, word_hashes

SPACE = "▁"
#: Segments of more characters than this don't go in a matrix.
LONG = 64
#: Distinct segments that a worker remembers.
REMEMBERED = 250_000

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True
LOWEST = np.float64(-np.inf)


@dataclass(frozen=True)
class Model:
    """Pieces with scores; ``merges``: a BPE model.  ``kinds``: n(ormal), b(yte) or c(ontrol) of each id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    merges: bool


def load_model(path: str) -> Model:
    """Read a model file; it must have byte pieces, add a space in front and leave text as it is."""
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sp.SentencePieceProcessor(model_file=path).serialized_model_proto())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
        raise ValueError("only models with byte fallback, a space in front and no normalisation are supported")
    kinds = "".join({1: "n", 4: "n", 6: "b"}.get(p.type, "c") for p in proto.pieces)
    return Model(tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), kinds, proto.trainer_spec.model_type == 2)


def _hash_strings(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of character codes."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _STEP + codes[:, k].astype(np.uint64) + np.uint64(1)
    return mix(h + np.uint64(codes.shape[1]))


def _matrix(strings: list[str], n: int) -> np.ndarray:
    return np.array(strings, f"U{n}").view(np.uint32).reshape(len(strings), n)


class Pieces:
    """A model made ready: sorted piece keys, and the bytes of each id."""

    def __init__(self, model: Model):
        self.model = model
        by_length: dict[int, list[int]] = {}
        for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == "n":
                by_length.setdefault(len(p), []).append(i)
        keys = np.concatenate([_hash_strings(_matrix([model.pieces[i] for i in ids], n)) for n, ids in by_length.items()])
        ids = np.concatenate(list(by_length.values()))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        self.scores = np.array(model.scores)[self.ids]
        self.longest = max(by_length)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.by_text = {p: i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == "n"}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == "b"}
        raw = [p.replace(SPACE, " ").encode() if k == "n" else bytes([int(p[3:5], 16)]) if k == "b" else b"" for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.sizes = np.array([len(r) for r in raw])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.known: dict[int, tuple[int, ...]] = {}

    # --- encoding -----------------------------------------------------------------

    def _table(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece codes[:, i : i + n] at [n, :, i]; -inf and -1 where there is none."""
        rows, length = codes.shape
        most = min(length, self.longest)
        score = np.full((most + 1, rows, length + 1), LOWEST, np.float32)
        ids = np.full((most + 1, rows, length + 1), -1, np.int32)
        h = np.zeros((rows, length), np.uint64)
        plus = codes.astype(np.uint64) + np.uint64(1)
        for n in range(1, most + 1):
            h = h[:, : length - n + 1] * _STEP + plus[:, n - 1 :]
            key = mix(h + np.uint64(n))
            r, i = np.nonzero(self.maybe[(key >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, key[r, i]), len(self.keys) - 1)
            hit = self.keys[at] == key[r, i]
            score[n, r[hit], i[hit]] = self.scores[at[hit]]
            ids[n, r[hit], i[hit]] = self.ids[at[hit]]
        return score, ids

    def _merge(self, score: np.ndarray) -> np.ndarray:
        """BPE: the length of the final piece at each character that begins one, else 0."""
        most, rows, columns = score.shape[0] - 1, *score.shape[1:]
        length = columns - 1
        size = np.zeros((rows, columns + 1), np.int64)
        size[:, :length] = 1
        column = np.arange(columns)
        live = np.arange(rows)
        while len(live):
            own = size[live, :columns]
            after = np.take_along_axis(size[live], np.minimum(column + own, columns), 1)
            n = own + after
            pair = np.where((own > 0) & (after > 0) & (n <= most), score[np.minimum(n, most), live[:, None], column], LOWEST)
            best = pair.argmax(1)
            ok = pair[np.arange(len(live)), best] > LOWEST
            live, best, n = live[ok], best[ok], n[ok]
            second = best + size[live, best]
            size[live, best] = n[np.arange(len(live)), best]
            size[live, second] = 0
        return size[:, :length]

    def _viterbi(self, score: np.ndarray) -> np.ndarray:
        """Unigram: the length of the piece at each character that begins one on the best path, else 0."""
        most, rows, columns = score.shape[0] - 1, *score.shape[1:]
        length = columns - 1
        finite = self.scores[self.scores > -1e8]
        unknown = (finite.min() if len(finite) else 0.0) - 10
        best = np.full((rows, columns), LOWEST)
        best[:, 0] = 0
        back = np.zeros((rows, columns), np.int64)
        for end in range(1, columns):
            sizes = np.arange(1, min(end, most) + 1)
            s = np.stack([score[n, :, end - n] for n in sizes])
            s[0] = np.where(s[0] == LOWEST, unknown, s[0])
            total = s + best[:, end - sizes].T
            back[:, end] = sizes[total.argmax(0)]
            best[:, end] = total.max(0)
        size = np.zeros((rows, length), np.int64)
        at = np.full(rows, length)
        while (live := np.flatnonzero(at > 0)).size:
            n = back[live, at[live]]
            at[live] -= n
            size[live, at[live]] = n
        return size

    def _encode_equal(self, strings: list[str], n: int) -> list[tuple[int, ...]]:
        """Ids of segments of n characters each."""
        codes = _matrix(strings, n)
        score, ids = self._table(codes)
        size = (self._merge if self.model.merges else self._viterbi)(score)
        r, i = np.nonzero(size)
        found = ids[size[r, i], r, i]
        per_row = np.bincount(r, minlength=len(strings))
        ends = np.cumsum(per_row)
        flat = found.tolist()
        out = [tuple(flat[b:e]) for b, e in zip((ends - per_row).tolist(), ends.tolist(), strict=True)]
        for k in np.unique(r[found < 0]).tolist():  # characters without a piece
            pieces = []
            for c, x in zip(i[r == k].tolist(), out[k], strict=True):
                pieces += [x] if x >= 0 else [self.byte_ids[b] for b in strings[k][c].encode()]
            out[k] = tuple(pieces)
        return out

    def _encode_long(self, text: str) -> tuple[int, ...]:
        """Ids of one long segment of a BPE model: pairs wait in a heap by score, then place."""
        rank = lambda s: self.model.scores[self.by_text[s]] if s in self.by_text else None
        n = len(text)
        part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 1, 1) for i in range(n - 1) if (s := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or len(part[i]) != a or len(part[j]) != b or not a or not b:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := rank(part[i] + part[after[i]])) is not None:
                    heapq.heappush(heap, (-s, i, len(part[i]), len(part[after[i]])))
            if before[i] >= 0 and (s := rank(part[before[i]] + part[i])) is not None:
                heapq.heappush(heap, (-s, before[i], len(part[before[i]]), len(part[i])))
        return tuple(chain.from_iterable([self.by_text[p]] if p in self.by_text else [self.byte_ids[b] for b in p.encode()] for p in part if p))

    def encode_segments(self, strings: list[str]) -> list[tuple[int, ...]]:
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(strings):
            by_length.setdefault(len(s), []).append(k)
        out: list[tuple[int, ...]] = [()] * len(strings)
        for n, where in by_length.items():
            step = max(1, 200_000 // (n * min(n, self.longest) + 1)) if n <= LONG or not self.model.merges else 1
            for b in range(0, len(where), step):
                some = where[b : b + step]
                group = [strings[k] for k in some]
                for k, ids in zip(some, [self._encode_long(group[0])] if step == 1 and n > LONG else self._encode_equal(group, n), strict=True):
                    out[k] = ids
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of text at data[starts:ends], and how many each row has."""
        begin, end, row = word_bounds(data, starts, ends, _ONLY_SPACE)
        # A row that ends in spaces has them as a last segment, a word of no bytes.
        tail = np.flatnonzero((ends > starts) & (data[np.maximum(ends - 1, 0)] == 32)) if len(data) else np.zeros(0, np.int64)
        if len(tail):
            order = np.argsort(np.concatenate([row, tail]), kind="stable")
            begin, end, row = (np.concatenate([a, b])[order] for a, b in ((begin, ends[tail]), (end, ends[tail]), (row, tail)))
        head = np.ones(len(row), bool)
        head[1:] = row[1:] != row[:-1]
        previous = np.where(head, starts[row], np.concatenate([[0], end[:-1]])) if len(row) else begin
        spaces = begin - previous + head  # one more in front of the text
        keys = mix(word_hashes(data, begin, end) + spaces.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = distinct.tolist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [k for k, name in enumerate(names) if name not in self.known]
        raw = data.tobytes()
        strings = [SPACE * int(spaces[f]) + raw[begin[f] : end[f]].decode() for f in first[new].tolist()]
        self.known.update(zip([names[k] for k in new], self.encode_segments(strings), strict=True))
        ids = [self.known[name] for name in names]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        at = np.cumsum(sizes) - sizes
        n = sizes[inverse]
        out = flat[np.repeat(at[inverse] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return out, np.bincount(row, weights=n, minlength=len(starts)).astype(np.int64)

    # --- decoding -----------------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows of ids together, and how many each row has."""
        n = self.sizes[ids]
        out = self.raw[np.repeat(self.begins[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        lead = bounds[:-1][full]
        lead, full = lead[out[lead] == 32], full[out[lead] == 32]
        sizes[full] -= 1  # the space in front
        keep = np.ones(len(out), bool)
        keep[lead] = False
        return out[keep], sizes


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (whether decoding the ids gives the text's bytes again) of each row."""
    spark = docs.sparkSession
    small_batches(spark, 256)
    model = spark.sparkContext.broadcast(load_model(path))  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for batch in batches:
            data, starts, ends = text_view(batch.column("text"))
            ids, counts, same = [], [], []
            for i, j in slices(starts, ends):
                part, b, e = data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]
                x, n = pieces.encode(part, b, e)
                back, sizes = pieces.decode(x, n)
                if np.array_equal(sizes, e - b) and np.array_equal(back, part):
                    same.append(np.ones(j - i, bool))
                else:
                    to = np.cumsum(sizes)
                    same.append(np.array([s == y - z and np.array_equal(back[t - s : t], part[z:y]) for t, s, z, y in zip(to, sizes, b, e, strict=True)]))
                ids.append(x)
                counts.append(n)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array(np.concatenate(same) if same else np.zeros(0, bool))],
                names=["doc_id", "n_tokens", "ids", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, round_trip boolean")


def detokenize(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""
    spark = tokens.sparkSession
    small_batches(spark, 256)
    model = spark.sparkContext.broadcast(load_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for batch in batches:
            rows = batch.column("ids").fill_null([])
            counts = np.asarray(rows.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            raw, sizes = pieces.decode(np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.int64), counts)
            to = np.cumsum(sizes)
            texts = [raw[t - s : t].tobytes().decode("utf-8", "replace") for t, s in zip(to, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


#: The model of the query.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), MODEL)
