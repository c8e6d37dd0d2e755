"""SentencePiece encoding and decoding by batched numpy Viterbi.

Pieces and scores come from a model file; a text's ids are the segmentation with the largest sum of
scores (the unigram rule; on ties the longest last piece), with byte fallback for what no piece covers. A
space is the mark U+2581, a text begins with one, and no piece goes on past a word into a mark, so
words are segmented apart: each distinct word once per task.

New words go by length: words of one length form a matrix and advance together. Hashes of all their
substrings of a length probe the sorted hashes of the pieces of that length; at each position a
vectorised maximum over piece lengths stores the score and the backpointer. Long strings without a space
find their pieces in the same way and advance alone.

Decoding joins the pieces' bytes, turns marks to spaces and drops the first. A mark character in the text
itself is written as bytes, so every text comes back exactly.

Defined cases. Null and empty texts have no ids; null decodes to the empty text. Extra columns pass
through. Repeated rows have the same ids. Lone surrogates don't occur in UTF-8 columns.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without
from .text import Types, mix, seeded, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
_LITERAL = 0x110000  # a mark character of the text itself
_LONG = 48
_KEPT = 1 << 19
_SLICE = 1 << 18  # bytes of text at a time
_BASE = int(seeded(1, 733)[0])


class Pieces:
    """Normal pieces as sorted hashes by length; byte pieces; the bytes of every id."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        self.bytes: list[bytes] = []
        self.fallback = np.full(256, model.unk_id(), np.int32)
        normal: list[tuple[str, float, int]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.fallback[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                normal.append((piece, model.get_score(i), i))
                self.bytes.append(piece.replace(chr(MARK), " ").encode())
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p, _, _ in normal):
            raise ValueError("pieces that go on past a word are not supported")
        self.unknown = min(s for _, s, _ in normal) - 10
        self.lines = not any("\n" in p for p, _, _ in normal)  # then each line end stands alone
        self.maybe: dict[int, np.ndarray] = {}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p, _, _ in normal}):
            own = [(p, s, i) for p, s, i in normal if len(p) == length]
            x = np.array([[ord(c) for c in p] for p, _, _ in own], np.uint64)
            h = _rolled(x)[:, -1]
            order = np.argsort(h)
            self.maybe[length] = np.zeros(1 << 18, bool)  # most substrings are no piece: one look tells
            self.maybe[length][h >> np.uint64(46)] = True
            self.by_length[length] = h[order], np.array([s for _, s, _ in own], np.float64)[order], np.array([i for _, _, i in own], np.int32)[order]

    def find(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(score or -inf, id) for hashes of substrings of this length."""
        keys, scores, ids = self.by_length[length]
        score, own = np.full(hashes.shape, -np.inf), np.full(hashes.shape, -1, np.int64)
        where = np.nonzero(self.maybe[length][hashes >> np.uint64(46)])
        some = hashes[where]
        at = np.searchsorted(keys, some)
        at[at == len(keys)] = 0
        found = keys[at] == some
        score[where], own[where] = np.where(found, scores[at], -np.inf), np.where(found, ids[at], -1)
        return score, own


def _rolled(x: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row: h[i+1] = h[i] * base + x[i]; the last column is the whole row's."""
    out = np.zeros((x.shape[0], x.shape[1] + 1), np.uint64)
    x = mix(x + np.uint64(1))
    for i in range(x.shape[1]):
        out[:, i + 1] = out[:, i] * np.uint64(_BASE) + x[:, i]
    return out


def _substrings(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of length n, by start."""
    return h[:, n:] - h[:, :-n] * np.uint64(pow(_BASE, n, 1 << 64))


def _viterbi(x: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """x: (words, length). Ids of all words' tokens, last token first, and each word's count.

    A character that no piece covers has the id -1 - code point.
    """
    m, length = x.shape
    h = _rolled(x)
    found = {n: pieces.find(_substrings(h, n), n) for n in pieces.by_length if n <= length}
    best = np.full((m, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((m, length + 1), np.int64)
    token = np.zeros((m, length + 1), np.int64)
    for e in range(1, length + 1):
        for n in sorted((n for n in found if n <= e), reverse=True):
            score = best[:, e - n] + found[n][0][:, e - n]
            better = score > best[:, e]
            best[better, e] = score[better]
            back[better, e] = e - n
            token[better, e] = found[n][1][better, e - n]
        score = best[:, e - 1] + pieces.unknown
        better = score > best[:, e]
        best[better, e] = score[better]
        back[better, e] = e - 1
        token[better, e] = -1 - x[better, e - 1].astype(np.int64)
    rows, at, out = np.arange(m), np.full(m, length), []
    counts = np.zeros(m, np.int64)
    while len(rows):
        out.append((rows, token[rows, at]))
        counts[rows] += 1
        at = back[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    row, ids = np.concatenate([r for r, _ in out]), np.concatenate([i for _, i in out])
    step = np.concatenate([np.full(len(r), k) for k, (r, _) in enumerate(out)])
    order = np.lexsort((-step, row))
    return ids[order], counts


def _viterbi_long(x: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The same for one long string; substrings are looked up at once, the best path goes step by step."""
    h = np.empty(len(x) + 1, np.uint64)
    h[0] = value = 0
    for i, c in enumerate(mix(x + np.uint64(1)).tolist()):
        value = (value * _BASE + c) & (1 << 64) - 1
        h[i + 1] = value
    ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(x) + 1)]
    for n in sorted(pieces.by_length, reverse=True):
        if n <= len(x):
            score, ids = (v[0] for v in pieces.find(_substrings(h[None, :], n), n))
            for i in np.flatnonzero(ids >= 0).tolist():
                ends[i + n].append((n, float(score[i]), int(ids[i])))
    best, back, token = [0.0] * (len(x) + 1), [0] * (len(x) + 1), [0] * (len(x) + 1)
    for e in range(1, len(x) + 1):
        top, frm, tok = -np.inf, e - 1, -1 - int(x[e - 1])
        for n, s, i in ends[e]:
            if best[e - n] + s > top:
                top, frm, tok = best[e - n] + s, e - n, i
        if best[e - 1] + pieces.unknown > top:
            top, frm, tok = best[e - 1] + pieces.unknown, e - 1, -1 - int(x[e - 1])
        best[e], back[e], token[e] = top, frm, tok
    out, e = [], len(x)
    while e:
        out.append(token[e])
        e = back[e]
    return np.array(out[::-1], np.int64)


def _expanded(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Uncovered characters as byte pieces."""
    if not (ids < 0).any():
        return ids.astype(np.int32), counts
    word = np.repeat(np.arange(len(counts)), counts)
    out, size = [], np.ones(len(ids), np.int64)
    own: dict[int, np.ndarray] = {}
    for v in np.unique(ids[ids < 0]).tolist():
        c = -1 - v
        own[v] = pieces.fallback[list(chr(MARK if c == _LITERAL else c).encode())]
        size[ids == v] = len(own[v])
    flat = np.repeat(ids, size)
    start = np.cumsum(size) - size
    for v, b in own.items():
        for j, byte in enumerate(b):
            flat[start[ids == v] + j] = byte
    out = flat.astype(np.int32)
    return out, np.bincount(word, size, len(counts)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Codec:
    def __init__(self, data: bytes) -> None:
        self.pieces = Pieces(data)
        self.sizes = np.array([len(b) for b in self.pieces.bytes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.pieces.bytes), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.types, self.tokens, self.count, self.first = Types(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Segment new words and append their tokens, by length."""
        n = ends - starts
        first, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        parts, size = [self.tokens], len(self.tokens)
        for length in np.unique(n).tolist():
            where = np.flatnonzero(n == length)
            step = max(1, (1 << 16) // length) if length <= _LONG else 1
            for k in range(0, len(where), step):
                some = where[k : k + step]
                if length <= _LONG:
                    ids, counts = _viterbi(x[starts[some][:, None] + np.arange(length)], self.pieces)
                else:
                    ids = _viterbi_long(x[starts[some[0]] : ends[some[0]]], self.pieces)
                    counts = np.array([len(ids)])
                ids, counts = _expanded(ids, counts, self.pieces)
                count[some], first[some] = counts, size + np.cumsum(counts) - counts
                parts.append(ids)
                size += len(ids)
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.tokens = np.concatenate(parts)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and n+1 offsets."""
        rows = np.diff(offsets)
        chars = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[offsets]
        text = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        text = np.where(text == MARK, _LITERAL, np.where(text == 32, MARK, text))
        full = np.flatnonzero(rows > 0)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        x = np.insert(text, chars[full], MARK)
        begins = chars[full] + np.arange(len(full))
        edge = np.zeros(len(x) + 1, bool)
        edge[1:-1] = (x[1:] == MARK) & (x[:-1] != MARK)
        if self.pieces.lines:
            edge[1:-1] |= (x[1:] == 10) | (x[:-1] == 10)
        edge[begins] = edge[-1] = True
        marks = np.flatnonzero(edge)
        starts, ends = marks[:-1], marks[1:]
        u = mix(x.astype(np.uint64) + np.uint64(3))
        n = ends - starts
        place = np.arange(len(x)) - np.repeat(starts, n)
        many = seeded(int(n.max()), 761)
        keys = mix(np.add.reduceat(u * many[place], starts) + n.astype(np.uint64))
        if len(self.types) > _KEPT or len(self.tokens) > 1 << 23:
            self._forget()
        own, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        number, new = self.types.numbers(own)
        if new.any():
            self._learn(x.astype(np.uint64), starts[where[new]], ends[where[new]])
        word = number[inverse]
        sizes = self.count[word]
        ids = self.tokens[_ranges(self.first[word], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        row_starts = np.searchsorted(starts, np.append(begins, len(x)), "left")
        at = np.zeros(len(offsets), np.int64)
        at[full + 1] = np.diff(total[row_starts])
        return ids, np.cumsum(at)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all rows and n+1 offsets."""
        sizes = self.sizes[ids]
        raw = self.flat[_ranges(self.starts[ids], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        full = np.diff(at) > 0
        return np.delete(raw, at[:-1][full]), at - np.concatenate([[0], np.cumsum(full)])


def encode(df: DataFrame, text_col: str = "text", model: str | bytes = MODEL, decoded: bool = False) -> DataFrame:
    """df with token_ids array<int>; with decoded, also the text that these ids decode to, in the same pass."""
    data = df.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else Path(model).read_bytes())
    df = without(df, ("token_ids", *("decoded",) * decoded), text_col)
    names = df.columns
    where = names.index(text_col)
    more = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded]

    def apply(batches):
        codec = Codec(data.value)
        for batch in batches:
            raw, at = utf8(batch.column(where))
            for a, b in slices(at, _SLICE):
                ids, to = codec.encode(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                own = [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    own.append(_strings(*codec.decode(ids, to)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *own], [*names, *(f.name for f in more)])

    return df.mapInArrow(apply, T.StructType([*df.schema.fields, *more]))


def _strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())


def decode(df: DataFrame, ids_col: str = "token_ids", model: str | bytes = MODEL) -> DataFrame:
    """df with decoded, the text of its ids."""
    data = df.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else Path(model).read_bytes())
    df = without(df, ("decoded",), ids_col)
    names = df.columns
    where = names.index(ids_col)

    def apply(batches):
        codec = Codec(data.value)
        for batch in batches:
            own = batch.column(where)
            at = np.concatenate([[0], np.cumsum(np.asarray(own.value_lengths().fill_null(0)))]).astype(np.int64)
            flat = np.asarray(own.flatten(), np.int64)
            for a, b in slices(at * 4, _SLICE):
                text = _strings(*codec.decode(flat[at[a] : at[b]], at[a : b + 1] - at[a]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, text], [*names, "decoded"])

    return df.mapInArrow(apply, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_sha256 (of the text decoded from the ids)."""
    out = encode(docs.select("doc_id", "text"), decoded=True)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))
