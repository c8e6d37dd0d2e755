"""Quality rules: counts of words, symbols and repeats, and an n-gram perplexity band of each language.

Three modified Kneser-Ney models of each language are counted over all documents.

* Characters: a word stands between boundary marks, and each character (and the end) is predicted from up to three
  before it in the word.
* Classes: a text stands between boundary marks, and each word's class (and the end) is predicted from the class of the word
  before, or else from its shape (the kind of its first character and the punctuation mark at its end). A class is the word
  itself, if it has at most three bytes without punctuation at its end; else its last byte; and its shape.
* Words: which word stands for a class, predicted from the class, or else as one of the language's words. Together with
  the classes (a class-based n-gram model) this gives each word of a text a probability, by all words of the corpus.

One scan counts words and n-grams. Tasks send their counts as sorted columns, packed by language and bucket of the key; these are
merged by bucket, and adjusted counts, discounts, context weights and interpolated probabilities are DataFrame aggregations and joins.
Keys are hashes of 64 bits. Every n-gram of every text has its row with its probability, and with what it is when unseen, so
that scoring looks up one row for each. A class or word that only the text itself has after its context counts as unseen, as it would be
likely by itself.

No n-gram is dropped. Arrays of the HELD commonest rows of each model are broadcast; what a text has beyond them goes with its row and
is joined with the other rows of the model. Words counted once are unseen wherever they stand: their class tells what they weigh.
kneser_ney can also prune (`most`); no query does.

Each measure of a document (SPREADS) must lie in its language's band: from the median so many robust deviations down and
up, each side with its own deviation (1.4826 times the median distance of the values on that side), over all
documents of the language that have words. Measures are the log perplexity over characters; that over classes, whose low edge rejects
texts of few patterns (lists, keyword stuffing); that over words, whose high edge rejects texts of words that the language
hardly uses; and how much the one over classes exceeds that without contexts, whose high edge rejects texts whose words
stand in no order, whichever they are.

Defined cases. Null, empty and blank texts have all counts 0, fail the base rules, and have no
perplexity. A null language is one language of its own. Repeated rows count each time. doc_id keeps its type, and null
ids their rows. Extra columns are not read.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import join_on_hot_keys, written
from .text import Types, mix, seeded, slices, utf8, windows, word_hashes, words

ORDER = 4
WORD_LEVELS = 3
#: Of each measure, how many robust deviations its band reaches down and up; None: as far as there are values.
SPREADS = {"log_perplexity": (4.0, 4.0), "class_log_perplexity": (4.0, 4.0), "word_log_perplexity": (4.0, 4.0), "order_log_ratio": (None, 3.5)}
_LOGS = list(SPREADS)
#: Rows of a model that are broadcast as arrays, 24 bytes each at most; the others are joined.
HELD = 1 << 21
#: Rounding of sums, so that equal texts stay on their own median.
_ROUNDING = 1e-9
MIN_WORDS, MOST_REPEATED = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_EDGE = 10
_MARKS = np.zeros(256, bool)
_MARKS[list(string.punctuation.encode())] = True
_KIND = np.full(256, 3, np.uint64)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_PLACE = seeded(ORDER, 301)
_SALT = seeded(2 * ORDER, 331)
#: The three models, in tables of all.
_CHARACTERS, _CLASSES, _WORDS = range(3)
_BUCKET_BITS = 8
_PACKED = "m int, lang string, bucket int, data binary"
_EVENTS = ["m", "lang", "k", *(f"{c}{j}" for j in range(ORDER) for c in "gc"), "n"]
_EVENT_SCHEMA = "m int, lang string, " + ", ".join(f"{c} long" for c in _EVENTS[2:])


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row, given its words and their hashes."""
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    chars = (np.cumsum(inside[:-1]) > 0) & (raw & 0xC0 != 0x80)
    grams, at = windows(hashes, first, 3)
    row = np.searchsorted(first, at, "right") - 1
    keys = mix(grams + _SALT[1] * row.astype(np.uint64))  # of the window in its row
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(starts), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    dup = np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(dup)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].tobytes().split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    return {"n_words": np.diff(first), "word_chars": _row_sums(chars, offsets), "n_symbols": _row_sums(_SYMBOL[raw], offsets), "n_dup_lines": dup, "n_repeat_words": _row_sums(covered, first)}


class _Slice:
    """Words of some rows: starts, ends, first (n+1 numbers), hashes; their different (language, word) keys, a place of each, and which one each word is."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        self.raw, self.offsets, self.langs = raw, offsets, langs
        self.starts, self.ends, self.first = words(raw, offsets)
        self.hashes = word_hashes(raw, self.starts, self.ends, False)
        n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(n)), n)
        self.keys, self.where, self.which, self.times = np.unique(self.hashes ^ np.repeat(langs, n), return_index=True, return_inverse=True, return_counts=True)
        self.classes, self.shapes = word_classes(raw, self.starts[self.where], self.ends[self.where])
        self.of = self.row[self.where]

    def sequence(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of the class of each word and of each row's end: row; class, shape before, class before."""
        rows = np.flatnonzero(np.diff(self.first))
        stop = np.zeros(len(self.which) + len(rows), bool)
        stop[self.first[1:][rows] + np.arange(len(rows))] = True
        x, shape = np.full(len(stop), _EDGE, np.uint64), np.full(len(stop), _EDGE, np.uint64)
        x[~stop], shape[~stop] = self.classes[self.which], self.shapes[self.which]
        before = np.full((2, len(stop)), _EDGE, np.uint64)
        if len(stop):
            before[:, 1:] = shape[:-1], x[:-1]
        return rows[np.cumsum(stop) - stop], [x, *before]

    def emitted(self) -> np.ndarray:
        """Of each key, the id of the word after its class."""
        return _mixed(_grams_of(self.langs[self.of], [self.keys - np.uint64(11), self.classes])[0][1], 1, 0)


def _grams(raw, starts, ends, langs: np.ndarray):
    """For all symbols of the given words (and their ends): word number, context length, the symbol and those before it
    (0 beyond the context), and the mixed hash of the n-gram."""
    n = ends - starts
    first = np.cumsum(n + 1) - (n + 1)
    text = np.full(int((n + 1).sum()), _EDGE, np.uint8)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(first, n) + place] = raw[np.repeat(starts, n) + place]
    x = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    stop = x == _EDGE
    word = np.cumsum(stop) - stop
    begin = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
    k = np.minimum(np.arange(len(x)) - begin[word] + 1, ORDER - 1)
    x = np.concatenate([np.full(ORDER, _EDGE, np.uint64), x])
    symbols = [np.where(k >= j, x[ORDER - j : len(x) - j], np.uint64(0)) for j in range(ORDER)]
    grams, _ = _grams_of(langs[word], symbols)
    return word, k, symbols, _mixed(np.choose(k, grams), k, 0)


def _grams_of(langs: np.ndarray, symbols: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By context length, the unmixed hashes of n-grams and of their contexts; symbols: the last one and those before it."""
    contexts = [langs]
    for j in range(1, len(symbols)):
        contexts.append(contexts[-1] + (symbols[j] + np.uint64(11)) * _PLACE[j])
    last = (symbols[0] + np.uint64(11)) * _PLACE[0]
    return [c + last for c in contexts], contexts


def word_classes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word, as a number that tells all classes apart; and its shape, of which the class is finer."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    stop = ends.copy()
    open_ = np.arange(len(ends))
    for _ in range(16):
        open_ = open_[(stop[open_] > starts[open_]) & _MARKS[raw[stop[open_] - 1]]]
        stop[open_] -= 1
    for i in open_.tolist():  # longer runs of marks
        stop[i] = starts[i] + len(raw[starts[i] : stop[i]].tobytes().rstrip(string.punctuation.encode()))
    n = stop - starts
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    short = np.zeros(len(n), np.uint64)
    for i in range(3):
        short |= np.where(n > i, padded[starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
    kind = _KIND[raw[starts]]
    long = _LOWER[raw[stop - 1]] | kind << np.uint64(16)
    mark = np.where(stop < ends, raw[ends - 1], 0).astype(np.uint64) << np.uint64(32)
    return np.where(n <= 3, short, long) | mark | np.minimum(n, 4).astype(np.uint64) << np.uint64(40), mark | kind << np.uint64(16) | np.uint64(1)


def _mixed(hashes: np.ndarray, j, context: int) -> np.ndarray:
    return mix(hashes + _SALT[2 * j + context])


def _ids(hashes: np.ndarray, j, context: int) -> np.ndarray:
    """Hashes as long values; j: the context length."""
    return _mixed(hashes, j, context).view(np.int64)


def _pick(raw, starts, ends) -> np.ndarray:
    """The bytes of these words, one after the other."""
    n = ends - starts
    return raw[np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]


def _lang_hashes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    names = ["" if v is None else "." + v for v in column.to_pylist()]
    known = {v: word_hashes(np.frombuffer(b"l" + v.encode(), np.uint8), np.array([0]), np.array([len(v.encode()) + 1]), False)[0] for v in set(names)}
    return names, np.array([known[v] for v in names], np.uint64)


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of counted n-grams (key first, count last), each key once, sorted."""
    m = [np.concatenate(c) for c in zip(*parts, strict=True)]
    own, where, inverse = np.unique(m[0], return_index=True, return_inverse=True)
    return [own, *(c[where] for c in m[1:-1]), np.bincount(inverse, m[-1], len(own)).astype(np.uint64)]


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64 bits, the first one sorted: differences of that one, and all bytes of a place together."""
    columns = [np.diff(columns[0], prepend=np.uint64(0)), *columns[1:]]
    return zlib.compress(b"".join(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), 1)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


#: Columns of each model's packed counts: key, (context length,) symbols, count.
_COLUMNS = {_CHARACTERS: 3 + ORDER, _CLASSES: 2 + WORD_LEVELS, _WORDS: 3}


def _task_counts(batches):
    """Batches (lang, text) -> the packed counts of a task."""
    code: dict[str, int] = {}
    found: dict[int, list] = {m: [] for m in _COLUMNS}
    types, held, times = Types(), [], np.zeros(0, np.int64)

    def add(m, part):
        found[m].append(part)
        if sum(len(f[0]) for f in found[m]) > 1 << 21:
            found[m][:] = [_summed(found[m])]

    def flush():
        size = np.concatenate([h[1] for h in held])
        raw, ends = np.concatenate([h[0] for h in held]), np.cumsum(size)
        langs, codes = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        for i in range(0, len(size), 1 << 16):
            part = slice(i, i + (1 << 16))
            word, k, symbols, key = _grams(raw, (ends - size)[part], ends[part], langs[part])
            own, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            add(_CHARACTERS, [own, codes[part][word[where]], k[where], *(x[where] for x in symbols), np.bincount(inverse, times[part][word], len(own)).astype(np.uint64)])

    for batch in batches:
        names, langs = _lang_hashes(batch.column(0))
        codes = np.array([code.setdefault(v, len(code)) for v in names])
        raw, at = utf8(batch.column(1))
        for a, b in slices(at):
            x = _Slice(raw[at[a] : at[b]], at[a : b + 1] - at[a], langs[a:b])
            if not len(x.keys):
                continue
            own = codes[a:b]
            add(_WORDS, [x.emitted(), own[x.of], x.classes, x.times.astype(np.uint64)])
            row, symbols = x.sequence()
            key = _mixed(_grams_of(x.langs[row], symbols)[0][-1], WORD_LEVELS - 1, 0)
            keys, where, n = np.unique(key, return_index=True, return_counts=True)
            add(_CLASSES, [keys, own[row[where]], *(c[where] for c in symbols), n.astype(np.uint64)])
            number, new = types.numbers(x.keys)
            times = np.concatenate([times, np.zeros(int(new.sum()), np.int64)])
            times[number] += x.times
            w = x.where[new]
            held.append((_pick(x.raw, x.starts[w], x.ends[w]), x.ends[w] - x.starts[w], x.langs[x.of[new]], own[x.of[new]]))
            if len(types) > 1 << 20:
                flush()
                types, held, times = Types(), [], np.zeros(0, np.int64)
    if held:
        flush()
    for m, parts in found.items():
        if not parts:
            continue
        columns, rows = _summed(parts), []
        for lang, c in code.items():
            own = [x[columns[1] == c] for x in (columns[0], *columns[2:])]
            edges = np.searchsorted(own[0] >> np.uint64(64 - _BUCKET_BITS), np.arange((1 << _BUCKET_BITS) + 1)).tolist()
            rows += [(m, lang, i, _packed([x[a:b] for x in own])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["m", "lang", "bucket", "data"])


def _merged(batches):
    """Packed counts, sorted by model, language and bucket -> rows of _EVENTS, each n-gram once."""

    def rows(m, lang, parts):
        key, *symbols, n = _summed(parts)
        k = symbols.pop(0).astype(np.int64) if m == _CHARACTERS else np.full(len(key), _COLUMNS[m] - 3 if m == _CLASSES else 1)
        langs = np.full(len(key), _lang_hashes(pa.array([lang[1:] if lang else None]))[1][0])
        if m == _WORDS:  # a word is known by its id, and has one class
            ids = {"g1": key.view(np.int64), "c1": _ids(_grams_of(langs, [key, *symbols])[1][1], 1, 1)}
        else:
            grams, contexts = _grams_of(langs, symbols)
            ids = {f"{c}{j}": _ids(h[j], j, i) for j in range(len(symbols)) for c, i, h in (("g", 0, grams), ("c", 1, contexts))}
        columns = {"m": pa.repeat(pa.scalar(m, pa.int32()), len(key)), "lang": pa.repeat(lang, len(key)), "k": pa.array(k, pa.int64()), "n": pa.array(n.view(np.int64))}
        whole = pa.table({c: columns[c] if c in columns else pa.array(ids[c]) if c in ids else pa.nulls(len(key), pa.int64()) for c in _EVENTS})
        yield from whole.to_batches(1 << 16)

    at, parts = None, []
    for batch in batches:
        for m, lang, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (m, lang, bucket) != at:
                if parts:
                    yield from rows(*at[:2], parts)
                at, parts = (m, lang, bucket), []
            parts.append(_unpacked(data, _COLUMNS[m]))
    if parts:
        yield from rows(*at[:2], parts)


def count(docs: DataFrame) -> DataFrame:
    """docs (lang, text) -> _EVENTS: each longest n-gram of each model with its count, and the ids of its shorter ones and contexts."""
    key = ["m", "lang", "bucket"]
    parts = docs.select("lang", "text").mapInArrow(_task_counts, _PACKED)
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merged, _EVENT_SCHEMA)


def _least(sizes: DataFrame, most: int) -> DataFrame:
    """sizes (a written table: lang, c, n entries with this count) -> (lang, least, _total): the least count that is kept, such that at most `most` entries are.

    Languages with few entries keep all, the others share what is left evenly.
    """
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("total"))
    by_size = Window.orderBy("total", "lang")  # one row a language
    left = F.lit(most) - F.coalesce(F.sum("total").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = totals.withColumn("share", left / (F.lit(totals.count()) + 1 - F.row_number().over(by_size)))
    share = shares.filter("total > share").agg(F.min_by("share", F.struct("total", "lang"))).first()[0]
    upwards = Window.partitionBy("lang").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.min(F.when(F.lit(share is None) | (F.col("run") <= F.lit(share or 0.0)), F.col("c")))
    return sizes.withColumn("run", F.sum("n").over(upwards)).groupBy("lang").agg(F.coalesce(fits, F.max("c") + 1).alias("least"), F.sum("n").alias("_total"))


def _with_least(entries: DataFrame, most: int) -> DataFrame:
    """entries (a written table with lang and a count c) with `least`; see _least."""
    sizes = written(entries.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n")))
    return join_on_hot_keys(entries, written(_least(sizes, most)), "lang", "_total").drop("_total")


def _discounts(sizes: DataFrame) -> DataFrame:
    """sizes (lang, n1 to n4: entries with these counts, n: of any) -> (lang, v, d1, d2, d3, _contexts), each language once."""
    n1, n2, n3, n4 = (F.greatest(F.col(f"n{i}").cast("double"), F.lit(1.0)) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    bounded = lambda x, most, name: F.greatest(F.lit(0.1), F.least(x, F.lit(most))).alias(name)
    d = sizes.groupBy("lang").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(1, 5)), F.sum("n").alias("v"), F.count(F.lit(1)).alias("_contexts"))
    return d.select("lang", "v", "_contexts", bounded(1 - 2 * y * n2 / n1, 0.9, "d1"), bounded(2 - 3 * y * n3 / n2, 1.9, "d2"), bounded(3 - 4 * y * n4 / n3, 2.9, "d3"))


def kneser_ney(events: DataFrame, orders: int, shorter: bool = True, most: int | None = None, *, single: bool = False) -> tuple[DataFrame, DataFrame]:
    """events (a written table of each longest n-gram) -> their rows (id, p: probability, u: what it is when unseen, a: after nothing, c: count), and the contexts of the longest with u, if single.

    shorter: whether events have symbols with less context than the longest, too. most: prune, so that of each length at most so many
    keep their counts; the others are predicted by their shorter ones. single: each symbol has one context, so all are alike after nothing.
    """
    entries = [None] * orders
    for j in reversed(range(int(single), orders)):
        own, some = ["lang", f"g{j}"], [*(f"g{i}" for i in range(int(single), j)), *(f"c{i}" for i in range(int(single), j + 1))]
        parts = []
        if shorter or j == orders - 1:
            parts.append(events.filter(F.col("k") == j).select(*own, *some, F.col("n").alias("c")))
        if j < orders - 1:
            parts.append(entries[j + 1].groupBy(*own).agg(*(F.min(x).alias(x) for x in some), F.count(F.lit(1)).alias("c")))
        if len(parts) == 2:
            parts = [parts[0].unionByName(parts[1]).groupBy(*own).agg(*(F.min(x).alias(x) for x in some), F.sum("c").alias("c"))]
        entries[j] = parts[0] if j == orders - 1 else written(parts[0])
    found, lower, contexts = [], None, None
    if single:
        sizes = written(entries[1].groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.lit(1).cast("long")))
        least = _least(sizes, most) if most is not None else sizes.select("lang", F.lit(1).alias("least"))
        alike = sizes.withColumns({"n1": F.col("n"), **{f"n{i}": F.lit(0) for i in (2, 3, 4)}})
        keep, v = F.col("least") <= 1, F.col("v")
        p = F.when(keep, (1 - F.col("d1")) / v).otherwise(0.0) + F.when(keep, F.col("d1")).otherwise(1.0) / (v + 1)
        lower = written(_discounts(alike).join(least.select("lang", "least"), "lang").select("lang", p.alias("p_lower"), p.alias("a"), v.alias("_n")))
    for j in range(int(single), orders):
        level = entries[j].withColumn("least", F.lit(1)) if most is None else written(_with_least(written(entries[j]), most))
        c, keep = F.col("c"), F.col("c") >= F.col("least")
        number = lambda which, name: F.sum(which.cast("long")).alias(name)
        kept = [number(keep & (c == 1), "k1"), number(keep & (c == 2), "k2"), number(keep & (c > 2), "k3"), F.sum(F.when(keep, 0).otherwise(c)).alias("lost")]
        ctx = written(level.groupBy("lang", f"c{j}").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("n"), *(number(c == i, f"n{i}") for i in range(1, 5)), *kept))
        ctx = join_on_hot_keys(ctx, written(_discounts(ctx)), "lang", "_contexts")
        gamma = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3") + F.col("lost")) / F.col("s")
        ctx = written(ctx.select("lang", f"c{j}", "s", gamma.alias("gamma"), "d1", "d2", "d3", "v", F.col("n").alias("_n")))
        if single:
            ctx = written(join_on_hot_keys(ctx, lower.select("lang", "p_lower", "a", "_n").withColumnRenamed("_n", "_words"), "lang", "_words"))
            contexts = ctx.select(F.col(f"c{j}").alias("id"), (F.col("gamma") * F.col("p_lower")).alias("u"))
            level = level.filter("c > 1") if contexts.count() <= HELD else level
        level = level.join(ctx.drop("_n"), ["lang", f"c{j}"]) if j else join_on_hot_keys(written(level), ctx.drop("c0"), "lang", "_n")
        if j and not single:
            level = level.join(lower.select("lang", F.col("id").alias(f"g{j - 1}"), F.col("p").alias("p_lower"), "a"), ["lang", f"g{j - 1}"])
        d = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        u = F.col("gamma") * (F.col("p_lower") if j else 1 / (F.col("v") + 1))
        p = F.when(keep, (c - d) / F.col("s")).otherwise(0.0) + u
        lower = written(level.select("lang", F.col(f"g{j}").alias("id"), p.alias("p"), u.alias("u"), (F.col("a") if j else p).alias("a"), "c"))
        if j == orders - 1 or shorter and j:
            found.append(lower)
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    return rows.drop("lang"), contexts


def stored(rows: DataFrame, logs: list[str], counts: bool = False) -> tuple[tuple[bytes, ...], DataFrame | None]:
    """The commonest HELD rows as sorted arrays (hashes, float32 logarithms, counts where asked for), and the others, if there are any."""
    rest = None
    if rows.count() > HELD:
        sizes = written(rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("lang", F.lit("")))
        least = _least(sizes, HELD).first().least
        rows, rest = rows.filter(F.col("c") >= least), rows.filter(F.col("c") < least)
    t = rows.select("id", *(F.log(x).cast("float").alias(x) for x in logs), *([F.least("c", F.lit((1 << 31) - 1)).cast("int").alias("c")] if counts else [])).toArrow()
    ids = t["id"].to_numpy().view(np.uint64)
    order = np.argsort(ids)
    return (ids[order].tobytes(), *(t[x].to_numpy()[order].tobytes() for x in t.column_names[1:])), rest


class _Table:
    """Sorted arrays of a model; open: whether it has more rows than these."""

    def __init__(self, kept: tuple[bytes, ...], logs: int, open_: bool) -> None:
        self.open = open_
        self.ids, *self.columns = map(np.frombuffer, kept, (np.uint64, *[np.float32] * logs, np.int32))

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which ids are here, and their columns (0 where they aren't)."""
        if not len(self.ids):
            return np.zeros(len(ids), bool), [np.zeros(len(ids)) for _ in self.columns]
        order = np.argsort(ids)  # neighbours are near each other in the table
        at = np.empty(len(ids), np.int64)
        at[order] = np.searchsorted(self.ids, ids[order])
        at[at == len(self.ids)] = 0
        has = self.ids[at] == ids
        return has, [np.where(has, c[at], 0).astype(np.float64) for c in self.columns]


def _once(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key of each row, and how often the row has it."""
    own = mix(keys + _SALT[0] * rows.astype(np.uint64))
    order = np.argsort(own)
    new = np.ones(len(order), bool)
    np.not_equal(own[order][1:], own[order][:-1], out=new[1:])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def word_scores(sequence: _Table, emission: _Table, other: _Table | None, x: _Slice) -> tuple[list[np.ndarray], list[tuple]]:
    """Log perplexity of each row over its words' classes, over its words, and how much the first exceeds that without contexts; NaN
    without words. And what the tables don't have: model, rows, ids, how often, and the logarithm when unseen (NaN: the model has it)."""
    row, symbols = x.sequence()
    size = len(x.offsets) - 1
    n = np.bincount(row, minlength=size)
    mean = lambda rows, y: np.where(n > 0, -np.bincount(rows, y, size) / np.maximum(1, n), np.nan)
    key = _mixed(_grams_of(x.langs[row], symbols)[0][-1], WORD_LEVELS - 1, 0)
    at, times = _once(key, row)
    has, (p, u, alone, c) = sequence(key[at])
    logs = np.where(c > times, p, u)
    of_classes, order = mean(row[at], times * logs), mean(row[at], times * (logs - alone))
    missing = [(_CLASSES, row[at][~has], key[at][~has], times[~has], np.full(int((~has).sum()), np.nan))]
    keys = x.emitted()
    has, (p, u, c) = emission(keys)
    if other is not None:
        known, (rest,) = other(_mixed(_grams_of(x.langs[x.of], [x.keys, x.classes])[1][1], 1, 1))
        u = np.where(has, u, np.where(known, rest, np.nan))
    else:
        u = np.where(has, u, np.nan)
    place, times = np.unique(x.row * max(1, len(keys)) + x.which, return_counts=True)
    rows, word = np.divmod(place, max(1, len(keys)))
    ask = ~has[word] if emission.open else np.zeros(len(word), bool)
    logs = np.where(ask, 0.0, np.where(c[word] > times, p[word], u[word]))
    missing.append((_WORDS, rows[ask], keys[word[ask]], times[ask], u[word[ask]]))
    return [of_classes, of_classes + mean(rows, times * logs), order], missing


class Scorer:
    """Log probabilities of words by binary search; words met lately are remembered."""

    KEPT = 1 << 20

    def __init__(self, table: _Table) -> None:
        self.table = table
        self._forget()

    def _forget(self) -> None:
        self.types, self.logs, self.sizes = Types(), np.zeros(0), np.zeros(0, np.int64)
        self.open: dict[int, np.ndarray] = {}  # ids that the table doesn't have, by word

    def __call__(self, x: _Slice) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """Log perplexity of each row (NaN without words), its symbols, and what the table doesn't have."""
        if len(self.types) > self.KEPT:
            self._forget()
        number, new = self.types.numbers(x.keys)
        w = x.where[new]
        for i in range(0, len(w), 1 << 16):
            v = w[i : i + (1 << 16)]
            word, _, _, ids = _grams(x.raw, x.starts[v], x.ends[v], x.langs[x.row[v]])
            has, (p,) = self.table(ids)
            for at in np.flatnonzero(~has).tolist():
                self.open.setdefault(len(self.logs) + int(word[at]), []).append(ids[at])
            self.logs, self.sizes = np.concatenate([self.logs, np.bincount(word, p, len(v))]), np.concatenate([self.sizes, np.bincount(word, minlength=len(v))])
        sums, counts = _row_sums(self.logs[number][x.which], x.first), _row_sums(self.sizes[number][x.which], x.first)
        missing = []
        for i, ids in ((i, self.open[m]) for i, m in enumerate(number.tolist()) if m in self.open) if self.open else ():
            rows = x.row[x.which == i]
            rows = np.repeat(rows, len(ids))
            missing.append((_CHARACTERS, rows, np.tile(np.array(ids, np.uint64), len(rows) // len(ids)), np.ones(len(rows), np.int64), np.full(len(rows), np.nan)))
        return np.where(counts > 0, -sums / np.maximum(1, counts), np.nan), counts, missing


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


_OPEN = "array<struct<m: int, id: bigint, times: bigint, u: double>>"


def _lists(missing: list[tuple], rows: int) -> pa.Array:
    """For each row its list of n-grams that the arrays don't have."""
    row = np.concatenate([x[1] for x in missing])
    order = np.argsort(row, kind="stable")
    column = lambda parts: np.concatenate(parts)[order]
    m, ids, times, u = (column([np.full(len(x[1]), x[0], np.int32) for x in missing]), *(column([x[i] for x in missing]) for i in (2, 3, 4)))
    found = pa.StructArray.from_arrays([pa.array(m), pa.array(ids.view(np.int64)), pa.array(times, pa.int64()), pa.array(u, from_pandas=True)], ["m", "id", "times", "u"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(rows + 1)), pa.int32()), found)


def _completed(rows: DataFrame, rest: dict[int, DataFrame]) -> DataFrame:
    """rows (a written table), their measures with what the arrays didn't have."""
    logs = lambda df: [F.log(x).cast("float").alias(f"log_{x}") for x in "pua"]
    others = [df.select(F.lit(m).alias("m"), "id", *logs(df), "c") for m, df in rest.items()]
    table = others[0]
    for x in others[1:]:
        table = table.unionByName(x)
    asked = rows.select("_row", F.explode("_open").alias("o")).select("_row", "o.*").join(table, ["m", "id"], "left")
    log = F.when((F.col("m") == _CHARACTERS) | (F.col("c") > F.col("times")), F.col("log_p")).otherwise(F.coalesce("log_u", "u"))
    total = lambda m, x, name: F.sum(F.when(F.col("m") == m, F.col("times") * x)).alias(name)
    sums = asked.groupBy("_row").agg(total(_CHARACTERS, log, "_characters"), total(_CLASSES, log, "_classes"), total(_CLASSES, log - F.col("log_a"), "_order"), total(_WORDS, log, "_words"))
    less = lambda *x: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in x), F.lit(0.0))
    n = F.col("n_words") + 1
    more = {"log_perplexity": less("_characters") / F.col("_symbols"), "class_log_perplexity": less("_classes") / n, "word_log_perplexity": less("_classes", "_words") / n, "order_log_ratio": less("_order") / n}
    return rows.join(sums, "_row", "left").withColumns({c: F.col(c) - x for c, x in more.items()})


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) -> doc_id, lang, the base counts, and the measures _LOGS (null without words), as a written table."""
    share = docs.sparkSession.sparkContext.broadcast
    events = written(count(docs))
    of = lambda m: events.filter(F.col("m") == m)
    words_, contexts = kneser_ney(of(_WORDS), 2, False, single=True)
    few = contexts.count() <= HELD
    held, rest = {}, {}
    for m, rows, logs in ((_CHARACTERS, kneser_ney(of(_CHARACTERS), ORDER)[0], "p"), (_CLASSES, kneser_ney(of(_CLASSES), WORD_LEVELS, False)[0], "pua"), (_WORDS, words_, "pu")):
        kept, others = stored(rows, list(logs), m != _CHARACTERS)
        held[m] = (share(kept), len(logs))
        if others is not None:
            rest[m] = others
    other = share(stored(contexts.withColumn("c", F.lit(1)), ["u"])[0]) if few else None
    if not few:  # then words that were counted once are rows, too
        rest.setdefault(_WORDS, words_.limit(0))
    opened = set(rest)

    def apply(batches):
        characters, sequence, emission = (_Table(held[m][0].value, held[m][1], m in opened) for m in sorted(held))
        score, unseen, n, task = Scorer(characters), None if other is None else _Table(other.value, 1, False), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            _, langs = _lang_hashes(batch.column(1))
            raw, at = utf8(batch.column(2))
            for a, b in slices(at):
                x = _Slice(raw[at[a] : at[b]], at[a : b + 1] - at[a], langs[a:b])
                counts = base_counts(x.raw, x.offsets, x.starts, x.ends, x.first, x.hashes)
                of_characters, symbols, missing = score(x)
                of_words, more = word_scores(sequence, emission, unseen, x)
                numbers, n = task + n + np.arange(b - a), n + b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(counts[c], pa.int64()) for c in _COUNTS), *(pa.array(y, pa.float64(), from_pandas=True) for y in (of_characters, *of_words)), pa.array(numbers), pa.array(symbols, pa.int64()), _lists(missing + more, b - a)], ["doc_id", "lang", *_COUNTS, *_LOGS, "_row", "_symbols", "_open"])

    fields = ", ".join([f"{c} long" for c in _COUNTS] + [f"{c} double" for c in _LOGS])
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(f"lang string, {fields}, _row long, _symbols long, _open {_OPEN}")])
    rows = written(docs.select("doc_id", "lang", "text").mapInArrow(apply, schema))
    return (written(_completed(rows, rest)) if rest else rows).select("doc_id", "lang", *_COUNTS, *_LOGS)


def judge(docs: DataFrame, spreads: dict[str, tuple[float | None, float | None]] = SPREADS) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and each measure of _LOGS with its _low and _high edge."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measured(docs).withColumn("_lang", F.coalesce(F.concat(F.lit("."), F.col("lang")), F.lit("")))
    median = lambda c: F.percentile_approx(c, 0.5, 10000)
    middle = written(rows.groupBy("_lang").agg(*(median(x).alias(f"{x}_middle") for x in _LOGS), F.count(F.lit(1)).alias("_n")))
    edges = []
    for x in _LOGS:
        off = F.col(x) - F.col(f"{x}_middle")
        reach = lambda side, spread: F.lit(spread * 1.4826) * median(F.when(side >= 0, side)) + _ROUNDING
        low, high = (F.min(x) if spreads[x][0] is None else F.first(f"{x}_middle") - reach(-off, spreads[x][0])), (F.max(x) if spreads[x][1] is None else F.first(f"{x}_middle") + reach(off, spreads[x][1]))
        edges += [low.alias(f"{x}_low"), high.alias(f"{x}_high")]
    banded = written(join_on_hot_keys(rows, middle, "_lang", "_n").groupBy("_lang").agg(*edges, F.first("_n").alias("_n")))
    kept = ~F.col("base_failed")
    for x in _LOGS:
        kept &= F.coalesce(F.col(x).between(F.col(f"{x}_low"), F.col(f"{x}_high")), F.lit(True))
    return join_on_hot_keys(rows, banded, "_lang", "_n").withColumn("base_failed", failed).select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), *(f"{x}{e}" for x in _LOGS for e in ("", "_low", "_high")))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *_COUNTS, "base_failed", "kept")
