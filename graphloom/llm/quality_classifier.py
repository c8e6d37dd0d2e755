"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Features are n-grams of words, of word shapes (runs of capitals, other letters, digits; other
characters as they are) and of marks that say whether a word equals one of the two before it, all
hashed to 2^BITS weights. A group of n-grams has the weight count / total, so a
score is a sparse dot product: the mean of the weights of the tokens met, group by group.

Training reads at most `sample` labelled rows, the first by a hash of their id, in one task that
streams them; the weights (1 MB) come back and are broadcast. Nothing else is bounded: every row and whole
text is scored. Labels, languages, sources and ids never enter a score.

Defined cases. Null, empty and blank texts have no features; their score is that of the bias. Labels that are
null are left out; an id labelled twice counts with its smallest label. Without any label to
learn from, all weights are 0 and all scores 1/2. Repeated rows score alike. Other columns pass through; one that has
the score's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without
from .text import mix, slices, utf8, windows, word_hashes, words

BITS = 18
SAMPLE = 6000
EPOCHS = 3
THRESHOLD = 0.3
FOLDS = 5
ALPHA, BETA, L1, L2 = 20.0, 1.0, 1e-5, 1e-4
#: (of shapes, words in the n-gram)
GROUPS = ((False, 1), (False, 2), (True, 1), (True, 2), (True, 3))

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group the slots of all its n-grams and their n+1 offsets by row."""
    starts, ends, first = words(raw, offsets)
    plain = word_hashes(raw, starts, ends, False)
    kinds = _SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = word_hashes(kinds[keep], place[starts], place[ends], False)
    out = []
    for k, (shaped, n) in enumerate(GROUPS):
        grams, at = windows(shapes if shaped else plain, first, n, 101 + 16 * k)
        out.append(((grams >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(at, first, "left")))
    echo = np.zeros(len(plain), np.uint64)
    echo[1:] += plain[1:] == plain[:-1]
    echo[2:] += np.uint64(2) * (plain[2:] == plain[:-2])
    out.append(((mix(echo + np.uint64(977)) >> np.uint64(64 - BITS)).astype(np.int64), first))
    return out


def _dots(groups: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    total = 0.0
    for slots, at in groups:
        sums = np.concatenate([[0.0], np.cumsum(w[slots])])
        total = total + (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
    return total


def _vectors(groups: list[tuple[np.ndarray, np.ndarray]], row: int) -> tuple[np.ndarray, np.ndarray]:
    slot, value = [], []
    for slots, at in groups:
        own, n = np.unique(slots[at[row] : at[row + 1]], return_counts=True)
        slot.append(own)
        value.append(n / max(1, n.sum()))
    slot, value = np.concatenate(slot), np.concatenate(value)
    own, where = np.unique(slot, return_inverse=True)
    return own.astype(np.int32), np.bincount(where, value, len(own)).astype(np.float32)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last weight is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, slot: np.ndarray, value: np.ndarray, label: int) -> None:
        slot, value = np.append(slot, 1 << BITS), np.append(value, 1.0)
        w = self.weights(slot)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        self.z[slot] += g - (np.sqrt(self.n[slot] + g * g) - np.sqrt(self.n[slot])) / ALPHA * w
        self.n[slot] += g * g


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights from documents with labels (id, label); at most `sample` of them, chosen by hash."""
    once = labels.filter("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    some = once.withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    order = texts.select("_h", "label", "text").repartition(1).sortWithinPartitions("_h", "label", "text")

    def fit(batches):
        seen: list[tuple[np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            labelled = batch.column(1).to_pylist()
            raw, at = utf8(batch.column(2))
            for a, b in slices(at):
                groups = features(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                seen += [(*_vectors(groups, i - a), labelled[i]) for i in range(a, b)]
        model = Ftrl()
        for _ in range(EPOCHS):
            for slot, value, label in seen:
                model.learn(slot, value, label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    found = order.mapInArrow(fit, "weights binary").first()
    return np.frombuffer(bytes(found[0]), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with score (or another name), the probability of label 1."""
    docs = without(docs, (name,), text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    names = docs.columns
    where = names.index(text_col)

    def apply(batches):
        w = np.frombuffer(shared.value, np.float32).astype(np.float64)
        for batch in batches:
            raw, at = utf8(batch.column(where))
            parts = [_dots(features(raw[at[a] : at[b]], at[a : b + 1] - at[a]), w) for a, b in slices(at)]
            total = (np.concatenate(parts) if parts else np.zeros(0)) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-total)))], [*names, name])

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights for `documents` from `labels.quality`, without the held-out fold."""
    own = labels.filter(~held_out("doc_id")).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return train(docs, own)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text")
    out = score(texts, fitted(texts, labels))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
