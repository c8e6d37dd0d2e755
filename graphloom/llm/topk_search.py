"""Exact top-k by inner product: blocks in the order of their bounds, until no bound reaches the k-th score.

Components become floor(64 x). Rows with equal vectors are one class that keeps its k + 1 smallest ids, so neither many
copies nor many equal queries cost more than one. Classes are put into ranges by the nearest of some centres (fitted on
SAMPLE rows of the smallest hashes, a bound that affects speed alone); BLOCK classes in a row are a block, GROUP blocks
a group. Of a block and of a group the largest and the smallest value of each component are known: their products with a
query, summed, bound the score of every member.

A query first meets one group of its own range, which gives a k-th score from below. Then it is sent to the groups whose
bound reaches that. In a group, its blocks are taken by bound; each is scored whole, by one product of matrices of the block's forward
index and the queries that want it, and a query ends where the next bound is below the k-th score so far. Best rows of
all groups are merged. Nothing is approximate; rows of queries and of the index meet in tasks by group, where the index is
held (at most GROUP * BLOCK rows) and queries stream.

Defined cases. Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as filled
up with zeros. Rows with equal ids are rows of their own; a repeated query row (same id and vector) is answered once,
without one row of its own. Null ids are no queries; as candidates they come last among ties. Ties go to the smaller id.
Fewer candidates than k: all of them. Scores beyond a long are cut to it. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_on_hot_keys, written

TOP = 20
BLOCK, GROUP = 256, 32
CELLS, SAMPLE = 64, 4096
#: Bounds of groups that a task holds at a time.
CHUNK = 1024
#: Queries in one product, and those that a task puts to one group, or so.
SLICE, SHARE = 512, 1 << 14
_EXACT = float(1 << 53)


def quantised(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, k): floor(64 x) of each component, all of one length; and a key of the vector."""
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    rows = rows.filter(F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    longest = rows.agg(F.max(F.size("e"))).first()[0] or 0
    v = F.transform("e", lambda x: F.floor(64 * x))
    rows = rows.select("vec_id", F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("e"))).alias("v"))
    return rows.withColumn("k", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T, exact: floats hold it where no sum can pass 2^53, whole numbers of any size otherwise."""
    most = [max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def bounds(queries: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For each query and each range of vectors, what no score exceeds."""
    sums = [dot(np.maximum(queries, 0), hi), dot(np.minimum(queries, 0), lo)]
    total = sums[0] + sums[1]
    over = (sums[0] > 0) & (sums[1] > 0) & (total < 0)
    return np.where(over, np.iinfo(np.int64).max, total)


def centres(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Means of a bounded sample of different vectors, by ten rounds of k-means."""
    found = rows.select("k", "v").dropDuplicates(["k"]).orderBy("k").limit(sample).select("v").toArrow()
    x = matrix(found.column("v").combine_chunks()).astype(np.float64) if found.num_rows else np.zeros((1, 0))
    means = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(10):
        near = nearest(x, means)
        means = np.stack([x[near == c].mean(0) if (near == c).any() else means[c] for c in range(len(means))])
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means**2).sum(1) - 2 * x.astype(np.float64) @ means.T).argmin(1)


def celled(rows: DataFrame, means: np.ndarray) -> DataFrame:
    """rows (k, v, ...) with cell, the number of the nearest centre (of CELLS at most, which go along with the tasks)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(nearest(matrix(b.column("v")), means), pa.int64()))

    return rows.mapInArrow(near, StructType([*rows.schema.fields, StructField("cell", LongType())]))


_INDEX = pa.schema([("grp", pa.int64()), ("cell", pa.int64()), ("block", pa.int64()), ("v", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])


def indexed(rows: DataFrame, means: np.ndarray, top: int = TOP) -> DataFrame:
    """(grp, cell, block, v, low, ids): classes in blocks and groups; block -1 has a group's largest (v) and smallest (low) components."""
    first = F.row_number().over(Window.partitionBy("k").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("r", first).filter(F.col("r") <= top + 1)
    classes = few.groupBy("k").agg(F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))).alias("ids"))
    classes = celled(classes.select("k", "v", F.transform("ids", lambda s: s["vec_id"]).alias("ids")), means)
    dealt = classes.repartitionByRange("cell", "k").sortWithinPartitions("cell", "k").select("cell", "v", "ids")
    most = BLOCK * GROUP

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, n, hi, lo = TaskContext.get().partitionId() << 32, None, 0, None, None

        def summary() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"grp": number, "cell": cell, "block": -1, "v": hi.tolist(), "low": lo.tolist(), "ids": []}], _INDEX)

        for b in batches:
            x, cells = matrix(b.column("v")), np.asarray(b.column("cell"))
            at = 0
            while at < len(x):
                if n and (cells[at] != cell or n == most):
                    yield summary()
                    number, n = number + 1, 0
                if not n:
                    cell, hi, lo = int(cells[at]), x[at], x[at]
                end = at + min(most - n, int(np.argmax(np.append(cells[at:] != cell, True))))
                hi, lo = np.maximum(hi, x[at:end].max(0)), np.minimum(lo, x[at:end].min(0))
                part, size = b.slice(at, end - at), end - at
                blocks = (n + np.arange(size)) // BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, number)), pa.array(np.full(size, cell)), pa.array(blocks.astype(np.int64)), part.column("v"), pa.nulls(size, pa.list_(pa.int64())), part.column("ids")], schema=_INDEX)
                at, n = end, n + size
        if n:
            yield summary()

    return dealt.mapInArrow(cut, "grp long, cell long, block long, v array<long>, low array<long>, ids array<long>")


_MET = "at long, salt long, held boolean, grp long, block long, k string, v array<long>, low array<long>, ids array<long>, least long"


def _met(held: DataFrame, asking: DataFrame) -> DataFrame:
    """Rows of both, dealt by (at, salt): what a task holds comes first, and the queries after it."""
    columns = [c.rsplit(" ", 1) for c in _MET.split(", ")]

    def shaped(df: DataFrame, is_held: bool) -> DataFrame:
        df = df.withColumn("held", F.lit(is_held))
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns))

    both = shaped(held, True).unionByName(shaped(asking, False))
    return both.repartition("at", "salt").sortWithinPartitions("at", "salt", F.col("held").desc(), "grp", "block")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """Slices of one (at, salt) and one kind: (whether a new place begins, whether held, rows)."""
    last = None
    for b in batches:
        place = np.stack([np.asarray(b.column("at")), np.asarray(b.column("salt"))]).T
        held = np.asarray(b.column("held").cast(pa.int8()))
        if not len(held):
            continue
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(1) | (held[1:] != held[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(held)], strict=True):
            here = tuple(place[i])
            yield here != last, bool(held[i]), b.slice(i, j - i)
            last = here


def wanted(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(k, v, least, grp): the groups whose bound reaches a query's `least`, its home group aside.

    Bounds of groups are held CHUNK at a time; queries are dealt to as many tasks as a shuffle has.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = index.filter("block = -1").select("grp", "v", "low")
    chunks = -(-marks.count() // CHUNK)
    held = marks.withColumn("at", F.pmod(F.xxhash64("grp"), F.lit(max(1, chunks)))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asking = queries.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(max(1, chunks) - 1)))).withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(parts))).withColumnRenamed("home", "grp")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, hi, lo = np.zeros(0, np.int64), [], []
        for new, is_held, b in _parts(batches):
            if new:
                groups, hi, lo = np.zeros(0, np.int64), [], []
            if is_held:
                groups = np.append(groups, np.asarray(b.column("grp")))
                hi.append(matrix(b.column("v")))
                lo.append(matrix(b.column("low")))
            elif len(groups):
                hi, lo = [np.concatenate(hi)], [np.concatenate(lo)]
                for i in range(0, len(b), SLICE):
                    rows = b.slice(i, SLICE)
                    reach = bounds(matrix(rows.column("v")), hi[0], lo[0]) >= np.asarray(rows.column("least"))[:, None]
                    reach &= groups[None, :] != np.asarray(rows.column("grp"))[:, None]
                    q, g = np.nonzero(reach)
                    for j in range(0, len(q), 10_000):
                        taken = rows.take(pa.array(q[j : j + 10_000]))
                        yield pa.RecordBatch.from_arrays([taken.column("k"), taken.column("v"), taken.column("least"), pa.array(groups[g[j : j + 10_000]])], ["k", "v", "least", "grp"])

    return _met(held, asking).mapInArrow(select, "k string, v array<long>, least long, grp long")


class Held:
    """Blocks of one group: forward indexes, bounds, ids."""

    def __init__(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.ready = False

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)

    def prepare(self) -> None:
        x = np.concatenate([matrix(r.column("v")) for r in self.rows])
        block = np.concatenate([np.asarray(r.column("block")) for r in self.rows])
        self.ids = [ids for r in self.rows for ids in r.column("ids").to_pylist()]
        self.starts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        self.blocks = [x[i:j] for i, j in zip(self.starts[:-1], self.starts[1:], strict=True)]
        self.hi, self.lo = np.stack([b.max(0) for b in self.blocks]), np.stack([b.min(0) for b in self.blocks])
        self.ready, self.rows = True, []

    def best(self, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[list[list[tuple[int, int | None]]], int]:
        """For each query its k best rows, as (score, id), of those with `least` or more; and how many blocks were scored."""
        bound = bounds(queries, self.hi, self.lo)
        order = np.argsort(-bound, axis=1, kind="stable")
        floor, tops = least.copy(), np.full((len(queries), k), np.iinfo(np.int64).min)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every, scored = np.arange(len(queries)), 0
        for turn in range(len(self.blocks)):
            at = order[:, turn]
            live = bound[every, at] >= floor
            if not live.any():
                break
            for b in np.unique(at[live]):
                rows = np.flatnonzero(live & (at == b))
                scores = dot(queries[rows], self.blocks[b])
                scored += len(rows)
                q, c = np.nonzero(scores >= floor[rows, None])
                found.append((rows[q], c + self.starts[b], scores[q, c]))
                tops[rows] = np.partition(np.hstack([tops[rows], scores]), -k, axis=1)[:, -k:]
                floor[rows] = np.maximum(floor[rows], tops[rows].min(1))
        out: list[list[tuple[int, int | None]]] = [[] for _ in every]
        for q, c, s in found:
            for i in np.flatnonzero(s >= floor[q]):
                out[q[i]] += [(int(s[i]), x) for x in self.ids[c[i]]]
        return [sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:k] for hits in out], scored


_HITS = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))


def searched(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(k, hits): the k best rows of a group for each query that asks it. queries: (k, v, least, grp), a written table.

    A task has one group, and of the queries that ask it about SHARE.
    """
    salts = max(1, queries.select("k").distinct().count() // SHARE)
    asking = queries.withColumn("at", F.col("grp")).withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)))
    held = index.filter("block >= 0").join(asking.select("grp", "at", "salt").distinct(), "grp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Held()
        for new, is_held, b in _parts(batches):
            if new:
                group = Held()
            if is_held:
                group.add(b)
                continue
            if not group.ready:
                group.prepare()
            for i in range(0, len(b), SLICE):
                rows = b.slice(i, SLICE)
                hits, _ = group.best(matrix(rows.column("v")), np.asarray(rows.column("least")), k)
                yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array([[{"score": s, "vec_id": x} for s, x in h] for h in hits], _HITS)], ["k", "hits"])

    return _met(held, asking).mapInArrow(search, "k string, hits array<struct<score: long, vec_id: long>>")


def search(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries, its best rows other than itself. Both: (vec_id, v, k)."""
    least = np.iinfo(np.int64).min
    means = centres(rows)
    index = written(indexed(rows, means, top))
    own = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    asked = written(queries.select("vec_id", "k", "v", F.least(own, F.lit(np.iinfo(np.int64).max)).cast("long").alias("own")).dropDuplicates(["vec_id", "k"]))
    different = celled(asked.groupBy("k").agg(F.first("v").alias("v")), means)
    homes = index.filter("block = -1").groupBy("cell").agg(F.min("grp").alias("home"))
    start = written(different.join(F.broadcast(homes), "cell").select("k", "v", "home"))  # a row for each centre, at most CELLS
    near = written(searched(index, start.select("k", "v", F.lit(least).alias("least"), F.col("home").alias("grp")), top + 1))
    floor = F.when(F.size("hits") > top, F.element_at("hits", -1)["score"]).otherwise(F.lit(least))
    begun = start.join(near.select("k", floor.alias("least")), "k")
    far = searched(index, written(wanted(begun, index)), top + 1)
    hits = near.unionByName(far).select("k", F.explode("hits").alias("h"))
    place = Window.partitionBy("k").orderBy(F.col("h.score").desc(), F.col("h.vec_id").asc_nulls_last())
    merged = hits.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= top + 1)
    lists = merged.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda s: s["h"]).alias("hits"))
    answers = written(lists.join(asked.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k"))
    mine = join_on_hot_keys(asked.select("vec_id", "k", "own"), answers, "k", "n")
    at = F.array_position("hits", F.struct(F.col("own").alias("score"), "vec_id"))
    rest = F.filter("hits", lambda h, i: i + 1 != at)
    out = mine.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(rest, 1, top)).alias("i", "h"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "h.vec_id", "h.score")


def report(embeddings: DataFrame, top: int = TOP) -> DataFrame:
    rows = written(quantised(embeddings))
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0), top)


SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) WHERE rank <= 20
"""
