"""Ranges of lines: which overlap, and which is nearest, without comparing all with all.

A range is cut into blocks of power-of-two size and aligned place (its cover), at most two of a size. Two ranges overlap
if and only if the start of one lies in the other, so in one block of its cover; all blocks that hold a start are one per size. So
overlap is equality of blocks: a start's blocks against a cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def _block(size: Column, at: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), at.cast("long").alias("at"))


def _shift(value: Column, by: Column, up: bool) -> Column:
    """value / 2^by, rounded up or down."""
    more = F.call_function("shiftleft", F.lit(1).cast("long"), by) - 1 if up else F.lit(0).cast("long")
    return F.call_function("shiftright", value + more, by)


def cover(start: Column, end: Column, sizes: int) -> Column:
    """The blocks (size, at) of a range of whole numbers, ends included; sizes: the exponents to use, from 0."""
    first, after = start.cast("long"), end.cast("long") + 1

    def at_size(s: Column) -> Column:
        low, high = _shift(first, s, True), _shift(after, s, False)
        some = low < high
        left, right = some & (low % 2 != 0), some & (high % 2 != 0)
        return F.filter(F.array(F.when(left, _block(s, low)), F.when(right, _block(s, high - 1))), lambda b: b.isNotNull())

    top = F.lit(sizes - 1)
    inner = F.flatten(F.transform(F.sequence(F.lit(0), top), at_size))
    low, high = _shift(first, top, True), _shift(after, top, False)
    rest = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda x: _block(top, x))).otherwise(F.array().cast("array<struct<size:int,at:bigint>>"))
    return F.array_distinct(F.concat(inner, rest))


def holders(start: Column, sizes: int) -> Column:
    """The blocks that hold a number, one of each size."""
    return F.transform(F.sequence(F.lit(0), F.lit(sizes - 1)), lambda s: _block(s, _shift(start.cast("long"), s, False)))


def sizes_for(df: DataFrame, start: str, end: str) -> int:
    """Exponents up to that of the longest range."""
    longest = df.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long") + 1)).first()[0] or 1
    return max(1, int(longest).bit_length())


def overtaken(df: DataFrame, keys: list[str], start: str, end: str, order: str, name: str) -> DataFrame:
    """df with `name`: whether a row of the same keys and of a larger order overlaps the range.

    Of each block only the largest order is kept: of the ranges that start in it, and of those whose cover has it. A row asks
    its own blocks. Rows never meet rows, so a key with very many rows costs no more than its rows' blocks. Ranges without a
    number, or with the end before the start, overlap nothing.
    """
    rows = written(df.withColumn("_id", F.monotonically_increasing_id()))
    n = sizes_for(rows, start, end)
    good = rows.filter(F.col(start) <= F.col(end))
    covers = good.select("_id", *keys, F.col(order).alias("_o"), F.explode(cover(F.col(start), F.col(end), n)).alias("_b"), F.lit(True).alias("_c"))
    starts = good.select("_id", *keys, F.col(order).alias("_o"), F.explode(holders(F.col(start), n)).alias("_b"), F.lit(False).alias("_c"))
    asked = written(covers.unionByName(starts))
    latest = asked.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_c"), F.col("_o"))).alias("_oc"), F.max(F.when(~F.col("_c"), F.col("_o"))).alias("_os"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys] + [F.col("a._b") == F.col("l._b")]
    later = asked.alias("a").join(latest.alias("l"), same).filter(F.when(F.col("a._c"), F.col("l._os")).otherwise(F.col("l._oc")) > F.col("a._o")).select("a._id").distinct()
    return rows.join(later.withColumn(name, F.lit(True)), "_id", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_id")


def best(wanted: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """(key, id): of the places of the same keys the one with most in common with the range, else the nearest; ties: smallest id.

    wanted: (key, *keys, a, b), places: (id, *keys, c, d). Ranges that overlap meet by blocks; of places with equal ranges the smallest
    id stands for all. Ranges without an overlap look to the last end before them and the first start after them, by running maxima in order.
    """
    same = places.groupBy(*keys, "c", "d").agg(F.min("id").alias("id"))
    p = written(same.withColumn("d", F.greatest("c", "d")).groupBy(*keys, "c", "d").agg(F.min("id").alias("id")))
    w = written(wanted.select("key", *keys, "a", F.greatest("a", "b").alias("b")).distinct())
    n = max(sizes_for(w, "a", "b"), sizes_for(p, "c", "d"))
    ours = {True: w.select("*", F.explode(cover(F.col("a"), F.col("b"), n)).alias("_b")), False: w.select("*", F.explode(holders(F.col("a"), n)).alias("_b"))}
    theirs = {True: p.select("*", F.explode(holders(F.col("c"), n)).alias("_b")), False: p.select("*", F.explode(cover(F.col("c"), F.col("d"), n)).alias("_b"))}
    met = [ours[side].join(theirs[side], [*keys, "_b"]).select("key", "id", (F.greatest("a", "c") - F.least("b", "d")).alias("cost")) for side in (True, False)]
    over = met[0].union(met[1]).groupBy("key").agg(F.min(F.struct("cost", "id")).alias("m"))
    over = written(over.select("key", "m.id"))
    alone = w.join(over.select("key"), "key", "left_anti")
    near = _beside(alone, p, keys, "a", "d", 1).unionByName(_beside(alone, p, keys, "b", "c", -1))
    return over.union(near.groupBy("key").agg(F.min(F.struct("cost", "id")).alias("m")).select("key", "m.id"))


def _beside(w: DataFrame, p: DataFrame, keys: list[str], own: str, other: str, way: int) -> DataFrame:
    """(key, cost, id): the place whose end `other` is the nearest one below `own` (way 1) or above it (-1)."""
    a = w.select(*keys, (F.col(own) * way).alias("x"), "key", F.lit(None).cast(p.schema["id"].dataType).alias("id"))
    b = p.select(*keys, (F.col(other) * way).alias("x"), F.lit(None).cast(w.schema["key"].dataType).alias("key"), "id")
    both = a.unionByName(b.groupBy(*keys, "x").agg(F.min("id").alias("id"), F.first("key").alias("key")))
    order = Window.partitionBy(*keys).orderBy("x", F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("id").isNotNull(), F.struct("x", "id")), ignorenulls=True).over(order)
    return both.withColumn("l", last).filter("id is null and l is not null").select("key", (F.col("x") - F.col("l.x")).alias("cost"), "l.id")
