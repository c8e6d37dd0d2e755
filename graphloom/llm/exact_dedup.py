"""Exact deduplication with two Bloom passes, in DataFrame operations only.

The text is read once: a narrow table of digests is written to the shared folder. Pass 1 deals each
digest a slot and finds the slots hit at least twice; pass 2 does so again with another slot of
those rows alone. Each pass's filter is a bitmap in 64-bit words, broadcast (its size is bounded by
the number of slots, see MOST_SLOTS). Rows that leave a pass unsuspected are unique for certain and
pass straight through; only the rest are shuffled by digest.

Defined cases. Null text counts as empty, so nulls and empty texts are one group. A null id sorts
below every id. Rows that repeat both id and text are told apart by their place in the table: one of
them stays. An empty table gives an empty result. Other columns are carried untouched (names starting with `_gl_` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_on_hot_keys, power_of_two, written

#: 2^27 slots are at most 2^21 words of 64 bits: about 64 MB broadcast. Past about as many rows, the
#: filters fill up and more unique rows go through the shuffle of digests; the result is the same.
LEAST_SLOTS, MOST_SLOTS = 12, 27


def _suspects(rows: DataFrame, slot: Column) -> DataFrame:
    """rows, with `suspect`: whether the row's slot is hit by another row too."""
    rows = rows.withColumn("_slot", slot)
    hit = rows.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    words = hit.groupBy(F.shiftrightunsigned("_slot", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(_slot & 63)))").alias("_bits"))
    rows = rows.withColumn("_word", F.shiftrightunsigned("_slot", 6)).join(F.broadcast(words), "_word", "left")
    return rows.withColumn("suspect", F.expr("coalesce(shiftrightunsigned(_bits, int(_slot & 63)) & 1, 0) = 1")).drop("_slot", "_word", "_bits")


def groups(df: DataFrame, id_col: str, text_col: str, slots_per_row: int = 32) -> DataFrame:
    """One row per row of df: doc_id, digest (SHA-256 of the normalised text), keep_id, group_size, kept."""
    return _grouped(df, id_col, text_col, F.monotonically_increasing_id(), slots_per_row).drop("_row")


def _grouped(df: DataFrame, id_col: str, text_col: str, row: Column, slots_per_row: int = 32) -> DataFrame:
    """The rows of groups, with _row: the number by which rows are told apart."""
    digests = written(
        df.select(F.col(id_col).alias("doc_id"), row.alias("_row"), F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest"))
    )
    bits = power_of_two(slots_per_row * digests.count(), LEAST_SLOTS, MOST_SLOTS)
    slot = lambda seed: F.shiftrightunsigned(F.xxhash64("digest", F.lit(seed)), 64 - bits)
    first = written(_suspects(digests, slot(1)))
    second = written(_suspects(first.filter("suspect").drop("suspect"), slot(2)))
    alone = first.filter("not suspect").drop("suspect").unionByName(second.filter("not suspect").drop("suspect"))
    suspected = second.filter("suspect").drop("suspect")
    best = F.max(F.struct("doc_id", "_row")).alias("_best")
    sizes = written(suspected.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")))
    together = join_on_hot_keys(suspected, sizes, "digest", "group_size")
    cols = ["_row", "doc_id", "digest"]
    return alone.select(*cols, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")).unionByName(
        together.select(*cols, F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"))
    )


def drop_exact_copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df without the rows that are not kept, whatever their ids. Only dropped rows' numbers are joined."""
    rows = written(df.withColumn("_gl_number", F.monotonically_increasing_id()))
    dropped = _grouped(rows, id_col, text_col, F.col("_gl_number")).filter("not kept").select(F.col("_row").alias("_gl_number"))
    return rows.join(dropped, "_gl_number", "left_anti").select(*df.columns)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return groups(df, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
