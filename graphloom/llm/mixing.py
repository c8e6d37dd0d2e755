"""Mixing sources to target weights, in DataFrame operations only.

Targets. Sources in code point order, null last, take the weights in turn; they share `share` of all
words, none more than `most` times its own words, the excess reshared by weight. Sorted by cap per
weight, the level is the largest (share - caps before) / (weights from here on): one window, no loop.

Blocks. A source's documents fall by hash into blocks of about BLOCK_WORDS words, or less: there are 2^12 to 2^20. Whole
passes over a source take every block; the rest of the target takes blocks in a permuted order. The
block that crosses the target is cut between documents, and the crossing document after the word that
meets it, so each source's words are its target, rounded. Block tables have at most MOST_BLOCKS rows and
one per source; no window or task holds more than one block's documents.

Shards. Each block in each pass is a unit. A splitting tree halves the slots of all sources level by
level; which slots go left is drawn without replacement, so every node's counts by source are a
multivariate-hypergeometric draw with exact totals. At the leaves a shard has its quota of each source;
it takes that many units, in order, from the source's permutation, so shards are disjoint. Rows
carry a shuffle key for the order inside their shard.

Defined cases. Null text has size 0. Documents without words follow their block. Rows that repeat an
id stand next to each other in their block's order. If all sizes are 0, all targets are. An empty
table gives an empty result. Reruns give the same mix: all draws are MD5 of ids and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, power_of_two, without, written

WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2  # 150 %
MOST = 2
#: Words of a block, within bounds for the number of blocks; and of a shard, the shards being a power of two.
BLOCK_WORDS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 20, 1 << 12, 1 << 20
SHARD_WORDS, LEAST_LEVELS, MOST_LEVELS = 1 << 23, 4, 16
#: Rows of the block table up to which it's broadcast; beyond, it's joined with a shuffle.
BROADCAST_ROWS = 200_000


def _draw(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source of sizes (source, size): source_size, weight, target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by_weight = F.array(*map(F.lit, weights))
    known = totals.withColumn("weight", F.element_at(by_weight, place + 1).cast("long"))
    rising = Window.orderBy(F.lit(MOST) * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(MOST * F.col("source_size")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    shared = F.lit(SHARE_NUM) * F.sum("source_size").over(everything) / F.lit(float(SHARE_DEN))
    leveled = known.withColumn("_level", (shared - before) / after).withColumn("_level", F.max("_level").over(everything))
    return leveled.select("source", "source_size", "weight", F.least(F.col("source_size") * F.lit(float(MOST)), F.col("_level") * F.col("weight")).alias("target"))


def _tree(units: DataFrame, levels: int) -> DataFrame:
    """units (source, _u from 1): the same slots with their leaf. Each node's slots are halved by a draw."""
    slots = units.withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(_draw(F.col("source"), F.col("_u"), f"split{level}"), "source", "_u"))
        slots = slots.withColumn("_left", (rank <= F.floor(F.count(F.lit(1)).over(node) / 2)).cast("int")).withColumn("shard", F.col("shard") * 2 + 1 - F.col("_left")).drop("_left")
    return slots


def _key(id_: Column) -> Column:
    return _draw(id_, "mix")


def _in_block(rows: DataFrame, source: Column, key: Column, sources: DataFrame) -> DataFrame:
    """rows with their source's columns and _b, their block."""
    few = sources.count() <= BROADCAST_ROWS
    own = sources.withColumnRenamed("source", "_s0")
    met = rows.join(F.broadcast(own) if few else own, source.eqNullSafe(F.col("_s0"))).drop("_s0")
    return met.withColumn("_b", F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.col("n_blocks"))


def _with_plan(rows: DataFrame, source: Column, blocks: DataFrame) -> DataFrame:
    """rows with the plan of their block: whole passes, words of the partial pass, shards by pass."""
    few = blocks.count() <= BROADCAST_ROWS
    own = blocks.withColumnsRenamed({"source": "_s1", "block": "_b1"})
    return rows.join(F.broadcast(own) if few else own, source.eqNullSafe(F.col("_s1")) & (F.col("_b") == F.col("_b1"))).drop("_s1", "_b1")


_CUT = "partial > 0 and partial < words"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _layout(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs: doc_id, source, _key, size; sources; block plans; cut: documents of blocks that are taken in part, with last)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"))
    docs = written(docs.withColumns({"_key": _key(F.col("doc_id")), "_row": F.monotonically_increasing_id()}))
    sources = written(targets(docs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, min(MOST_BLOCKS, total // BLOCK_WORDS))
    levels = power_of_two(total * SHARE_NUM / SHARE_DEN / SHARD_WORDS, LEAST_LEVELS, MOST_LEVELS)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") * blocks / F.lit(max(1, total)))).cast("long")
    sources = sources.withColumn("n_blocks", n_blocks)
    placed = _in_block(docs, F.col("source"), F.col("_key"), sources)

    of_block = placed.groupBy("source", F.col("_b").alias("block")).agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    wanted = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    permuted = Window.partitionBy("source").orderBy(_draw(F.col("source"), F.col("block"), "block"), "block")
    upto = permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_block = of_block.withColumns({"whole": whole, "left": wanted - whole * F.col("source_size"), "start": F.sum("words").over(upto) - F.col("words")})
    of_block = written(of_block.withColumn("partial", F.greatest(F.lit(0), F.least("words", F.col("left") - F.col("start")))))
    passes = of_block.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") + (F.col("partial") > 0).cast("long")))).filter("pass > 0")
    order = Window.partitionBy("source").orderBy(_draw(F.col("source"), F.col("block"), F.col("pass"), "unit"), "block", "pass")
    units = passes.select("source", "block", "pass", F.row_number().over(order).alias("_u"))
    slots = _tree(units.select("source", "_u"), levels).select(F.col("source").alias("_s"), "shard", F.row_number().over(Window.partitionBy("source").orderBy("shard", "_u")).alias("_v"))
    dealt = units.join(slots, units["source"].eqNullSafe(slots["_s"]) & (units["_u"] == slots["_v"]))
    shards = dealt.groupBy(F.col("source").alias("_s2"), F.col("block").alias("_b2")).agg(F.map_from_entries(F.collect_list(F.struct("pass", "shard"))).alias("shards"))
    plans = of_block.select("source", "block", "words", "whole", "partial").join(shards, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("block") == F.col("_b2")), "left").drop("_s2", "_b2")
    plans = written(plans)

    in_cut = Window.partitionBy("source", "_b").orderBy("_key", "size", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("size").over(in_cut) - F.col("size")
    cut = _with_plan(placed, F.col("source"), plans.filter(_CUT)).withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("partial") - before)))
    return placed, sources, plans, written(cut)


def _parts(size: Column) -> Column:
    """array of (pass, shard, words) from whole, partial, shards and last."""
    one = lambda p, words: F.struct(p.cast("long").alias("pass"), F.element_at("shards", p.cast("long")).alias("shard"), words.cast("long").alias("words"))
    none = F.array().cast("array<struct<pass:bigint,shard:int,words:bigint>>")
    runs = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole")), lambda p: one(p, size))).otherwise(none)
    return F.concat(runs, F.when(F.col("last").isNotNull(), F.array(one(F.col("whole") + 1, F.col("last")))).otherwise(none))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of df: doc_id, source, _key, size, source_size, target, taken, parts.

    parts: array of (pass, shard, words), one for each time that the mix takes the document.
    """
    placed, _, plans, cut = _layout(df, id_col, text_col, source_col)
    rest = _with_plan(placed, F.col("source"), plans.filter(f"not ({_CUT})")).withColumn("last", F.when(F.col("partial") > 0, F.col("size")))
    rows = rest.unionByName(cut.withColumn("last", F.when(F.col("last") > 0, F.col("last"))))
    taken = F.col("whole") * F.col("size") + F.coalesce("last", F.lit(0))
    return rows.select("doc_id", "source", "_key", "size", "source_size", "target", taken.alias("taken"), _parts(F.col("size")).alias("parts"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", names: tuple[str, str] = ("shard", "shuffle_key")) -> DataFrame:
    """The mix itself: rows of df, one for each time it's taken, with shard and shuffle_key (or other names, of which df may have columns: they are replaced).

    Sort by shuffle_key inside each shard, e.g. repartition("shard").sortWithinPartitions("shuffle_key").
    A document that crosses its source's target ends after the last word taken; one per source at most. Rows meet
    the block plans where they are; only those of blocks taken in part are joined by source, id, size and their place
    among the rows that share these. Such rows are alike to the plan, so any order among them gives the same totals;
    by text it gives the same mix again.
    """
    df = without(df, names, id_col, text_col, source_col)
    _, sources, plans, cut = _layout(df, id_col, text_col, source_col)
    inner = {c: f"_m{i}" for i, c in enumerate(df.columns)}  # so that no name clashes
    id_, text_, source_ = (F.col(inner[c]) for c in (id_col, text_col, source_col))
    rows = _in_block(df.withColumnsRenamed(inner), source_, _key(id_), sources.select("source", "n_blocks"))
    whole = _with_plan(rows, source_, plans.filter(f"not ({_CUT})"))
    size = F.lit(None).cast("long")
    whole = whole.withColumns({"last": F.when(F.col("partial") > 0, F.lit(-1).cast("long")), "_size": size})
    alike = lambda *key: Window.partitionBy(*key, "_size")
    nth = F.row_number().over(alike("source", "doc_id").orderBy(F.desc("last"), "_row"))
    own = cut.withColumnRenamed("size", "_size").select(F.col("source").alias("_s3"), F.col("doc_id").alias("_id"), "last", "_size", nth.alias("_nth"))
    own = own.withColumnsRenamed({"_size": "_size1", "_nth": "_nth1"})
    some = _with_plan(rows, source_, plans.filter(_CUT)).withColumn("_size", _size(text_))
    some = some.withColumn("_nth", F.row_number().over(alike(source_, id_).orderBy(F.xxhash64(text_), text_)))
    some = some.join(own, source_.eqNullSafe(F.col("_s3")) & id_.eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_size1")) & (F.col("_nth") == F.col("_nth1")))
    some = some.drop("_s3", "_id", "_size1", "_nth", "_nth1")
    some = some.withColumn("last", F.when(F.col("last") > 0, F.col("last")))
    taken = whole.unionByName(some).withColumn("_part", F.explode(_parts(F.lit(-1).cast("long"))))
    pieces = F.split(text_, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    short = (F.col("_part.words") >= 0) & (F.col("_part.words") < F.col("_size"))
    text = F.when(short, F.array_join(F.slice(pieces, F.lit(1), F.col("_part.words").cast("int")), "")).otherwise(text_)
    key = F.xxhash64(id_, F.col("_part.pass"), F.lit("local"))
    return taken.select(*((text if c == text_col else F.col(inner[c])).alias(c) for c in df.columns), F.col("_part.shard").alias(names[0]), key.alias(names[1]))


def report(df: DataFrame) -> DataFrame:
    return plan(df).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k FROM documents),
     s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     s1 AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s0),
     s2 AS (SELECT *, (3 * sum(source_size) OVER () / 2.0::DOUBLE
                       - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
     s3 AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(lv) OVER () * weight) AS target,
                   greatest(1, ceil(source_size * greatest(4096, least(1048576, sum(source_size) OVER () // 1048576)) / greatest(1, sum(source_size) OVER ())::DOUBLE))::BIGINT AS nb FROM s2),
     b AS (SELECT d.*, s3.source_size, s3.target, ('0x' || substr(k, 1, 8))::BIGINT % nb AS block,
                  CASE WHEN s3.source_size > 0 THEN round(s3.target)::BIGINT // s3.source_size ELSE 0 END AS whole,
                  round(s3.target)::BIGINT AS wanted
           FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
     g AS (SELECT source, block, sum(size) AS words, max(wanted - whole * source_size) AS lft FROM b GROUP BY source, block),
     h AS (SELECT *, greatest(0, least(words, lft - (sum(words) OVER (PARTITION BY source ORDER BY md5(coalesce(source, '') || ':' || block || ':block'), block ROWS UNBOUNDED PRECEDING) - words))) AS part FROM g),
     m AS (SELECT b.*, h.part, sum(size) OVER (PARTITION BY b.source, b.block ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS before
           FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source AND b.block = h.block)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, part - before)))::BIGINT AS taken FROM m
"""
