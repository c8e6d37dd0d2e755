"""Windows over ordered rows: transcripts of agents, log lines, labelled intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import written
from .intervals import overtaken


def truncated(messages: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The first message and as many of the latest pairs as fit the budget of tokens; at least one pair.

    A pair is an assistant's message with the one after it. Transcripts that fit, and those of at
    most three messages, stay whole.
    """
    w = Window.partitionBy(key).orderBy(order)
    every = Window.partitionBy(key)
    m = messages.withColumn("_t", F.coalesce(tokens(F.col(text)), F.lit(0))).withColumn("_i", F.row_number().over(w))
    m = m.withColumns({"_all": F.sum("_t").over(every), "_n": F.count(F.lit(1)).over(every), "_first": F.sum(F.when(F.col("_i") == 1, F.col("_t"))).over(every)})
    # a pair begins at an assistant's message that isn't itself the second of a pair: count inside runs of assistants
    m = m.withColumn("_other", F.sum(F.when((F.col("role") != "assistant") | (F.col("_i") == 1), 1).otherwise(0)).over(w))
    run = Window.partitionBy(key, "_other").orderBy(order)
    m = m.withColumn("_k", F.row_number().over(run))
    begins_run = (F.col("role") == "assistant") & (F.col("_i") > 1)
    # in a run of assistants after another message, pairs begin at every second one
    place = F.when(begins_run, F.col("_k") - 1)
    starts = F.when(F.col("_i") == 1, True).when(begins_run, place % 2 == 1).otherwise(~(F.lag("role").over(w).eqNullSafe("assistant") & F.coalesce(F.lag(F.when(begins_run, place % 2 == 1)).over(w), F.lit(False))))
    m = m.withColumn("_s", starts).withColumn("_pair", F.sum(F.col("_s").cast("int")).over(w))
    m = m.withColumn("_later", F.sum("_t").over(Window.partitionBy(key).orderBy(F.col("_pair").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    m = m.withColumn("_last", F.max("_pair").over(every))
    keep = (F.col("_all") <= budget) | (F.col("_n") <= 3) | (F.col("_i") == 1) | (F.col("_pair") == F.col("_last")) | (F.col("_first") + F.col("_later") <= budget)
    return m.filter(keep).select(*messages.columns)


def latest(uses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """uses with latest: whether no later use of the same keys follows."""
    return uses.withColumn("latest", F.col(order) == F.max(order).over(Window.partitionBy(*keys)))


def stale_reads(reads: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """reads (key, order, path, start, end) with stale: a later read of the path overlaps the range."""
    return overtaken(reads, [key, "path"], "start", "end", order, "stale")


def carried(df: DataFrame, marker: Column, name: str, order: list[str], key: str | None = None) -> DataFrame:
    """df with the last non-null marker up to each row."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(*order)
    return df.withColumn(name, F.last(marker, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def until_next(labels: DataFrame, end: Column, order: str, key: str) -> DataFrame:
    """Labels with the row before the next one as their end, the last until `end`."""
    following = F.lead(order).over(Window.partitionBy(key).orderBy(order))
    return labels.withColumn("end", F.coalesce(following - 1, end))


def merged_ranges(ranges: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """(key, start, end): ranges that touch or overlap become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > before + gap, 1).otherwise(0)).over(w)
    r = ranges.withColumn("_b", before).withColumn("_i", island)
    return r.groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


# What marks an error in a build log.
ERRORS = "error:|Error:|ERROR:|failed|Failed|FAILED"
# End of fixed values.


def warnings_kept(lines: DataFrame, key: str, pattern: str = ERRORS, least_chars: int = 10_000, context: int = 2, head: int = 20, tail: int = 30) -> DataFrame:
    """Lines of a log near an error. Without errors its head and tail; logs under least_chars, or no longer than both, whole."""
    every = Window.partitionBy(key)
    size = F.sum(F.length("line") + 1).over(every) - 1
    hit = F.rlike(F.col("line"), F.lit(pattern)).cast("int")
    rows = lines.withColumns({"_size": size, "_n": F.count(F.lit(1)).over(every), "_any": F.max(hit).over(every), "_near": F.max(hit).over(Window.partitionBy(key).orderBy("pos").rowsBetween(-context, context))})
    calm = (F.col("_n") <= head + tail) | (F.col("pos") <= head) | (F.col("pos") > F.col("_n") - tail)
    return rows.filter((F.col("_size") < least_chars) | (F.col("_near") == 1) | (F.col("_any") == 0) & calm).drop("_size", "_n", "_any", "_near")


def grouped_spans(spans: DataFrame, least: int = 10, key: str | list[str] = "function_id") -> DataFrame:
    """(key, start, end): short neighbouring spans joined until their own lines make `least`; long spans stand alone.

    The lines so far decide where a group ends. A long span ends every group, so the fold goes over the short spans
    between two long ones, as one sorted array.
    """
    keys = [key] if isinstance(key, str) else key
    good = spans.filter("end >= start").select(*keys, F.col("start").cast("long"), F.col("end").cast("long")).withColumn("_n", F.col("end") - F.col("start") + 1)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    good = good.withColumn("_run", F.sum((F.col("_n") >= least).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    long_, short = good.filter(F.col("_n") >= least), good.filter(F.col("_n") < least)
    runs = short.groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(F.struct("start", "end", "_n"))).alias("s"))
    group = "struct<start:bigint,end:bigint>"
    state = F.struct(F.array().cast(f"array<{group}>").alias("done"), F.lit(None).cast(group).alias("now"), F.lit(least).cast("long").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        joins = acc["size"] < least
        now = F.struct(F.when(joins, acc["now"]["start"]).otherwise(x["start"]).alias("start"), F.when(joins, F.greatest(acc["now"]["end"], x["end"])).otherwise(x["end"]).alias("end"))
        done = F.when(joins | acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
        return F.struct(done.alias("done"), now.alias("now"), (F.when(joins, acc["size"]).otherwise(0) + x["_n"]).alias("size"))

    folded = runs.select(*keys, F.explode(F.aggregate("s", state, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))).alias("g"))
    return folded.select(*keys, "g.start", "g.end").union(long_.select(*keys, "start", "end"))


def split_blocks(spans: DataFrame, lines: DataFrame, most_chars: int = 40_000, depth: int = 2, least: int = 10) -> DataFrame:
    """(function_id, start, end, depth): groups of a function's top spans; groups over most_chars replaced by those of their spans' children.

    spans: (function_id, id, parent, start, end), parent null at the top; lines: (function_id, pos, chars). A group is replaced where its spans have
    at least two children, `depth` times over; groups that leave the function's lines go.
    """
    w = Window.partitionBy("function_id").orderBy("pos")
    upto = written(lines.select("function_id", F.col("pos").cast("long").alias("pos"), F.sum(F.col("chars") + 1).over(w).alias("upto")))
    left = written(spans.select("function_id", "id", "parent", F.col("start").cast("long"), F.col("end").cast("long")))
    now, out = left.filter("parent is null").withColumn("_g", F.lit(0).cast("long")), None
    for level in range(depth + 1):
        groups = grouped_spans(now, least, ["function_id", "_g"])
        ends = upto.select("function_id", F.col("pos").alias("end"), F.col("upto").alias("_b"))
        starts = upto.select("function_id", (F.col("pos") + 1).alias("start"), F.col("upto").alias("_a"))
        sized = groups.join(ends, ["function_id", "end"]).join(starts, ["function_id", "start"], "left").filter("start >= 1").withColumn("chars", F.col("_b") - F.coalesce("_a", F.lit(0)) - 1)
        sized = written(sized.select("function_id", "_g", "start", "end", "chars").withColumn("_n", F.monotonically_increasing_id()))
        big = sized.filter(F.col("chars") > most_chars)
        if level < depth:
            # spans of one list don't leave their group: each belongs to the last group that begins at or before it
            begun = Window.partitionBy("function_id", "_g").orderBy("start", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            marks = sized.select("function_id", "_g", "start", F.lit(None).cast("long").alias("id"), "_n", F.col("end").alias("_e"), F.lit(None).cast("long").alias("end"))
            both = marks.unionByName(now.select("function_id", "_g", "start", "id", F.lit(None).cast("long").alias("_n"), F.lit(None).cast("long").alias("_e"), "end"))
            placed = both.withColumns({"_n": F.last("_n", ignorenulls=True).over(begun), "_e": F.last("_e", ignorenulls=True).over(begun)}).filter("id is not null and end <= _e")
            inside = placed.join(big.select("_n"), "_n", "left_semi").select("function_id", F.col("id").alias("parent"), F.col("_n").alias("_of"))
            children = left.join(inside, ["function_id", "parent"]).filter("end >= start")
            several = children.groupBy("_of").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
            now = written(children.join(several.select("_of"), "_of", "left_semi").withColumnRenamed("_of", "_g").select("function_id", "id", "parent", "start", "end", "_g"))
            kept = sized.join(now.select(F.col("_g").alias("_n")).distinct(), "_n", "left_anti")
        else:
            kept = sized
        found = kept.select("function_id", "start", "end", F.lit(level).alias("depth"))
        out = found if out is None else out.union(found)
    return out


def nested_blocks(texts: DataFrame, opens: str, middles: str, closes: str, key: str = "id") -> DataFrame:
    """(key, start, middle, end, depth): conditional blocks by line, nested ones too; malformed ones left out."""
    import re

    schema = f"{key} long, start int, middle int, end int, depth int"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, c = (re.compile(p) for p in (opens, middles, closes))
        for rows in batches:
            out = []
            for k, text in rows.itertuples(index=False):
                stack: list[list] = []
                for i, line in enumerate((text or "").split("\n"), 1):
                    if a.search(line):
                        stack.append([i, None])
                    elif b.search(line) and stack:
                        stack[-1][1] = i
                    elif c.search(line) and stack:
                        start, middle = stack.pop()
                        out.append((k, start, middle, i, len(stack)))
            yield pd.DataFrame(out, columns=[key, "start", "middle", "end", "depth"]).astype({"middle": "Int32"})

    return texts.select(F.col(key).cast("long"), "source").mapInPandas(parse, schema)
