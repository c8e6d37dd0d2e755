"""What must be summarised again: missing, stale and changed functions, and version differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_hash
from .graph import affected
from .lookup import is_stub


def missing(functions: DataFrame, summaries: DataFrame) -> DataFrame:
    """(id): functions with source but no summary."""
    return functions.filter(~is_stub(F.col("source"))).select("id").join(summaries.select(F.col("function_id").alias("id")), "id", "left_anti")


def stale(functions: DataFrame, edges: DataFrame, summaries: DataFrame, upstream: list[DataFrame] | None = None) -> DataFrame:
    """(id): callers with source whose summary is older than a callee's; equal times aren't stale.

    upstream: further tables whose callee rows count. A callee's newest row decides, so all
    tables fold into one maximum per callee before the join.
    """
    newest = summaries.select("function_id", "updated_at")
    for t in upstream or []:
        newest = newest.unionByName(t.select("function_id", "updated_at"))
    newest = newest.groupBy(F.col("function_id").alias("callee_id")).agg(F.max("updated_at").alias("newest"))
    of_callee = edges.select("caller_id", "callee_id").join(newest, "callee_id").groupBy("caller_id").agg(F.max("newest").alias("newest"))
    own = summaries.select(F.col("function_id").alias("caller_id"), "updated_at")
    late = of_callee.join(own, "caller_id").filter("newest > updated_at").select(F.col("caller_id").alias("id"))
    return late.join(functions.filter(~is_stub(F.col("source"))).select("id"), "id", "left_semi").distinct()


def dirty(functions: DataFrame, edges: DataFrame, summaries: DataFrame, upstream: list[DataFrame] | None = None) -> DataFrame:
    """(id): missing or stale."""
    return missing(functions, summaries).union(stale(functions, edges, summaries, upstream)).distinct()


def dirty_by_pass(functions: DataFrame, edges: DataFrame, passes: dict[str, DataFrame], upstream: dict[str, list[DataFrame]] | None = None) -> DataFrame:
    """(pass, id)."""
    out = None
    for name, df in passes.items():
        one = dirty(functions, edges, df, (upstream or {}).get(name)).select(F.lit(name).alias("pass"), "id")
        out = one if out is None else out.union(one)
    return out


def to_do(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): dirty functions and all that depend on them."""
    return affected(seeds, edges)


def needs_update(wanted: DataFrame, functions: DataFrame, summaries: DataFrame) -> DataFrame:
    """wanted (name, signature, file_path, source) with needs_update: unknown, without summary, or of another hash."""
    f = functions.select("name", "signature", "file_path", F.col("id").alias("_id"), F.col("source_hash").alias("_hash"))
    s = summaries.select(F.col("function_id").alias("_id"), F.lit(True).alias("_has")).distinct()
    met = wanted.join(f, ["name", "signature", "file_path"], "left").join(s, "_id", "left")
    return met.withColumn("needs_update", F.col("_id").isNull() | F.col("_has").isNull() | ~F.col("_hash").eqNullSafe(source_hash(F.col("source")))).drop("_id", "_hash", "_has")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, signature, change): added, removed, changed or same, by source hash."""
    a = old.select("name", "signature", F.coalesce(source_hash(F.col("source")), F.lit("")).alias("a"))
    b = new.select("name", "signature", F.coalesce(source_hash(F.col("source")), F.lit("")).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, ["name", "signature"], "full_outer").select("name", "signature", change.alias("change"))


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: changed and unchanged functions among those that had a hash."""
    a = before.filter("source_hash is not null").select("id", F.col("source_hash").alias("a"))
    b = after.select("id", F.col("source_hash").alias("b"))
    met = a.join(b, "id").withColumn("changed", ~F.col("a").eqNullSafe(F.col("b")))
    return met.agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"))


def invalidate(summaries: DataFrame, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """summaries without those of the seeds and of everything that calls them."""
    gone = affected(seeds, edges)
    return summaries.join(gone.withColumnRenamed("id", "function_id"), "function_id", "left_anti")


def cached(functions: DataFrame, cache: DataFrame, summaries: DataFrame) -> DataFrame:
    """Cache rows for functions of the same name and source hash that have no summary yet. cache: (name, source_hash, summary_json)."""
    met = functions.select(F.col("id").alias("function_id"), "name", "source_hash").join(cache, ["name", "source_hash"])
    return met.join(summaries.select("function_id"), "function_id", "left_anti").select("function_id", "summary_json")


def cache_of(functions: DataFrame, passes: dict[str, DataFrame]) -> DataFrame:
    """(name, source_hash, payloads): JSON by pass."""
    out = None
    for name, df in passes.items():
        one = df.select("function_id", F.lit(name).alias("pass"), "summary_json")
        out = one if out is None else out.union(one)
    f = functions.filter("source_hash is not null").select(F.col("id").alias("function_id"), "name", "source_hash")
    rows = out.join(f, "function_id").groupBy("name", "source_hash", "pass").agg(F.max("summary_json").alias("summary_json"))
    return rows.groupBy("name", "source_hash").agg(F.map_from_entries(F.collect_list(F.struct("pass", "summary_json"))).alias("payloads"))
