"""Alias context: functions whose values may alias those of a query, ranked.

entries: (name, kind, class), from named nodes and their classes; rows: (class, other), the relation.
Kinds: 2 global, 3 argument `f::arg#i`, 6 return `ret:f`, 7 varargs `f::vararg`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GLOBAL, ARGUMENT, RETURN, VARARG = 2, 3, 6, 7
# Parts of names that make, or set up, objects.
PROVIDERS = ("alloc", "create", "init", "new", "open", "setup")
SCORED = ("alloc", "create", "init", "new", "setup")
# End of fixed values.


def function_of(name: Column, kind: Column) -> Column:
    """The function that an entry belongs to; null for globals."""
    return F.when(kind.isin(ARGUMENT, VARARG), F.substring_index(name, "::", 1)).when(kind == RETURN, F.regexp_replace(name, "^[^:]*:", ""))


def heap_classes(entries: DataFrame, allocators: DataFrame, deallocators: DataFrame) -> DataFrame:
    """(class): returns of allocators and first arguments of deallocators; they alias with everything."""
    f = entries.withColumn("function", function_of(F.col("name"), F.col("kind")))
    made = f.filter(F.col("kind") == RETURN).join(allocators.select(F.col("name").alias("function")), "function", "left_semi")
    freed = f.filter((F.col("kind") == ARGUMENT) & F.col("name").endswith("::arg#0")).join(deallocators.select(F.col("name").alias("function")), "function", "left_semi")
    return made.select("class").union(freed.select("class")).distinct()


def group(query: DataFrame, entries: DataFrame, rows: DataFrame, heap: DataFrame) -> DataFrame:
    """(query, name, kind, function): entries that may alias one of the query's functions. query: (query, name)."""
    f = entries.withColumn("function", function_of(F.col("name"), F.col("kind")))
    own = query.select("query", F.col("name").alias("function")).join(f.select("function", "class"), "function").select("query", "class").distinct().join(heap, "class", "left_anti")
    near = own.join(rows, "class").select("query", F.col("other").alias("class")).union(own.select("query", "class")).distinct()
    return near.join(f, "class").select("query", "name", "kind", "function").distinct()


def aliased_parameters(group: DataFrame, functions: DataFrame) -> DataFrame:
    """(query, name, params): names of the parameters that take part; indices out of range are left out."""
    at = F.regexp_extract("name", r"#([0-9]+)$", 1)
    args = group.filter((F.col("kind") == ARGUMENT) & (at != "")).select("query", "function", at.cast("int").alias("i"))
    met = args.join(functions.select(F.col("name").alias("function"), "params"), "function").withColumn("p", F.get("params", F.col("i"))).filter("p is not null")
    return met.groupBy("query", F.col("function").alias("name")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"])).alias("params"))


def is_provider(name: Column, source: Column) -> Column:
    """Named like one that makes objects, or with a store to a field."""
    body = F.coalesce(source, F.lit(""))
    return F.rlike(F.lower(name), F.lit("|".join(PROVIDERS))) | (body.contains("->") & body.contains("="))


def relevance(query: DataFrame, candidates: DataFrame, entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, name, score): 1 for each (query function, class of it) that a class of the candidate may alias;
    0.5 for a maker's name, 0.3 for three first letters in common with a query function. 0 without classes.

    query: (query, name); candidates: (query, name).
    """
    f = entries.select(function_of(F.col("name"), F.col("kind")).alias("name"), "class").filter("name is not null").distinct()
    q = query.join(f, "name").select("query", F.col("name").alias("q"), F.col("class").alias("qc"))
    c = candidates.join(f, "name").select("query", "name", "class")
    r = rows.select(F.col("class").alias("qc"), F.col("other").alias("class")).distinct()
    hits = q.join(r, "qc").join(c, ["query", "class"]).groupBy("query", "name").agg(F.countDistinct("q", "qc").cast("double").alias("s"))
    prefixed = query.select("query", F.substring("name", 1, 3).alias("p")).filter(F.length("p") == 3).distinct().withColumn("_p", F.lit(0.3))
    known = c.select("query", "name").distinct().withColumn("_k", F.lit(True))
    out = candidates.join(known, ["query", "name"], "left").join(hits, ["query", "name"], "left").withColumn("p", F.substring("name", 1, 3)).join(prefixed, ["query", "p"], "left")
    score = F.coalesce("s", F.lit(0.0)) + F.when(F.rlike(F.lower("name"), F.lit("|".join(SCORED))), 0.5).otherwise(0.0) + F.coalesce("_p", F.lit(0.0))
    return out.select("query", "name", F.when(F.col("_k"), score).otherwise(0.0).alias("score"))


def providers(query: DataFrame, group: DataFrame, functions: DataFrame, entries: DataFrame, rows: DataFrame, k: int = 3) -> DataFrame:
    """(query, rank, name, score): the k best providers of context that aren't the query's own; ties by name."""
    own = query.select("query", "name")
    named = group.filter("function is not null").select("query", F.col("function").alias("name")).distinct().join(own, ["query", "name"], "left_anti")
    some = named.join(functions.filter(is_provider(F.col("name"), F.col("source"))).select("name").distinct(), "name", "left_semi").select("query", "name")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "name")
    return relevance(query, some, entries, rows).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "name", "score")
