"""Joined listings: call graph, indirect calls, containers, issues with their reviews, callee sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import issue_fingerprint


def call_graph(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges with both names; an edge with an unknown end drops out."""
    a = functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    b = functions.select(F.col("id").alias("callee_id"), F.col("name").alias("callee"))
    return edges.join(a, "caller_id").join(b, "callee_id")


def with_function(summaries: DataFrame, functions: DataFrame, how: str = "inner") -> DataFrame:
    f = functions.select(F.col("id").alias("function_id"), "name", "signature", "file_path")
    return summaries.join(f, "function_id", how)


def named_or_id(df: DataFrame, functions: DataFrame, key: str) -> DataFrame:
    """df with name; `ID:<key>` where the function is unknown."""
    f = functions.select(F.col("id").alias(key), "name")
    return df.join(f, key, "left").withColumn("name", F.coalesce("name", F.concat(F.lit("ID:"), F.col(key).cast("string"))))


def indirect_calls(callsites: DataFrame, targets: DataFrame, functions: DataFrame) -> DataFrame:
    """Callsites with their targets; those without any stay."""
    own = named_or_id(callsites.withColumnRenamed("id", "callsite_id"), functions, "caller_function_id").withColumnRenamed("name", "caller")
    t = named_or_id(targets, functions, "target_function_id").withColumnRenamed("name", "target")
    return own.join(t, "callsite_id", "left")


def issues(payloads: DataFrame) -> DataFrame:
    """(function_id, issue_index, issue fields, fingerprint) from (function_id, issues)."""
    rows = payloads.select("function_id", F.posexplode("issues").alias("issue_index", "i")).select("function_id", "issue_index", "i.*")
    return rows.withColumn("fingerprint", issue_fingerprint(F.col("issue_kind"), F.col("location"), F.col("description")))


def reviewed(issues: DataFrame, reviews: DataFrame, default: str = "pending") -> DataFrame:
    """Issues with their status and reason, by function and fingerprint."""
    r = reviews.select("function_id", F.col("issue_fingerprint").alias("fingerprint"), "status", "reason")
    return issues.join(r, ["function_id", "fingerprint"], "left").withColumn("status", F.coalesce("status", F.lit(default)))


def open_counts(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """(function_id, n): issues without a final review."""
    final = reviews.filter("status <> 'pending'").select("function_id", F.col("issue_fingerprint").alias("fingerprint"))
    return issues.join(final, ["function_id", "fingerprint"], "left_anti").groupBy("function_id").agg(F.count(F.lit(1)).alias("n"))


def review_map(reviews: DataFrame) -> DataFrame:
    """One row per function: its reviews by fingerprint."""
    return reviews.groupBy("function_id").agg(F.map_from_entries(F.collect_list(F.struct("issue_fingerprint", F.struct("status", "reason")))).alias("reviews"))


def callee_list(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_id, callee): names, marked where any edge between the two is indirect."""
    pairs = edges.groupBy("caller_id", "callee_id").agg(F.max(F.coalesce("is_indirect", F.lit(False))).alias("indirect"))
    f = functions.select(F.col("id").alias("callee_id"), "name")
    return pairs.join(f, "callee_id").select("caller_id", "callee_id", F.concat("name", F.when(F.col("indirect"), F.lit(" [indirect]")).otherwise(F.lit(""))).alias("callee"))


def caller_list(edges: DataFrame, functions: DataFrame, chars: int = 8000) -> DataFrame:
    """(callee_id, caller_id, name, source, truncated): callers with their sources cut to chars."""
    f = functions.select(F.col("id").alias("caller_id"), "name", F.substring("source", 1, chars).alias("source"), (F.length("source") > chars).alias("truncated"))
    return edges.select("callee_id", "caller_id").distinct().join(f, "caller_id")


def callee_sections(edges: DataFrame, texts: list[DataFrame], functions: DataFrame) -> DataFrame:
    """(caller_id, section): per caller one line per callee, by name, from the first of texts that has it.

    texts: (function_id, text), best first. Callees without a text are left out.
    """
    rows = edges.select("caller_id", F.col("callee_id").alias("function_id")).distinct()
    rows = rows.join(functions.select(F.col("id").alias("function_id"), "name"), "function_id")
    for i, t in enumerate(texts):
        rows = rows.join(t.select("function_id", F.col("text").alias(f"_t{i}")), "function_id", "left")
    rows = rows.withColumn("text", F.coalesce(*(F.col(f"_t{i}") for i in range(len(texts))))).filter("text is not null")
    line = F.concat(F.lit("- "), "name", F.lit(": "), "text")
    return rows.groupBy("caller_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "function_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("section"))


def type_definitions(words: DataFrame, typedefs: DataFrame) -> DataFrame:
    """(id, name, definition): types named in a source; the same file's before the shortest other.

    words: (id, file_path, name).
    """
    t = typedefs.filter("definition is not null").select("name", "definition", F.col("file_path").alias("from"))
    met = words.join(t, "name")
    best = F.min_by("definition", F.struct((F.col("file_path") != F.col("from")).alias("other"), F.length("definition").alias("n"), "definition"))
    return met.groupBy("id", "name").agg(best.alias("definition"))


def top(df: DataFrame, by: str, k: int, tie: str, group: str | None = None) -> DataFrame:
    """The k best rows by descending value, ties by key; per group if given."""
    if group is None:
        return df.orderBy(F.col(by).desc(), tie).limit(k)
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), tie)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def capped(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows, with truncated: whether there were more."""
    some = df.orderBy(*order).limit(n + 1).withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    return some.withColumn("truncated", F.max((F.col("_r") > n).cast("int")).over(Window.partitionBy()) == 1).filter(F.col("_r") <= n).drop("_r")
