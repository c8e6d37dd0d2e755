"""Filters and point lookups over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal the given values; a None is no condition. One conjunction, pushed down."""
    tests = [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def by_id(functions: DataFrame, function_id: int) -> DataFrame:
    return functions.filter(F.col("id") == function_id)


def by_name(functions: DataFrame, name: str, signature: str | None = None) -> DataFrame:
    return where(functions, name=name, signature=signature)


def by_file(functions: DataFrame, file_path: str) -> DataFrame:
    return where(functions, file_path=file_path)


def first_id_by_name(functions: DataFrame, name: str) -> DataFrame:
    """The smallest id with this name; no row without one."""
    return by_name(functions, name).agg(F.min("id").alias("id")).filter("id is not null")


def first_by_name(df: DataFrame) -> DataFrame:
    """Of rows with the same name, the one with the smallest id."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter("_n = 1").drop("_n")


def with_names(df: DataFrame, names: DataFrame, defined_only: bool = False) -> DataFrame:
    """Rows whose name is in names; optionally those with a definition only."""
    found = df.join(names.select("name").distinct(), "name", "left_semi")
    return found.filter(F.col("definition").isNotNull()) if defined_only else found


def variables_of_file(typedefs: DataFrame, file_path: str) -> DataFrame:
    return typedefs.filter((F.col("file_path") == file_path) & F.col("kind").isin("static_var", "global_var") & F.col("definition").isNotNull())


def unique_by_name(functions: DataFrame) -> DataFrame:
    """Functions whose name no other has."""
    counts = functions.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    return functions.join(counts.select("name"), "name", "left_semi")


def by_name_and_suffix(functions: DataFrame, name: str, suffix: str) -> DataFrame:
    """The one function of this name whose path ends so, exactly; none if several do."""
    found = functions.filter((F.col("name") == name) & F.col("file_path").endswith(suffix))
    return found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("_n = 1").drop("_n")


def callees(edges: DataFrame, caller_id: int) -> DataFrame:
    return edges.filter(F.col("caller_id") == caller_id).select("callee_id").distinct()


def callers(edges: DataFrame, callee_id: int) -> DataFrame:
    return edges.filter(F.col("callee_id") == callee_id).select("caller_id").distinct()


def present(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """keys with `present`: whether df has a row of that key."""
    flags = df.select(key).distinct().withColumn("_p", F.lit(True))
    return keys.join(flags, key, "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def page(functions: DataFrame, summaries: DataFrame, name: str | None = None, file: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Functions by id that match, cut to the page first; then those without a summary go."""
    found = functions
    if name:
        found = found.filter(F.col("name").contains(name))
    if file:
        found = found.filter(F.col("file_path").contains(file))
    return found.orderBy("id").offset(offset).limit(limit).join(summaries, F.col("id") == F.col("function_id"), "left_semi")


def is_stub(source: Column) -> Column:
    """A function without source: null or empty."""
    return F.coalesce(source, F.lit("")) == ""


def pointer_typedefs(typedefs: DataFrame) -> DataFrame:
    return typedefs.filter(F.col("underlying_type").contains("*")).select("name").distinct()


def scalar_typedefs(typedefs: DataFrame, scalars: tuple[str, ...]) -> DataFrame:
    bare = F.regexp_replace("underlying_type", "^const ", "")
    return typedefs.filter(~F.col("underlying_type").contains("*") & bare.isin(*scalars)).select("name", bare.alias("underlying_type")).distinct()


def starts_with_any(path: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: path.startswith(p))


def task_functions(functions: DataFrame, boilerplate: DataFrame, variant: str) -> DataFrame:
    """Functions under test: no main, no boilerplate, no numbered helpers; by the variant's name mark."""
    name = F.col("name")
    marked = name.endswith(f"_{variant}") | name.startswith(variant)
    plain = functions.filter((name != "main") & ~name.rlike("^(bad|good)[0-9]+$") & marked)
    return plain.join(boilerplate.select("name"), "name", "left_anti")
