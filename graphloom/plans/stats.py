"""Counts: per table, per pass, per type, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.union(one)
    return out


def by_value(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(column, n); the k largest, ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), column).limit(k) if k else counts


def grouped(df: DataFrame, column: str, value: str) -> DataFrame:
    """(column, n, values): sorted distinct values of each group."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(value)).alias("values"))


def of_pass(payloads: DataFrame, array: str, high: str | None = None) -> DataFrame:
    """One row: functions, those whose array isn't empty, its items, and items of high severity."""
    size = F.coalesce(F.size(array), F.lit(0))
    items = [F.count(F.lit(1)).alias("functions"), F.count_if(size > 0).alias("with_any"), F.coalesce(F.sum(size), F.lit(0)).alias("items")]
    if high:
        items.append(F.coalesce(F.sum(F.size(F.filter(array, lambda i: i[high] == "high"))), F.lit(0)).alias("high"))
    return payloads.agg(*items)


def tiers(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(tier, n): rows by the first rule (name, SQL condition) that holds, else `other`."""
    tier = F.lit("other")
    for name, test in reversed(rules):
        tier = F.when(F.expr(test), F.lit(name)).otherwise(tier)
    return df.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))
