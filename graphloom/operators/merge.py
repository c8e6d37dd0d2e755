"""Data changes as new DataFrames: upsert, ignore, replace, update, delete with cascade.

Plain Parquet has no MERGE. Each function gives the table's next version; Store writes versions side by
side and moves a pointer, so no path is overwritten while it's read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CHILDREN
from ..storage import written
from .lookup import is_stub


def _on(keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return test


def last_of(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the last by order (or any, if the rows are alike)."""
    if order is None:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows in place of those with the same key; null keys are equal.

    keep: columns that stay as they were where the row existed (ids, creation times).
    fill: columns that take new's value only where it isn't null.
    """
    both = old.alias("o").withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), _on(keys), "full_outer")
    is_new, was = F.col("n._n").isNotNull(), F.col("o._o").isNotNull()
    out = []
    for c in old.columns:
        if c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            out.append(F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c in fill:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old wins; of new rows with one key, one comes in. A null in a key makes rows distinct."""
    fresh = new.alias("n").join(old.alias("o"), [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys], "left_anti")
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    return old.unionByName(fresh.filter(~some_null).dropDuplicates(keys)).unionByName(fresh.filter(some_null))


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new wins, whole rows."""
    kept = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "left_anti")
    return kept.unionByName(new)


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of rows whose key is in changes (one row per key)."""
    c = changes.select(key, F.lit(True).alias("_c"), *(F.col(x).alias(f"_{x}") for x in columns))
    met = df.join(c, key, "left")
    return met.select(*(F.when(F.col("_c"), F.col(f"_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in df.columns))


def delete(df: DataFrame, keys: DataFrame, column: str, key: str = "id") -> DataFrame:
    return df.join(keys.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' places in an order, from 0. They come from counts of sorted partitions, not from one task that sorts all."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    rows = written(rows.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")  # a row for each partition


def assign_ids(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Ids after the largest existing one, in an order."""
    top = existing.agg(F.max("id")).first()[0] or 0
    return numbered(new, order, "id").withColumn("id", F.col("id") + top + 1)


def stubs(calls: DataFrame) -> DataFrame:
    """Functions known by name only: empty source, signature name(...)."""
    return calls.select("name", F.concat("name", F.lit("(...)")).alias("signature"), "file_path", "line_start", "line_end", F.lit("").alias("source"), "linkage", "attributes")


def update_decl_headers(functions: DataFrame, headers: DataFrame) -> DataFrame:
    """decl_header of functions without source, by name. headers: (name, header), one row per name."""
    met = functions.join(headers.withColumnRenamed("header", "_h"), "name", "left")
    return met.withColumn("decl_header", F.when(is_stub(F.col("source")) & F.col("_h").isNotNull(), F.col("_h")).otherwise(F.col("decl_header"))).select(*functions.columns)


def touch(summaries: DataFrame, functions: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """updated_at of summaries of stubs that something calls."""
    called = functions.filter(is_stub(F.col("source"))).join(edges.select(F.col("callee_id").alias("id")).distinct(), "id", "left_semi")
    flags = called.select(F.col("id").alias("function_id"), F.lit(True).alias("_t"))
    return summaries.join(flags, "function_id", "left").withColumn("updated_at", F.when(F.col("_t"), now).otherwise(F.col("updated_at"))).select(*summaries.columns)


def delete_functions(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Functions and all their children, edges included. ids: (id)."""
    out = dict(tables)
    out["functions"] = delete(tables["functions"], ids, "id")
    for name, column in CHILDREN.items():
        if name in tables:
            out[name] = delete(tables[name], ids, column)
    if "call_edges" in tables:
        out["call_edges"] = delete(delete(tables["call_edges"], ids, "caller_id"), ids, "callee_id")
    return out


def clear_stubs(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return delete_functions(tables, tables["functions"].filter(is_stub(F.col("source"))).select("id"))


def clear(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df.limit(0) for name, df in tables.items()}


class Store:
    """Versioned Parquet tables: <root>/<table>/v=<n>, with the current version in <root>/<table>/CURRENT."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, table: str) -> int:
        at = self._path(f"{self.root}/{table}/CURRENT")
        if not self._fs.exists(at):
            return 0
        return int(self.spark.read.text(str(at.toString())).first()[0])

    def read(self, table: str, schema: str) -> DataFrame:
        n = self.version(table)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v={n}") if n else self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame) -> int:
        """df as the next version; readers of the old one aren't disturbed."""
        n = self.version(table) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v={n}")
        out = self._fs.create(self._path(f"{self.root}/{table}/CURRENT"), True)
        out.write(bytearray(str(n).encode()))
        out.close()
        return n
