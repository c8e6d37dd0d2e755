"""What the operators share: reading, written intermediate tables, sizes, joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a broadcast table that lists hot keys; a key is hot from 1/HOT of all rows on.
HOT = 10_000
WORD = r"[^\x20\x09-\x0D]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that it's computed once and outlives executors.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, results: tuple[str, ...], *inputs: str) -> DataFrame:
    """df without columns named like results, whatever their case, which give way to them; inputs must be none of these."""
    taken = {c.lower() for c in results}
    for c in inputs:
        if c.lower() in taken:
            raise ValueError(f"the input column {c} has the name of a result")
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in taken))


def stored_bytes(df: DataFrame, text: str) -> int:
    """About how many bytes of text df has: the plan's statistics, or a sum where they are unknown."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return 2 * known  # files are compressed
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def power_of_two(n: float, least: int, most: int) -> int:
    """The exponent of the smallest power of two from n on, within bounds."""
    return max(least, min(most, int(max(1, n) - 1).bit_length()))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def join_on_hot_keys(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join on key; right has one row per key, and in weight how many rows of left have it.

    Keys that hold 1/HOT of the rows or more are at most HOT in number; they are broadcast, so their
    rows stay where they are. The other keys go through a shuffle that no single key can unbalance.
    left is read twice: it should be a written table.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) >= max(1000, total // HOT))
    cold = right.filter(F.col(weight) < max(1000, total // HOT))
    keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(keys, key, "left_anti").join(cold, key))
