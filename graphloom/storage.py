"""Intermediate tables in the shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, in folders by some columns, gone when the application ends; and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, *by: str) -> DataFrame:
    return stored(df, by)[0]


class Rounds:
    """A table that a loop adds to: each round's rows are written once, and read together."""

    def __init__(self) -> None:
        self.schema, self.paths = None, []

    def add(self, df: DataFrame) -> DataFrame:
        """The new rows, as written."""
        table, path = stored(df)
        self.spark, self.schema = df.sparkSession, self.schema or df.schema
        self.paths.append(path)
        return table

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
