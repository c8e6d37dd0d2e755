"""A table format with commits, as a data source: spark.read / df.write .format("fact_table").

A table is a folder of Parquet files and of manifests, one for each version, that list the version's files. A write's tasks
put one file each under a name of their own; only the commit on the driver, after all tasks are done, writes the next manifest. A
write that fails, or a task that runs twice, leaves files that no manifest names, and the version before. Readers see one
version: the latest when they plan, or option `version`. Two writers that commit at once: the second fails, as a manifest is never
overwritten. Reading splits files by row groups, and skips those whose statistics lie outside option `between`. Readers take no filters
from Spark: it keeps one reader for all queries over a DataFrame, so one query's filter would take rows from another.

Files are opened by pyarrow's file systems, so a path can be local, or a URI that these know (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

ROW_GROUP = 1 << 17


def _at(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):  # as Spark names local files: not encoded
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _manifest(path: str, version: int | None = None) -> dict:
    """The manifest of a version, by default the latest; version 0 is the empty table."""
    from pyarrow import fs

    system, root = _at(path)
    found = [int(i.base_name.split(".")[0]) for i in system.get_file_info(fs.FileSelector(f"{root}/_versions", allow_not_found=True)) if i.base_name.endswith(".json")]
    if version is None:
        version = max(found, default=0)
    if version == 0:
        return {"version": 0, "schema": None, "files": []}
    if version not in found:
        raise ValueError(f"{path} has no version {version}")
    with system.open_input_stream(f"{root}/_versions/{version}.json") as f:
        return json.loads(f.read())


@dataclass
class _Part(InputPartition):
    file: str
    group: int

    def __init__(self, file: str, group: int) -> None:
        self.file, self.group = file, group


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, version: int | None, between: dict | None = None) -> None:
        self.path, self.schema, self.version, self.between = path, schema, version, between or {}

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq

        system, root = _at(self.path)
        out = []
        for name in _manifest(self.path, self.version)["files"]:
            with pq.ParquetFile(system.open_input_file(f"{root}/{name}")) as f:
                out += [_Part(name, g) for g in range(f.num_row_groups) if self._may_hold(f.metadata.row_group(g))]
        return out

    def _may_hold(self, group) -> bool:
        found = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for name, (low, high) in self.between.items():
            s = found.get(name)
            if s is None or not s.has_min_max:
                continue
            if low is not None and type(s.max) is type(low) and s.max < low or high is not None and type(s.min) is type(high) and s.min > high:
                return False
        return True

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition is None or partition.file is None:
            return
        system, root = _at(self.path)
        with pq.ParquetFile(system.open_input_file(f"{root}/{partition.file}")) as f:
            yield from f.iter_batches(row_groups=[partition.group], columns=self.schema.names)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.before = _manifest(path)
        if not overwrite and self.before["schema"] and StructType.fromJson(self.before["schema"]).simpleString() != schema.simpleString():
            raise ValueError("the rows' schema is not the table's")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        system, root = _at(self.path)
        name, writer, n = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if writer is None:
                system.create_dir(root, recursive=True)
                writer = pq.ParquetWriter(system.open_output_stream(f"{root}/{name}"), batch.schema)
            writer.write_batch(batch, row_group_size=ROW_GROUP)
            n += batch.num_rows
        if writer is not None:
            writer.close()
        return _Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, root = _at(self.path)
        system.create_dir(f"{root}/_versions", recursive=True)
        files = sorted(m.file for m in messages if m is not None and m.rows)
        after = {"version": self.before["version"] + 1, "schema": self.schema.jsonValue(), "files": files if self.overwrite else self.before["files"] + files}
        at = f"{root}/_versions/{after['version']}.json"
        if system.get_file_info(at).type != fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"version {after['version']} was committed meanwhile")
        part = f"{root}/_versions/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(after).encode())
        system.move(part, at)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _at(self.path)
        for m in messages:
            if m is not None and m.rows:
                system.delete_file(f"{root}/{m.file}")


class FactTable(DataSource):
    """Options: path; version to read; between, JSON of {column: [low or null, high or null]}, skips row groups that hold no such row."""

    @classmethod
    def name(cls) -> str:
        return "fact_table"

    def _version(self) -> int | None:
        v = self.options.get("version")
        return None if v is None else int(v)

    def schema(self) -> StructType:
        found = _manifest(self.options["path"], self._version())["schema"]
        if found is None:
            raise ValueError(f"{self.options['path']} has no version yet: give a schema")
        return StructType.fromJson(found)

    def reader(self, schema: StructType) -> DataSourceReader:
        version = self._version()
        return _Reader(self.options["path"], schema, _manifest(self.options["path"])["version"] if version is None else version, json.loads(self.options.get("between", "{}")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FactTable)


class Table:
    """A table of this format, with changes by key; each change is one commit."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        register(spark)
        self.spark, self.path, self.ddl = spark, path, schema

    def version(self) -> int:
        return _manifest(self.path)["version"]

    def read(self, version: int | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
        """The rows of a version, by default the latest; between: only those whose columns lie in ranges (low, high), None for open."""
        r = self.spark.read.format("fact_table").schema(self.ddl).option("between", json.dumps(between or {}))
        rows = (r if version is None else r.option("version", version)).load(self.path)
        for name, (low, high) in (between or {}).items():
            for bound, test in ((low, F.col(name) >= F.lit(low)), (high, F.col(name) <= F.lit(high))):
                rows = rows if bound is None else rows.filter(test)
        return rows

    def append(self, rows: DataFrame) -> None:
        self._shaped(rows).write.format("fact_table").mode("append").save(self.path)

    def replace(self, rows: DataFrame) -> None:
        self._shaped(rows).write.format("fact_table").mode("overwrite").save(self.path)

    def upsert(self, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> None:
        from ..operators import merge

        self.replace(merge.upsert(self.read(), rows, keys, keep, fill))

    def delete(self, keys: DataFrame, column: str, key: str = "id") -> None:
        from ..operators import merge

        self.replace(merge.delete(self.read(), keys, column, key))

    def _shaped(self, rows: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], self.ddl).schema
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))
