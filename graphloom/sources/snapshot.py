"""Alias snapshots: a binary file with an equivalence of nodes, a relation of classes, and named nodes.

Layout: 8 bytes of magic; version, flags, label, reserved (4 bytes each); node, class and metadata sizes
(8 each); metadata JSON; then variable-length integers: the class of each node, the node of each class, each
class's row (its size, first value, differences), and named entries (node, kind byte, name). Reading
checks all bounds.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .table import _at

# Fixed values of the file format.
MAGIC = b"KAVSNAP1"
VERSION = 1


class _Cursor:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def number(self, below: int | None = None) -> int:
        value = shift = 0
        while True:
            if self.at >= len(self.data):
                raise ValueError("the snapshot ends inside a number")
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                break
            shift += 7
            if shift > 63:
                raise ValueError("a number has too many bytes")
        if below is not None and value >= below:
            raise ValueError("a number is out of range")
        return value

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the snapshot ends inside a text")
        self.at += n
        return self.data[self.at - n : self.at]


def parse(data: bytes, magic: bytes = MAGIC, version: int = VERSION) -> Iterator[tuple[str, int, int, int | None, str | None]]:
    """Rows (what, a, b, kind, name): `class` (node, class), `row` (class, class), `name` (node)."""
    if len(data) < 48 or data[:8] != magic:
        raise ValueError("not a snapshot")
    found, _, _, _, nodes, classes, meta = struct.unpack_from("<4I3Q", data, 8)
    if found != version:
        raise ValueError(f"version {found} is not supported")
    c = _Cursor(data, 48)
    extra = c.take(meta)
    if extra:
        json.loads(extra)
    for node in range(nodes):
        yield "class", node, c.number(classes), None, None
    for _ in range(classes):
        c.number(nodes)
    for k in range(classes):
        at = 0
        for _ in range(c.number()):
            at += c.number()
            if at >= classes:
                raise ValueError("a class is out of range")
            yield "row", k, at, None, None
    if c.at < len(data):
        for _ in range(c.number()):
            node, kind = c.number(), c.take(1)[0]
            yield "name", node, 0, kind, c.take(c.number()).decode()
    if c.at != len(data):
        raise ValueError("bytes are left over")


def write(nodes: list[int], rows: list[list[int]], names: list[tuple[int, int, str]]) -> bytes:
    """A snapshot's bytes, for fixtures."""

    def number(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
        return bytes(out)

    out = MAGIC + struct.pack("<4I3Q", VERSION, 0, 0, 0, len(nodes), len(rows), 0)
    out += b"".join(map(number, nodes)) + b"".join(number(nodes.index(k)) for k in range(len(rows)))
    for row in rows:
        out += number(len(row)) + b"".join(number(b - a) for a, b in zip([0, *row], row, strict=False))
    out += number(len(names))
    for node, kind, name in names:
        out += number(node) + bytes([kind]) + number(len(name.encode())) + name.encode()
    return out


#: The relations of a snapshot, as parse names them, and their columns.
RELATIONS = {
    "class": "path string, node long, class long",
    "row": "path string, class long, other long",
    "name": "path string, node long, kind int, name string",
}
_BATCH = 1 << 16


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, relation: str, magic: bytes, version: int, schema: StructType) -> None:
        self.path, self.relation, self.magic, self.version, self.schema = path, relation, magic, version, schema

    def partitions(self) -> list[InputPartition]:
        """One partition for each file: the path itself, or all .vsnap files of a folder and its folders."""
        from pyarrow import fs

        system, root = _at(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} is not there")
        found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.base_name.endswith(".vsnap")]
        paths = sorted(self.path.removesuffix(root) + i.path for i in found)
        return [_File(p) for p in paths] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, name = _at(partition.path)
        with system.open_input_file(name) as f:
            data = f.read()
        columns = self.schema.names[1:]
        types = to_arrow_schema(self.schema)
        place = {"class": (1, 2), "row": (1, 2), "name": (1, 3, 4)}[self.relation]
        buffer: list[tuple] = []

        def batch() -> pa.RecordBatch:
            values = [pa.array([partition.path] * len(buffer), types.field(0).type)]
            values += [pa.array([row[i] for row in buffer], types.field(c).type) for i, c in zip(place, columns, strict=True)]
            return pa.RecordBatch.from_arrays(values, schema=types)

        for row in parse(data, self.magic, self.version):
            if row[0] == self.relation:
                buffer.append(row)
                if len(buffer) == _BATCH:
                    yield batch()
                    buffer = []
        if buffer:
            yield batch()


class AliasSnapshot(DataSource):
    """spark.read.format("alias_snapshot"). Options: path (a file or a folder), relation (class, row, name), magic, version."""

    @classmethod
    def name(cls) -> str:
        return "alias_snapshot"

    def _relation(self) -> str:
        relation = self.options.get("relation", "class")
        if relation not in RELATIONS:
            raise ValueError(f"relation is one of {', '.join(RELATIONS)}")
        return relation

    def schema(self) -> str:
        return RELATIONS[self._relation()]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._relation(), self.options.get("magic", MAGIC.decode()).encode(), int(self.options.get("version", VERSION)), schema)


def read(spark: SparkSession, path: str, magic: bytes = MAGIC, version: int = VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node_class: node, class), (class_rows: class, other), (named: node, kind, name) of all files, each with path.

    Each relation is a scan of its own, so a query that needs one builds rows of one alone. Every scan checks the whole file. Nodes and classes are
    numbered inside their file: join on path too where there are several.
    """
    spark.dataSource.register(AliasSnapshot)
    r = lambda relation: spark.read.format("alias_snapshot").option("relation", relation).option("magic", magic.decode()).option("version", version).load(path)
    return r("class"), r("row"), r("name")


def may_alias(pairs: DataFrame, node_class: DataFrame, class_rows: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes with may_alias: the row of a's class has b's."""
    x = node_class.select(F.col("node").alias("a"), F.col("class").alias("_x"))
    y = node_class.select(F.col("node").alias("b"), F.col("class").alias("_y"))
    r = class_rows.select(F.col("class").alias("_x"), F.col("other").alias("_y"), F.lit(True).alias("_m")).distinct()
    return pairs.join(x, "a", "left").join(y, "b", "left").join(r, ["_x", "_y"], "left").select("a", "b", F.coalesce("_m", F.lit(False)).alias("may_alias"))


def names_alias(names: DataFrame, named: DataFrame, node_class: DataFrame, class_rows: DataFrame) -> DataFrame:
    """names (x, y) with may_alias: any node of x may alias any node of y."""
    a = named.select(F.col("name").alias("x"), F.col("node").alias("a"))
    b = named.select(F.col("name").alias("y"), F.col("node").alias("b"))
    pairs = names.join(a, "x").join(b, "y")
    hits = may_alias(pairs.select("a", "b").distinct(), node_class, class_rows).filter("may_alias")
    found = pairs.join(hits, ["a", "b"], "left_semi").select("x", "y").distinct().withColumn("may_alias", F.lit(True))
    return names.join(found, ["x", "y"], "left").select("x", "y", F.coalesce("may_alias", F.lit(False)).alias("may_alias"))


def name_relation(named: DataFrame, node_class: DataFrame, class_rows: DataFrame) -> DataFrame:
    """(a, b): names whose classes are in relation; input for operators.graph.confirm."""
    n = named.join(node_class, "node").select("name", "class").distinct()
    a = n.select(F.col("name").alias("a"), "class")
    b = n.select(F.col("name").alias("b"), F.col("class").alias("other"))
    return class_rows.select("class", "other").distinct().join(a, "class").join(b, "other").select("a", "b").distinct()


def function_of(name, kind):
    """The function that an entry names: before `::`, or after `ret:`; the entry itself for functions."""
    return F.when(name.startswith("ret:"), F.substr(name, F.lit(5))).when(name.contains("::"), F.substring_index(name, "::", 1)).otherwise(name)
