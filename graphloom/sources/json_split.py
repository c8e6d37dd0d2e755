"""Entries of large JSON documents, read by many tasks from inside each file.

A document may be one object of millions of members on one line, which no line-based split can cut. Files are cut into chunks of
equal size instead. The first scan counts, for each chunk, its unescaped quotes, and how much its brackets change the depth if it starts
outside a string, and if inside. Sums over earlier chunks (one small row each) then say how each chunk really starts. In the second
scan a chunk gives the entries whose separator (the comma or opening bracket before them) lies in it, and reads on until the last ends.
An entry is one row, so one entry must fit into a task; documents and containers need not.

Files are opened by pyarrow's file systems, as in `table`. Text that isn't JSON gives no entries, or entries that don't parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written
from .table import _at

CHUNK = 8 << 20
_OPEN, _CLOSE, _COMMA, _QUOTE, _BACK = (b"{["), (b"}]"), ord(","), ord('"'), ord("\\")


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of quotes that an even number of backslashes precedes; data starts where no escape is open."""
    at = np.flatnonzero(data == _QUOTE)
    after = at[(at > 0) & (data[at - 1] == _BACK)]
    if len(after) == 0:
        return at
    plain = np.maximum.accumulate(np.where(data != _BACK, np.arange(len(data), dtype=np.int64), -1))
    return np.setdiff1d(at, after[(after - 1 - plain[after - 1]) % 2 == 1], assume_unique=True)


def _read(file, start: int, end: int) -> tuple[np.ndarray, int]:
    """Bytes from start to end, and before them the backslashes that reach up to start; and how many those are."""
    back = 0
    while back < start:
        file.seek(max(0, start - 2 * back - 64))
        seen = file.read(start - max(0, start - 2 * back - 64))
        back = len(seen) - len(seen.rstrip(b"\\"))
        if back < len(seen):
            break
    file.seek(start - back)
    return np.frombuffer(file.read(end - start + back), dtype=np.uint8), back


def _structure(data: np.ndarray, back: int, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Brackets and commas outside strings: places, change of depth, depth after; and the state after data."""
    quotes = _quotes(data)
    step = np.zeros(256, dtype=np.int8)
    step[list(_OPEN)], step[list(_CLOSE)] = 1, -1
    mark = step != 0
    mark[_COMMA] = True
    at = np.flatnonzero(mark[data])
    at = at[at >= back]
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    change = step[data[at]].astype(np.int64)
    after = depth + np.cumsum(change)
    return at, change, after, (inside + len(quotes)) % 2, int(after[-1]) if len(after) else depth


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            system, name = _at(r.path)
            with system.open_input_file(name) as file:
                data, back = _read(file, r.start, r.end)
            _, change, _, quotes, _ = _structure(data, back, 0, 0)
            out.append((r.path, r.start, r.end, quotes, int(change.sum()), int(_structure(data, back, 1, 0)[1].sum())))
        yield pd.DataFrame(out, columns=["path", "start", "end", "quotes", "outside", "inside"])


def _key_before(file, place: int) -> str | None:
    """The key of the container that opens at a place; None inside arrays and at the top."""
    import json

    size = 256
    while True:
        first = max(0, place - size)
        file.seek(first)
        seen = file.read(place - first).rstrip()
        if seen and not seen.endswith(b":"):
            return None
        text = seen[:-1].rstrip()
        quotes = [i for i in range(len(text)) if text[i] == _QUOTE and (i - len(text[:i].rstrip(b"\\"))) % 2 == 0]
        # the window may begin inside a run of backslashes, so its first quote counts only where something stands before
        if len(quotes) > 1 and (first == 0 or quotes[-2] > 0 and text[: quotes[-2]].rstrip(b"\\")):
            return json.loads(text[quotes[-2] :].decode("utf-8"), strict=False)
        if first == 0:
            return None
        size *= 8


def _entries_of(depth: int):
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "start", "seq", "known", "member", "text"]
        for batch in batches:
            for r in batch.itertuples(index=False):
                out, size, seq, known, member, edge = [], 0, 0, depth == 1, None, None
                system, name = _at(r.path)
                with system.open_input_file(name) as file:
                    place, inside, level, parts = r.start, int(r.inside), int(r.depth), []
                    while place < r.end or edge is not None:
                        last = r.end if place < r.end else min(r.size, place + max(1 << 20, sum(map(len, parts))))
                        if place >= last:
                            break  # the document is cut short: its last entry never ends
                        data, back = _read(file, place, last)
                        at, change, after, inside, level = _structure(data, back, inside, level)
                        raw, cut = data.tobytes(), ((change == 0) & (after == depth)) | ((change == 1) & (after == depth)) | ((change == -1) & (after == depth - 1))
                        begin = back
                        for i, kind in zip(at[cut].tolist(), change[cut].tolist(), strict=True):
                            if edge is not None:
                                text = (b"".join(parts) + raw[begin:i]).strip()
                                parts = []
                                if text:
                                    out.append((r.path, r.start, seq, known, member, text.decode("utf-8", "replace")))
                                    size, seq = size + len(text), seq + 1
                                edge = None
                                if place >= r.end:
                                    break
                            if kind == 1 and depth > 1:
                                known, member = True, _key_before(file, place - back + i)
                            if kind != -1:
                                edge, begin = i, i + 1
                            if size > 1 << 22:
                                yield pd.DataFrame(out, columns=names)
                                out, size = [], 0
                        if edge is not None:
                            parts.append(raw[begin:])
                        place = last
                out.append((r.path, r.start, -1, known, member, None))
                yield pd.DataFrame(out, columns=names)

    return entries


def entries(spark: SparkSession, path: str, depth: int, members: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """(path, member, start, seq, text): members or elements of all containers at a depth of files.

    depth 1: entries of the document itself, member null. depth 2: those of its containers, member the container's key; members: only
    those of these keys. text is the entry as it stands, `"key": value` in objects. (start, seq) is its order in the file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    # tasks by what there is to read and open; a small chunk makes no more of them
    n = max(1, min(100_000, files.agg(F.ceil(F.sum(F.col("size") / CHUNK + F.lit(0.01))).cast("int")).first()[0] or 1))
    step = F.lit(chunk).cast("long")
    chunks = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("start")).withColumn("end", F.least(F.col("size"), F.col("start") + step))
    found = chunks.repartition(n, "path", "start").mapInPandas(_summaries, "path string, start long, end long, quotes int, outside long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    at = found.withColumn("_in", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("_in") == 1, F.col("inside")).otherwise(F.col("outside"))
    at = at.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    size = F.max("end").over(Window.partitionBy("path"))
    states = written(at.select("path", "start", "end", size.alias("size"), F.col("_in").cast("int").alias("inside"), "depth"))
    rows = states.repartition(n, "path", "start").mapInPandas(_entries_of(depth), "path string, start long, seq long, known boolean, member string, text string")
    if members:
        rows = rows.filter(F.col("text").isNull() | ~F.col("known") | F.col("member").isin(*members))
    rows = written(rows)
    # entries before a chunk's first container belong to the last one that opened in an earlier chunk
    ends = rows.filter("seq = -1").select("path", "start", F.when(F.col("known"), F.struct("member")).alias("m"))
    ends = ends.select("path", "start", F.last("m", ignorenulls=True).over(before).alias("_m"))
    whole = rows.filter("seq >= 0 and known").select("path", "member", "start", "seq", "text")
    late = rows.filter("seq >= 0 and not known").join(ends, ["path", "start"]).select("path", F.col("_m.member").alias("member"), "start", "seq", "text")
    out = whole.unionByName(late)
    return out.filter(F.col("member").isin(*members)) if members else out


def numbered(rows: DataFrame) -> DataFrame:
    """entries with pos, from 0, by path and member: numbers come from counts of chunks, not from one sort of all rows."""
    w = Window.partitionBy("path", "member", "start").orderBy("seq")
    counts = rows.groupBy("path", "member", "start").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path", "member").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", F.col("member").alias("_member"), "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    met = rows.withColumn("_r", F.row_number().over(w) - 1).withColumn("_k", F.col("member"))
    met = met.join(offsets.withColumnRenamed("path", "_p").withColumnRenamed("start", "_s"), (F.col("path") == F.col("_p")) & (F.col("start") == F.col("_s")) & F.col("_k").eqNullSafe(F.col("_member")))
    return met.select("path", "member", "start", "seq", "text", (F.col("_o") + F.col("_r")).cast("int").alias("pos"))


def write_documents(rows: DataFrame, path: str, member: str | None = None, array: bool = True, key: str = "text", order: tuple[str, ...] = ("text",), each: int = 1_000_000) -> None:
    """Entries (column text, without line breaks) as JSON documents of about `each` entries; entries of one key share a document.

    Inside a document entries stand in order. member: the document is an object, and its member holds them; array: in an array, else an object. A
    document is a file below path, written line by line from a sorted stream, so no task holds one. No rows: no documents.
    """
    n = -(-rows.count() // each) or 1
    w = Window.partitionBy("document").orderBy(*order)
    head, tail = ("[", "]") if array else ("{", "}")
    if member is not None:
        head, tail = F.to_json(F.array(F.lit(member))), tail + "}"
        head = F.concat(F.lit("{"), F.substring(head, F.lit(2), F.length(head) - 2), F.lit(":[" if array else ":{"))
    else:
        head = F.lit(head)
    numbered = rows.withColumn("document", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    numbered = numbered.select("document", "text", *(c for c in order if c != "text"), F.row_number().over(w).alias("_r"), F.lead(F.lit(1)).over(w).alias("_next"))
    line = F.concat(F.when(F.col("_r") == 1, head).otherwise(F.lit("")), "text", F.when(F.col("_next").isNull(), F.lit(tail)).otherwise(F.lit(",")))
    numbered.select("document", line.alias("value")).write.partitionBy("document").option("maxRecordsPerFile", 0).text(path)
