"""Line deduplication: once-seen and twice-seen Bloom filters, exact confirmation of suspects only.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Keys of
at least min_chars code points that two or more documents hold lose all their lines except in the
document with the smallest id.

Scan 1 builds the filters from each document's distinct keys. Scan 2 probes them; of suspected lines
only (id, row digest, key digest) is written and shuffled, to confirm them exactly and to choose the
first holder. Scan 3 drops lines: documents without a suspected line pass straight through, the
others meet their lists of dropped keys by row digest, so a list is no longer than its own text.

Defined cases. Null and empty texts are one empty line, which never drops. Rows with the same id are
one document; null ids together are one document after all others. Lines repeated inside one
document don't count. Ids may be of any type that orders. Extra columns pass through; those named like a count are
replaced by it, and names starting with `_gl_` are reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .bloom import LEAST_BITS, MOST_BITS, might_repeat, twice_seen
from .common import join_on_hot_keys, power_of_two, stored_bytes, without, written

K = 2


def _key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip().lower()  # for bytes, just the six ASCII spaces and A-Z
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    return ((x or "").encode() for x in column.to_pylist())


def _suspects(texts: list[bytes], twice: bytes, bits: int, min_chars: int) -> list[dict[bytes, None]]:
    """For each text its distinct keys that may be in another document too."""
    keys = [list(dict.fromkeys(k for line in t.split(b"\n") if (k := _key(line, min_chars)) is not None)) for t in texts]
    flat = np.fromiter((xxhash.xxh3_64_intdigest(k) for ks in keys for k in ks), np.uint64)
    found = might_repeat(twice, flat, bits, K)
    out, at = [], 0
    for ks in keys:
        out.append([k for k, f in zip(ks, found[at : at + len(ks)], strict=True) if f])
        at += len(ks)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bytes_per_line: int = 64, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """df with text_col without the dropped lines, and (names in counts) its lines before and the dropped ones (long)."""
    df = without(df, counts, id_col, text_col)
    bits = power_of_two(16 * stored_bytes(df, text_col) / bytes_per_line, LEAST_BITS, MOST_BITS)
    texts = df.select(F.col(text_col).alias("_gl_text"))

    def hashes(batch):
        for x in _texts(batch.column(0)):
            keys = {k for line in x.split(b"\n") if (k := _key(line, min_chars)) is not None}
            mine.extend(map(xxhash.xxh3_64_intdigest, keys))
            if len(mine) > 1 << 18:
                yield np.array(mine, np.uint64)
                mine.clear()
        yield np.array(mine, np.uint64)
        mine.clear()

    mine: list[int] = []
    twice = twice_seen(texts, hashes, bits, K)

    def occurrences(batches):
        for batch in batches:
            ids, row, key = [], [], []
            for part in _slices(batch, 1):
                found = list(_texts(part.column(1)))
                for i, x, keys in zip(part.column(0).to_pylist(), found, _suspects(found, twice.value, bits, min_chars), strict=True):
                    if keys:
                        ids += [i] * len(keys)
                        row += [_digest(x)] * len(keys)
                        key += map(_digest, keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(row, pa.binary()), pa.array(key, pa.binary())], ["_gl_id", "_gl_row", "_gl_key"])

    ids = df.select(F.col(id_col).alias("_gl_id"), F.col(text_col).alias("_gl_text"))
    spark_id = ids.schema["_gl_id"].dataType
    id_type = to_arrow_type(spark_id)
    schema = T.StructType([T.StructField("_gl_id", spark_id), T.StructField("_gl_row", T.BinaryType()), T.StructField("_gl_key", T.BinaryType())])
    seen = written(ids.mapInArrow(occurrences, schema))
    first = seen.groupBy("_gl_key").agg(F.min("_gl_id").alias("_gl_first"), F.max("_gl_id").alias("_gl_last"), F.count("_gl_id").alias("_gl_ids"), F.count(F.lit(1)).alias("_gl_n"))
    repeated = written(first.filter("_gl_first <> _gl_last or (_gl_ids > 0 and _gl_ids < _gl_n)").select("_gl_key", "_gl_first", "_gl_n"))
    held = join_on_hot_keys(seen, repeated, "_gl_key", "_gl_n").filter("not (_gl_id <=> _gl_first)")
    drops = written(held.groupBy("_gl_id", "_gl_row").agg(F.collect_set("_gl_key").alias("_gl_drop")))

    marked = T.StructType([*df.schema.fields, T.StructField("_gl_row", T.BinaryType())])

    def mark(batches):
        where = df_names.index(text_col)
        for batch in batches:
            for part in _slices(batch, where):
                found = list(_texts(part.column(where)))
                rows = [_digest(x) if keys else None for x, keys in zip(found, _suspects(found, twice.value, bits, min_chars), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())], [*df_names, "_gl_row"])

    df_names = df.columns
    rows = df.mapInArrow(mark, marked)
    plain = rows.filter("_gl_row is null").drop("_gl_row")
    plain = plain.withColumns({counts[0]: F.coalesce(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"))), F.lit(0)).cast("long") + 1, counts[1]: F.lit(0).cast("long")})
    listed = drops.withColumnsRenamed({"_gl_row": "_gl_row2", "_gl_id": "_gl_id2"})
    met = rows.filter("_gl_row is not null").join(listed, F.col("_gl_row").eqNullSafe(F.col("_gl_row2")) & F.col(id_col).eqNullSafe(F.col("_gl_id2")), "left").select(*df_names, "_gl_drop")
    more = [T.StructField(c, T.LongType(), False) for c in counts]

    def drop(batches):
        where = df_names.index(text_col)
        for batch in batches:
            for part in _slices(batch, where):
                out, n, gone = [], [], []
                for x, keys in zip(_texts(part.column(where)), part.column(len(df_names)).to_pylist(), strict=True):
                    lines = x.split(b"\n")
                    keys = set(keys or ())
                    kept = [line for line in lines if not keys or (k := _key(line, min_chars)) is None or _digest(k) not in keys]
                    out.append(b"\n".join(kept).decode())
                    n.append(len(lines))
                    gone.append(len(lines) - len(kept))
                columns = [pa.array(out, part.column(i).type) if i == where else part.column(i) for i in range(len(df_names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*df_names, *counts])

    return plain.unionByName(met.mapInArrow(drop, T.StructType([*df.schema.fields, *more])))


def _slices(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about limit bytes of text each, so that Python objects stay few."""
    from .text import slices, utf8

    for a, b in slices(utf8(batch.column(text))[1], limit):
        yield batch.slice(a, b - a)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = dedup_lines(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM t),
     k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
     m AS (SELECT k.doc_id, k.line, k.i, (r.key IS NOT NULL AND k.doc_id <> r.first) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
