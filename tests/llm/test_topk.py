"""Exact search against brute force: copies, ties, short and broken vectors, large numbers, small blocks."""

import math
import random

import numpy as np
import pytest

from graphloom.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, top=T.TOP):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asked = [], set()
    for n, (i, q) in enumerate(good):
        key = (i, tuple(q))
        if i is None or i % 20 or key in asked:
            continue
        asked.add(key)
        scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for m, (j, v) in enumerate(good) if m != n]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


def vectors(seed, n=400, d=6):
    rng = random.Random(seed)
    means = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(means)]) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 8), ("GROUP", 3), ("CELLS", 4), ("CHUNK", 4), ("SHARE", 5), ("SLICE", 3)):
        monkeypatch.setattr(T, name, value)


def test_search_equals_brute_force(spark, small):
    rows = vectors(1) + [(1000 + i, [0.5] * 6) for i in range(120)] + [(2000, None), (2020, [0.1, None]), (2040, [float("nan")] * 6), (2060, [1.0, -math.inf]), (None, [2.0] * 6), (2080, []), (2100, [1.0])]
    rows += [(40, [0.25] * 6)] + [rows[0]] * 2  # ids and rows that repeat
    got = sorted((tuple(r) for r in T.report(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_few_rows_and_none(spark):
    assert T.report(table(spark, [])).count() == 0 and T.report(table(spark, [(20, [1.0])])).count() == 0
    got = T.report(table(spark, [(20, [1.0]), (21, [-1.0]), (40, [0.5])]))
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"
    assert sorted(map(tuple, got.collect())) == [(20, 1, 40, 2048), (20, 2, 21, -4096), (40, 1, 20, 2048), (40, 2, 21, -2048)]


def test_large_components_stay_exact(spark):
    rows = [(20, [2.0**40, 1.0]), (1, [2.0**10, 3.0]), (2, [2.0**10, 3.5]), (3, [-(2.0**10), 1.0])]
    assert sorted(map(tuple, T.report(table(spark, rows)).collect())) == brute(rows)
    a = np.array([[1 << 40, 3]], dtype=np.int64)
    assert T.dot(a, a).tolist() == [[(1 << 63) - 1]] and T.dot(a, np.array([[1, 1]])).tolist() == [[(1 << 40) + 3]]


def test_blocks_are_pruned():
    """A query near one of far blocks scores few of them."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-3, 3, (50, 8)) + 100 * np.eye(8, dtype=np.int64)[i % 8] for i in range(16)])
    group = T.Held()
    group.add(pa.RecordBatch.from_pydict({"v": x.tolist(), "block": np.repeat(np.arange(16), 50), "ids": [[i] for i in range(len(x))]}))
    group.prepare()
    queries = x[:4]
    hits, scored = group.best(queries, np.full(4, np.iinfo(np.int64).min), 10)
    assert scored <= 4 * 4
    for q, h in zip(queries, hits, strict=True):
        s = x @ q
        assert h == sorted(((int(v), i) for i, v in enumerate(s)), key=lambda p: (-p[0], p[1]))[:10]
