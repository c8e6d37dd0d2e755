"""Overlaps, nearest places, candidates and split blocks against plain Python."""

import random

import pytest

from graphloom.operators import intervals, resolve, transcript


def test_cover_and_holders(spark):
    from pyspark.sql import functions as F

    rows = [(a, b) for a in range(0, 40, 3) for b in range(a, 70, 5)]
    df = spark.createDataFrame(rows, "a long, b long")
    for n in (1, 3, 7):
        for r in df.select("a", "b", intervals.cover(F.col("a"), F.col("b"), n).alias("c"), intervals.holders(F.col("a"), n).alias("h")).collect():
            assert sorted(x for c in r.c for x in range(c.at << c.size, (c.at + 1) << c.size)) == list(range(r.a, r.b + 1))
            assert [(h.size, h.at) for h in r.h] == [(s, r.a >> s) for s in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_overtaken(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        a = rng.randrange(200)
        rows.append((rng.choice([1, 1, 1, 2, None]), rng.choice("xy"), rng.randrange(60), a, a + rng.choice([-1, 0, 3, 20])))
    rows += [rows[0]] * 2 + [(1, "x", 5, None, 3), (1, "x", None, 3, 9)]
    df = spark.createDataFrame(rows, "conv_id long, path string, turn long, start long, end long")
    ok = [r for r in rows if r[3] is not None and r[3] <= r[4]]
    want = [(*r, r in ok and r[2] is not None and any(o[:2] == r[:2] and o[2] is not None and o[2] > r[2] and r[3] <= o[4] and o[3] <= r[4] for o in ok)) for r in rows]
    assert sorted(map(tuple, transcript.stale_reads(df).collect()), key=str) == sorted(want, key=str)


def test_place_of_functions_named_alike(spark):
    rng = random.Random(3)
    functions = []
    for i in range(400):
        c = rng.randrange(1, 900)
        functions.append((i, rng.choice(["f", "f", "g"]), rng.choice(["/x/src/a.c", "/y/xsrc/a.c", "/z/b.c", "a.c"]), c, c + rng.randrange(12)))
    wanted = []
    for k in range(150):
        a = rng.randrange(0, 1000)
        wanted.append((f"k{k}", rng.choice(["f", "g", "h"]), rng.choice(["/q/src/a.c", "a.c", "b.c", "", "src/a.c"]), a, rng.choice([0, a, a + 5, a + 60])))
    want = {}
    for key, name, file, a, b in wanted:
        b = b or a
        tail = "/".join(file.split("/")[-2:])
        costs = []
        for i, n, path, c, d in functions:
            if file and a and n == name and path.endswith(tail):
                costs.append((max(a, c) - min(b, d) if a <= d and b >= c else min(abs(a - d), abs(b - c)), i))
        over = [x for x in costs if x[0] <= 0]
        if costs:
            want[key] = min(over or costs)[1]
    w = spark.createDataFrame(wanted, "key string, name string, file string, line_start int, line_end int")
    f = spark.createDataFrame(functions, "id long, name string, file_path string, line_start int, line_end int")
    got = resolve.by_place(w, f)
    assert {r.key: r.id for r in got.collect()} == want and got.count() == len(want)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()


def test_candidates_by_factors(spark):
    sites = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, None)], "id long, signature string")
    functions = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, None)], "id long, signature string")
    classes, members = resolve.signature_classes(sites, functions)
    assert {r.callsite_id: (r["class"], r.size) for r in classes.collect()} == {1: ("=a", 2), 2: ("=b", 1), 3: ("*", 4), 4: ("*", 4)}
    pairs = {(r.callsite_id, r.function_id) for r in resolve.by_signature(sites, functions).collect()}
    assert pairs == {(1, 10), (1, 11), (2, 12)} | {(s, f) for s in (3, 4) for f in (10, 11, 12, 13)}
    asked = spark.createDataFrame([(2,), (3,)], "callsite_id long")
    assert resolve.candidates_of(asked, classes, members).count() == 5


def python_groups(spans, least):
    groups, size = [], None
    for s, e in sorted(spans):
        own = e - s + 1
        if groups and size < least and own < least:
            groups[-1][1] = max(groups[-1][1], e)
            size += own
        else:
            groups.append([s, e])
            size = own
    return [tuple(g) for g in groups]


def test_split_blocks(spark):
    """Two functions with nested spans; blocks over 300 characters give way to their children, twice."""
    rng = random.Random(4)
    spans, lines, want = [], [], []
    for f in (1, 2):
        chars = [rng.randrange(0, 30) for _ in range(300)]
        lines += [(f, i + 1, c) for i, c in enumerate(chars)]
        ids = iter(range(f * 1000, f * 1000 + 999))

        def children(parent, start, end, depth):
            out, at = [], start
            while at <= end:
                stop = min(end, at + rng.choice([0, 1, 3, 8, 30 >> depth]))
                out.append((next(ids), parent, at, stop))
                at = stop + 1 + rng.choice([0, 0, 2])
            return out

        top = children(None, 1, 300, 0)
        tree = {None: top}
        for level in (1, 2):
            for i, _, s, e in [x for xs in list(tree.values()) for x in xs if x[0] not in tree]:
                if e - s > 5:
                    tree[i] = children(i, s, e, level)
        spans += [(f, *x) for xs in tree.values() for x in xs]

        def groups(rows, depth):
            for s, e in python_groups([(a, b) for _, _, a, b in rows], 10):
                if sum(chars[s - 1 : e]) + e - s > 300 and depth < 2:
                    below = [c for i, _, a, b in rows if a >= s and b <= e for c in tree.get(i, [])]
                    if len(below) > 1:
                        groups(below, depth + 1)
                        continue
                want.append((f, s, e, depth))

        groups(top, 0)
    s = spark.createDataFrame(spans, "function_id long, id long, parent long, start int, end int")
    n = spark.createDataFrame(lines, "function_id long, pos int, chars int")
    assert sorted(map(tuple, transcript.split_blocks(s, n, most_chars=300).collect())) == sorted(want)
    assert {d for *_, d in want} == {0, 1, 2}


def test_long_runs_of_short_spans(spark):
    spans = [(1, i, i + i % 4) for i in range(0, 3000, 5)]
    df = spark.createDataFrame(spans, "function_id long, start long, end long")
    assert sorted((r.start, r.end) for r in transcript.grouped_spans(df).collect()) == python_groups([s[1:] for s in spans], 10)
