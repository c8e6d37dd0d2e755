"""Commits of the table format: versions, failures, changes by key, ranges; and names in texts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.sources import table

DDL = "id bigint, name string, v double, tags array<string>"


def rows(t, version=None):
    return sorted((r.id, r.name, r.v) for r in t.read(version).collect())


def test_versions_changes_and_failures(spark, tmp_path):
    path = str(tmp_path / "t")
    t = table.Table(spark, path, DDL)
    assert t.version() == 0 and rows(t) == []
    first = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 2).alias("v"), F.array(F.lit("x")).alias("tags")).repartition(4)
    t.append(first)
    t.append(spark.createDataFrame([(100, None, None, None)], DDL))
    assert t.version() == 2 and len(rows(t)) == 101 and len(rows(t, 1)) == 100
    files = set(os.listdir(path))
    bad = first.withColumn("v", F.when(F.col("id") == 57, F.raise_error("no")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        t.replace(bad)
    assert t.version() == 2 and len(rows(t)) == 101
    t.upsert(spark.createDataFrame([(5, "five", None, ["y"]), (500, "new", 1.0, None)], DDL), ["id"], fill=("v",))
    got = {i: (n, v) for i, n, v in rows(t)}
    assert t.version() == 3 and got[5] == ("five", 2.5) and got[500] == ("new", 1.0) and len(got) == 102
    t.delete(spark.range(10), "id")
    assert len(rows(t)) == 92 and len(rows(t, 3)) == 102
    assert files <= set(os.listdir(path))  # earlier versions keep their files
    assert spark.read.format("fact_table").load(path).columns == ["id", "name", "v", "tags"]
    with pytest.raises(Exception, match="no version 9"):
        t.read(9).collect()


def test_commit_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.createDataFrame([], DDL).schema
    a, b = (table._Writer(path, schema, False) for _ in range(2))
    a.commit([])
    with pytest.raises(ValueError, match="meanwhile"):
        b.commit([])
    with pytest.raises(ValueError, match="schema"):
        table._Writer(path, spark.range(1).schema, False)


def test_filters_choose_row_groups(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t = table.Table(spark, path, DDL)
    for i in range(3):
        t.append(spark.range(i * 100, i * 100 + 100, numPartitions=1).selectExpr("id", "'a' name", "1D v", "null tags"))
    parts = lambda between: len(table._Reader(path, t.read().schema, None, between).partitions())
    assert [parts(b) for b in ({}, {"id": (150, None)}, {"id": (None, 99)}, {"id": (150, 150)}, {"id": (150, 150), "name": ("b", None)}, {"id": ("x", None)})] == [3, 2, 1, 1, 0, 3]
    assert [r.id for r in t.read(between={"id": (150, 151)}).orderBy("id").collect()] == [150, 151]
    assert t.read(between={"name": (None, "Z")}).count() == 0


def test_queries_over_one_frame_keep_their_rows(spark, tmp_path):
    """A filter of one query, or of one side of a union, takes nothing from another."""
    t = table.Table(spark, str(tmp_path / "t"), DDL)
    for i in range(2):
        t.append(spark.range(i * 100, i * 100 + 100, numPartitions=1).selectExpr("id", "'a' name", "1D v", "null tags"))
    df = t.read()
    assert [df.count(), df.filter("id < 100").count(), df.count(), df.filter("id < 100").union(df.filter("id >= 100")).count()] == [200, 100, 200, 200]


def test_references(spark):
    rng = random.Random(1)
    names = ["ab", "abc", "x_1", "zz", "", "bcd"]
    files = [(f"{rng.choice(['tests', 'lib', 'fuzz', 'src/Test'])}/{i}{rng.choice(['.c', '.c', '.cc', '.h'])}", "\n".join(" ".join(rng.choice(["abcd", "ab", "q", "x_12(", "a-b", "zzz" * 40, "é"]) for _ in range(3)) for _ in range(rng.randrange(4))) if i else None) for i in range(40)]
    df = spark.createDataFrame(files, "path string, text string")
    n = spark.createDataFrame([(x,) for x in names + [None]], "name string")
    want = sorted({(x, p, i + 1) for p, t in files for i, line in enumerate((t or "").split("\n")) for x in names if x and x in line})
    assert sorted(map(tuple, search.references(df, n).collect())) == want
    few = [r for x in names for r in [w for w in want if w[0] == x][:4]]
    assert sorted(map(tuple, search.references(df, n, 4).collect())) == sorted(few)
    assert search.references(df, n.limit(0)).count() == 0
    out = search.harnesses(df, n, most=10)
    fuzz = {p for p, _ in files if p.startswith("fuzz/") and p.endswith((".c", ".cc"))}
    tests = {(x, p) for x in names for y, p, _ in [w for w in want if w[0] == x and w[1].endswith(".c")][:10] if "test" in p.lower() and p not in fuzz}
    assert {(r.name, r.path) for r in out.collect()} == {(None, p) for p in fuzz} | tests


def test_first_references_with_and_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(f"{i}.c", f"x\nfoo_a {i} bar\nb\nbar foo_b") for i in range(9)], "path string, text string")
    n = spark.createDataFrame([("foo",), ("bar",)], "name string")
    few = sorted(map(tuple, search.references(df, n, 3).collect()))
    monkeypatch.setattr(search, "SMALL", -1)
    assert sorted(map(tuple, search.references(df, n, 3).collect())) == few and len(few) == 6
