"""The pass driver: early cut-off, errors, incomplete callees, recursion, stored payloads."""

import pytest
from pyspark.sql import functions as F

from graphloom.plans import passes

EDGES = [(1, 2), (2, 3), (4, 3), (5, 4), (6, 7)]


@pytest.fixture
def graph(spark):
    def make(weights, edges=EDGES, sources=None):
        f = spark.createDataFrame([(i, f"f{i}", float(w), (sources or {}).get(i, "x")) for i, w in weights.items()], "id long, name string, weight double, source string")
        return f, spark.createDataFrame(edges, "caller_id long, callee_id long")

    return make


def ran(result):
    return {r.function_id: (r.payload.top, r.changed) for r in result.filter("ran").collect()}


def test_equal_payloads_stop_the_change(spark, graph):
    rule = passes.weight_pass()
    weights = {1: 0, 2: 9, 3: 1, 4: 2, 5: 0, 6: 1, 7: 1}
    f, e = graph(weights)
    first = passes.run(f, e, [rule])["weight"]
    assert ran(first) == {i: (t, True) for i, t in {1: 9, 2: 9, 3: 1, 4: 2, 5: 2, 6: 1, 7: 1}.items()}
    have = {"weight": first.select("function_id", "payload")}
    g, _ = graph(weights | {3: 5})
    dirty = {"weight": spark.createDataFrame([(3,)], "id long")}
    second = passes.run(g, e, [rule], have, dirty)["weight"]
    assert ran(second) == {3: (5, True), 2: (9, False), 4: (5, True), 5: (5, True)}  # 1 isn't asked, as 2 stays
    kept = {r.function_id: r.payload.top for r in passes.stored([rule], have, {"weight": second})["weight"].collect()}
    assert kept == {1: 9, 2: 9, 3: 5, 4: 5, 5: 5, 6: 1, 7: 1}
    alone = passes.run(g, e, [rule], have, targets=spark.createDataFrame([(3,), (4,)], "id long"), force=True)["weight"]
    assert ran(alone) == {3: (5, True), 4: (5, True)}
    assert ran(passes.run(g, e, [rule], have)["weight"]) == {}


def test_errors_and_incomplete_callees(spark, graph):
    """A function below 0 reports an error; one above 5 needs callees that have no payload yet."""
    seen = []

    def summarise(rows):
        seen.append(1)
        top = F.coalesce(F.array_max(F.transform("callees", lambda c: c["payload"]["top"])), F.lit(0.0)) + F.col("weight")
        lacks = F.when((F.col("weight") > 5) & F.exists("callees", lambda c: c["payload"]["top"] < 1), F.array(F.lit(3).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return rows.select("function_id", F.struct(F.when(F.col("previous").isNotNull() & (F.col("function_id") == 3), 2.0).otherwise(top).alias("top")).alias("payload"), (F.col("weight") < 0).alias("error"), lacks.alias("needs"))

    rule = passes.Pass("p", "struct<top:double>", summarise, cached=lambda f, s: s.filter("payload.top > 0").select("function_id"))
    f, e = graph({1: -1, 2: 7, 3: 0, 4: 1, 6: 8, 7: 0}, sources={4: ""})
    have = {"p": spark.createDataFrame([(3, (0.0,))], "function_id long, payload struct<top:double>")}
    out = {r.function_id: r for r in passes.run(f, e, [rule], have)["p"].collect()}
    assert out[2].payload.top == 9 and out[3].payload.top == 2  # 3 ran again, then 2
    assert out[1].error and not out[1].changed and 4 not in out  # no source, no run
    assert 6 not in out  # still incomplete
    assert 1 not in {r.function_id for r in passes.stored([rule], have, {"p": passes.run(f, e, [rule], have)["p"]})["p"].collect()}


def test_recursive_components_run_until_nothing_changes(spark, graph):
    f, e = graph({1: 1, 2: 2, 3: 7, 4: 0}, [(1, 2), (2, 1), (2, 3), (4, 1)])
    out = passes.run(f, e, [passes.weight_pass(), passes.memsafe_pass("f1", "name")])
    assert ran(out["weight"]) == {i: (7, True) for i in (1, 2, 3, 4)}
    assert {r.function_id for r in out["memsafe"].collect()} == {1, 2, 3, 4}


def test_graphs_without_cycles_need_no_components(spark, graph, monkeypatch):
    def none(*args):
        raise AssertionError("components of a graph without cycles")

    monkeypatch.setattr(passes.graph, "sccs", none)
    f, e = graph({1: 0, 2: 9, 3: 1, 4: 2, 5: 0}, [(1, 2), (2, 3), (4, 3), (5, 4), (3, 3), (3, 77)])  # a self call, and a callee that is no function
    calls = passes.calls(e)
    first = passes.run(f, calls, [passes.weight_pass()], clean=True)["weight"]
    assert ran(first) == {i: (t, True) for i, t in {1: 9, 2: 9, 3: 1, 4: 2, 5: 2}.items()}
    have, dirty = {"weight": first.select("function_id", "payload")}, {"weight": spark.createDataFrame([(4,)], "id long")}
    assert ran(passes.run(f.withColumn("weight", F.col("weight") + 1), calls, [passes.weight_pass()], have, dirty, clean=True)["weight"]) == {4: (3, True), 5: (3, True)}
