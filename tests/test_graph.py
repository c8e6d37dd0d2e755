"""Small graphs with known answers; random graphs against brute force."""

import random

import pytest

from graphloom.operators import graph

GRAPHS = {
    "chain": ([(1, 2), (2, 3)], {1: 1, 2: 2, 3: 3}),
    "cycle": ([(1, 2), (2, 3), (3, 1)], {1: 1, 2: 1, 3: 1}),
    "two cycles": ([(1, 2), (1, 3), (2, 1), (3, 4), (4, 5), (5, 3)], {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}),
    "self loop": ([(1, 1)], {1: 1}),
    "diamond": ([(1, 2), (1, 3), (2, 4), (3, 4)], {1: 1, 2: 2, 3: 3, 4: 4}),
}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "caller_id long, callee_id long")


def sccs(spark, pairs, task_edges=3):
    return {r.id: r.scc_id for r in graph.sccs(edges(spark, pairs), task_edges=task_edges).collect()}


@pytest.mark.parametrize("name", GRAPHS)
def test_sccs(spark, name):
    pairs, want = GRAPHS[name]
    assert sccs(spark, pairs) == want


def test_isolated_and_empty(spark):
    none = edges(spark, []).limit(0)
    v = spark.createDataFrame([(7,)], "id long")
    assert [(r.id, r.scc_id) for r in graph.sccs(none, v).collect()] == [(7, 7)]
    assert graph.sccs(none).count() == 0
    assert graph.levels(none, graph.sccs(none, v)).first().level == 0


def test_random_sccs_and_levels(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    nodes = {x for p in pairs for x in p}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}
    e = edges(spark, pairs)
    assert sccs(spark, pairs, 15) == want == sccs(spark, pairs, 100)
    over = {(want[a], want[b]) for a, b in pairs if want[a] != want[b]}

    def level(x):
        return max((level(b) + 1 for a, b in over if a == x), default=0)

    assert {r.scc_id: r.level for r in graph.levels(e, graph.sccs(e)).collect()} == {x: level(x) for x in want.values()}
    seeds = spark.createDataFrame([(pairs[0][0],)], "id long")
    assert {r.id for r in graph.reachable(seeds, e).collect()} == reach[pairs[0][0]]
    assert {r.id for r in graph.affected(seeds, e).collect()} == {a for a in nodes if pairs[0][0] in reach[a]}


def test_null_ends_are_no_nodes(spark):
    e = edges(spark, [(1, 2), (2, None), (None, 3)])
    seeds = spark.createDataFrame([(1,), (None,)], "id long")
    assert sorted(r.id for r in graph.reachable(seeds, e).collect()) == [1, 2]
    assert sorted(r.id for r in graph.affected(spark.createDataFrame([(3,)], "id long"), e).collect()) == [3]
    assert sccs(spark, [(1, 2), (2, None)]) == {1: 1, 2: 2}


def test_aliases_of_many_sets_over_few_members(spark):
    rng = random.Random(7)
    sets = {f"u{i}": {m for m in "abcde" if rng.random() < 0.6} for i in range(3000)}
    units = spark.createDataFrame([(n, i) for i, n in enumerate(sets)], "name string, pos long")
    members = spark.createDataFrame([(n, m) for n, s in sets.items() for m in s for _ in range(2)], "name string, member string")
    first = {}
    for i, (n, s) in enumerate(sets.items()):
        first.setdefault(frozenset(s), (i, n))
    want = {}
    for n, s in sets.items():
        over = [(len(x) - len(s), i, other) for x, (i, other) in first.items() if s and s < x]
        if over:
            want[n] = min(over)[2]
    assert {r.name: r.alias_of for r in graph.aliases(units, members).collect()} == want


def test_stats_and_condensation(spark):
    pairs, _ = GRAPHS["two cycles"]
    e = edges(spark, pairs)
    c = graph.sccs(e)
    assert tuple(graph.stats(e, c).first()) == (5, 6, 2, 2, 3)
    assert [tuple(r) for r in graph.condensation(e, c).collect()] == [(1, 3)]
    assert {tuple(r) for r in graph.external_callees(e, c).collect()} == {(1, 3)}
    assert {r.id for r in graph.recursive(graph.sccs(edges(spark, [(1, 1), (1, 2)]))).collect()} == set()
    order = {r.scc_id: r.position for r in graph.topological(e, c).collect()}
    assert order[3] < order[1]


def test_entries_fall_back(spark):
    v = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.id for r in graph.entries(edges(spark, [(1, 2), (2, 1)]), v).collect()] == [1]
    assert [r.id for r in graph.entries(edges(spark, [(1, 2), (1, 1)]), v).collect()] == [1]


def brute(pairs):
    """Smallest member of each node's component, by closures."""
    calls, back = {}, {}
    for a, b in pairs:
        calls.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def closure(x, way):
        seen, work = {x}, [x]
        while work:
            for y in way.get(work.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    work.append(y)
        return seen

    return {x: min(closure(x, calls) & closure(x, back)) for x in {x for p in pairs for x in p}}


@pytest.mark.parametrize("task_edges", [60, 10_000])
def test_contraction_over_many_tasks(spark, task_edges):
    rng = random.Random(task_edges)
    ring = [(i * 37 % 61, (i + 1) * 37 % 61) for i in range(61)]  # one cycle across all ranges
    near = [(200 + i, 200 + max(0, min(59, i + rng.choice([-2, 1, 1, 2])))) for i in range(60)]
    wide = [(1000, 1001 + i) for i in range(20)] + [(1001 + i, 1000) for i in range(0, 20, 2)]
    pairs = ring + near + wide + [(rng.randrange(300), rng.randrange(300)) for _ in range(20)]
    assert sccs(spark, pairs, task_edges) == brute(pairs)


def test_levels_refuse_cycles(spark):
    e = edges(spark, [(1, 2), (2, 1)])
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(e, e.select("caller_id").selectExpr("caller_id AS id", "caller_id AS scc_id"))


def test_sides_that_grow_are_not_broadcast(spark):
    e = spark.range(60).selectExpr("id AS caller_id", "if(id % 10 = 9, id - 2, id + 1) AS callee_id")
    c = graph.sccs(e)
    for df in (c, graph.condensation(e, c), graph.external_callees(e, c), graph.recursive(c)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in graph.recursive(c).collect()} == {i for i in range(60) if i % 10 in (7, 8, 9)}


def test_reachable_over_several_rounds_with_short_cuts(spark):
    """Nodes that are met before a round's last step aren't expanded again; those at its last step are."""
    e = [(i, i + 1) for i in range(1, 12)] + [(1, 4), (4, 9), (12, 1), (9, 20), (30, 1)]
    found = graph.reachable(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame(e, "caller_id long, callee_id long"))
    assert sorted(r.id for r in found.collect()) == [*range(1, 13), 20]
