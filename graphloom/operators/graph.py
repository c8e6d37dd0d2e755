"""Call-graph structure: closures, strongly connected components, condensation, levels.

Edges are (caller_id, callee_id); an edge without one of its ends is none, nor is a null id a node. Loops run on
written tables with a scalar test per round, and a round writes its own rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds, written
from .merge import numbered

#: Edges that one task contracts at a time; some 30 MB.
TASK_EDGES = 1 << 18
#: Steps along edges in one job of a loop.
HOPS = 4
#: Rows up to which a side of a loop's joins may be broadcast; larger ones never pass through the driver.
SMALL = 1 << 16


def _apart(df: DataFrame, n: int | None = None) -> DataFrame:
    """df (of n rows at most) as a side of a join that isn't broadcast unless it is small."""
    return df if n is not None and n <= SMALL else df.hint("merge")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller_id").alias("id")).union(edges.select(F.col("callee_id").alias("id"))).filter("id is not null").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("callee_id").alias("caller_id"), F.col("caller_id").alias("callee_id"))


def adjacency(edges: DataFrame) -> DataFrame:
    """caller_id with its distinct callees, sorted. A node's list is as long as its degree."""
    return edges.groupBy("caller_id").agg(F.sort_array(F.collect_set("callee_id")).alias("callees"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per caller: calls (with duplicates) and distinct callees."""
    return edges.groupBy("caller_id").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("callee_id").alias("callees"))


def _pairs(edges: DataFrame) -> DataFrame:
    pairs = edges.filter("caller_id is not null and callee_id is not null")
    return pairs.select(F.col("caller_id").cast("long"), F.col("callee_id").cast("long")).distinct()


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long")).filter("id is not null").distinct()


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the seeds and all they call, directly or not. seeds: (id). A round goes HOPS calls far."""
    return _reached(seeds, written(_pairs(edges)))


def _reached(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """reachable over pairs (a written table of distinct ones)."""
    seen = Rounds()
    frontier = seen.add(_ids(seeds).withColumn("step", F.lit(HOPS)))
    n = total = frontier.count()
    while n:
        steps = [frontier.select("id")]
        for i in range(HOPS):
            steps.append(_apart(steps[-1], n if i == 0 else None).join(pairs, F.col("id") == F.col("caller_id")).select(F.col("callee_id").alias("id")).distinct())
        reached = reduce(DataFrame.union, [s.withColumn("step", F.lit(i)) for i, s in enumerate(steps) if i]).groupBy("id").agg(F.min("step").alias("step"))
        new = seen.add(reached.join(_apart(seen.all().select("id"), total), "id", "left_anti"))
        frontier = new.filter(F.col("step") == HOPS)  # the others' callees are reached already
        n, total = frontier.count(), total + new.count()
    return seen.all().select("id")


def affected(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the seeds and all that call them, directly or not."""
    return reachable(seeds, reverse(edges))


def _scc_local(graph: dict[int, list[int]]) -> dict[int, int]:
    """Smallest member of each node's component: path-based search with an explicit stack."""
    order: dict[int, int] = {}
    done: dict[int, int] = {}
    path: list[int] = []
    borders: list[int] = []
    for root in graph:
        if root in order:
            continue
        work = [(root, iter(graph[root]))]
        order[root] = len(order)
        path.append(root)
        borders.append(root)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in order:
                    order[b] = len(order)
                    path.append(b)
                    borders.append(b)
                    work.append((b, iter(graph[b])))
                    break
                if b not in done:
                    while order[borders[-1]] > order[b]:
                        borders.pop()
            else:
                work.pop()
                if borders[-1] == node:
                    borders.pop()
                    members = []
                    while True:
                        members.append(path.pop())
                        if members[-1] == node:
                            break
                    least = min(members)
                    done.update(dict.fromkeys(members, least))
    return done


def _contracted(pairs: DataFrame, tasks: int) -> DataFrame:
    """(id, name): members of components that lie inside one task's edges, by their smallest member.

    Edges are dealt by ranges of callers, as ids near each other mostly call each other. A caller with
    very many callees may fall to two tasks, which may name it differently; any of the names is a member of its component.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls: dict[int, list[int]] = {}
        for rows in batches:
            for a, b in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                calls.setdefault(a, []).append(b)
                calls.setdefault(b, [])
        found = [(a, b) for a, b in _scc_local(calls).items() if a != b]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["id", "name"])

    dealt = pairs.select("caller_id", "callee_id")
    dealt = dealt.repartitionByRange(tasks, "caller_id", "callee_id") if tasks > 1 else dealt.repartition(1)
    return dealt.mapInArrow(solve, "id long, name long").groupBy("id").agg(F.min("name").alias("name"))


def _renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """pairs between the new names, without those inside one."""
    a, b = names.select(F.col("id").alias("caller_id"), F.col("name").alias("x")), names.select(F.col("id").alias("callee_id"), F.col("name").alias("y"))
    met = pairs.join(_apart(a), "caller_id", "left").join(_apart(b), "callee_id", "left")
    return met.select(F.coalesce("x", "caller_id").alias("caller_id"), F.coalesce("y", "callee_id").alias("callee_id")).filter("caller_id <> callee_id").distinct()


def _trimmed(pairs: DataFrame) -> DataFrame:
    """pairs whose caller is called and whose callee calls; other nodes are components of their own."""
    kept = pairs.join(_apart(pairs.select(F.col("callee_id").alias("caller_id")).distinct()), "caller_id", "left_semi")
    return written(kept.join(_apart(pairs.select(F.col("caller_id").alias("callee_id")).distinct()), "callee_id", "left_semi").select("caller_id", "callee_id"))


def _followed(names: DataFrame | None, more: DataFrame) -> DataFrame:
    """names (id, name) carried on by further ones."""
    if names is None:
        return more
    further = names.join(_apart(more.select(F.col("id").alias("name"), F.col("name").alias("n"))), "name", "left").select("id", F.coalesce("n", "name").alias("name"))
    return written(further.unionByName(more.join(_apart(names), "id", "left_anti")))


def _spread(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """labels (id, color): each node's smallest color among itself and all that reach it."""
    while True:
        came = _apart(labels).join(pairs, F.col("id") == F.col("caller_id")).groupBy("callee_id").agg(F.min("color").alias("c"))
        after = labels.join(_apart(came), F.col("id") == F.col("callee_id"), "left").select("id", F.least("color", F.coalesce("c", "color")).alias("color"), (F.col("c") < F.col("color")).alias("less"))
        after = written(after)
        labels = after.select("id", "color")
        if after.filter("less").isEmpty():
            return labels


def _by_color(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name) of the components that hold the smallest node of all that reach them, and the pairs that are left."""
    colors = _spread(nodes(pairs).withColumn("color", F.col("id")), pairs)
    by = _apart(colors)
    inside = pairs.join(by.select(F.col("id").alias("caller_id"), F.col("color").alias("x")), "caller_id").join(by.select(F.col("id").alias("callee_id"), F.col("color").alias("y")), "callee_id").filter("x = y")
    inside = written(inside.select("caller_id", "callee_id"))
    members = reachable(colors.filter("id = color").select("id"), reverse(inside))
    found = written(colors.join(_apart(members), "id", "left_semi").select("id", F.col("color").alias("name")))
    gone = _apart(found.select("id"))
    left = inside.join(gone.withColumnRenamed("id", "caller_id"), "caller_id", "left_anti").join(gone.withColumnRenamed("id", "callee_id"), "callee_id", "left_anti")
    return found, written(left.select("caller_id", "callee_id"))


def sccs(edges: DataFrame, vertices: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, scc_id): strongly connected components, named by their smallest member.

    vertices: further nodes (id), for those without edges. Each task contracts the components among its own task_edges
    edges; what is left is renamed, trimmed of nodes without callers or callees, and dealt to fewer tasks, until
    one task holds the rest. Where a round hardly shrinks the graph (long cycles across all tasks), a round of colors follows: the smallest
    id that reaches a node is its color, and of a color those that reach its root make a component. No table that grows with the graph
    is broadcast.
    """
    pairs = written(_pairs(edges))
    every = nodes(pairs) if vertices is None else nodes(pairs).union(_ids(vertices)).distinct()
    pairs, names = pairs.filter("caller_id <> callee_id"), None
    n = pairs.count()
    while n > task_edges:
        pairs, before = _trimmed(pairs), n
        n = pairs.count()
        if n > 0.8 * before:
            break
    while n:
        tasks = -(-n // task_edges)
        names = _followed(names, found := written(_contracted(pairs, tasks)))
        if tasks == 1:
            break
        pairs = _trimmed(_trimmed(written(_renamed(pairs, found))))
        if pairs.count() > 0.8 * n:
            found, pairs = _by_color(pairs)
            names = _followed(names, found)
        n = pairs.count()
    if names is None:
        return every.select("id", F.col("id").alias("scc_id"))
    return every.join(_apart(names), "id", "left").select("id", F.coalesce("name", "id").alias("scc_id"))


def recursive(components: DataFrame) -> DataFrame:
    """(id): members of components with several members; a self call alone is not recursion."""
    big = components.groupBy("scc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return components.join(_apart(big), "scc_id", "left_semi").select("id")


def _labelled(edges: DataFrame, components: DataFrame) -> DataFrame:
    a = components.select(F.col("id").alias("caller_id"), F.col("scc_id").alias("src"))
    b = components.select(F.col("id").alias("callee_id"), F.col("scc_id").alias("dst"))
    return edges.join(_apart(a), "caller_id").join(_apart(b), "callee_id")


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst): distinct edges between different components."""
    return _labelled(edges, components).filter("src <> dst").select("src", "dst").distinct()


def external_callees(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc_id, callee_id): distinct callees of a component outside it."""
    return _labelled(edges, components).filter("src <> dst").select(F.col("src").alias("scc_id"), "callee_id").distinct()


def levels(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc_id, level): longest way to a leaf of the condensation; leaves have level 0."""
    found = _levels(written(condensation(edges, components)), components.select("scc_id").distinct())
    if found is None:
        raise ValueError("the condensation has a cycle")
    return found


def _levels(dag: DataFrame, every: DataFrame) -> DataFrame | None:
    """levels of every (scc_id) over dag (src, dst; a written table); None if it has a cycle.

    Those with level L + 1 or more are the callers of those with level L or more, so one join gives
    each next set; a round makes HOPS of them. A component's level is the last set that has it. Each set lies within
    the one before, so a round reads only calls of the last set.
    """
    sets, level = Rounds(), 0
    n = sets.add(every.withColumn("level", F.lit(0))).count()
    while n:
        steps = [dag.select(F.col("src").alias("scc_id")).distinct()]
        while len(steps) < HOPS:
            last = _apart(steps[-1].withColumnRenamed("scc_id", "dst"), n)
            steps.append(dag.join(last, "dst", "left_semi").select(F.col("src").alias("scc_id")).distinct())
        made = sets.add(reduce(DataFrame.union, [s.withColumn("level", F.lit(level + i)) for i, s in enumerate(steps, 1)]))
        level += HOPS
        last, before = made.filter(F.col("level") == level), n
        n = last.count()
        if n == before:
            return None
        if n:
            dag = written(dag.join(_apart(last.select(F.col("scc_id").alias("dst")), n), "dst", "left_semi").select("src", "dst"))
    return sets.all().groupBy("scc_id").agg(F.max("level").alias("level"))


def placed(pairs: DataFrame, every: DataFrame) -> DataFrame:
    """(id, scc_id, level, loop: whether its component has several members) of every (id), over pairs of these (a written table of distinct ones).

    Levels come first, as most call graphs have no cycle and need no components then.
    """
    found = _levels(pairs.filter("caller_id <> callee_id").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")), every.select(F.col("id").alias("scc_id")))
    if found is not None:
        return found.select(F.col("scc_id").alias("id"), "scc_id", "level", F.lit(False).alias("loop"))
    components = written(sccs(pairs, every))
    both = components.join(_apart(levels(pairs, components)), "scc_id").join(_apart(recursive(components).withColumn("loop", F.lit(True))), "id", "left")
    return both.select("id", "scc_id", "level", F.coalesce("loop", F.lit(False)).alias("loop"))


def topological(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(position, scc_id, level): callees first; inside a level by name. Numbers come from counts of sorted partitions."""
    return numbered(levels(edges, components), ["level", "scc_id"], "position")


def stats(edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges (with duplicates), sccs, recursive_sccs, largest_scc."""
    sizes = components.groupBy("scc_id").agg(F.count(F.lit(1)).alias("n"))
    of_sccs = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("sccs"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("recursive_sccs"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_scc"))
    return of_sccs.join(edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True)).select("nodes", "edges", "sccs", "recursive_sccs", "largest_scc")


def entries(edges: DataFrame, relevant: DataFrame) -> DataFrame:
    """(id): relevant nodes that no other relevant node calls; the smallest if there is none."""
    r = relevant.select(F.col("id").cast("long")).distinct()
    inside = edges.filter("caller_id <> callee_id").join(r.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")
    free = r.join(inside.select(F.col("callee_id").alias("id")).distinct(), "id", "left_anti")
    fallback = r.agg(F.min("id").alias("id")).filter("id is not null").join(free.limit(1).withColumnRenamed("id", "x"), F.lit(True), "left_anti")
    return free.union(fallback)


def aliases(units: DataFrame, members: DataFrame) -> DataFrame:
    """(name, alias_of): sets that are strict subsets of another, with their smallest superset.

    units: (name, pos), members: (name, member); ties go to the first in pos. Equal sets are one class, found by
    their size and two sums of hashes, and its first name stands for it. A superset holds the set's rarest member, so a
    class meets those that hold that one only, and is compared with them member by member.
    """
    m = written(members.filter("member is not null").distinct().join(units, "name"))
    sums = [F.sum(F.xxhash64(F.lit(i), "member").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    sets = written(m.groupBy("name").agg(F.first("pos").alias("pos"), F.count(F.lit(1)).alias("size"), *sums))
    classes = written(sets.groupBy("size", "s1", "s2").agg(F.min_by("name", F.struct("pos", "name")).alias("rep"), F.min("pos").alias("pos")))
    held = written(m.select("name", "member").join(classes.select(F.col("rep").alias("name"), "size", "pos"), "name"))
    counts = held.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    rare = held.join(counts, "member").groupBy("name").agg(F.min(F.struct("n", "member")).alias("r"), F.first("size").alias("own"))
    a = rare.select("name", "own", F.col("r.member").alias("member"))
    pairs = a.join(held.select("member", F.col("name").alias("other"), "size", "pos"), "member").filter("size > own").drop("member")
    rows = written(pairs).join(held.select("name", "member"), "name")
    both = rows.join(held.select(F.col("name").alias("other"), "member"), ["other", "member"], "left_semi").groupBy("name", "other").agg(F.count(F.lit(1)).alias("both"), F.first("own").alias("own"), F.first("size").alias("size"), F.first("pos").alias("pos"))
    best = both.filter("both = own").groupBy("name").agg(F.min_by("other", F.struct(F.col("size") - F.col("own"), "pos", "other")).alias("alias_of"))
    known = classes.join(best, classes["rep"] == best["name"]).select("size", "s1", "s2", "alias_of")
    return sets.join(known, ["size", "s1", "s2"]).select("name", "alias_of")


def confirm(candidates: DataFrame, known: DataFrame, alias: DataFrame) -> DataFrame:
    """Candidates (name) that may alias a known name, or a confirmed one: a fixpoint. alias: (a, b), either way."""
    either = alias.select("a", "b").union(alias.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(either.join(_apart(candidates.select(F.col("name").alias("b")).distinct()), "b", "left_semi").select("a", "b"))
    found = candidates.join(known, "name", "left_semi").select("name").distinct()
    frontier = written(known.select("name").union(found).distinct())
    confirmed = Rounds()
    n, total = frontier.count(), confirmed.add(found).count()
    while n:
        near = _apart(frontier, n).join(both, F.col("name") == F.col("a")).select(F.col("b").alias("name")).distinct()
        frontier = confirmed.add(near.join(_apart(confirmed.all(), total), "name", "left_anti"))
        n = frontier.count()
        total += n
    return confirmed.all()
