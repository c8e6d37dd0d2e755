"""Bottom-up summaries: passes over the levels of the condensed call graph, driven by what changed.

A pass turns functions and their callees' payloads into payloads of its own type. One traversal runs several passes. It goes
level by level from the leaves; a level is one plan per pass over the functions that have to run there.

Which have to: without `dirty`, all without a valid stored payload. With it, the dirty ones, and from there on callers of
functions whose payload came out different from the stored one; equal payloads stop the change. Levels and
components are worked out for the dirty functions and what calls them only, and functions, calls and stored payloads are
cut down to these once, in folders by level, so a run costs what the change can reach at most, and computes what it does reach.

Members of recursive components run again where a callee in the component changed, at most ITERATIONS times. Payloads that report an
error are handed to callers but not stored, and don't spread. A function may name callees whose payload is incomplete:
those run again, then the function, once; if it still names some it has no result. Functions without source never run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, merge
from ..storage import Rounds, written

ITERATIONS = 3


def _all_stored(functions: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select("function_id")


def _upserted(table: DataFrame, new: DataFrame) -> DataFrame:
    return merge.upsert(table, new, ["function_id"])


@dataclass(frozen=True)
class Pass:
    """A pass and its hooks.

    payload: the type of its payloads, as DDL.
    summarise: rows of functions with function_id, `callees` (array of callee_id, name, payload, by id) and `previous` (the
        payload so far, or null) -> (function_id, payload), and if it likes error (boolean), needs (array of callee ids), changed (boolean).
    cached: (functions, stored payloads) -> (function_id) whose stored payload is valid; all by default.
    merge: (payload so far, new one) -> the payload to keep of a function that runs again in its component.
    store: (table, new rows) -> the table's next version; both (function_id, payload).
    """

    name: str
    payload: str
    summarise: Callable[[DataFrame], DataFrame]
    cached: Callable[[DataFrame, DataFrame], DataFrame] = _all_stored
    merge: Callable[[Column, Column], Column] = lambda old, new: new
    store: Callable[[DataFrame, DataFrame], DataFrame] = _upserted


class _Scope:
    """What a run may touch, in folders by level.

    edges: distinct ones, a written table; ids: of the functions that it concerns, if not all; closed: these include all callers of theirs.
    """

    def __init__(self, functions: DataFrame, edges: DataFrame, ids: DataFrame | None, closed: bool) -> None:
        every = functions.select(F.col("id").cast("long")).distinct()
        self.ids = written(every if ids is None else every.join(graph._apart(ids), "id", "left_semi"))
        strangers = not graph.nodes(edges).join(graph._apart(self.ids if ids is None else every), "id", "left_anti").isEmpty()
        inside, known = edges, graph._apart(self.ids)
        if strangers or not (ids is None or closed):
            inside = inside.join(known.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")
        if strangers or ids is not None:
            inside = inside.join(known.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
        inside = edges if inside is edges else written(inside.select("caller_id", "callee_id"))
        self.placed = written(graph.placed(inside, self.ids))
        self.loops = not self.placed.filter("loop").isEmpty()
        self.names = written(functions.select(F.col("id").cast("long").alias("callee_id"), F.col("name").alias("callee")))
        at = graph._apart(self.placed.select("id", "level"))
        self.calls = written(edges.join(at.withColumnRenamed("id", "caller_id"), "caller_id").select("caller_id", "callee_id", "level"), "level")
        runnable = functions.filter(F.coalesce("source", F.lit("")) != "") if "source" in functions.columns else functions
        self.functions = written(runnable.join(graph._apart(self.placed), "id").withColumnRenamed("id", "function_id"), "level")
        self.callees = self.calls.select(F.col("callee_id").alias("function_id")).union(self.ids.select(F.col("id").alias("function_id"))).distinct()


class _Work:
    """One pass in one run."""

    def __init__(self, p: Pass, scope: _Scope, have: DataFrame | None, dirty: DataFrame | None, force: bool) -> None:
        self.p, self.scope, self.spread = p, scope, dirty is not None
        self.needs = False
        self.whole = dirty is None and (force or have is None)  # all functions run
        empty = scope.ids.sparkSession.sql(f"SELECT CAST(NULL AS BIGINT) AS function_id, CAST(NULL AS {p.payload}) AS payload WHERE false")
        self.base = empty if have is None else written(have.select(F.col("function_id").cast("long"), F.col("payload").cast(p.payload)).join(graph._apart(scope.callees), "function_id", "left_semi"))
        where = scope.functions.select("function_id", "level")
        start = where if force or have is None else where.join(graph._apart(p.cached(scope.functions, self.base).select("function_id").distinct()), "function_id", "left_anti")
        if dirty is not None:
            start = start.union(where.join(graph._apart(dirty.select(F.col("id").alias("function_id")).distinct()), "function_id", "left_semi"))
        self.marks, self.results, self.retried = Rounds(), Rounds(), False
        self.marks.add(start)
        self.results.add(empty.select("function_id", "payload", F.lit(False).alias("error"), F.lit(False).alias("changed"), F.lit(0).cast("long").alias("place")))
        self.place = 0

    def levels(self) -> DataFrame:
        return self.marks.all().select("level").distinct()

    def found(self) -> DataFrame:
        """(function_id, payload, error, changed) of what ran, the last of each function."""
        rows = self.results.all()
        if not self.retried:
            return rows.drop("place")
        last = rows.groupBy("function_id").agg(F.max_by(F.struct("payload", "error", "changed"), "place").alias("r"))
        return last.select("function_id", "r.*")

    def _summarised(self, ids: DataFrame | None, level: int | None, working: DataFrame | None = None) -> DataFrame:
        """(function_id, payload, error, needs, changed, old) of functions, from the payloads so far. level: theirs, if it's one; ids None: all of it."""
        at = F.lit(True) if level is None else F.col("level") == level
        calls, rows = self.scope.calls.filter(at).select("caller_id", "callee_id"), self.scope.functions.filter(at)
        if ids is not None:
            ids = graph._apart(ids.select("function_id"))
            calls, rows = calls.join(ids.withColumnRenamed("function_id", "caller_id"), "caller_id", "left_semi"), rows.join(ids, "function_id", "left_semi")
        layers = [x for x in (working, self.found(), self.base) if x is not None]
        for i, x in enumerate(layers):  # joins on callees share one shuffle of the calls
            calls = calls.join(graph._apart(x.select(F.col("function_id").alias("callee_id"), F.col("payload").alias(f"_{i}"))), "callee_id", "left")
        calls = calls.withColumn("payload", F.coalesce(*(f"_{i}" for i in range(len(layers))))).filter("payload is not null")
        calls = calls.join(graph._apart(self.scope.names), "callee_id", "left").select("caller_id", "callee_id", "callee", "payload")
        called = calls.groupBy(F.col("caller_id").alias("function_id")).agg(F.sort_array(F.collect_list(F.struct("callee_id", F.col("callee").alias("name"), "payload"))).alias("callees"))
        rows = rows.join(graph._apart(called), "function_id", "left")
        rows = rows.withColumn("callees", F.coalesce("callees", F.array().cast(f"array<struct<callee_id:bigint,name:string,payload:{self.p.payload}>>")))
        before = self.base if working is None else working.select("function_id", "payload").unionByName(self.base.join(working, "function_id", "left_anti"))
        old = graph._apart(before.select("function_id", F.col("payload").alias("previous")))
        made = self.p.summarise(rows.join(old, "function_id", "left"))
        self.needs = "needs" in made.columns
        given = {"error": F.lit(False), "needs": F.array().cast("array<bigint>"), "changed": F.lit(True)}
        made = made.select("function_id", F.col("payload").cast(self.p.payload), *(F.coalesce(c, d).alias(c) if c in made.columns else d.alias(c) for c, d in given.items()))
        made = made.join(old, "function_id", "left")
        if working is not None:
            made = made.withColumn("payload", F.when(F.col("previous").isNull(), F.col("payload")).otherwise(self.p.merge(F.col("previous"), F.col("payload"))))
        same = F.col("payload").eqNullSafe(F.col("previous"))
        return made.withColumn("changed", F.col("changed") & ~F.col("error") & ~same).drop("previous")

    def _completed(self, ids: DataFrame | None, level: int, working: DataFrame | None = None) -> DataFrame:
        """_summarised; callees that were named as incomplete run again before those that named them."""
        made = self._summarised(ids, level, working)
        if not self.needs:
            return made.drop("needs")
        made = written(made)
        lacking = made.filter(F.size("needs") > 0)
        if lacking.isEmpty():
            return made.drop("needs")
        again = lacking.select(F.explode("needs").alias("function_id")).distinct().join(self.scope.functions.select("function_id"), "function_id", "left_semi")
        self._keep(written(self._summarised(again, None)).drop("needs"))
        self.retried = True
        second = written(self._summarised(lacking.select("function_id"), level, working)).filter(F.size("needs") == 0)
        return made.filter(F.size("needs") == 0).unionByName(second).drop("needs")

    def _keep(self, made: DataFrame) -> DataFrame:
        self.place += 1
        return self.results.add(made.select("function_id", "payload", "error", "changed", F.lit(self.place).cast("long").alias("place")))

    def run_level(self, level: int) -> None:
        todo = self.marks.all().filter(F.col("level") == level).select("function_id").distinct()
        if not self.scope.loops:
            self._finish(self._completed(None if self.whole else todo, level), level)
            return
        todo = written(todo.join(self.scope.placed.select(F.col("id").alias("function_id"), "loop", "scc_id"), "function_id"))
        self._finish(self._completed(todo.filter("not loop"), level), level)
        ids, working = todo.filter("loop").select("function_id"), None
        if ids.isEmpty():
            return
        members = self.scope.placed.filter((F.col("level") == level) & F.col("loop")).select("id", "scc_id")
        for i in range(ITERATIONS):
            made = written(self._completed(ids, level, working))
            if working is not None:
                kept = working.join(made.select("function_id", F.col("changed").alias("now")), "function_id", "left_anti")
                made = made.join(working.select("function_id", F.col("changed").alias("was")), "function_id", "left").withColumn("now", F.col("changed"))
                made = made.withColumn("changed", F.col("changed") | F.coalesce("was", F.lit(False))).drop("was")
                working = written(made.unionByName(kept.withColumn("now", F.lit(False))))
            else:
                working = written(made.withColumn("now", F.col("changed")))
            moved = working.filter("now").select(F.col("function_id").alias("callee_id"))
            near = self.scope.calls.filter(F.col("level") == level).join(moved, "callee_id", "left_semi").select("caller_id", "callee_id")
            inside = near.join(members.select(F.col("id").alias("caller_id"), F.col("scc_id").alias("a")), "caller_id").join(members.select(F.col("id").alias("callee_id"), F.col("scc_id").alias("b")), "callee_id").filter("a = b")
            ids = written(inside.select(F.col("caller_id").alias("function_id")).distinct())
            working = working.drop("now")
            if i + 1 == ITERATIONS or ids.isEmpty():
                break
        self._finish(working, level)

    def _finish(self, made: DataFrame, level: int) -> None:
        made = self._keep(made)
        if self.spread:
            moved = made.filter("changed").select(F.col("function_id").alias("callee_id"))
            callers = self.scope.calls.filter(F.col("level") > level).join(graph._apart(moved), "callee_id", "left_semi")
            self.marks.add(callers.select(F.col("caller_id").alias("function_id"), "level").distinct())

    def result(self) -> DataFrame:
        ran = self.found().withColumn("ran", F.lit(True))
        kept = self.base.join(graph._apart(self.scope.ids.withColumnRenamed("id", "function_id")), "function_id", "left_semi").join(graph._apart(ran), "function_id", "left_anti")
        return ran.unionByName(kept.select("function_id", "payload", F.lit(False).alias("error"), F.lit(False).alias("changed"), F.lit(False).alias("ran")))


def calls(edges: DataFrame) -> DataFrame:
    """edges as distinct pairs without nulls, a written table: for several runs over the same ones."""
    return written(graph._pairs(edges))


def run(functions: DataFrame, edges: DataFrame, passes: list[Pass], have: dict[str, DataFrame] | None = None, dirty: dict[str, DataFrame] | None = None, targets: DataFrame | None = None, force: bool = False, clean: bool = False) -> dict[str, DataFrame]:
    """By pass: (function_id, payload, error, changed, ran) of the functions that the run concerns.

    functions: (id, name, ...); have: stored (function_id, payload) by pass; dirty: (id) by pass; targets: (id), these alone
    and without spreading; force: run whatever is stored; clean: edges come from `calls`. `changed` is against the stored payload.
    """
    have = have or {}
    edges, ids = edges if clean else calls(edges), None
    if targets is not None:
        ids, dirty = targets.select(F.col("id").cast("long")).distinct(), None
    elif dirty is not None:
        ids = graph._reached(reduce(DataFrame.union, [d.select(F.col("id").cast("long")) for d in dirty.values()]), graph.reverse(edges))
    scope = _Scope(functions, edges, ids, dirty is not None)
    none = scope.ids.limit(0)
    works = [_Work(p, scope, have.get(p.name), None if dirty is None else dirty.get(p.name, none), force) for p in passes]

    def open_levels(after: int) -> list[int]:  # as many as the graph is deep
        found = reduce(DataFrame.union, [w.levels() for w in works]).filter(F.col("level") > after).distinct()
        return sorted(r.level for r in found.collect())

    todo = open_levels(-1)
    while todo:
        level = todo.pop(0)
        for w in works:
            w.run_level(level)
        if dirty is not None:
            todo = open_levels(level)
    return {w.p.name: w.result() for w in works}


def stored(passes: list[Pass], have: dict[str, DataFrame], results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The next version of each pass's table: rows that ran, changed and report no error."""
    return {p.name: p.store(have[p.name], results[p.name].filter("ran and changed and not error").select("function_id", "payload")) for p in passes}


# --- deterministic passes: rules in place of a language model


def _largest(field: str, otherwise: Column) -> Column:
    """The largest of a field of the callees' payloads."""
    return F.coalesce(F.array_max(F.transform("callees", lambda c: c["payload"][field])), otherwise)


def depth_pass() -> Pass:
    """The longest chain of calls below a function, and how many it calls."""

    def summarise(rows: DataFrame) -> DataFrame:
        return rows.select("function_id", F.struct((_largest("depth", F.lit(-1)) + 1).cast("int").alias("depth"), F.size("callees").cast("long").alias("calls")).alias("payload"))

    return Pass("depth", "struct<depth:int,calls:bigint>", summarise)


def weight_pass(column: str = "weight") -> Pass:
    """The largest weight of a function and all below it."""

    def summarise(rows: DataFrame) -> DataFrame:
        own = F.col(column).cast("double")
        return rows.select("function_id", F.struct(F.greatest(own, _largest("top", own)).alias("top")).alias("payload"))

    return Pass("weight", "struct<top:double>", summarise)


def _sites(pattern: str, text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern)).cast("long")


def allocation_pass(pattern: str, text: str = "source") -> Pass:
    """sites: calls of allocators in the text; allocates: here or below; via: the callees that do."""

    def summarise(rows: DataFrame) -> DataFrame:
        via = F.transform(F.filter("callees", lambda c: c["payload"]["allocates"]), lambda c: c["callee_id"])
        both = rows.select("function_id", _sites(pattern, text).alias("sites"), via.alias("via"))
        return both.select("function_id", F.struct("sites", ((F.col("sites") > 0) | (F.size("via") > 0)).alias("allocates"), "via").alias("payload"))

    return Pass("allocation", "struct<sites:bigint,allocates:boolean,via:array<bigint>>", summarise, merge=lambda old, new: new)


def free_pass(pattern: str, text: str = "source") -> Pass:
    """sites: calls of deallocators in the text; far: calls down to the nearest one, null where none is below."""

    def summarise(rows: DataFrame) -> DataFrame:
        nearest = F.array_min(F.transform("callees", lambda c: c["payload"]["far"])) + 1
        both = rows.select("function_id", _sites(pattern, text).alias("sites"), nearest.alias("below"))
        return both.select("function_id", F.struct("sites", F.when(F.col("sites") > 0, 0).otherwise(F.col("below")).cast("int").alias("far")).alias("payload"))

    return Pass("free", "struct<sites:bigint,far:int>", summarise)


def memsafe_pass(pattern: str, text: str = "source") -> Pass:
    """own: unchecked operations in the text; worst: the most of them on one chain of calls."""

    def summarise(rows: DataFrame) -> DataFrame:
        both = rows.select("function_id", _sites(pattern, text).alias("own"), _largest("worst", F.lit(0)).alias("below"))
        return both.select("function_id", F.struct("own", (F.col("own") + F.col("below")).cast("long").alias("worst")).alias("payload"))

    return Pass("memsafe", "struct<own:bigint,worst:bigint>", summarise)
