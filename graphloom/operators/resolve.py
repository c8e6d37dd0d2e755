"""Entity resolution between call graphs that were produced apart, and joins by position and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import base_name, normal_callee, split_key, without_abi_tags, without_anonymous, without_return_type, without_templates
from .intervals import best


def by_place(wanted: DataFrame, functions: DataFrame) -> DataFrame:
    """(key, id): of functions with the same name and path ending, the one with most lines in common, else the nearest.

    wanted: (key, name, file, line_start, line_end). Ties go to the smallest id. Path endings are keys: a function has one of
    each length that is asked for with its name.
    """
    end = F.when(F.coalesce("line_end", F.lit(0)) == 0, F.col("line_start")).otherwise(F.col("line_end"))
    w = wanted.filter("file <> '' and line_start > 0").select("key", "name", paths.suffix(F.col("file"), 2).alias("tail"), F.col("line_start").alias("a"), end.alias("b"))
    lengths = w.select("name", F.length("tail").alias("n")).distinct()
    f = functions.select("id", "name", "file_path", F.col("line_start").alias("c"), F.col("line_end").alias("d")).join(lengths, "name").filter(F.length("file_path") >= F.col("n"))
    return best(w, f.select("id", "name", F.expr("right(file_path, n)").alias("tail"), "c", "d"), ["name", "tail"])


def _by_name(wanted: DataFrame, functions: DataFrame, name: Column) -> DataFrame:
    """(key, id) by a name that only one function has, or else by place among those that have it."""
    counts = functions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    named = wanted.withColumn("name", name).filter("name <> ''")
    single = named.join(counts.filter("n = 1"), "name").select("key", "id")
    several = named.join(counts.filter("n > 1").select("name"), "name", "left_semi")
    return single.union(by_place(several, functions))


def cascade(wanted: DataFrame, functions: DataFrame) -> DataFrame:
    """(key, id, strategy): each key of a foreign call graph with the best function for it; id null makes a stub.

    wanted: (key, file, line_start, line_end, demangled), key being `path:name` or `name`; demangled
    may be null. Each strategy sees all keys; the first that answers wins, so the plan is a union of
    joins and one ranking, not one pass after the other.
    """
    parts = split_key(F.col("key"))
    rows = wanted.select("key", "demangled", "line_start", "line_end", paths.without_container(parts["file"]).alias("own"), normal_callee(parts["name"]).alias("name"), paths.without_container(F.coalesce("file", parts["file"], F.lit(""))).alias("file"))
    f = functions.select("id", "name", "file_path", "line_start", "line_end")
    exact = rows.filter("own is not null").join(f.select("id", F.col("name").alias("n"), "file_path"), (F.col("name") == F.col("n")) & (F.col("own") == F.col("file_path"))).groupBy("key").agg(F.max("id").alias("id"))
    ends = rows.filter("own is not null").join(f.select("id", F.col("name").alias("n"), "file_path"), F.col("name") == F.col("n")).filter(F.col("file_path").endswith(paths.suffix(F.col("own"))))
    ends = ends.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").select("key", "id")
    plain = without_abi_tags(without_anonymous(without_return_type(F.substring_index("demangled", "(", 1))))
    mangled = rows.filter(F.col("name").startswith("_Z") & F.col("demangled").isNotNull())
    steps = [("file", exact), ("suffix", ends), ("name", _by_name(rows, f, F.col("name"))), ("demangled", _by_name(mangled, f, plain)), ("template", _by_name(mangled, f, without_templates(plain))), ("base", _by_name(mangled, f, base_name(F.col("demangled"))))]
    found = None
    for i, (name, df) in enumerate(steps):
        one = df.select("key", "id", F.lit(i).alias("rank"), F.lit(name).alias("strategy"))
        found = one if found is None else found.union(one)
    best = found.groupBy("key").agg(F.min(F.struct("rank", "id", "strategy")).alias("b")).select("key", "b.id", "b.strategy")
    return rows.select("key").distinct().join(best, "key", "left").select("key", "id", F.coalesce("strategy", F.lit("stub")).alias("strategy"))


def strategy_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def zipped(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th row of each key on the left with the i-th on the right; left rows without one stay."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*right_order)))
    return a.join(b, [key, "_i"], "left").drop("_i")


ANY = "*"


def signature_classes(callsites: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Call sites (callsite_id, class, size) and members (class, function_id), the factors of all their pairs.

    A class is a signature, with `=` before it, or ANY for call sites whose signature no candidate has. Its members are the candidates of
    that signature, or all of them, which stand under their own signature and are not repeated under ANY.
    """
    members = candidates.select(F.concat(F.lit("="), F.col("signature").cast("string")).alias("class"), F.col("id").alias("function_id"))
    sizes = members.filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    every = members.agg(F.count(F.lit(1)).alias("every"))
    sites = callsites.select(F.col("id").alias("callsite_id"), F.concat(F.lit("="), F.col("signature").cast("string")).alias("class"))
    met = sites.join(sizes, "class", "left").join(F.broadcast(every), F.lit(True))  # one row
    return met.select("callsite_id", F.when(F.col("n").isNull(), ANY).otherwise(F.col("class")).alias("class"), F.coalesce("n", "every").alias("size")), members


def candidates_of(asked: DataFrame, sites: DataFrame, members: DataFrame) -> DataFrame:
    """(callsite_id, function_id) of the call sites asked for (callsite_id): as many rows as their classes' sizes."""
    mine = sites.join(asked.select("callsite_id").distinct(), "callsite_id", "left_semi")
    some = mine.filter(F.col("class") != ANY).join(members, "class").select("callsite_id", "function_id")
    return some.union(mine.filter(F.col("class") == ANY).select("callsite_id").join(members.select("function_id"), F.lit(True)))


def by_signature(callsites: DataFrame, candidates: DataFrame) -> DataFrame:
    """(callsite_id, function_id) of all call sites; where these are many, keep to the factors."""
    sites, members = signature_classes(callsites, candidates)
    return candidates_of(sites, sites, members)


def import_summaries(target: DataFrame, source: DataFrame, present: DataFrame, force: bool = False) -> DataFrame:
    """Summaries of a dependency for target functions of the same name: (function_id, summary_json, ...).

    target: (id, name); source: (name, summary columns); present: (function_id) that have one already.
    """
    met = target.select(F.col("id").alias("function_id"), "name").join(source, "name").drop("name")
    return met if force else met.join(present, "function_id", "left_anti")


def remap_edges(edges: DataFrame, ids: DataFrame, existing: DataFrame) -> DataFrame:
    """A dependency's edges in the target's ids (old_id, new_id), without pairs that it has already."""
    a = ids.select(F.col("old_id").alias("caller_id"), F.col("new_id").alias("x"))
    b = ids.select(F.col("old_id").alias("callee_id"), F.col("new_id").alias("y"))
    new = edges.join(a, "caller_id").join(b, "callee_id").select(F.col("x").alias("caller_id"), F.col("y").alias("callee_id")).distinct()
    return new.join(existing, ["caller_id", "callee_id"], "left_anti")


def external_headers(functions: DataFrame, dependency: DataFrame) -> DataFrame:
    """(id, dep_id): stubs with a header and the dependency's function of that name, one with source before others.

    A name's function is chosen before the join, so that no stub meets all of its namesakes. Repeated stubs count once.
    """
    stubs = functions.filter("coalesce(source, '') = '' and decl_header is not null").select("id", "name")
    bare = F.coalesce("source", F.lit("")) == ""
    d = dependency.groupBy("name").agg(F.min(F.struct(bare.alias("bare"), F.col("id").alias("dep_id"))).alias("m"))
    return stubs.join(d, "name").groupBy("id").agg(F.min("m").alias("m")).select("id", "m.dep_id")


def single_project(headers: DataFrame, projects: DataFrame) -> DataFrame:
    """(header_path, dep_db_path): by file name, folder, or lib + file name; only where one project fits, its largest store."""
    stem = paths.stem(F.col("header_path"))
    folder = F.element_at(F.split("header_path", "/"), -2)
    keys = headers.select("header_path", F.explode(F.array(stem, F.when(F.size(F.split("header_path", "/")) > 1, folder), F.concat(F.lit("lib"), stem))).alias("project")).distinct()
    met = keys.join(projects, "project")
    return met.groupBy("header_path").agg(F.countDistinct("project").alias("n"), F.max_by("path", F.struct("size", "path")).alias("dep_db_path")).filter("n = 1").select("header_path", "dep_db_path")


def ranked(wanted: DataFrame, tiers: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """wanted with value and tier of the first tier that has its key. Each tier: (key, value), one row per key."""
    out, value, tier = wanted, F.lit(None).cast("string"), F.lit("missing")
    for name, df in tiers:
        out = out.join(df.select(key, F.col("value").alias(f"_{name}")), key, "left")
    for name, _ in reversed(tiers):
        value = F.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}")).otherwise(value)
        tier = F.when(F.col(f"_{name}").isNotNull(), F.lit(name)).otherwise(tier)
    return out.withColumns({"value": value, "tier": tier}).drop(*(f"_{name}" for name, _ in tiers))


def full_merge(runs: DataFrame, patches: DataFrame) -> DataFrame:
    """(challenge, runs, patches): findings of both kinds of truth side by side; either may be missing.

    Repeated findings of a run (file, line, function, issue_kind) count once.
    """
    keys = ["challenge", "file", "line", "function", "issue_kind"]
    a = runs.dropDuplicates(keys).groupBy("challenge").agg(F.count(F.lit(1)).alias("runs"))
    b = patches.groupBy("challenge").agg(F.count(F.lit(1)).alias("patches"))
    return a.join(b, "challenge", "full_outer").select("challenge", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("patches", F.lit(0)).alias("patches"))
