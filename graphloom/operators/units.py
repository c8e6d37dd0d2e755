"""Link units: order of dependence, stores of dependencies, objects and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import written
from .graph import aliases


def index(units: DataFrame) -> DataFrame:
    """(key, name): units by output and by its file name; the last one wins."""
    keys = units.select("pos", "name", F.explode(F.array_distinct(F.array("output", paths.base(F.col("output"))))).alias("key")).filter("key is not null")
    return keys.groupBy("key").agg(F.max_by("name", "pos").alias("name"))


def order(units: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(name, level): units after all they depend on. dependencies: (name, needs). A cycle is an error."""
    deps = written(dependencies.join(units.select(F.col("name").alias("needs")), "needs", "left_semi").select("name", "needs").distinct())
    left, level, out = written(units.select("name")), 0, None
    while not left.isEmpty():
        blocked = deps.join(left.withColumnRenamed("name", "needs"), "needs", "left_semi").select("name").distinct()
        now = written(left.join(blocked, "name", "left_anti").withColumn("level", F.lit(level)))
        if now.isEmpty():
            raise ValueError("units depend on each other in a cycle")
        out = now if out is None else written(out.union(now))
        left = written(left.join(now, "name", "left_anti"))
        level += 1
    return out


def dependency_stores(units: DataFrame) -> DataFrame:
    """(name, db_path): stores of a unit's direct dependencies that have one."""
    wanted = units.select("name", F.explode("link_deps").alias("key"))
    found = wanted.join(index(units).withColumnRenamed("name", "dep"), "key")
    return found.join(units.select(F.col("name").alias("dep"), "db_path"), "dep").filter("db_path is not null").select("name", "db_path").distinct()


def with_aliases(units: DataFrame) -> DataFrame:
    """units with alias_of set where a unit's files are a strict subset of another's; idempotent.

    Units with objects, dependencies or an alias already are left as they are.
    """
    plain = units.filter("coalesce(size(objects), 0) <= 0 and coalesce(size(link_deps), 0) <= 0 and alias_of is null and coalesce(size(bc_files), 0) > 0")
    found = aliases(plain.select("name", "pos"), plain.select("name", F.explode("bc_files").alias("member")))
    return units.join(found.withColumnRenamed("alias_of", "_a"), "name", "left").withColumn("alias_of", F.coalesce("alias_of", "_a")).select(*units.columns)


def with_alias_stores(units: DataFrame) -> DataFrame:
    """units with the store of their alias where they have none."""
    other = units.select(F.col("name").alias("alias_of"), F.col("db_path").alias("_p"))
    return units.join(other, "alias_of", "left").withColumn("db_path", F.coalesce("db_path", "_p")).select(*units.columns)


def sources_of_objects(objects: DataFrame, commands: DataFrame, build: str) -> DataFrame:
    """(object, file): by output path, by its path below the build folder, else by a stem that one command has."""
    from .resolve import ranked

    full = commands.select(F.col("output").alias("object"), F.col("file").alias("value")).filter("object is not null").dropDuplicates(["object"])
    below = full.withColumn("object", F.regexp_replace("object", f"^{build.rstrip('/')}/", "")).dropDuplicates(["object"])
    stem = lambda c: F.substring_index(paths.stem(c), "-lib-", -1)
    by_stem = commands.groupBy(stem(F.col("file")).alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("value")).filter("n = 1")
    unique = objects.select("object", stem(F.col("object")).alias("stem")).join(by_stem, "stem").select("object", "value").dropDuplicates(["object"])
    return ranked(objects.select("object").distinct(), [("output", full), ("below", below), ("stem", unique)], "object").select("object", F.col("value").alias("file"), "tier")


def assembly_of_objects(objects: DataFrame, commands: DataFrame) -> DataFrame:
    """(object, file): objects that come from assembly: by their full output path, else by file name (the last command wins)."""
    asm = commands.filter(F.rlike(F.col("file"), F.lit(r"\.[sS]$"))).withColumn("pos", F.monotonically_increasing_id())
    full = asm.groupBy(F.col("output").alias("object")).agg(F.max_by("file", "pos").alias("f1"))
    base = asm.groupBy(paths.base(F.col("output")).alias("b")).agg(F.max_by("file", "pos").alias("f2"))
    o = objects.select("object").distinct().withColumn("b", paths.base(F.col("object")))
    return o.join(full, "object", "left").join(base, "b", "left").select("object", F.coalesce("f1", "f2").alias("file")).filter("file is not null")


def split_by_key(findings: DataFrame, unavoidable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, unavoidable) findings by their key that doesn't depend on lines."""
    from ..functions.text import finding_key

    keyed = findings.withColumn("_k", finding_key(F.col("type"), F.col("file"), F.col("pattern")))
    keys = unavoidable.select(F.col("key").alias("_k")).distinct()
    return keyed.join(keys, "_k", "left_anti").drop("_k"), keyed.join(keys, "_k", "left_semi").drop("_k")
