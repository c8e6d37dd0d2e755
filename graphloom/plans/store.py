"""Commands over a store of fact tables: what a user of the tool asks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_hash
from ..operators import graph, incremental, listing, lookup, merge
from ..schema import KEYS, PASS_TABLES, REVIEW_STATUSES, TABLES, VERIFY_UPSTREAM
from . import passes, stats


class Facts:
    """Fact tables under a folder, by name; each change writes a next version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, merge.Store(spark, root)

    def __getitem__(self, table: str) -> DataFrame:
        return self.store.read(table, TABLES[table])

    def put(self, table: str, df: DataFrame) -> None:
        self.store.write(table, df.select(*self.spark.createDataFrame([], TABLES[table]).columns))

    def tables(self) -> dict[str, DataFrame]:
        return {t: self[t] for t in TABLES}

    def upsert(self, table: str, new: DataFrame, keep: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> None:
        self.put(table, merge.upsert(self[table], new, KEYS[table], keep, fill))

    def insert_functions(self, new: DataFrame) -> None:
        """Functions by (name, signature, file_path): known ones keep their id, the others get the next ones; blocks of both are dropped."""
        old, keys = self["functions"], KEYS["functions"]
        new = new.drop("id").withColumn("source_hash", source_hash(F.col("source"))).dropDuplicates(keys)
        met = new.join(old.select(*keys, F.col("id").alias("_id")), keys, "left")
        fresh = merge.assign_ids(met.filter("_id is null").drop("_id"), old, keys)
        both = met.filter("_id is not null").withColumnRenamed("_id", "id").unionByName(fresh, allowMissingColumns=True)
        columns = old.columns
        for c in columns:
            if c not in both.columns:
                both = both.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
        self.put("functions", merge.upsert(old, both.select(*columns), keys))
        self.put("function_blocks", merge.delete(self["function_blocks"], met.filter("_id is not null"), "function_id", "_id"))

    def summarize(self, todo: list[passes.Pass], incremental_run: bool = False, reachable_from: DataFrame | None = None, force: bool = False, model: str = "rules") -> dict[str, DataFrame]:
        """Run passes in one traversal and store what changed; by pass: (function_id, payload, error, changed, ran).

        incremental_run: from missing and stale functions on, as far as payloads change. reachable_from: (id), only
        these and what they call.
        """
        functions, edges = self["functions"], self["call_edges"]
        tables = {p.name: self[PASS_TABLES[p.name]] for p in todo}
        have = {p.name: tables[p.name].select("function_id", F.from_json("summary_json", p.payload).alias("payload")) for p in todo}
        dirty, targets = None, None
        if incremental_run:
            upstream = {"verify": [self[t] for t in VERIFY_UPSTREAM]}
            dirty = {p.name: incremental.dirty(functions, edges, tables[p.name], upstream.get(p.name)) for p in todo}
        if reachable_from is not None:
            targets = graph.reachable(reachable_from, edges)
        results = passes.run(functions, edges, todo, have, dirty, targets, force)
        for p in todo:
            next_ = p.store(have[p.name].limit(0), results[p.name].filter("ran and changed and not error").select("function_id", "payload"))
            now = F.current_timestamp()
            rows = next_.select("function_id", F.to_json("payload").alias("summary_json"), now.alias("created_at"), now.alias("updated_at"), F.lit(model).alias("model_used"))
            self.upsert(PASS_TABLES[p.name], rows, keep=("created_at",))
        return results

    def stats(self) -> DataFrame:
        return stats.by_table(self.tables())

    def show(self, pass_name: str, **page) -> DataFrame:
        return lookup.page(self["functions"], self[PASS_TABLES[pass_name]], **page)

    def lookup(self, name: str, signature: str | None = None) -> DataFrame:
        found = lookup.by_name(self["functions"], name, signature)
        s = self["allocation_summaries"].select(F.col("function_id").alias("id"), "summary_json")
        return found.join(s, "id", "left")

    def clear(self) -> None:
        for name, df in merge.clear(self.tables()).items():
            self.put(name, df)

    def export(self, path: str) -> None:
        """Functions with the JSON of every pass, one document per line."""
        view = self["functions"].select("id", "name", "signature", "file_path")
        for name, table in PASS_TABLES.items():
            view = view.join(self[table].select(F.col("function_id").alias("id"), F.col("summary_json").alias(name)), "id", "left")
        view.write.mode("overwrite").json(path)

    def callgraph(self, path: str, kind: str = "csv", header: bool = True) -> None:
        rows = listing.call_graph(self["call_edges"], self["functions"]).select("caller", F.concat_ws(":", "file_path", "line", "column").alias("callsite"), "callee")
        rows.write.mode("overwrite").option("header", header).format(kind).save(path)

    def review(self, function_id: int, index: int, fingerprint: str, status: str, reason: str | None = None) -> None:
        if status not in REVIEW_STATUSES:
            raise ValueError(f"status must be one of {REVIEW_STATUSES}")
        row = self.spark.createDataFrame([(function_id, index, fingerprint, status, reason)], "function_id long, issue_index int, issue_fingerprint string, status string, reason string")
        self.upsert("issue_reviews", row.withColumn("updated_at", F.current_timestamp()))

    def invalidate(self, pass_name: str, seeds: DataFrame) -> None:
        """Drop a pass's summaries of the seeds and of all that call them."""
        table = PASS_TABLES[pass_name]
        self.put(table, incremental.invalidate(self[table], seeds, self["call_edges"]))

    def seed(self, parts: dict[str, DataFrame], force: bool = False) -> None:
        """Rows for library functions: one wide row per name from (name, json) per kind; known names stay unless forced."""
        wide = None
        for kind in ("allocation", "free", "init", "memsafe"):
            one = parts[kind].select("name", F.col("json").alias(f"{kind}_json"))
            wide = one if wide is None else wide.join(one, "name", "full_outer")
        wide = wide.withColumn("model_used", F.lit("builtin"))
        old = self["stdlib_cache"]
        self.put("stdlib_cache", merge.insert_replace(old, wide.select(*old.columns), ["name"]) if force else merge.insert_ignore(old, wide.select(*old.columns), ["name"]))
