"""The fact tables as projections of the driver's tables, in Spark and as SQL.

EDGES has cycles, DAG has none; both are read from all lines and orders.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import issue_fingerprint, source_hash


class Tables:
    """The tables of a folder, read lazily; and the model's tables over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def functions(self) -> DataFrame:
        source = F.when(F.col("p_size") > 5, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.lit(""))
        f = self.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("signature"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line_start"), (F.col("p_size") + 10).alias("line_end"), source.alias("source"))
        return f.withColumn("source_hash", source_hash(F.col("source")))

    @cached_property
    def edges(self) -> DataFrame:
        """Of each customer's orders of one status: a call from the part of the first line to that of the last one."""
        rows = self.lineitem.join(self.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        place = F.struct("l_orderkey", "l_linenumber", "l_partkey")
        ends = rows.groupBy("o_custkey", "o_orderstatus").agg(F.min(place)["l_partkey"].alias("caller_id"), F.max(place)["l_partkey"].alias("callee_id"))
        return ends.select("caller_id", "callee_id").filter("callee_id <> caller_id").distinct()

    @cached_property
    def dag(self) -> DataFrame:
        """The same, from the larger id to the smaller."""
        return self.edges.select(F.greatest("caller_id", "callee_id").alias("caller_id"), F.least("caller_id", "callee_id").alias("callee_id")).distinct()

    @cached_property
    def layers(self) -> DataFrame:
        """A graph of all orders, parts, suppliers and nations: (id, name, weight); an order calls its parts, these their suppliers, these their nation."""
        parts = [("orders", "o_orderkey", "o_orderpriority", "o_totalprice"), ("part", "p_partkey", "p_name", "p_retailprice"), ("supplier", "s_suppkey", "s_name", "s_acctbal")]
        rows = self.nation.select((F.col("n_nationkey") * 4 + 3).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(0).cast("double").alias("weight"))
        for i, (table, key, name, weight) in enumerate(parts):
            rows = rows.union(getattr(self, table).select((F.col(key) * 4 + i).cast("long"), name, F.col(weight).cast("double")))
        return rows

    @cached_property
    def layer_edges(self) -> DataFrame:
        line = self.lineitem.select((F.col("l_orderkey") * 4).alias("o"), (F.col("l_partkey") * 4 + 1).alias("p"), (F.col("l_suppkey") * 4 + 2).alias("s"))
        pair = lambda a, b: F.struct(F.col(a).cast("long").alias("caller_id"), F.col(b).cast("long").alias("callee_id"))
        ways = line.select(F.explode(F.array(pair("o", "p"), pair("p", "s"))).alias("e")).select("e.*")
        return ways.union(self.supplier.select((F.col("s_suppkey") * 4 + 2).cast("long"), (F.col("s_nationkey") * 4 + 3).cast("long"))).distinct()

    @cached_property
    def summaries(self) -> DataFrame:
        return self.orders.groupBy(F.col("o_custkey").alias("function_id")).agg(F.max("o_orderdate").alias("updated_at"), F.count(F.lit(1)).alias("n"))

    @cached_property
    def issues(self) -> DataFrame:
        e = self.events.select(F.col("user_id").alias("function_id"), F.col("event_id").alias("issue_index"), F.col("event_type").alias("issue_kind"), F.col("event_id").cast("string").alias("location"), F.col("props").alias("description"), "value")
        return e.withColumn("fingerprint", issue_fingerprint(F.col("issue_kind"), F.col("location"), F.col("description")))

    @cached_property
    def reviews(self) -> DataFrame:
        status = F.when(F.col("issue_kind") == "error", "confirmed").when(F.col("issue_kind") == "click", "pending").otherwise("false_positive")
        return self.issues.filter("value > 20").select("function_id", F.col("fingerprint").alias("issue_fingerprint"), status.alias("status"), F.concat(F.lit("r"), "location").alias("reason"))

    @cached_property
    def texts(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), "doc_id").alias("name"), F.col("lang").alias("signature"), F.col("source").alias("file_path"), F.col("text").alias("source"))


_ENDS = "r0 AS (SELECT arg_min(l_partkey, {'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey}) AS a, arg_max(l_partkey, {'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey}) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderstatus)"
EDGES = f"{_ENDS}, call_edges AS (SELECT DISTINCT a AS caller_id, b AS callee_id FROM r0 WHERE a <> b)"
DAG = f"{_ENDS}, call_edges AS (SELECT DISTINCT greatest(a, b) AS caller_id, least(a, b) AS callee_id FROM r0 WHERE a <> b)"
#: The layers, from the lowest: table, key, name, weight, edges down.
NODES = (
    ("nation", "n_nationkey", "n_name", "0", ""), ("supplier", "s_suppkey", "s_name", "s_acctbal", "SELECT s_suppkey * 4 + 2 AS caller, s_nationkey * 4 + 3 AS callee FROM supplier"),
    ("part", "p_partkey", "p_name", "p_retailprice", "SELECT p * 4 + 1 AS caller, s * 4 + 2 AS callee FROM ps"), ("orders", "o_orderkey", "o_orderpriority", "o_totalprice", "SELECT o * 4 AS caller, p * 4 + 1 AS callee FROM op"),
)
LAYERS = "op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), ps AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)"
FUNCTIONS = "f0 AS (SELECT p_partkey AS id, p_name AS name, p_type AS signature, p_brand AS file_path, p_size AS line_start, p_size + 10 AS line_end, CASE WHEN p_size > 5 THEN p_name || ' ' || p_type ELSE '' END AS source FROM part), functions AS (SELECT *, CASE WHEN source <> '' THEN substr(sha256(source), 1, 16) END AS source_hash FROM f0)"
SUMMARIES = "summaries AS (SELECT o_custkey AS function_id, max(o_orderdate) AS updated_at, count(*) AS n FROM orders GROUP BY 1)"
ISSUES = "issues AS (SELECT user_id AS function_id, event_id AS issue_index, event_type AS issue_kind, event_id::VARCHAR AS location, props AS description, value, substr(sha256(event_type || '|' || event_id || '|' || substr(props, 1, 80)), 1, 16) AS fingerprint FROM events)"
REVIEWS = "reviews AS (SELECT function_id, fingerprint AS issue_fingerprint, CASE issue_kind WHEN 'error' THEN 'confirmed' WHEN 'click' THEN 'pending' ELSE 'false_positive' END AS status, 'r' || location AS reason FROM issues WHERE value > 20)"
TEXTS = "texts AS (SELECT doc_id AS id, 'doc_' || doc_id AS name, lang AS signature, source AS file_path, text AS source FROM documents)"
LINES = "l0 AS (SELECT id, string_split(regexp_replace(regexp_replace(source, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS ls FROM texts), lines AS (SELECT id, unnest(range(1, len(ls) + 1))::INT AS pos, unnest(ls) AS line FROM l0)"
