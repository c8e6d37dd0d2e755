"""Divergence between the sources of a language, by joint histograms of word counts.

Words are counted once, by (language, source, word), with partial sums before the shuffle. A language keeps
the words of at least LEAST_DOCS of its documents; each kept word has a profile, its counts in the
sources that have it. Equal profiles are tallied first. A pair of sources then gets a histogram: how many kept words have
the counts (a, b) there. Cells with a zero are never enumerated from words: they follow from each source's own
histogram and the cells without zeros. The term of the divergence is evaluated once per cell and multiplied.

With n occurrences of a word among a group's N kept ones, V words kept, p = 1 + SCALE * (n + 1) div (N + V);
the term of p against q is (p - q)^2 div q. All arithmetic is exact: products go through decimals, quotients are
integral. Sums stay below (SCALE + V)^2.

Defined cases. Null text, language and source are ''. Sources without kept words have n = 0 for each; a
language without kept words has the value 0 for each pair, and no word rows. Repeated rows are further documents. Ties of
values go by the bytes of the item. Other columns, doc_id too, aren't read. An empty table gives no rows. A profile is as
long as the number of sources of its language, which the pairs in the result square anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_WORDS = 200
#: What stands between words: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def tallied(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each word, and the documents that have it.

    A document's words are sorted, so that its first occurrence of a word is known where it stands.
    """
    words = F.sort_array(F.array_remove(F.split(ascii_lower(F.col("text")), BETWEEN), ""))
    d = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), words.alias("w"))
    marked = d.select("lang", "source", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("w", i - 1) != x)).cast("long").alias("first")))).alias("t"))
    return marked.groupBy("lang", "source", "t.term").agg(F.count(F.lit(1)).alias("n"), F.sum("t.first").alias("docs"))


def profiles(tally: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, cells): the kept words, with their counts in the sources that have them, by source."""
    cells = F.sort_array(F.collect_list(F.struct("source", "n")))
    return tally.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), cells.alias("cells")).filter(F.col("docs") >= least_docs).drop("docs")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, v, lang_n, source_n): every occurring group, with its language's kept words and both sums of counts."""
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    own = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("source_n"))
    return every.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "source_n"])


def joint(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, one, two, a, b, words): how many kept words have a occurrences in source one and b in source two.

    pairs: (lang, one, two, v) with one < two. Each word counts where both sources have it; a source's own histogram
    gives the cells with one zero, less what stands in cells without, and v the cell of two zeros, less all others.
    """
    alike = kept.groupBy("lang", "cells").agg(F.count(F.lit(1)).alias("m"))
    first = alike.select("lang", "m", "cells", F.posexplode("cells").alias("i", "x"))
    both = first.select("lang", "m", "x", F.explode(F.slice("cells", F.col("i") + 2, F.size("cells"))).alias("y"))
    full = both.groupBy("lang", F.col("x.source").alias("one"), F.col("y.source").alias("two"), F.col("x.n").alias("a"), F.col("y.n").alias("b")).agg(F.sum("m").alias("m"))
    own = alike.select("lang", "m", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("own"), F.col("x.n").alias("n")).agg(F.sum("m").alias("m"))

    def cell(a: Column, b: Column, m: Column) -> Column:
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), m.cast("long").alias("m"))

    zero, a, b, m, n = F.lit(0), F.col("a"), F.col("b"), F.col("m"), F.col("n")
    parts = [full.select("lang", "one", "two", F.explode(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))).alias("c"))]
    for side, at in (("one", cell(n, zero, m)), ("two", cell(zero, n, m))):
        parts.append(pairs.join(own.withColumnRenamed("own", side), ["lang", side]).select("lang", "one", "two", F.explode(F.array(at, cell(zero, zero, -m))).alias("c")))
    parts.append(pairs.select("lang", "one", "two", cell(zero, zero, F.col("v")).alias("c")))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.union(p)
    return cells.groupBy("lang", "one", "two", "c.a", "c.b").agg(F.sum("c.m").alias("words")).filter("words <> 0")


def share(n: Column, group_n: Column, v: Column) -> Column:
    """p of a word with n of group_n occurrences, among v words; a long."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1), F.greatest(group_n + v, F.lit(1)).cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(kept: DataFrame, every: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from each other one of its language."""
    a = every.select("lang", F.col("source").alias("one"), "v", F.col("source_n").alias("one_n"))
    b = every.select("lang", F.col("source").alias("two"), F.col("source_n").alias("two_n"))
    pairs = written(a.join(b, "lang").filter("one < two"))
    cells = joint(kept, pairs.select("lang", "one", "two", "v")).join(pairs, ["lang", "one", "two"])
    p, q = share(F.col("a"), F.col("one_n"), F.col("v")), share(F.col("b"), F.col("two_n"), F.col("v"))
    valued = cells.select("lang", "one", "two", "words", p.alias("p"), q.alias("q"))
    sums = valued.groupBy("lang", "one", "two").agg(F.sum(F.col("words") * excess(F.col("p"), F.col("q"))).alias("there"), F.sum(F.col("words") * excess(F.col("q"), F.col("p"))).alias("back"))
    found = pairs.select("lang", "one", "two").join(sums, ["lang", "one", "two"], "left")
    ways = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item"), F.col("there").alias("value")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"), F.col("back").alias("value")))
    return found.select("lang", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", F.coalesce("w.value", F.lit(0)).cast("long").alias("value"))


def term_values(kept: DataFrame, every: DataFrame) -> DataFrame:
    """(lang, source, item, value): the kept words that a source has more often than its language."""
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    met = cells.join(every, ["lang", "source"])
    both = met.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("source_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    return both.filter("p > q").select("lang", "source", "item", excess(F.col("p"), F.col("q")).alias("value"))


def report(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_WORDS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the words that set a source apart."""
    kept = written(profiles(tallied(docs), least_docs))
    every = written(groups(docs, kept))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pair_values(kept, every).withColumn("rank", rank)
    words = term_values(kept, every).withColumn("rank", rank).filter(F.col("rank") <= top)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(words.withColumn("part", F.lit("term")).select(*columns))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
     k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
     kc AS (SELECT c.* FROM c JOIN k USING (lang, term)),
     l AS (SELECT lang, term, sum(n) AS n FROM kc GROUP BY ALL),
     ln AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY ALL),
     gn AS (SELECT g.lang, g.source, coalesce(ln.v, 0)::HUGEINT AS v, coalesce(ln.total, 0)::HUGEINT AS lang_n, coalesce(s.n, 0)::HUGEINT AS source_n
            FROM g LEFT JOIN ln USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM kc GROUP BY ALL) s USING (lang, source)),
     p AS (SELECT gn.lang, gn.source, k.term, coalesce(kc.n, 0) AS n, 1 + (1000000000 * (coalesce(kc.n, 0)::HUGEINT + 1)) // (gn.source_n + gn.v) AS p,
                  1 + (1000000000 * (l.n::HUGEINT + 1)) // (gn.lang_n + gn.v) AS q
           FROM gn JOIN k USING (lang) JOIN l USING (lang, term) LEFT JOIN kc ON kc.lang = gn.lang AND kc.source = gn.source AND kc.term = k.term),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
