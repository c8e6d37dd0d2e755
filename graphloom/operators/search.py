"""Names in texts: which lines of which files hold a name, and the harnesses that refer to a function."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

# Folders of harnesses and of tests, endings of sources.
FUZZ_DIRS = ("contrib/oss-fuzz", "fuzz", "fuzzing", "tests/fuzz", "test/fuzz")
TEST_DIRS = ("tests", "test", "contrib/libtests", "contrib/testpngs")
FUZZ_ENDINGS = (".c", ".cc", ".cpp")
TEST_ENDING = ".c"
# End of fixed values.
IDENTIFIER = "[^A-Za-z0-9_]+"
#: Rows of a table of words that is broadcast.
SMALL = 300_000


def holding(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name): the names that stand anywhere in a word. Both are identifiers, distinct.

    A word's parts of the names' lengths meet the names by equality.
    """
    span = names.agg(F.min(F.length("name")).alias("short"), F.max(F.length("name")).alias("long")).first()
    if span.short is None:
        return words.select("word", F.lit("").alias("name")).limit(0)
    n = F.length("word")
    starts = F.sequence(F.lit(1), n - span.short + 1)
    parts = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(span.short), F.least(F.lit(span.long), n - i + 1)), lambda k: F.substring(F.col("word"), i, k)))
    cut = words.filter(n >= span.short).select("word", F.explode(F.array_distinct(F.flatten(parts))).alias("name"))
    return cut.join(names.select("name"), "name", "left_semi").select("word", "name")


def references(files: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(name, path, line): lines of files (path, text) that hold a name (name: identifiers), by path and line, the first `most` of each name.

    Texts are read once, all names together: only a file's different words meet names, through the words of all files.
    """
    wanted = written(names.select("name").filter("name <> ''").distinct())
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    words = lines.select("path", (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(F.split("said", IDENTIFIER))).alias("word")).filter("word <> ''")
    known = written(holding(words.select("word").distinct(), wanted))
    if most is None:
        return words.join(known, "word").select("name", "path", "line").distinct()

    def first(df: DataFrame, key: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("path", "line"))
        return df.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")

    held = known.select("word").distinct()
    if held.count() <= SMALL:  # only words that hold a name are ranked
        words = words.join(F.broadcast(held), "word", "left_semi")
    # a name's first lines are among the first lines of each word that holds it, which tasks find before the shuffle
    return first(first(words, "word").join(known, "word").select("name", "path", "line").distinct(), "name")


def harnesses(files: DataFrame, names: DataFrame, most: int = 10, head: int = 100) -> DataFrame:
    """(name, path, kind, snippet): sources in folders of harnesses, which serve any function (name null), and tests that refer to a function.

    Of a function the first `most` lines with its name count, in sources of TEST_ENDING; their files are taken if they look like tests
    and aren't among the harnesses. A path appears once for a name.
    """
    path = F.col("path")
    inside = F.lit(False)
    for d in FUZZ_DIRS:
        inside = inside | path.startswith(f"{d}/")
    source = F.lit(False)
    for e in FUZZ_ENDINGS:
        source = source | path.endswith(e)
    snippet = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, head), "\n").alias("snippet")
    fuzz = files.filter(inside & source).select(F.lit(None).cast("string").alias("name"), "path", F.lit("oss-fuzz").alias("kind"), snippet)
    like = F.lower("path").contains("test")
    for d in TEST_DIRS:
        like = like | path.contains(d)
    tests = references(files.filter(path.endswith(TEST_ENDING)), names, most).filter(like & ~(inside & source)).select("name", "path").distinct()
    return fuzz.union(tests.join(files.select("path", snippet), "path").select("name", "path", F.lit("test").alias("kind"), "snippet"))
