"""Hashes, fingerprints, names and lines. ASCII word classes throughout, so all engines agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CALL_KEYWORDS, INTRINSICS, TYPE_WORDS

WORD = "[A-Za-z0-9_]"


def source_hash(source: Column) -> Column:
    """First 16 hex digits of SHA-256; null for null or empty."""
    return F.when(F.length(source) > 0, F.substring(F.sha2(source, 256), 1, 16))


def issue_fingerprint(kind: Column, location: Column, description: Column) -> Column:
    """16 hex digits over kind, location and the first 80 characters of the description; nulls are empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", text(kind), text(location), F.substring(text(description), 1, 80)), 256), 1, 16)


def set_digest(fingerprints: Column) -> Column:
    """An aggregate: 12 hex digits over the sorted fingerprints, whatever their order; `none` without any."""
    joined = F.array_join(F.sort_array(F.collect_list(fingerprints)), "|")
    return F.when(F.count(fingerprints) == 0, F.lit("none")).otherwise(F.substring(F.sha2(joined, 256), 1, 12))


def finding_key(kind: Column, file: Column, pattern: Column) -> Column:
    """Type, file and pattern without a line, so that a finding keeps its key when code moves."""
    return F.concat(kind, F.lit(":"), file, F.lit(":"), F.coalesce(pattern, F.lit("")))


def tokens(text: Column) -> Column:
    """About four characters a token, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def lines(df: DataFrame, text: str = "source") -> DataFrame:
    """df exploded into pos (from 1) and line; a final newline opens no line, \\r\\n counts as one."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n$", "")
    split = df.select("*", F.posexplode(F.split(clean, "\n")).alias("_p", "line"))
    return split.withColumn("pos", F.col("_p") + 1).drop("_p", text)


def grep(df: DataFrame, pattern: str, text: str = "source", key: str = "id", per_file: int | None = None, total: int | None = None, ignore_case: bool = False) -> DataFrame:
    """Lines that match; at most per_file of a text (its first), and total of all in order."""
    hits = lines(df, text).filter(F.col("line").rlike(("(?i)" if ignore_case else "") + pattern))
    if per_file is not None:
        w = Window.partitionBy(key).orderBy("pos")
        hits = hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_file).drop("_n")
    return hits.orderBy(key, "pos").limit(total) if total is not None else hits


def with_context(df: DataFrame, hit: Column, before: int = 2, after: int = 2, key: str = "id") -> DataFrame:
    """Lines near a hit: pos, line, hit, and gap (whether lines are missing before it)."""
    near = Window.partitionBy(key).orderBy("pos").rowsBetween(-after, before)
    kept = df.withColumn("hit", hit).withColumn("_near", F.max(F.col("hit").cast("int")).over(near)).filter("_near = 1").drop("_near")
    previous = F.lag("pos").over(Window.partitionBy(key).orderBy("pos"))
    return kept.withColumn("gap", F.coalesce(F.col("pos") > previous + 1, F.lit(False)))


def excerpt(df: DataFrame, names: Column, context: int = 2, key: str = "id") -> DataFrame:
    """Per text: its signature (up to the first line with a brace) and lines with one of names, in context.

    The whole text where no name has two characters or where four fifths of the lines match.
    df: (key, source).
    """
    rows = lines(df.withColumn("_names", F.filter(names, lambda n: F.length(n) >= 2)))
    brace = F.min(F.when(F.contains(F.col("line"), F.lit("{")), F.col("pos"))).over(Window.partitionBy(key))
    has = F.exists("_names", lambda n: word_in(n, F.col("line")))
    hit = F.coalesce(F.col("pos") <= brace, F.lit(True)) | has
    rows = rows.withColumn("_hit", hit).withColumn("_share", F.avg(F.col("_hit").cast("int")).over(Window.partitionBy(key)))
    cut = with_context(rows, F.col("_hit"), context, context, key)
    piece = F.when(F.col("gap"), F.concat(F.lit("    ...\n"), F.col("line"))).otherwise(F.col("line"))
    text = cut.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x["t"]), "\n").alias("_cut"), F.first("_share").alias("_share"), F.first("_names").alias("_names"))
    whole = (F.size("_names") == 0) | (F.col("_share") >= 0.8) | F.col("_cut").isNull()
    return df.join(text, key, "left").select(key, F.when(F.coalesce(whole, F.lit(True)), F.col("source")).otherwise(F.col("_cut")).alias("excerpt"))


def word_in(word: Column, line: Column) -> Column:
    """Whether word stands in line with no word character beside it."""
    return F.rlike(line, F.concat(F.lit("(^|[^A-Za-z0-9_])\\Q"), word, F.lit("\\E($|[^A-Za-z0-9_])")))


def called_names(source: Column, keywords: Sequence[str] = CALL_KEYWORDS) -> Column:
    """Distinct identifiers before an opening parenthesis, without keywords."""
    found = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(r"(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, keywords)))


def direct_callees(functions: DataFrame, known: DataFrame) -> DataFrame:
    """(id, callee_id): functions called by name in each source, self calls included."""
    calls = functions.select("id", F.explode(called_names(F.col("source"))).alias("name"))
    return calls.join(known.select("name", F.col("id").alias("callee_id")), "name").select("id", "callee_id").distinct()


def parameter_names(signature: Column, clean: bool = False) -> Column:
    """The last identifier of each parameter; empty where that is a type word. clean: without the empty ones."""
    inside = F.trim(F.regexp_extract(F.coalesce(signature, F.lit("")), r"\(([^)]*)\)", 1))
    last = lambda p: F.element_at(F.split(F.trim(F.regexp_replace(F.regexp_replace(p, r"\[.*?\]", ""), r"\*", " ")), r"\s+"), -1)
    named = F.transform(F.filter(F.split(inside, ","), lambda p: F.trim(p) != ""), lambda p: F.when(last(p).isin(*TYPE_WORDS), F.lit("")).otherwise(last(p)))
    found = F.when((inside == "") | (inside == "void"), F.array().cast("array<string>")).otherwise(named)
    return F.filter(found, lambda n: n != "") if clean else found


def normal_callee(name: Column) -> Column:
    """Compiler intrinsics by their library name; exact, or followed by a dot."""
    out = name
    for intrinsic, plain in INTRINSICS.items():
        out = F.when((name == intrinsic) | name.startswith(f"{intrinsic}."), F.lit(plain)).otherwise(out)
    return out


def split_key(key: Column) -> Column:
    """struct(file, name): parted at the last colon where what precedes looks like a path."""
    file = F.regexp_extract(key, "(?s)^(.*):([^:]*)$", 1)
    looks = key.contains(":") & (file.contains("/") | file.contains("."))
    return F.struct(F.when(looks, file).alias("file"), F.when(looks, F.regexp_extract(key, "(?s)^(.*):([^:]*)$", 2)).otherwise(key).alias("name"))


def without_anonymous(name: Column) -> Column:
    return F.regexp_replace(name, r"^(\(anonymous namespace\)::)+", "")


def without_abi_tags(name: Column) -> Column:
    return F.regexp_replace(name, r"\[abi:[^\]]*\]", "")


def base_name(name: Column) -> Column:
    """The part after the last `::` before the parameters."""
    return F.substring_index(F.substring_index(name, "(", 1), "::", -1)


def without_templates(name: Column, depth: int = 12) -> Column:
    """Without what stands in angle brackets, nested up to depth."""
    for _ in range(depth):
        name = F.regexp_replace(name, "<[^<>]*>", "")
    return name


def without_return_type(name: Column) -> Column:
    """A qualified name without what precedes it: its last blank outside brackets that has `::` after it.

    Bracketed parts are masked by blanks' stand-ins of the same length, so positions stay.
    """
    masked = name
    for _ in range(8):
        masked = F.regexp_replace(masked, r"<([^<> ]*) ([^<>]*)>", "<$1_$2>")
    for _ in range(6):
        masked = F.regexp_replace(masked, r"<([^<>]*)>", "_$1_")
        masked = F.regexp_replace(masked, r"<([^<> ]*) ([^<>]*)>", "<$1_$2>")
    head = F.regexp_extract(masked, r"^(.* )[^ ]*::", 1)
    return F.substr(name, F.length(head) + 1)


def substitute(text: Column, pairs: Column) -> Column:
    """text with whole-word formals replaced by actuals, one after the other, longest formal first.

    pairs: array<struct<formal, actual>>. An actual that contains a later formal is replaced again.
    """
    ordered = F.array_sort(pairs, lambda a, b: F.when(F.length(a["formal"]) > F.length(b["formal"]), -1).when(F.length(a["formal"]) < F.length(b["formal"]), 1).otherwise(0))
    quoted = lambda s: F.regexp_replace(s, r"([\\$])", r"\\$1")
    step = lambda acc, p: F.when(F.length(p["formal"]) > 0, F.regexp_replace(acc, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), p["formal"], F.lit(r"\E(?![A-Za-z0-9_])")), quoted(p["actual"]))).otherwise(acc)
    return F.aggregate(ordered, text, step)


def strip_fences(text: Column) -> Column:
    """text without a Markdown fence at its ends, trimmed."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "^```json", ""), "^```", ""), "```$", ""), r"^\s+|\s+$", "")


def url_dir(url: Column) -> Column:
    """Last path part of a url without .git; null for none."""
    name = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.when(url != "", F.regexp_replace(name, r"\.git$", ""))


def normal_url(url: Column) -> Column:
    """Without slashes or .git at the end, with https, in lower case; null for none."""
    plain = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    return F.when(url != "", F.lower(F.replace(F.replace(plain, F.lit("git://"), F.lit("https://")), F.lit("http://"), F.lit("https://"))))


def section(text: Column, title: str) -> Column:
    """The body under a second-level heading, up to the next one; empty without it."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?s)##\s*{title}\s*\n(.*?)(?=\n##\s|\z)", 1), r"^\s+|\s+$", ""))


def cwe_numbers(text: Column) -> Column:
    """CWE numbers in order; without any, the bare numbers (`121: ...`) listed under "CWE classification"."""
    text = F.coalesce(text, F.lit(""))
    named = F.regexp_extract_all(text, F.lit("CWE-([0-9]+)"), 1)
    listed = F.regexp_extract_all(F.regexp_extract(text, r"(?s)CWE classification\s*\n(.*?)(?:\n##|\z)", 1), F.lit("(?m)^([0-9]+):"), 1)
    return F.transform(F.when(F.size(named) > 0, named).otherwise(listed), lambda x: x.cast("int"))


def line_range(rows: DataFrame, start: int, most: int, key: str = "id") -> DataFrame:
    """Lines from start on, at most `most` per text, with truncated: whether more follow."""
    size = F.max("pos").over(Window.partitionBy(key))
    return rows.withColumn("truncated", size >= start + most).filter((F.col("pos") >= start) & (F.col("pos") < start + most))
