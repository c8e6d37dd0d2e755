"""JSON, text and YAML sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lines
from .json_split import CHUNK, entries, numbered

CONTAINERS = "function string, file string, signature string, container_type string, container_arg long, store_args array<long>, load_return boolean, confidence string, heuristic_score long, model_used string"
_CALLEES = "array<struct<callee:string,call_type:string,line:int>>"
_FUNCTION = f"map<string,struct<file:string,line_start:int,line_end:int,linkage:string,callees:{_CALLEES}>>"
_COMMAND = "directory string, file string, command string, arguments array<string>, output string"
_UNIT = "name string, type string, output string, link_deps array<string>, bc_files array<string>, objects array<string>, alias_of string, db_path string"
TRUTH = "challenges map<string,struct<cwes:array<int>,vulnerabilities:array<struct<patch_id:string,file:string,line:int,function:string,issue_kind:string>>,patch_sites:array<struct<patch_id:string,file:string,line:int,function:string,issue_kind:string>>>>"
#: Flags of a compile command that matter for parsing, with whether a value follows.
PARSE_FLAGS = {"-I": True, "-D": True, "-U": True, "-include": True, "-isystem": True, "-std": False, "-f": False, "-m": False}


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or an array of objects, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def compile_commands(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, directory, output, flags): the last entry of each file, paths made absolute.

    flags: those of PARSE_FLAGS, in order; commands are split as a shell does. Large arrays are read by many tasks. Of entries that
    spell their directory and file alike, only the last one's command is split.
    """
    raw = entries(spark, path, 1, chunk=chunk).select("path", "start", "seq", F.from_json("text", _COMMAND).alias("e"))
    last = lambda df, *key: df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("pos").desc()))).filter("_r = 1").drop("_r")
    raw = last(raw.select(F.struct("path", "start", "seq").alias("pos"), "e.*"), "directory", "file")
    schema = "file string, directory string, output string, flags array<string>, pos struct<path:string,start:long,seq:long>"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath
        import shlex

        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                args = list(r.arguments) if r.arguments is not None else shlex.split(r.command or "")
                flags, i = [], 1
                while i < len(args):
                    name = next((f for f in PARSE_FLAGS if args[i].startswith(f)), None)
                    if name:
                        flags.append(args[i])
                        if PARSE_FLAGS[name] and args[i] == name and i + 1 < len(args):
                            i += 1
                            flags.append(args[i])
                    i += 1
                absolute = lambda p: posixpath.normpath(posixpath.join(r.directory or "", p)) if p else None  # noqa: B023, E731
                out.append((absolute(r.file), r.directory, absolute(r.output), flags, r.pos))
            yield pd.DataFrame(out, columns=["file", "directory", "output", "flags", "pos"])

    return last(raw.mapInPandas(parse, schema), "file").drop("pos")


def call_graph(spark: SparkSession, path: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(functions: key, file, line_start, line_end, linkage) and (edges: caller, callee, indirect, line).

    One large document is read by many tasks; each function is one row of text. A key that occurs twice gives two rows.
    """
    text = entries(spark, path, 2, ("functions",), chunk).select(F.concat(F.lit("{"), "text", F.lit("}")).alias("text"))
    rows = text.select(F.explode(F.from_json("text", _FUNCTION)).alias("key", "f"))
    functions = rows.select("key", "f.file", "f.line_start", "f.line_end", "f.linkage")
    calls = rows.select(F.col("key").alias("caller"), F.explode("f.callees").alias("c"))
    return functions, calls.select("caller", "c.callee", (F.col("c.call_type") == "indirect").alias("indirect"), "c.line")


def link_units(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row per unit, with pos inside its file; of each file the units under link_units, and where it has none, targets."""
    rows = numbered(entries(spark, path, 2, ("link_units", "targets"), chunk))
    first = rows.groupBy("path").agg(F.min("member").alias("member"))  # by name, link_units comes first
    return rows.join(first, ["path", "member"]).select("pos", F.from_json("text", _UNIT).alias("u")).select("pos", "u.*")


def containers(spark: SparkSession, path: str) -> DataFrame:
    """Committed container results; project is the file's name."""
    rows = json_table(spark, path, CONTAINERS)
    return rows.withColumn("project", F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(challenge, file, line, function, issue_kind): findings of runs, else patch sites."""
    rows = json_table(spark, path, TRUTH).select(F.explode("challenges").alias("challenge", "c"))
    chosen = F.when(F.size("c.vulnerabilities") > 0, F.col("c.vulnerabilities")).otherwise(F.col("c.patch_sites"))
    return rows.select("challenge", F.explode(chosen).alias("v")).select("challenge", "v.*")


def whole_texts(spark: SparkSession, path: str, text: str = "source") -> DataFrame:
    """(path, source): one row per file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(text))


def externals(spark: SparkSession, path: str) -> DataFrame:
    """(name): functions of a sanitizer's list, lines `fun:<name>=<category>`."""
    name = F.regexp_extract("value", r"^\s*fun:([^=*\s]+)\s*=", 1)
    return spark.read.text(path).select(name.alias("name")).filter("name <> ''").distinct()


def ninja_targets(texts: DataFrame) -> DataFrame:
    """(path, output, rule, inputs, deps) from build files: lines `build <out>: <rule> <inputs> [| deps]`."""
    joined = texts.withColumn("source", F.regexp_replace("source", r"\$\n\s*", ""))
    rows = lines(joined).filter(F.rlike(F.col("line"), F.lit("^build ")))
    part = lambda i: F.regexp_extract("line", r"^build ([^:|]+?)(?: \|[^:]*)?: ?(\S+) ?([^|]*)(?:\|\|?(.*))?$", i)
    split = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: ~x.isin("", "|", "||"))
    return rows.select("path", part(1).alias("output"), part(2).alias("rule"), split(part(3)).alias("inputs"), split(F.regexp_replace(part(4), r"\|", " ")).alias("deps")).filter("output <> ''")


def line_markers(texts: DataFrame) -> DataFrame:
    """(path, pos, file, line_number, line): preprocessed text mapped back by `# <line> "<file>"` marks."""
    from ..operators.transcript import carried

    rows = lines(texts)
    at = F.regexp_extract("line", r'^# ([0-9]+) "([^"]*)"', 1)
    mark = F.when(at != "", F.struct(at.cast("int").alias("n"), F.regexp_extract("line", r'^# ([0-9]+) "([^"]*)"', 2).alias("file"), F.col("pos").alias("at")))
    rows = carried(rows, mark, "_m", ["pos"], "path").filter("_m is not null and _m.at <> pos")
    return rows.select("path", "pos", F.col("_m.file").alias("file"), (F.col("_m.n") + F.col("pos") - F.col("_m.at") - 1).alias("line_number"), "line")


def declared_in(texts: DataFrame) -> DataFrame:
    """(path, name, header): the file in which each extern function is declared first."""
    found = line_markers(texts).withColumn("name", F.regexp_extract("line", r"^\s*extern\s[^;(]*?\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1)).filter("name <> ''")
    return found.groupBy("path", "name").agg(F.min_by("file", "pos").alias("header"))


def cfg_nodes(texts: DataFrame) -> DataFrame:
    """(path, file, line, column, id, kind, successors): `file,line,col:id:KIND[:succ...]`, kinds C, D, S, R, U."""
    part = lambda i: F.regexp_extract("line", r"^(.*),([0-9]+),([0-9]+):([0-9]+):([CDSRU])((?::[0-9]+)*)$", i)
    rows = lines(texts).filter(part(5) != "")
    follow = F.transform(F.filter(F.split(part(6), ":"), lambda x: x != ""), lambda x: x.cast("long"))
    return rows.select("path", part(1).alias("file"), part(2).try_cast("int").alias("line"), part(3).try_cast("int").alias("column"), part(4).try_cast("long").alias("id"), part(5).alias("kind"), follow.alias("successors"))


def asm_functions(texts: DataFrame) -> DataFrame:
    """(path, name, start, end): labels that a .type directive names as functions, each up to the next one."""
    from ..operators.transcript import until_next

    rows = lines(texts)
    last = rows.groupBy("path").agg(F.max("pos").alias("last"))
    named = rows.select("path", F.regexp_extract("line", r"^\s*\.type\s+([A-Za-z_.$][A-Za-z0-9_.$]*)\s*,\s*[@%]function", 1).alias("name")).filter("name <> ''").distinct()
    labels = rows.select("path", "pos", F.regexp_extract("line", r"^([A-Za-z_.$][A-Za-z0-9_.$]*):", 1).alias("name")).filter("name <> ''").join(named, ["path", "name"], "left_semi")
    return until_next(labels.join(last, "path"), F.col("last"), "pos", "path").select("path", "name", F.col("pos").alias("start"), "end")


def tasks(texts: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(path, property, expected, input): of each YAML task, the first property of interest that has a verdict.

    Task files are flat lists of `- property_file: ...` with `expected_verdict: ...` below.
    """
    rows = lines(texts)
    prop = F.regexp_extract("line", r"^\s*-?\s*property_file:\s*[\"']?([^\"'\s]+)", 1)
    verdict = F.regexp_extract("line", r"^\s*expected_verdict:\s*(true|false)", 1)
    sub = F.regexp_extract("line", r"^\s*subproperty:\s*[\"']?([A-Za-z-]+)", 1)
    source = F.regexp_extract("line", r"^\s*input_files:\s*[\"']?([^\"'\s]+)", 1)
    marked = rows.withColumn("_n", F.sum((prop != "").cast("int")).over(Window.partitionBy("path").orderBy("pos")))
    some = lambda c: F.max(F.when(c != "", c))
    each = marked.groupBy("path", "_n").agg(some(F.regexp_extract(prop, r"([^/]*)\.prp$", 1)).alias("property"), some(verdict).alias("expected"), some(sub).alias("sub"))
    inputs = rows.groupBy("path").agg(some(source).alias("input"))
    known = F.coalesce(F.col("sub"), F.col("property")).isin(*kinds) | F.col("property").isin(*kinds)
    best = each.filter(known & F.col("expected").isNotNull()).groupBy("path").agg(F.min(F.struct("_n", F.coalesce("sub", "property").alias("property"), (F.col("expected") == "true").alias("expected"))).alias("b"))
    return best.join(inputs, "path").select("path", "b.property", "b.expected", "input")


def fenced_json(responses: DataFrame, text: str = "text") -> DataFrame:
    """responses with json: the last fenced block that parses, else the outermost braces, repaired if need be.

    Repair: lone backslashes doubled, commas before a closing bracket dropped, missing brackets added.
    """
    import json as _json
    import re

    @F.pandas_udf("string")
    def extract(values: pd.Series) -> pd.Series:
        def repaired(s: str) -> str:
            s = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", s)
            need, quoted, i = [], False, 0
            while i < len(s):
                c = s[i]
                if quoted and c == "\\":
                    i += 1
                elif c == '"':
                    quoted = not quoted
                elif not quoted and c in "{[":
                    need.append("}" if c == "{" else "]")
                elif not quoted and c in "}]" and need:
                    need.pop()
                i += 1
            return re.sub(r",(\s*[}\]])", r"\1", s + ('"' if quoted else "") + "".join(reversed(need)))

        def one(s):
            if s is None:
                return None
            blocks = re.findall(r"```(?:json)?\s*\n(.*?)```", s, re.S)[::-1]
            a, b = s.find("{"), s.rfind("}")
            blocks += [s[a : b + 1]] if 0 <= a < b else [s[a:]] if a >= 0 else []
            for attempt in (lambda x: x, repaired):
                for x in blocks:
                    try:
                        return _json.dumps(_json.loads(attempt(x)))
                    except ValueError:
                        continue
            return None

        return values.map(one)

    return responses.withColumn("json", extract(text))


def preprocessed_sources(markers: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, pp_source): lines that preprocessing made of each function's own, in order. markers: line_markers' output."""
    f = functions.select("id", F.col("file_path").alias("file"), "line_start", "line_end")
    met = markers.join(f, "file").filter("line_number between line_start and line_end")
    ordered = F.array_sort(F.collect_list(F.struct("line_number", "pos", "line")))
    return met.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("pp_source"))


def debug_locations(texts: DataFrame) -> DataFrame:
    """(path, id, file, line, column): places of blocks in IR text, through chains of scopes to the file.

    Reads `!<n> = !DILocation(line, column, scope)`, scopes that name a file or a parent scope, and `!DIFile`. A chain
    is walked one step per round, until nobody has a parent left.
    """
    from ..storage import written

    rows = lines(texts).select("path", "line", F.regexp_extract("line", r"^!([0-9]+) = ", 1).alias("id")).filter("id <> ''")
    part = lambda name: F.regexp_extract("line", rf"\b{name}: !?([0-9]+)", 1)
    text = lambda name: F.regexp_extract("line", rf'\b{name}: "([^"]*)"', 1)
    names = rows.filter(F.col("line").contains("!DIFile(")).select("path", F.col("id").alias("file_id"), F.concat_ws("/", F.when(text("directory") != "", text("directory")), text("filename")).alias("file"))
    scopes = rows.filter(F.rlike(F.col("line"), F.lit(r"!DI(Subprogram|LexicalBlock|LexicalBlockFile)\("))).select("path", F.col("id").alias("scope"), part("file").alias("file_id"), part("scope").alias("parent"))
    places = rows.filter(F.col("line").contains("!DILocation(")).select("path", "id", part("line").try_cast("int").alias("line"), part("column").try_cast("int").alias("column"), part("scope").alias("scope"))
    scopes, open_, done = written(scopes), written(places), None
    while not open_.isEmpty():
        met = written(open_.join(scopes, ["path", "scope"]))
        found = met.filter("file_id <> ''").select("path", "id", "line", "column", "file_id")
        done = written(found if done is None else done.union(found))
        open_ = written(met.filter("file_id = '' and parent <> ''").select("path", "id", "line", "column", F.col("parent").alias("scope")))
    if done is None:
        return places.limit(0).select("path", "id", F.lit("").alias("file"), "line", "column")
    return done.join(names, ["path", "file_id"]).select("path", F.col("id").cast("long").alias("id"), "file", "line", "column")


def write_containers(rows: DataFrame, path: str) -> None:
    """Container results as JSON by project, without those that only a heuristic found."""
    rows.filter("coalesce(model_used, '') <> 'heuristic_only'").write.mode("overwrite").partitionBy("project").json(path)


def validations(verdicts: DataFrame, texts: DataFrame) -> DataFrame:
    """(fingerprint, hypothesis, run): verdicts with the run file whose folder bears their fingerprint; run is null without one.

    texts: whole files (path, source) named .../<fingerprint>/validation_result.json.
    """
    runs = texts.select(F.regexp_extract("path", r"([^/]+)/validation_result\.json$", 1).alias("fingerprint"), F.col("source").alias("run")).filter("fingerprint <> ''")
    return verdicts.join(runs, "fingerprint", "left").select("fingerprint", "hypothesis", "run")
