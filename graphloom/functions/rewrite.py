"""Rewriting of sources: macro differences, skeletons, contract notes, layouts, conditional blocks.

The state of a rewrite depends on the lines before, so these are Arrow-batched Python functions on whole
sources; what they need (contracts, layouts, summaries) is gathered by joins before.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _indent(line: str) -> str:
    return " " * (len(line) - len(line.lstrip()))


def macro_note(source: str, expanded: str) -> str:
    """The expanded text; above each changed or dropped part its original lines as `// (macro)` comments."""
    before, after, out = source.splitlines(), expanded.splitlines(), []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, before, after).get_opcodes():
        new = after[c:d]
        if kind in ("replace", "delete"):
            shared = next((_indent(x) for x in new if x.strip()), "")
            for x in before[a:b]:
                if x.strip():
                    out.append(f"{shared if kind == 'replace' else _indent(x)}// (macro) {x.strip()}")
        out += new
    return "\n".join(out)


@F.pandas_udf(StringType())
def macro_notes(source: pd.Series, expanded: pd.Series) -> pd.Series:
    """macro_note by row; without an expansion the source."""
    return pd.Series([s if not e or s is None else macro_note(s, e) for s, e in zip(source, expanded, strict=True)])


def skeletons(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, skeleton): block bodies replaced by `/* label — summary */`, the first line of a block stays.

    functions: (id, source, line_start); blocks: (function_id, label, line_start, line_end, summary). Blocks
    outside their function are left out.
    """
    b = blocks.filter("summary is not null").groupBy("function_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end", "label", "summary"))).alias("blocks"))

    @F.pandas_udf(StringType())
    def cut(source: pd.Series, start: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, first, own in zip(source, start, found, strict=True):
            lines = (text or "").splitlines()
            gone: set[int] = set()
            notes: dict[int, str] = {}
            for x in own if own is not None else ():
                a, z = x["line_start"] - first, x["line_end"] - first
                if 0 <= a and z < len(lines):
                    gone.update(range(a + 1, z + 1))
                    notes[a + 1] = f"{_indent(lines[a])}  /* {x['label']} — {x['summary']} */"
            rows = []
            for i, line in enumerate(lines):
                if i in notes:
                    rows.append(notes[i])
                if i not in gone:
                    rows.append(line)
            out.append("\n".join(rows))
        return pd.Series(out)

    met = functions.join(b, F.col("id") == F.col("function_id"), "left")
    return met.select("id", cut("source", "line_start", "blocks").alias("skeleton"))


def substituted(text: str, formals: list[str], actuals: list[str]) -> str:
    """Whole-word formals by actuals, longest formal first, one after the other."""
    for f, a in sorted(zip(formals, actuals, strict=False), key=lambda p: -len(p[0])):
        if f:
            text = re.sub(rf"\b{re.escape(f)}\b", lambda _, a=a: a, text)
    return text


def _call_of(sites: list[dict]) -> re.Pattern:
    names = {s["callee"] for s in sites} | {s["macro_name"] for s in sites if s.get("via_macro") and s.get("macro_name")}
    return re.compile("|".join(rf"\b{re.escape(n)}\s*\(" for n in sorted(names)))


def contract_notes(source: str, sites: list[dict], contracts: dict[str, list[dict]], params: dict[str, list[str]], after: dict[str, list[str]] | None = None) -> str:
    """source with a `PRE[...]` comment before each call whose callee has contracts, in the callee's order of calls.

    after: postconditions by callee, put as `POST[...]` comments below the call. Calls hidden by a macro are
    found by its name, and keep formal names.
    """
    waiting: dict[str, list[dict]] = {}
    for s in sorted(sites, key=lambda s: s.get("line_in_body") or 0):
        if s["callee"] in contracts or s["callee"] in (after or {}):
            waiting.setdefault(s["callee"], []).append(s)
    patterns = {c: _call_of(q) for c, q in waiting.items()}
    out = []
    for line in source.splitlines():
        below = []
        if not line.lstrip().startswith("// (macro)"):
            for callee, queue in waiting.items():
                if not queue or not patterns[callee].search(line):
                    continue
                site = queue.pop(0)
                hidden = site.get("via_macro")
                args = [] if hidden else list(site.get("args") if site.get("args") is not None else [])
                head = f"{callee}  [via macro {site.get('macro_name') or '?'}]" if hidden else f"{callee}({', '.join(args)})"
                put = lambda t, callee=callee, args=args: substituted(t, params.get(callee, []), args)
                pad = _indent(line)
                if contracts.get(callee):
                    out.append(f"{pad}/* PRE[{head}]:")
                    for c in contracts[callee]:
                        size = f"({put(c['size_expr'])})" if c["contract_kind"] == "buffer_size" and c.get("size_expr") else ""
                        out.append(f"{pad} *   {put(c['target'])}: {c['contract_kind']}{size}")
                    out.append(f"{pad} */")
                if (after or {}).get(callee):
                    below += [f"{pad}/* POST[{head}]:", *(f"{pad} *   {put(t)}" for t in after[callee]), f"{pad} */"]
        out += [line, *below]
    return "\n".join(out)


def with_contract_notes(functions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(id, annotated): functions (id, source, callsites) with the contracts (callee, params, contracts, post) of what they call."""
    wanted = functions.select("id", F.explode("callsites").alias("s")).select("id", F.col("s.callee").alias("callee")).distinct()
    each = wanted.join(contracts, "callee").groupBy("id").agg(F.collect_list(F.struct("callee", "params", "contracts", "post")).alias("known"))

    @F.pandas_udf(StringType())
    def note(source: pd.Series, sites: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for text, own, k in zip(source, sites, known, strict=True):
            if text is None or k is None or own is None:
                out.append(text)
                continue
            some = lambda v: list(v) if v is not None else []
            out.append(contract_notes(text, list(own), {x["callee"]: some(x["contracts"]) for x in k}, {x["callee"]: some(x["params"]) for x in k}, {x["callee"]: some(x["post"]) for x in k}))
        return pd.Series(out)

    return functions.join(each, "id", "left").select("id", note("source", "callsites", "known").alias("annotated"))


@F.pandas_udf(StringType())
def overflow_notes(source: pd.Series, warnings: pd.Series) -> pd.Series:
    """Warnings (array of texts) as comments after the first opening brace."""
    out = []
    for text, own in zip(source, warnings, strict=True):
        if text is None or own is None or not len(own) or "{" not in text:
            out.append(text)
            continue
        head, rest = text.split("{", 1)
        out.append(head + "{\n" + "\n".join(f"    /* OVERFLOW: {w} */" for w in own) + rest)
    return pd.Series(out)


def sizeof_notes(source: Column, sizes: Column) -> Column:
    """`sizeof(T)` followed by its value, for types in the map sizes: one pass per type that occurs."""
    names = F.array_distinct(F.regexp_extract_all(source, F.lit(r"sizeof\s*\(\s*((?:struct\s+)?[A-Za-z_][A-Za-z0-9_]*)\s*\)"), 1))
    known = F.filter(names, lambda n: F.try_element_at(sizes, n).isNotNull())
    return F.aggregate(known, source, lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"(sizeof\s*\(\s*\Q"), n, F.lit(r"\E\s*\))")), F.concat(F.lit("$1 /* = "), F.try_element_at(sizes, n).cast("string"), F.lit(" */"))))


@F.pandas_udf(StringType())
def layout_notes(definition: pd.Series, layout: pd.Series) -> pd.Series:
    """Field lines with their offset and size. layout: array of (field, offset, size); the first field found counts."""
    out = []
    for text, fields in zip(definition, layout, strict=True):
        if not text or fields is None or not len(fields):
            out.append(text)
            continue
        rows = []
        for line in text.splitlines():
            hit = next((f for f in fields if "/* offset:" not in line and re.search(rf"\b{re.escape(f['field'])}\s*[;\[,]", line)), None)
            rows.append(f"{line.rstrip()} /* offset: {hit['offset']}, size: {hit['size']} */" if hit else line)
        out.append("\n".join(rows))
    return pd.Series(out)


def without_blocks(source: str, name: str) -> str:
    """Without whole `#if` blocks that test name, both branches; one that doesn't end stays."""
    opens, nested, closes = re.compile(rf"#\s*(ifdef|ifndef)\s+{re.escape(name)}\b|#\s*if\s+!?\s*defined\s*\(?\s*{re.escape(name)}\b"), re.compile(r"#\s*if"), re.compile(r"#\s*endif")
    lines, out, i = source.splitlines(), [], 0
    while i < len(lines):
        end = None
        if opens.match(lines[i].strip()):
            depth = 1
            for j in range(i + 1, len(lines)):
                depth += bool(nested.match(lines[j].strip())) - bool(closes.match(lines[j].strip()))
                if depth == 0:
                    end = j
                    break
        if end is None:
            out.append(lines[i])
            i += 1
        else:
            i = end + 1
    return "\n".join(out)


def blocks_removed(source: Column, name: str) -> Column:
    @F.pandas_udf(StringType())
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else without_blocks(s, name))

    return cut(source)


def block_kind(lines: Column, start: Column, end: Column) -> Column:
    """struct(kind, label) of a block of lines, from its first line that isn't blank."""
    first = F.trim(F.get(F.filter(F.slice(lines, start, end - start + 1), lambda x: F.trim(x) != ""), 0))
    case = F.regexp_extract(first, r"^(case\s+.+?:)", 1)
    is_case = F.coalesce(F.rlike(first, F.lit(r"^case\s+.+:")), F.lit(False))
    kind = F.when(is_case, "switch_case").when(first.startswith("default:"), "default_case").otherwise("block")
    label = F.when(is_case, case).when(first.startswith("default:"), "default:").otherwise(F.substring(first, 1, 60))
    return F.struct(kind.alias("kind"), F.coalesce(label, F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))).alias("label"))


# How inline assembly is written in sources and in IR.
INLINE_ASM = (
    (r"\b__asm__\s*\(", "__asm__(...)"),
    (r"\b__asm\s*\(", "__asm(...)"),
    (r"\basm\s*\(\s*[\"']", 'asm("...")'),
    (r"\b__asm\s*\{", "__asm {...}"),
    (r"\b__asm__\s+__volatile__\s*\(", "__asm__ __volatile__(...)"),
    (r"\basm\s+volatile\s*\(", "asm volatile(...)"),
)
IR_ASM = ((r"\bcall\s+.*\basm\b", "call asm"), (r"\basm\s+sideeffect\b", "asm sideeffect"), (r"module\s+asm\b", "module asm"))
# End of fixed values.


def first_assembly(lines: DataFrame, patterns: tuple[tuple[str, str], ...] = INLINE_ASM, key: str = "path") -> DataFrame:
    """(key, line_number, snippet, pattern): the first line of each file that has assembly and isn't a comment. lines: (key, pos, line)."""
    plain = F.trim("line")
    which = F.coalesce(*(F.when(F.rlike(F.col("line"), F.lit(p)), F.lit(said)) for p, said in patterns))
    hits = lines.filter(~plain.startswith("//") & ~plain.startswith("/*")).withColumn("pattern", which).filter("pattern is not null")
    return hits.groupBy(key).agg(F.min(F.struct(F.col("pos").alias("line_number"), F.substring(plain, 1, 100).alias("snippet"), "pattern")).alias("m")).select(key, "m.*")


def local_sizes(allocations: Column, pairs: Column) -> Column:
    """Allocations whose size is local get the size that the summary pairs with where they are stored."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\[.*?\]", "")
    useful = F.filter(pairs, lambda p: (bare(p["buffer"]) != "") & (F.coalesce(p["size"], F.lit("")) != ""))
    paired = lambda stored: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(useful, lambda p: bare(p["buffer"]) == bare(stored)), lambda p: p["size"])), -1)

    def one(a: Column) -> Column:
        size = a["size_expr"]
        lasting = size.contains("->") | size.contains(".") | ((F.upper(size) == size) & F.rlike(size, F.lit("[A-Z]")))
        plain = F.when(size.startswith("local:"), F.trim(F.substr(size, F.lit(7)))).otherwise(size)
        new = F.when((F.coalesce(size, F.lit("")) == "") | lasting | (F.size(useful) <= 0), size).otherwise(F.coalesce(paired(a["stored_to"]), plain))
        return a.withField("size_expr", new)

    return F.transform(allocations, one)


# Which checkers tell about an issue kind.
CHECKERS = ("checker_nullderef", "checker_ubi", "trace_bounds")
RELEVANT = {"null_deref": "checker_nullderef", "buffer_overflow": "trace_bounds", "use_after_free": "trace_bounds", "out_of_bounds": "trace_bounds", "uninitialized_use": "checker_ubi"}
# End of fixed values.


def disabled_checkers(kind: Column) -> Column:
    """Checkers that have nothing to say about an issue kind; none for unknown kinds."""
    out = F.array().cast("array<string>")
    for k, keep in RELEVANT.items():
        out = F.when(kind == k, F.array(*(F.lit(c) for c in CHECKERS if c != keep))).otherwise(out)
    return out
