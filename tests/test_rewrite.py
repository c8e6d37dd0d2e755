"""Source rewriting, alias context, and the store's commands."""

import dataclasses
import json

from pyspark.sql import functions as F

from graphloom.functions import rewrite
from graphloom.functions import text as T
from graphloom.operators import alias
from graphloom.plans import passes
from graphloom.plans.store import Facts


def test_macro_note():
    assert rewrite.macro_note("a\n  X;\nc", "a\n  1;\nc") == "a\n  // (macro) X;\n  1;\nc"
    assert rewrite.macro_note("  // gone\nb", "b") == "  // (macro) // gone\nb"


def test_blocks_removed():
    s = "a\n#ifdef P\nx\n#if Q\n#endif\n#else\ny\n#endif\nb\n#ifndef P\nopen"
    assert rewrite.without_blocks(s, "P") == "a\nb\n#ifndef P\nopen"


def test_contract_notes():
    sites = [{"callee": "f", "line_in_body": 2, "args": ["buf", "n+1"]}, {"callee": "f", "line_in_body": 3, "via_macro": True, "macro_name": "M", "args": ["x"]}]
    contracts = {"f": [{"target": "p", "contract_kind": "not_null"}, {"target": "p", "contract_kind": "buffer_size", "size_expr": "len"}]}
    got = rewrite.contract_notes("{\n  f(buf, n+1);\n  M(x);\n  f(z);\n}", sites, contracts, {"f": ["p", "len"]}, {"f": ["p freed"]})
    assert got.split("\n") == ["{", "  /* PRE[f(buf, n+1)]:", "   *   buf: not_null", "   *   buf: buffer_size(n+1)", "   */", "  f(buf, n+1);", "  /* POST[f(buf, n+1)]:", "   *   buf freed", "   */",
                               "  /* PRE[f  [via macro M]]:", "   *   p: not_null", "   *   p: buffer_size(len)", "   */", "  M(x);", "  /* POST[f  [via macro M]]:", "   *   p freed", "   */", "  f(z);", "}"]


def test_columns(spark):
    f = spark.createDataFrame([(1, "void g() {\n  switch\n    case A:\n      x;\n      y;\n}", 10)], "id long, source string, line_start int")
    b = spark.createDataFrame([(1, "case A:", 12, 14, "does x"), (1, "z", 90, 99, "no")], "function_id long, label string, line_start int, line_end int, summary string")
    assert rewrite.skeletons(f, b).first().skeleton == "void g() {\n  switch\n    case A:\n      /* case A: — does x */\n}"
    kind = rewrite.block_kind(F.split("source", "\n"), F.lit(3), F.lit(4))
    assert tuple(f.select(kind.alias("k")).first().k) == ("switch_case", "case A:")
    s = spark.createDataFrame([("a = sizeof(T) + sizeof( U );", {"T": 10})], "source string, sizes map<string,int>")
    assert s.select(rewrite.sizeof_notes(F.col("source"), F.col("sizes"))).first()[0] == "a = sizeof(T) /* = 10 */ + sizeof( U );"
    d = spark.createDataFrame([("struct {\n int x;\n int xy;\n}", [("x", 0, 4)], ["w"])], "d string, l array<struct<field:string,offset:int,size:int>>, w array<string>")
    assert d.select(rewrite.layout_notes("d", "l")).first()[0] == "struct {\n int x; /* offset: 0, size: 4 */\n int xy;\n}"
    assert d.select(rewrite.overflow_notes(F.lit("f() { x }"), "w")).first()[0] == "f() {\n    /* OVERFLOW: w */ x }"
    assert f.select(rewrite.blocks_removed(F.lit("#ifdef P\n#endif\nk"), "P")).first()[0] == "k"
    sites = "array<struct<callee:string,line_in_body:int,via_macro:boolean,macro_name:string,args:array<string>>>"
    g = spark.createDataFrame([(1, "h(a);", [("h", 1, False, None, ["a"])]), (2, "k();", [("k", 1, False, None, [])])], f"id long, source string, callsites {sites}")
    c = spark.createDataFrame([("h", ["p"], [("p", "not_null", None)], None)], "callee string, params array<string>, contracts array<struct<target:string,contract_kind:string,size_expr:string>>, post array<string>")
    got = {r.id: r.annotated for r in rewrite.with_contract_notes(g, c).collect()}
    assert got == {1: "/* PRE[h(a)]:\n *   a: not_null\n */\nh(a);", 2: "k();"}
    lines = T.lines(spark.createDataFrame([("p", "// asm(\"\")\nx\n asm volatile(\"nop\");")], "path string, source string"))
    r = rewrite.first_assembly(lines).first()
    assert (r.line_number, r.pattern) == (3, "asm volatile(...)")
    alloc = spark.createDataFrame([([("local:n", "s->b[i]"), ("s->n", "s->b"), ("MAX", "s->b"), ("k", "other")], [("s->b[]", "s->cap")])], "a array<struct<size_expr:string,stored_to:string>>, p array<struct<buffer:string,size:string>>")
    assert [x.size_expr for x in alloc.select(rewrite.local_sizes(F.col("a"), F.col("p")).alias("x")).first().x] == ["s->cap", "s->n", "MAX", "k"]
    assert spark.range(1).select(rewrite.disabled_checkers(F.lit("null_deref"))).first()[0] == ["checker_ubi", "trace_bounds"]


def test_alias_context(spark):
    entries = spark.createDataFrame([("f::arg#1", 3, 1), ("ret:node_init", 6, 2), ("ret:malloc", 6, 9), ("f::arg#0", 3, 9), ("g::arg#0", 3, 1), ("glob", 2, 2)], "name string, kind int, class int")
    rows = spark.createDataFrame([(1, 2), (9, 1), (9, 2), (1, 1)], "class int, other int")
    q = spark.createDataFrame([(0, "f")], "query int, name string")
    heap = alias.heap_classes(entries, spark.createDataFrame([("malloc",)], "name string"), spark.createDataFrame([("free",)], "name string"))
    group = alias.group(q, entries, rows, heap)
    assert {r.name for r in group.collect()} == {"ret:node_init", "glob", "f::arg#1", "g::arg#0"}
    functions = spark.createDataFrame([("node_init", "", ["x"]), ("g", "a->b = 1", ["first"]), ("f", "", ["a", "b"])], "name string, source string, params array<string>")
    params = {r.name: r.params for r in alias.aliased_parameters(group, functions).collect()}
    assert params == {"f": ["b"], "g": ["first"]}
    best = alias.providers(q, group, functions, entries, rows).orderBy("rank").collect()
    assert [(r.name, r.score) for r in best] == [("node_init", 2.5), ("g", 2.0)]


def test_store_commands(spark, tmp_path):
    s = Facts(spark, str(tmp_path / "db"))
    new = spark.createDataFrame([("a", "()", "f.c", "x"), ("b", "()", "f.c", "y")], "name string, signature string, file_path string, source string")
    s.insert_functions(new)
    ids = {r.name: r.id for r in s["functions"].collect()}
    s.insert_functions(new.withColumn("source", F.lit("z")).union(spark.createDataFrame([("c", "()", "g.c", "w")], new.schema)))
    after = {r.name: (r.id, r.source) for r in s["functions"].collect()}
    assert {k: after[k][0] for k in ids} == ids and after["a"][1] == "z" and len({v[0] for v in after.values()}) == 3
    s.put("call_edges", spark.createDataFrame([(after["a"][0], after["b"][0], False, "f.c", 1, 2)], "caller_id long, callee_id long, is_indirect boolean, file_path string, line int, `column` int"))
    p = dataclasses.replace(passes.depth_pass(), name="allocation")
    out = s.summarize([p], incremental_run=True)["allocation"]
    assert sorted((r.payload.depth, r.changed) for r in out.collect()) == [(0, True), (0, True), (1, True)]
    assert {json.loads(r.summary_json)["depth"] for r in s["allocation_summaries"].collect()} == {0, 1}
    assert s.summarize([p], incremental_run=True)["allocation"].count() == 0
    s.invalidate("allocation", spark.createDataFrame([(after["b"][0],)], "id long"))
    assert s["allocation_summaries"].count() == 1 and s.lookup("c").first().summary_json is not None
    s.review(1, 0, "fp", "confirmed", "why")
    s.review(1, 0, "fp", "wontfix")
    assert [(r.status, r.reason) for r in s["issue_reviews"].collect()] == [("wontfix", None)]
    s.callgraph(str(tmp_path / "cg"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cg")).first().callsite == "f.c:1:2"
    s.export(str(tmp_path / "ex"))
    assert spark.read.json(str(tmp_path / "ex")).count() == 3
    kinds = {k: spark.createDataFrame([("malloc", k)] if k != "free" else [("free", k)], "name string, json string") for k in ("allocation", "free", "init", "memsafe")}
    s.seed(kinds)
    s.seed(kinds)
    assert s["stdlib_cache"].count() == 2 and {r.table: r.rows for r in s.stats().collect()}["functions"] == 3
    s.clear()
    assert s["functions"].count() == 0
