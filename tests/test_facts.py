"""Merges, text, payloads, resolution, reviews, sources."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import paths, payloads, scores, text
from graphloom.operators import incremental, listing, merge, resolve, transcript, units
from graphloom.plans import evaluate, passes
from graphloom.sources import files, snapshot


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_upsert_is_idempotent_and_keeps_ids(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id int, k string, v int")
    new = spark.createDataFrame([(9, "a", 7), (8, None, None), (7, "c", 1)], "id int, k string, v int")
    once = merge.upsert(old, new, ["k"], keep=("id",), fill=("v",))
    want = {(1, "a", 7), (2, None, 6), (7, "c", 1)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in merge.upsert(once, new, ["k"], keep=("id",), fill=("v",)).collect()} == want


def test_ignore_and_replace_with_nulls(spark):
    old = spark.createDataFrame([("a", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), (None, 2), ("b", 2), ("b", 2)], "k string, v int")
    assert sorted(map(str, map(tuple, merge.insert_ignore(old, new, ["k"]).collect()))) == sorted(map(str, [("a", 1), (None, 1), (None, 2), ("b", 2)]))
    assert {tuple(r) for r in merge.insert_replace(old, new, ["k"]).collect()} == {(None, 1), ("a", 2), (None, 2), ("b", 2)}


def test_store_versions(spark, tmp_path):
    s = merge.Store(spark, str(tmp_path))
    assert s.read("t", "a int").count() == 0
    s.write("t", spark.createDataFrame([(1,)], "a int"))
    s.write("t", s.read("t", "a int").union(spark.createDataFrame([(2,)], "a int")))
    assert s.version("t") == 2 and {r.a for r in s.read("t", "a int").collect()} == {1, 2}


def test_cascade_delete(spark):
    f = spark.createDataFrame([(1, ""), (2, "x")], "id long, source string")
    e = spark.createDataFrame([(2, 1), (2, 2)], "caller_id long, callee_id long")
    s = spark.createDataFrame([(1,), (2,)], "function_id long")
    out = merge.clear_stubs({"functions": f, "call_edges": e, "free_summaries": s})
    assert {k: v.count() for k, v in out.items()} == {"functions": 1, "call_edges": 1, "free_summaries": 1}


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (text.without_return_type, "unsigned long ns::f", "ns::f"),
        (text.without_return_type, "std::pair<char*, char*> std::op<a, b<c d>>::g", "std::op<a, b<c d>>::g"),
        (text.without_return_type, "plain", "plain"),
        (text.without_templates, "A<B<C>>::foo", "A::foo"),
        (text.without_anonymous, "(anonymous namespace)::(anonymous namespace)::f", "f"),
        (text.without_abi_tags, "std::all_of[abi:ne180100]", "std::all_of"),
        (text.base_name, "ns::C::m(int, a::b)", "m"),
        (text.normal_callee, "llvm.memcpy.p0", "memcpy"),
        (text.normal_callee, "llvm.memcpyx", "llvm.memcpyx"),
        (text.normal_url, "http://X/y.git/", "https://x/y"),
        (text.url_dir, "https://h/a/repo.git", "repo"),
        (text.strip_fences, "\n```json\n{}\n```", "{}"),
        (paths.stem, "/a/b.c.o", "b.c"),
        (paths.without_container, "/workspace/src/a.c", "a.c"),
        (scores.container_type, "Skip-List", "linked_list"),
        (scores.container_type, "my hash_table v2", "hash_table"),
        (scores.container_type, None, "other"),
    ],
)
def test_strings(spark, fn, value, want):
    assert one(spark, fn(F.col("v")), v=value) == want


def test_suffix_and_keys(spark):
    assert one(spark, paths.suffix(F.col("v"), 2), v="/m/t/repo/png.c") == "repo/png.c"
    assert tuple(one(spark, text.split_key(F.col("v")), v="/p/f.cc:_ZN3FooE")) == ("/p/f.cc", "_ZN3FooE")
    assert tuple(one(spark, text.split_key(F.col("v")), v="plain")) == (None, "plain")
    assert one(spark, text.source_hash(F.col("v")), v="") is None


def test_paths_and_numbers(spark):
    v = F.col("v")
    for p, want in [("/workspace/src/a", "/p/a"), ("/workspace/src", "/p"), ("/workspace/build/x", "/b/x"), ("/workspace/other", "/b/other"), ("/x", "/x"), ("/workspace/srcs/x", "/b/srcs/x")]:
        assert one(spark, paths.remap(v, "/p", "/b"), v=p) == want
    assert one(spark, paths.remap_argument(v, "/p", "/b"), v="-I/workspace/src/inc") == "-I/p/inc"
    assert one(spark, paths.remap_argument(v, "/p", "/b"), v="-DX=/workspace/src") == "-DX=/workspace/src"
    known = F.create_map(F.lit("stdio.h"), F.lit("libc"), F.lit("math.h"), F.lit("libm"))
    for p, want in [("/usr/include/x86_64-linux-gnu/bits/a.h", "libc"), ("/usr/include/math.h", "libm"), ("/usr/include/q/stdio.h", "libc"), ("/opt/stdio.h", None), ("/usr/include/png.h", None)]:
        assert one(spark, paths.header_library(v, known), v=p) == want
    assert one(spark, text.cwe_numbers(v), v="CWE-787 and CWE-20") == [787, 20]
    assert one(spark, text.cwe_numbers(v), v="### CWE classification\n\n121: x\n122: y\n## z\n9: n") == [121, 122]
    assert one(spark, text.section(v, "Vulnerability"), v="# a\n## Vulnerability\nbody\n\n## next") == "body"


def test_substitute_is_sequential(spark):
    pairs = F.array(F.struct(F.lit("n").alias("formal"), F.lit("$z").alias("actual")), F.struct(F.lit("len").alias("formal"), F.lit("n").alias("actual")))
    assert one(spark, text.substitute(F.col("v"), pairs), v="len + nn + n") == "$z + nn + $z"


def test_scores(spark):
    row = {"name": "my_alloc", "sig": "char*(size_t n)", "src": "p = malloc(n); if (!p) return 0; return malloc(n);"}
    score, signals = scores.allocator(F.col("name"), F.col("sig"), F.col("src"))
    assert one(spark, score, **row) == 13 and len(one(spark, signals, **row)) == 6
    row = {"name": "x_free", "sig": "void f(void *p)", "src": "free(p);"}
    assert one(spark, scores.deallocator(F.col("name"), F.col("sig"), F.col("src"))[0], **row) == 11
    row = {"name": "hash_insert", "sig": "void *f(struct t *t, void *value, void **out)", "src": "// x->next\nt->slot = value;\nt->next = 0;\nreturn t->slot;\ni = hash(k) % size;"}
    assert one(spark, scores.container(F.col("name"), F.col("sig"), F.col("src"))[0], **row) == 3 + 2 + 2 + 2 + 2 + 4 + 1 + 3 + 2


def test_kinds(spark):
    agree = scores.kinds_agree(F.col("a"), F.col("b"))
    for a, b, want in [("segv", "x", True), ("buffer_overflow", "integer_overflow", True), ("integer_overflow", "buffer_overflow", True), ("double_free", "null_deref", False), ("x", None, True)]:
        assert one(spark, agree, a=a, b=b) is want
    assert one(spark, scores.kind_of(F.col("n").cast("int"), schema.CWE_KINDS_PATCH), n="190") == "buffer_overflow"
    assert one(spark, scores.kind_of(F.col("n").cast("int"), schema.CWE_KINDS_RUN), n="190") == "integer_overflow"


@pytest.mark.parametrize(
    ("said", "run", "want"),
    [
        ("safe", {}, "safe_confirmed"),
        ("safe", {"crashes": [123]}, "safe_confirmed"),
        ("safe", {"crashes": [152]}, "safe_rejected"),
        ("safe", {"crashes": [{"code": 123, "reason": "loop_oob"}]}, "safe_rejected"),
        ("feasible", {"plan_coverage": {"traces": [{"status": "covered"}]}}, "feasible_confirmed"),
        ("feasible", {"assertions": {"assertions": [{"assertion_id": 1, "fail_count": 2}]}}, "feasible_confirmed"),
        ("feasible", {"crashes": [124]}, "feasible_rejected"),
        (None, {}, "unknown"),
    ],
)
def test_outcomes(spark, said, run, want):
    assert one(spark, payloads.outcome(F.col("h"), F.col("r")), h=said, r=json.dumps(run)).outcome == want


def test_payload_defaults(spark):
    p = one(spark, payloads.decoded(F.col("j"), "verify"), j='{"issues": [{"severity": "HUGE", "issue_kind": "x"}]}')
    assert p.simplified_contracts is None and p.description == "" and len(p.issues) == 1
    assert one(spark, payloads.checked_issues(payloads.decoded(F.col("j"), "verify")["issues"]), j='{"issues": [{"severity": "HUGE"}]}')[0].severity == "medium"
    assert one(spark, payloads.decoded(F.col("j"), "allocation")["allocations"], j="not json") == []
    assert one(spark, payloads.changed_flag(F.col("j")), j='{"changed": false}') is False
    assert one(spark, payloads.changed_flag(F.col("j")), j="{}") is True


def test_resolution_strategies(spark):
    f = spark.createDataFrame(
        [(1, "f", "src/a.c", 1, 9), (2, "f", "src/b.c", 1, 9), (3, "g", "lib/x/y/g.c", 5, 8), (4, "ns::h", "h.cc", 1, 2), (5, "only", "o.c", 1, 2)],
        "id long, name string, file_path string, line_start int, line_end int",
    )
    w = spark.createDataFrame(
        [("src/a.c:f", None, 0, 0, None), ("/b/x/y/g.c:g", None, 0, 0, None), ("only", None, 0, 0, None), ("f", "z/src/b.c", 3, 4, None), ("_Z1h", "h.cc", 1, 2, "int ns::h(int)"), ("new", "n.c", 1, 1, None)],
        "key string, file string, line_start int, line_end int, demangled string",
    )
    got = {r.key: (r.id, r.strategy) for r in resolve.cascade(w, f).collect()}
    assert got == {"src/a.c:f": (1, "file"), "/b/x/y/g.c:g": (3, "suffix"), "only": (5, "name"), "f": (2, "name"), "_Z1h": (4, "demangled"), "new": (None, "stub")}


def test_external_headers_meet_names_once(spark):
    """2,000 stubs and 50,000 functions of one name: the join gives a row for each stub, not each pair."""
    stubs = spark.range(2000).selectExpr("id", "if(id < 1999, 'f', 'g') AS name", "'' AS source", "'h.h' AS decl_header")
    d = spark.range(50_000).selectExpr("id + 7 AS id", "'f' AS name", "if(id >= 40, 'x', null) AS source")
    out = resolve.external_headers(stubs, d)
    assert {(r.id, r.dep_id) for r in out.collect()} == {(i, 47) for i in range(1999)}
    bare = resolve.external_headers(stubs, d.filter("source is null").union(spark.createDataFrame([(3, None, "x")], "id long, name string, source string")))
    assert {r.dep_id for r in bare.collect()} == {7}
    joins, todo = [], [out._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        p = todo.pop()
        joins += [p] if "Join" in p.nodeName() else []
        todo += [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
    assert [j.metrics().apply("numOutputRows").value() for j in joins] == [1999]


def test_reviews_and_matches(spark):
    p = spark.createDataFrame([(1, [("l", "k", "d")])], "function_id long, issues array<struct<location:string,issue_kind:string,description:string>>")
    i = listing.issues(p)
    r = i.select("function_id", F.col("fingerprint").alias("issue_fingerprint"), F.lit("confirmed").alias("status"), F.lit("why").alias("reason"))
    assert listing.reviewed(i, r).first().status == "confirmed" and listing.open_counts(i, r).count() == 0
    truth = spark.createDataFrame([("f", "k", 1), ("f", "k", 2), (None, "k", 3)], "function string, issue_kind string, k int")
    found = spark.createDataFrame([("f", "k", 1), ("g", "k", 2)], "function string, issue_kind string, j int")
    m = evaluate.matched(truth, found, ["function", "issue_kind"], "k", "j")
    assert sorted(x.outcome for x in m.collect()) == ["fn", "fn", "fp", "tp"]
    row = evaluate.confusion(m.fillna("?"), "issue_kind").first()
    assert (row.precision, row.recall) == (0.5, 0.3333)


def test_stale_is_strict(spark):
    f = spark.createDataFrame([(1, "x"), (2, "y"), (3, "")], "id long, source string")
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "caller_id long, callee_id long")
    s = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "function_id long, updated_at int")
    assert incremental.stale(f, e, s).count() == 0
    assert {r.id for r in incremental.missing(f, s.filter("function_id = 3")).collect()} == {1, 2}
    up = spark.createDataFrame([(2, 9)], "function_id long, updated_at int")
    assert [r.id for r in incremental.stale(f, e, s, [up]).collect()] == [1]


def test_truncate_against_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(c, i, rng.choice(["user", "assistant", "assistant"]), "x" * rng.randrange(400)) for c in range(30) for i in range(rng.randrange(1, 12))]
    want = set()
    for c in range(30):
        m = [r for r in rows if r[0] == c]
        size = lambda r: len(r[3]) // 4
        if sum(map(size, m)) <= 200 or len(m) <= 3:
            want |= {r[:2] for r in m}
            continue
        pairs, i, rest = [], 0, m[1:]
        while i < len(rest):
            n = 2 if rest[i][2] == "assistant" and i + 1 < len(rest) else 1
            pairs.append(rest[i : i + n])
            i += n
        used, kept = size(m[0]), [m[0]]
        for k, pair in enumerate(reversed(pairs)):
            if k and used + sum(map(size, pair)) > 200:
                break
            used += sum(map(size, pair))
            kept += pair
        want |= {r[:2] for r in kept}
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {(r.conv_id, r.turn) for r in transcript.truncated(df, 200).collect()} == want


def test_spans_and_blocks(spark):
    s = spark.createDataFrame([(1, 1, 4), (1, 5, 9), (1, 10, 12), (1, 13, 30), (1, 31, 33)], "function_id long, start long, end long")
    assert sorted((r.start, r.end) for r in transcript.grouped_spans(s).collect()) == [(1, 12), (13, 30), (31, 33)]
    t = spark.createDataFrame([(1, "#if A\nx\n#if B\ny\n#endif\n#else\nz\n#endif\n#endif")], "id long, source string")
    got = sorted((r.start, r.middle, r.end, r.depth) for r in transcript.nested_blocks(t, "^#if", "^#else", "^#endif").collect())
    assert got == [(1, 6, 8, 0), (3, None, 5, 1)]


def test_units(spark):
    rows = [(0, "a", "static", "liba.a", [], ["1", "2"], [], None, None), (1, "b", "static", "libb.a", [], ["1", "2", "3"], [], None, "/b.db"), (2, "c", "exe", "c", ["liba.a"], ["9"], [], None, None)]
    u = spark.createDataFrame(rows, f"pos int, {files._UNIT}")
    aliased = units.with_aliases(u)
    assert {r.name: r.alias_of for r in aliased.collect()} == {"a": "b", "b": None, "c": None}
    assert {r.name: r.db_path for r in units.with_alias_stores(aliased).collect()}["a"] == "/b.db"
    deps = spark.createDataFrame([("c", "a"), ("a", "b")], "name string, needs string")
    assert {r.name: r.level for r in units.order(u, deps).collect()} == {"b": 0, "a": 1, "c": 2}
    with pytest.raises(ValueError, match="cycle"):
        units.order(u, deps.union(spark.createDataFrame([("b", "c")], "name string, needs string")))


def test_passes_on_cycle(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "caller_id long, callee_id long")
    got = {r.function_id: r.payload.depth for r in passes.run(f, e, [passes.depth_pass()])["depth"].collect()}
    assert got[3] == 0 and got[2] >= 1 and set(got) == {1, 2, 3}


def test_snapshot_round_trip(spark, tmp_path):
    data = snapshot.write([0, 0, 1, 300 % 2], [[1], [0, 1]], [(0, 1, "f::ret"), (2, 2, "g")])
    (tmp_path / "s.vsnap").write_bytes(data)
    classes, rows, names = snapshot.read(spark, str(tmp_path / "s.vsnap"))
    assert (classes.count(), rows.count(), names.count()) == (4, 3, 2)
    pairs = spark.createDataFrame([(0, 2), (0, 1), (3, 3)], "a long, b long")
    assert {(r.a, r.b): r.may_alias for r in snapshot.may_alias(pairs, classes, rows).collect()} == {(0, 2): True, (0, 1): False, (3, 3): False}
    with pytest.raises(ValueError, match="left over"):
        list(snapshot.parse(data + b"\0"))
    with pytest.raises(ValueError):
        list(snapshot.parse(data[:-1]))


def test_json_sources(spark, tmp_path):
    (tmp_path / "cc.json").write_text(json.dumps([{"directory": "/d", "file": "a.c", "command": "cc -Ix -DA='1 2' -c a.c"}, {"directory": "/d", "file": "a.c", "arguments": ["cc", "-I", "y", "a.c"]}]))
    rows = files.compile_commands(spark, str(tmp_path / "cc.json")).collect()
    assert [(r.file, r.flags) for r in rows] == [("/d/a.c", ["-I", "y"])]
    (tmp_path / "cg.json").write_text(json.dumps({"functions": {"a.c:f": {"file": "a.c", "line_start": 1, "line_end": 2, "linkage": "internal", "callees": [{"callee": "g", "call_type": "direct", "line": 2}]}, "g": {"file": "", "callees": []}}}))
    f, e = files.call_graph(spark, str(tmp_path / "cg.json"))
    assert f.count() == 2 and [tuple(r) for r in e.collect()] == [("a.c:f", "g", False, 2)]
    (tmp_path / "lu.json").write_text(json.dumps({"targets": [{"name": "x", "output": "libx.a"}]}))
    assert files.link_units(spark, str(tmp_path / "lu.json")).first().name == "x"


def test_text_sources(spark):
    df = lambda s: spark.createDataFrame([("p", s)], "path string, source string")
    n = files.ninja_targets(df("build libx.a: AR a.o b.o | dep.h || order\nrule x\n")).first()
    assert (n.output, n.rule, n.inputs) == ("libx.a", "AR", ["a.o", "b.o"])
    m = files.line_markers(df('# 5 "a.h"\nextern int f(int);\nint g;\n# 1 "b.c"\nx\n')).orderBy("pos").collect()
    assert [(r.file, r.line_number) for r in m] == [("a.h", 5), ("a.h", 6), ("b.c", 1)]
    assert files.declared_in(df('# 5 "a.h"\nextern int f(int);\n')).first().header == "a.h"
    c = files.cfg_nodes(df("a.c,3,4:7:C:8:9\na.c,3,4:8:R\nbad\n")).orderBy("id").collect()
    assert [(r.id, r.kind, r.successors) for r in c] == [(7, "C", [8, 9]), (8, "R", [])]
    a = files.asm_functions(df("\t.type f, @function\nf:\n ret\n\t.type g, @function\ng:\n ret\n.L1:\n")).orderBy("start").collect()
    assert [(r.name, r.start, r.end) for r in a] == [("f", 2, 4), ("g", 5, 7)]
    y = files.tasks(df("input_files: 'x.c'\nproperties:\n  - property_file: ../p/termination.prp\n    expected_verdict: true\n  - property_file: ../p/valid-memsafety.prp\n    expected_verdict: false\n    subproperty: valid-free\n"), schema.PROPERTY_KINDS).first()
    assert (y.property, y.expected, y.input) == ("valid-free", False, "x.c")
    j = files.fenced_json(spark.createDataFrame([('```json\n{"a": [1,],\n```',), ("x {\"b\": 2} y",), (None,)], "text string")).collect()
    assert [r.json for r in j] == ['{"a": [1]}', '{"b": 2}', None]


def test_stream_of_updates(spark, tmp_path):
    from graphloom.streaming import dirty

    s = spark.createDataFrame([(1, 5), (2, 5)], "function_id long, updated_at int")
    e = spark.createDataFrame([(1, 2)], "caller_id long, callee_id long")
    spark.createDataFrame([(2, 9)], "function_id long, updated_at int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("function_id long, updated_at int").parquet(str(tmp_path / "in"))
    got = []
    dirty.follow(stream, e, lambda: s, lambda df, n: got.extend(r.caller_id for r in df.collect()), str(tmp_path / "c")).awaitTermination(60)
    assert got == [1]


def test_more_sources(spark, tmp_path):
    df = lambda s: spark.createDataFrame([("p", s)], "path string, source string")
    ir = '!1 = !DIFile(filename: "a.c", directory: "/d")\n!2 = distinct !DISubprogram(name: "f", file: !1, line: 1)\n!3 = !DILexicalBlock(scope: !2, line: 4)\n!4 = !DILocation(line: 5, column: 3, scope: !3)\n!5 = !DILocation(line: 2, column: 1, scope: !2)\n!6 = !DILocation(line: 2, scope: !99)'
    assert sorted(tuple(r) for r in files.debug_locations(df(ir)).select("id", "file", "line", "column").collect()) == [(4, "/d/a.c", 5, 3), (5, "/d/a.c", 2, 1)]
    f = spark.createDataFrame([(1, "a.h", 5, 6)], "id long, file_path string, line_start int, line_end int")
    assert files.preprocessed_sources(files.line_markers(df('# 5 "a.h"\nx\ny\nz\n# 5 "a.h"\nw')), f).first().pp_source == "x\nw\ny"
    rows = text.line_range(text.lines(spark.createDataFrame([(1, "a\nb\nc\nd")], "id int, source string")), 2, 2).orderBy("pos").collect()
    assert [(r.line, r.truncated) for r in rows] == [("b", True), ("c", True)]
    c = spark.createDataFrame([("p1", "f", "x"), ("p1", "g", "heuristic_only")], "project string, function string, model_used string")
    files.write_containers(c, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 1
    v = spark.createDataFrame([("fp1", "safe"), ("fp2", "safe")], "fingerprint string, hypothesis string")
    t = spark.createDataFrame([("/h/fp1/validation_result.json", "{}")], "path string, source string")
    assert {r.fingerprint: r.run for r in files.validations(v, t).collect()} == {"fp1": "{}", "fp2": None}
    cmd = spark.createDataFrame([("/b/x.o", "/s/x.S"), ("/b/y.o", "/s/y.c")], "output string, file string")
    o = spark.createDataFrame([("/b/x.o",), ("q/x.o",), ("/b/y.o",)], "object string")
    assert {r.object for r in units.assembly_of_objects(o, cmd).collect()} == {"/b/x.o", "q/x.o"}
    found = spark.createDataFrame([("inline", "a.c", "asm"), ("ir", "b.ll", None)], "type string, file string, pattern string")
    kept, gone = units.split_by_key(found, spark.createDataFrame([("ir:b.ll:",)], "key string"))
    assert (kept.first().type, gone.first().type) == ("inline", "ir")
