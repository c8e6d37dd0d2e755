"""Sources: large JSON documents cut anywhere, snapshots as a format, queries over written files."""

import json
import random

import pytest

from graphloom.sources import files, json_split, snapshot


def _value(r, level=0):
    texts = ["", "a,b", 'q"x', "\\", "\\\\", '\\"', "{[", "]}", "é\n", "ß" * 9, ":", '":{', "x" * 40]
    kind = r.randrange(8 if level < 3 else 4)
    if kind < 4:
        return [r.choice(texts), r.random(), None, r.randrange(99)][kind]
    if kind < 6:
        return [_value(r, level + 1) for _ in range(r.randrange(4))]
    return {r.choice(texts) + str(i): _value(r, level + 1) for i in range(r.randrange(4))}


@pytest.mark.parametrize("chunk", [1, 3, 16, 257, 1 << 20])
def test_entries_wherever_chunks_end(spark, tmp_path, chunk):
    r = random.Random(chunk)
    few = 4 if chunk < 16 else 12
    docs = {}
    for i in range(3):
        doc = {"functions": {f'k{j}"\\': _value(r) for j in range(few)}, "n": 3, 'odd\\"': [_value(r) for _ in range(few)], "empty": {}, "t": {"functions": {"no": 1}}}
        if i == 1:  # the members in another order
            doc = dict(reversed(doc.items()))
        docs[f"d{i}"] = doc
        (tmp_path / f"d{i}.json").write_text(json.dumps(doc, ensure_ascii=bool(i % 2), indent=2 if i == 2 else None))
    (tmp_path / "e.json").write_text("")
    (tmp_path / "f.json").write_text(" {} ")
    got = {}
    for x in json_split.entries(spark, str(tmp_path), 2, chunk=chunk).collect():
        got.setdefault((x.path[-7:-5], x.member), []).append((x.start, x.seq, x.text))
    want = {(d, m): v for d, doc in docs.items() for m, v in doc.items() if isinstance(v, dict | list) and v}
    assert set(got) == set(want)
    for key, v in want.items():
        texts = [t for _, _, t in sorted(got[key])]
        if isinstance(v, list):
            assert [json.loads(t) for t in texts] == v
        else:
            assert [json.loads("{" + t + "}") for t in texts] == [{k: w} for k, w in v.items()]
    top = [x.text for x in sorted(json_split.entries(spark, str(tmp_path / "d0.json"), 1, chunk=chunk).collect(), key=lambda x: (x.start, x.seq))]
    assert [json.loads("{" + t + "}") for t in top] == [{k: v} for k, v in docs["d0"].items()]


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_readers(spark, tmp_path, chunk):
    units = [{"name": f"u{i}", "output": f"lib{i}.a", "objects": ["a,b.o"]} for i in range(20)]
    (tmp_path / "lu1.json").write_text(json.dumps({"targets": [{"name": "old"}], "link_units": units}))
    (tmp_path / "lu2.json").write_text(json.dumps({"x": 1, "targets": [{"name": "t"}]}))
    got = sorted((r.name, r.pos, r.objects) for r in files.link_units(spark, str(tmp_path / "lu*.json"), chunk).collect())
    assert got == sorted([(u["name"], i, u["objects"]) for i, u in enumerate(units)] + [("t", 0, None)])
    cc = [{"directory": "/d", "file": f"{i % 3}.c", "command": f"cc -DI={i} -c x"} for i in range(10)]
    (tmp_path / "cc.json").write_text(json.dumps(cc, indent=1))
    assert {r.file: r.flags for r in files.compile_commands(spark, str(tmp_path / "cc.json"), chunk).collect()} == {"/d/0.c": ["-DI=9"], "/d/1.c": ["-DI=7"], "/d/2.c": ["-DI=8"]}
    (tmp_path / "cut.json").write_text(json.dumps({"functions": {"f": {"callees": []}, "g": {"callees": []}}})[:-6])
    assert [r.key for r in files.call_graph(spark, str(tmp_path / "cut.json"), chunk)[0].collect()] == ["f"]
    (tmp_path / "none.json").write_text("")
    assert files.call_graph(spark, str(tmp_path / "none.json"), chunk)[1].collect() == []


def test_only_last_commands_are_split(spark, tmp_path):
    """Commands that a later entry of the same directory and file replaces are never split; other spellings of a file still meet."""
    cc = [{"directory": "/d", "file": "a.c", "command": "cc 'never ends"}, {"directory": "/d", "file": "a.c", "command": "cc -DI=1"}, {"directory": "/d/e", "file": "../b.c", "command": "cc -DI=2"}, {"directory": "/d", "file": "./b.c", "arguments": ["cc", "-DI=3"]}]
    (tmp_path / "cc.json").write_text(json.dumps(cc))
    assert {r.file: r.flags for r in files.compile_commands(spark, str(tmp_path / "cc.json"), 20).collect()} == {"/d/a.c": ["-DI=1"], "/d/b.c": ["-DI=3"]}


def test_documents_written(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i, json.dumps({"i": i, "t": "a,\n]"})) for i in range(60)], "k int, i int, text string")
    json_split.write_documents(rows, str(tmp_path / "a"), 'm"', key="k", order=("i",), each=20)
    docs = [json.loads(p.read_text()) for p in (tmp_path / "a").glob("document=*/part-*.txt")]
    lists = [d['m"'] for d in docs]
    assert sorted(x["i"] for v in lists for x in v) == list(range(60)) and all(v == sorted(v, key=lambda x: x["i"]) for v in lists)
    keys = [{x["i"] % 7 for x in v} for v in lists]
    assert len(docs) > 1 and sum(map(len, keys)) == 7  # a key has one document
    got = json_split.numbered(json_split.entries(spark, str(tmp_path / "a"), 2, ('m"',), chunk=50))
    assert sorted((r.pos, json.loads(r.text)["i"]) for r in got.collect()) == sorted((n, x["i"]) for v in lists for n, x in enumerate(v))
    members = rows.selectExpr("concat('\"', i, '\":', text) AS text")
    json_split.write_documents(members, str(tmp_path / "b"), array=False)
    assert set(json.loads(next((tmp_path / "b").glob("document=*/part-*.txt")).read_text())) == {str(i) for i in range(60)}
    json_split.write_documents(rows.limit(0), str(tmp_path / "c"))
    assert json_split.entries(spark, str(tmp_path / "c"), 1).collect() == []


def test_snapshot_format(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    paths = [str(tmp_path / "a.vsnap"), str(tmp_path / "sub" / "b.vsnap")]
    for i, path in enumerate(paths):
        data = snapshot.write([0, 1, 1, i], [[0], [0, 1]], [(2, 2, f"g{i}"), (3, 1, "f::ret")])
        with open(path, "wb") as f:
            f.write(data)
    classes, rows, _ = snapshot.read(spark, str(tmp_path))
    assert sorted(tuple(r) for r in classes.collect()) == sorted((p, n, c) for i, p in enumerate(paths) for n, c in enumerate([0, 1, 1, i]))
    assert rows.groupBy("class").count().orderBy("class").collect() == [(0, 2), (1, 4)]
    assert sorted(tuple(r)[1:] for r in snapshot.read(spark, paths[1])[2].collect()) == [(2, 2, "g1"), (3, 1, "f::ret")]
    with open(paths[1], "ab") as f:
        f.write(b"x")
    assert snapshot.read(spark, paths[0])[0].count() == 4  # the broken file isn't read
    with pytest.raises(Exception, match="left over"):
        classes.count()
    with pytest.raises(Exception, match="relation is one of"):
        spark.read.format("alias_snapshot").option("relation", "odd").load(str(tmp_path)).schema
    (tmp_path / "none").mkdir()
    assert snapshot.read(spark, str(tmp_path / "none"))[2].collect() == []
    with pytest.raises(Exception, match="is not there"):
        snapshot.read(spark, str(tmp_path / "gone"))[0].collect()
