"""Exact, line and near deduplication against brute force, with nulls, ties, repeats and hot groups."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from graphloom.llm import exact_dedup, line_dedup, ngram_join
from graphloom.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def test_exact(docs):
    rows = [(i, random.Random(i % 40).choice(["Ab", "aB", "é", "É", "", None, "x" * 50_000])) for i in range(300)]
    got = {r.doc_id: r for r in exact_dedup.report(docs(rows)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    for key, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    left = exact_dedup.drop_exact_copies(docs(rows), "doc_id", "text")
    assert {r.doc_id for r in left.collect()} == {max(v) for v in groups.values()} and "count" in left.columns


def test_exact_edges(docs):
    rows = [(None, "a"), (1, "a"), (1, "a"), (None, None)]
    got = exact_dedup.report(docs(rows)).collect()
    a = [r for r in got if r.group_size == 3]
    assert len(a) == 3 and sum(r.kept for r in a) == 1 and {r.keep_id for r in a} == {1}
    assert exact_dedup.report(docs([])).count() == 0


def lines_brute(rows):
    strip, held = " \t\n\x0b\x0c\r", defaultdict(set)
    key = lambda x: x.strip(strip).translate(LOWER)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 10 or len(held[key(x)]) < 2 or i == min(held[key(x)])]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines(docs):
    rng = random.Random(1)
    pool = ["a common line of text", " A COMMON line of text\r", "short", "", "ééééééééé", "éééééééééé", "x\x85padded by nel....", *(f"own line number {i}" for i in range(60))]
    rows = [(i, None if i == 5 else "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(120)] + [(500, "a common line of text\n" * 3000)]
    assert sorted(tuple(r) for r in line_dedup.report(docs(rows)).collect()) == lines_brute(rows)
    full = line_dedup.dedup_lines(docs(rows))
    assert full.columns == ["doc_id", "text", "lang", "source", "n_chars", "count", "n_lines", "n_dropped"] and full.count() == len(rows)


def test_exact_copies_go_by_row(docs):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (3, "A"), (3, "c"), (None, None), (4, "")]
    left = exact_dedup.drop_exact_copies(docs(rows), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, "b"), (3, "A"), (3, "c"), (4, "")]


def test_lines_edges(docs):
    assert line_dedup.report(docs([])).count() == 0
    got = line_dedup.report(docs([(None, "a line of twelve"), (3, "a line of twelve"), (3, "a line of twelve"), (4, "a line of twelve")])).collect()
    assert sorted((r.doc_id or 99, r.n_dropped) for r in got) == [(3, 0), (3, 0), (4, 1), (99, 1)]


def near_brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted((d, len(sets[i]), min(low[find(i)])) for i, (d, _) in enumerate(rows))


def copies(rng, n, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near(docs):
    rng = random.Random(3)
    texts = [t for n, w, e in [(60, 80, 4), (40, 200, 8), (30, 40, 2), (5, 5, 1), (20, 300, 6)] for t in copies(rng, n, w, e)]
    texts += ["a b", "A  B", "a b c", "", None, " \n ", "one", *(" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40))]
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(k))}" for k in range(0, 60, 3)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    found = ngram_join.groups(docs(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == near_brute(rows)
    left = {r.doc_id for r in ngram_join.drop_near_copies(docs(rows)).collect()}
    assert left == {c for _, n, c in near_brute(rows) if n} | {d for d, n, _ in near_brute(rows) if not n}


def test_near_edges(docs):
    assert ngram_join.groups(docs([])).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " x"), (2, long + " x"), (None, long), (7, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.groups(docs(rows)).collect())
    assert got == [(0, 59996, 1), (1, 59996, 1), (2, 59997, 1), (2, 59997, 1), (7, 0, 7)]


def test_near_copies_go_by_row(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (None, "other " * 3), (5, text), (5, text), (7, text + " y"), (None, None), (None, None), (8, "a b"), (8, "a b")]
    left = ngram_join.drop_near_copies(docs(rows)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in left) == [(0, ""), (0, ""), (0, "other"), (5, "w0 w1"), (8, "a b")]
    assert left[0]["count"] == "x"


@pytest.mark.parametrize(("block", "sparse"), [(4, 0), (4, 10**9), (512, 64)])
def test_near_counts_all_links(docs, monkeypatch, block, sparse):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SPARSE", sparse)
    rng = random.Random(9)
    texts = [t for n, w, e in [(40, 80, 6), (20, 200, 14), (10, 40, 3)] for t in copies(rng, n, w, e)]
    texts += [texts[0]] * 3 + ["a b", "A  B", "", None, *(" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(10))]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = {i: sum(linked(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in ngram_join.report(docs(list(enumerate(texts)))).collect()} == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
