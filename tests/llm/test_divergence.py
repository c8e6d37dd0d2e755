"""Divergence of sources against plain Python over all pairs and words."""

import random
import re
from collections import Counter, defaultdict

from graphloom.llm import divergence as D

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=D.LEAST_DOCS, top=D.TOP_WORDS):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        names = [s for x, s in groups if x == lang]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            words = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", words)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(ranked) if part == "pair" or r < top]
    return sorted(out)


def sample(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["É", "naïve", "x1y", "A_b", "日本", "𝒳y", "Zz"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de", None, "xx"])
        text = " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=rng.randrange(30))) if lang != "xx" else f"only{chr(97 + i % 26)}{'q' * i}"
        rows.append((i, rng.choice([text, text.upper(), None]) if rng.random() < 0.1 else text, lang, rng.choice(["hot"] * 9 + ["b", "é", "c", None, ""])))
    return rows + [rows[0]] * 3 + [(9, "", "en", "empty"), (None, None, "zz", "lonely"), (1, "w" * 200_000 + " wa" * 50_000, "en", "long")]


def test_report_equals_brute_force(docs):
    rows = sample(1)
    got = D.report(docs(rows))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"


def test_parameters_and_empty_table(docs):
    rows = sample(2, 100)
    assert sorted(map(tuple, D.report(docs(rows), least_docs=1, top=3).collect())) == brute(rows, 1, 3)
    assert D.report(docs([])).count() == 0


def test_histogram_counts_every_kept_word_once(docs):
    kept = D.profiles(D.tallied(docs(sample(3))))
    every = D.groups(docs(sample(3)), kept).filter("lang = 'en'")
    one, two = sorted(r.source for r in every.collect())[:2]
    v = every.first().v
    pairs = kept.sparkSession.createDataFrame([("en", one, two, v)], "lang string, one string, two string, v long")
    cells = D.joint(kept, pairs).filter("lang = 'en'").filter(f"one = '{one}' and two = '{two}'").collect()
    assert sum(c.words for c in cells) == v and min(c.words for c in cells) > 0 and len({(c.a, c.b) for c in cells}) == len(cells)
