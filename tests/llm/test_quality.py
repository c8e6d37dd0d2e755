"""Quality rules against a plain Kneser-Ney model; the classifier on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality_classifier as Q
from graphloom.llm import quality_rules as R

from .conftest import SF


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def model(texts):
    """Probability of a symbol after its context, by a plain modified Kneser-Ney model of order 4."""
    raw = [Counter() for _ in range(4)]
    for t in texts:
        for w in words(t):
            s = "\n" + w + "\n"
            for i in range(1, len(s)):
                k = min(i, 3)
                raw[k][s[i - k : i + 1]] += 1
    count = [None] * 4
    count[3] = raw[3]
    for k in (2, 1, 0):
        c = Counter(raw[k])
        for g in count[k + 1]:
            c[g[1:]] += 1
        count[k] = c
    clip = lambda x, most: max(0.1, min(x, most))
    discounts, ctx = [], []
    for k in range(4):
        n = [max(1, sum(v == i for v in count[k].values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts.append([clip(1 - 2 * y * n[1] / n[0], 0.9), clip(2 - 3 * y * n[2] / n[1], 1.9), clip(3 - 4 * y * n[3] / n[2], 2.9)])
        by = defaultdict(list)
        for g, v in count[k].items():
            by[g[:-1]].append(v)
        ctx.append(by)

    def p(gram):
        k = len(gram) - 1
        lower = p(gram[1:]) if k else 1 / (len(count[0]) + 1)
        seen = ctx[k].get(gram[:-1])
        if not seen:
            return lower
        d = lambda v: discounts[k][min(v, 3) - 1] if v else 0
        v = count[k][gram]
        return ((v - d(v)) + sum(map(d, seen)) * lower) / sum(seen)

    return p


def perplexity(p, t):
    logs = [math.log(p(s[i - min(i, 3) : i + 1])) for w in words(t) for s in ["\n" + w + "\n"] for i in range(1, len(s))]
    return -sum(logs) / len(logs) if logs else None


TEXTS = ["the cat the cat the cat sat\nthe cat\n\nthe cat", "a b c a b c a", "été à la é 🙂 #*$%&|<>", "", None, " \n\t", "x" * 3000, "ab" + "#!" * 40 + " cd?? $$ " + "-" * 30, "one\x0ctwo\x85three", "Ab ab AB ab"]


def test_counts_and_perplexity(docs):
    rng = random.Random(1)
    texts = TEXTS + [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(80))) for _ in range(40)]
    langs = [None if i % 7 == 0 else "en" if i % 2 else "fr" for i in range(len(texts))]
    df = docs([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]).repartition(3)
    of = {lang: model([t for t, x in zip(texts, langs, strict=True) if x == lang]) for lang in set(langs)}
    got = {r.doc_id: r for r in R.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        want = perplexity(of[langs[i]], t)
        assert (r.log_perplexity is None) == (want is None)
        if want is not None:
            assert r.log_perplexity == pytest.approx(want, abs=1e-3)
        assert not (r.kept and r.base_failed)


def test_probabilities_sum_to_one():
    p = model(["abc abd bcd", "dab cab"])
    assert sum(p("\na" + c) for c in "abcd\n") < 1 and sum(p(c) for c in "abcd\n") == pytest.approx(5 / 6, abs=0.2)


def test_band_rejects_gibberish(docs):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(120)), "en") for i in range(150)]
    rows.append((999, " ".join("".join(rng.choice("QWZX!?@0123456789") for _ in range(6)) for _ in range(120)), "en"))
    got = {r.doc_id: r.kept for r in R.report(docs(rows)).collect()}
    assert not got.pop(999) and all(got.values())


def word_class(w):
    """(class, shape) of a word, from its bytes."""
    w = w.encode()
    core = w.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    mark = w[-1:] if len(core) < len(w) else b""
    first = w[:1]
    kind = "upper" if first.isupper() else "lower" if first.islower() else "digit" if first.isdigit() else "other"
    return (core, mark) if len(core) <= 3 else (kind, core[-1:].lower(), mark), (kind, mark)


END = ("end", "end")


def counts(texts):
    """Counts of classes after nothing, shape and class; and of words as one of all, and for their class."""
    raw, uses = Counter(), Counter()
    for t in filter(words, texts):
        s = (END, *map(word_class, words(t)), END)
        raw.update((a, b[0]) for a, b in zip(s, s[1:], strict=False))
        uses.update((word_class(w)[0], w) for w in words(t))
    shapes = Counter((a[1], b) for a, b in raw)
    return [Counter(((), b) for _, b in shapes), shapes, raw], [Counter(((), w) for _, w in uses), uses]


def shares(counters, most):
    """The least kept count of each language: those with few entries keep all, the others share the rest evenly."""
    left, least = most, {}
    for done, (lang, c) in enumerate(sorted(counters.items(), key=lambda x: (len(x[1]), x[0] or ""))):
        share = left / (len(counters) - done)
        if len(c) > share:
            break
        left, least[lang] = left - len(c), 1
    rest = {x: c for x, c in counters.items() if x not in least}
    return least | {x: next(v for v in range(1, max(c.values()) + 2) if sum(n >= v for n in c.values()) <= share) for x, c in rest.items()}


def interpolated(count, least):
    """A plain modified Kneser-Ney model of these counts; n-grams of each length below its least count are pruned."""
    clip = lambda x, most: max(0.1, min(x, most))
    discounts, by = [], []
    for c in count:
        n = [max(1, sum(v == i for v in c.values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts.append([clip(1 - 2 * y * n[1] / n[0], 0.9), clip(2 - 3 * y * n[2] / n[1], 1.9), clip(3 - 4 * y * n[3] / n[2], 2.9)])
        by.append(defaultdict(list))
        for (a, _), v in c.items():
            by[-1][a].append(v)

    top = len(count) - 1

    def p(a, b, own, k=top):
        context = [(), a[1], a][k] if top == 2 else [(), a][k]
        lower = p(a, b, own, k - 1) if k else 1 / (len(count[0]) + 1)
        seen = by[k].get(context)
        if not seen:
            return lower
        d = lambda v: discounts[k][min(v, 3) - 1] if v >= least[k] else v
        v = count[k][context, b]
        v = 0 if k == top and v <= own else v
        return ((v - d(v) if v else 0.0) + sum(map(d, seen)) * lower) / sum(seen)

    return p


def word_measures(p, uses, t):
    """Log perplexity over classes, over words, and how much the first exceeds that without contexts."""
    if not words(t):
        return None, None, None
    s = [END, *map(word_class, words(t)), END]
    own = Counter((a, b[0]) for a, b in zip(s, s[1:], strict=False))
    full, alone = (-sum(n * math.log(p(*x, n, k)) for x, n in own.items()) / (len(s) - 1) for k in (2, 0))
    emitted = -sum(n * math.log(uses(word_class(w)[0], w, n)) for w, n in Counter(words(t)).items()) / (len(s) - 1)
    return full, full + emitted, full - alone


def corpus(rng):
    """Texts with sentences in three languages (one null), some of them odd."""
    vocabulary = ["".join(rng.choice("aeioulmnrsté") for _ in range(rng.randrange(1, 9))) for _ in range(150)]

    def sentences(n):
        out = []
        while len(out) < n:
            s = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 12))]
            out += [s[0].capitalize(), *s[1:-1], s[-1] + rng.choice(".?,")]
        return out

    texts = TEXTS + [" ".join(sentences(rng.randrange(40, 160))) for _ in range(150)]
    odd = [x for t in texts[-6:] for x in [rng.sample(words(t), len(words(t)))]]
    texts += [*map(" ".join, odd), "| a | b. " * 90, " ".join(["zq7#"] * 30 + sentences(60)), " ".join(rng.choice(vocabulary[:5]) for _ in range(99))]
    return [(i, t, [None, "en", "fr"][i % 3]) for i, t in enumerate(texts)]


def band(values, spreads):
    """Edges from the lower median and the lower median distance of each side."""
    median = lambda x: sorted(x)[(len(x) - 1) // 2]
    m = median(values)
    low, high = (math.inf if n is None else median([abs(v - m) for v in values if side * (v - m) >= 0]) * n * 1.4826 + 1e-9 for side, n in zip((-1, 1), spreads, strict=True))
    return m - low, m + high


@pytest.mark.parametrize("most", [1 << 21, 150, 5])
def test_judged_as_by_brute_force(docs, monkeypatch, most):
    monkeypatch.setattr(R.kneser_ney, "__defaults__", (True, most))
    rows = [(i, t, "fr" if x == "fr" and i % 4 else None if x is None else "en") for i, t, x in corpus(random.Random(8))]
    got = {r.doc_id: r for r in R.judge(docs(rows).repartition(3)).collect()}
    langs = (None, "en", "fr")
    counted = {x: counts([t for _, t, lang in rows if lang == x]) for x in langs}
    least = [[shares({x: counted[x][m][k] for x in langs}, most) for k in range(n)] for m, n in ((0, 3), (1, 2))]
    kept = {}
    for lang in langs:
        own = [(i, t) for i, t, x in rows if x == lang]
        models = [interpolated(counted[lang][m], [x[lang] for x in least[m]]) for m in (0, 1)]
        measures = list(zip(*(word_measures(*models, t) for _, t in own), strict=True))
        if most > 150:
            of_characters = model([t for _, t in own])
            measures.append([perplexity(of_characters, t) for _, t in own])
        for name, found in zip(("class_log_perplexity", "word_log_perplexity", "order_log_ratio", "log_perplexity"), measures, strict=False):
            low, high = band([v for v in found if v is not None], R.SPREADS[name])
            for (i, _), v in zip(own, found, strict=True):
                assert getattr(got[i], name) == (None if v is None else pytest.approx(v, abs=1e-4))
                kept[i] = kept.get(i, True) and (v is None or low <= v <= high)
    if most > 150:
        for i, t, _ in rows:
            n, *_, repeated = base(t)
            assert got[i].kept == (kept[i] and n >= 50 and 100 * repeated <= 50 * n), i
        assert any(not got[i].kept and not got[i].base_failed for i in got)


@pytest.mark.parametrize("held", [40, 500])
def test_no_ngram_is_dropped(docs, monkeypatch, held):
    """With arrays that hold a part of each model (40: not even all classes), measures are those of whole models."""
    assert R.kneser_ney.__defaults__ == (True, None)  # no pruning
    monkeypatch.setattr(R, "HELD", held)
    rows = [(i, t, "en" if x == "en" else None) for i, t, x in corpus(random.Random(8))[:90]]
    got = {r.doc_id: r for r in R.judge(docs(rows).repartition(3)).collect()}
    for lang in (None, "en"):
        own = [(i, t) for i, t, x in rows if x == lang]
        of_characters, words_of = model([t for _, t in own]), counts([t for _, t in own])
        models = [interpolated(c, [1] * len(c)) for c in words_of]
        assert sum(map(len, words_of[0])) > held and len(words_of[1][1]) > min(held, 100)
        for i, t in own:
            want = [perplexity(of_characters, t), *word_measures(*models, t)]
            for name, v in zip(("log_perplexity", "class_log_perplexity", "word_log_perplexity", "order_log_ratio"), want, strict=True):
                assert getattr(got[i], name) == (None if v is None else pytest.approx(v, abs=1e-4)), (i, name)


def test_large_language_leaves_room_for_a_small_one(spark):
    rows = [("big", c) for c in range(1, 201)] + [("small", 1)] * 10 + [("mid", 1)] * 30 + [("mid", 2)] * 30
    got = {r.lang: r.least for r in R._with_least(R.written(spark.createDataFrame(rows, "lang string, c long")), 90).distinct().collect()}
    assert got == {"small": 1, "mid": 2, "big": 161}  # 10 of 90 for the first, 40 each for the others


def test_strange_words_go_and_ids_keep_their_type(spark):
    """Words of usual letters and endings, in usual order, that no other text uses."""
    rng = random.Random(12)
    some = lambda n: ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(n)]
    vocabulary = some(200)
    rows = [(f"d{i}", " ".join(rng.choice(vocabulary) for _ in range(120)), "en") for i in range(150)] + [("x", " ".join(some(120)), "en"), (None, "", "en")]
    got = {r.doc_id: r for r in R.judge(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    x = got.pop("x")
    assert x.word_log_perplexity > x.word_log_perplexity_high and not x.kept and not x.base_failed
    assert got.pop(None).base_failed and sum(r.kept for r in got.values()) > 0.95 * len(got)


def test_order_of_words_decides(spark):
    """Of good documents, nearly all stay; with their words in random order, nearly all go."""
    d, lab = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    rng = random.Random(4)
    some = [r for r in d.join(lab.filter("quality = 1"), "doc_id").orderBy("doc_id").limit(400).collect() if len(words(r.text)) >= 80]
    extra = [(10**9 + i, " ".join(rng.sample(words(r.text), len(words(r.text)))), r.lang) for i, r in enumerate(some)]
    got = {r.doc_id: r for r in R.report(d.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))).collect()}
    mixed = [got[i].kept for i, *_ in extra if not got[i].base_failed]
    assert len(mixed) > 200 and sum(mixed) <= 0.05 * len(mixed)
    kept = {q: [got[r.doc_id].kept for r in lab.filter(f"quality = {q}").collect() if not got[r.doc_id].base_failed] for q in (0, 1)}
    assert sum(kept[1]) >= 0.97 * len(kept[1]) and sum(kept[0]) <= 0.3 * len(kept[0])


def test_each_edge_of_the_band_rejects(docs):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    share = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, share, k=200)), "en") for i in range(150)]
    rows += [(998, " ".join(rng.choice(vocabulary[:12]) for _ in range(200)), "en"), (999, " ".join(rng.choice(vocabulary[100:]) for _ in range(200)), "en")]
    got = {r.doc_id: r for r in R.judge(docs(rows)).collect()}
    low, high = got.pop(998), got.pop(999)
    assert not low.base_failed and low.log_perplexity < low.log_perplexity_low and not low.kept
    assert not high.base_failed and high.log_perplexity > high.log_perplexity_high and not high.kept
    assert sum(r.kept for r in got.values()) > 0.97 * len(got)


def test_rules_empty(docs):
    assert R.report(docs([])).count() == 0


def test_classifier(spark):
    d, lab = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    got = Q.report(d, lab)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[x.doc_id], x.quality) for x in lab.collect() if rows[x.doc_id].held_out]
    good = [r.predicted for r, q in held if q == 1]
    bad = [r.predicted for r, q in held if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_classifier_never_sees_the_held_out_fold(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = lab.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (Q.fitted(d, lab) == Q.fitted(d.withColumn("lang", F.lit("x")), flipped)).all()


def test_classifier_edges(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.report(docs([(1, None), (2, ""), (3, "x" * 90_000), (None, "a b")]), none).collect()
    assert {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert Q.report(docs([(1, "a"), (1, "a")]), some).count() == 2
    assert Q.report(docs([]), some).count() == 0
