"""Names that clash with results, null ids and long texts, for the operators that carry other columns along."""

import corpus_pipeline
from graphloom.llm import line_dedup, mixing, ngram_join, quality_classifier, quality_rules, secret_scan, sentencepiece

LONG = " ".join(f"w{i % 977}." for i in range(150_000))
ROWS = [(None, "a line of twelve", "en", "a"), (1, "a line of twelve", None, None), (1, LONG, "en", "a"), (None, None, None, None), (2, "", "en", "b"), (3, "x" * 300_000, "fr", "b")]


def clashing(docs, *names):
    df = docs(ROWS)
    for i, n in enumerate(names):
        df = df.selectExpr("*", f"'own{i}' AS {n}")
    return df


def test_results_replace_columns_of_their_name(docs):
    got = line_dedup.dedup_lines(clashing(docs, "N_lines", "n_dropped", "shard"))
    assert got.columns[-3:] == ["shard", "n_lines", "n_dropped"] and [r.n_dropped for r in got.collect() if r.doc_id is None and r.text == ""] == [1]
    none = docs([]).sparkSession.createDataFrame([], "doc_id long, quality int")
    df = clashing(docs, "score", "n_lines")
    got = quality_classifier.score(df, quality_classifier.fitted(df, none))
    assert got.columns[-2:] == ["n_lines", "score"] and {r.score for r in got.collect()} == {0.5}
    got = sentencepiece.decode(sentencepiece.encode(clashing(docs, "token_ids", "decoded")))
    assert got.columns[-2:] == ["token_ids", "decoded"] and all(r.decoded == (r.text or "") for r in got.collect())
    got = mixing.mixed(clashing(docs, "shard", "shuffle_key", "score"))
    assert got.columns[-3:] == ["score", "shard", "shuffle_key"] and {r.score for r in got.collect()} == {"own2"}


def test_stages_keep_columns_of_these_names(docs, spark):
    names = ["score", "n_lines", "n_dropped", "shard", "shuffle_key", "uid", "kept", "lists"]
    df = clashing(docs, *names)
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_copies, corpus_pipeline.mix):
        df = corpus_pipeline.written(stage(spark, df, None))
        assert df.columns[-len(names):] == names and all(tuple(r[n] for n in names) == tuple(f"own{i}" for i in range(len(names))) for r in df.collect())


def test_null_ids_and_long_texts(docs):
    assert [r.n_secrets for r in secret_scan.report(docs(ROWS)).collect()] == [0] * 6
    got = sorted((r.size, r.taken <= 2 * r.size) for r in mixing.report(docs(ROWS)).collect())
    assert [s for s, _ in got] == [0, 0, 1, 4, 4, 150_000] and all(ok for _, ok in got)
    rules = {(r.doc_id, r.n_words): r.base_failed for r in quality_rules.report(docs(ROWS)).collect()}
    assert rules[(1, 150_000)] and len(rules) == 6


def test_ids_of_other_types(docs):
    df = docs([(1, "a line of twelve"), (2, "A LINE OF TWELVE")]).selectExpr("cast(doc_id AS decimal(9, 0)) AS doc_id", "text")
    assert sorted((int(r.doc_id), r.n_dropped) for r in line_dedup.report(df).collect()) == [(1, 0), (2, 1)]


def test_overfull_filters_change_nothing(docs, monkeypatch):
    import random

    from graphloom.llm import bloom

    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(60)) + "\nthe same line of text") for i in range(40)]
    rows += [(100 + i, t + " x") for i, (_, t) in enumerate(rows[:10])]
    full = sorted(map(tuple, ngram_join.report(docs(rows)).collect())), sorted(map(tuple, line_dedup.report(docs(rows)).collect()))
    for module in (bloom, ngram_join, line_dedup):
        for name in ("LEAST_BITS", "MOST_BITS"):
            monkeypatch.setattr(module, name, 6, raising=False)
    monkeypatch.setattr(ngram_join, "power_of_two", lambda *_: 6)
    assert (sorted(map(tuple, ngram_join.report(docs(rows)).collect())), sorted(map(tuple, line_dedup.report(docs(rows)).collect()))) == full
