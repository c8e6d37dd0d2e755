"""The pipeline's stages, each on the table that the one before wrote."""

import re

import corpus_pipeline
from graphloom.llm import quality_classifier as Q
from graphloom.llm.queries import oracle_sql, queries

from .conftest import SF


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first, lines, near, mixed, tokens = seen.values()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in first.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert first.count() < before and sum(i in kept for i in good) > 0.97 * len(good)
    assert {r.doc_id for r in lines.collect()} == kept
    assert near.count() <= lines.count()
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect())
    assert abs(size(mixed) - 1.5 * size(near)) < 0.01 * size(near) + 40
    assert tokens.count() == mixed.count() and {len(r.token_ids) == r.n_tokens for r in tokens.collect()} == {True}


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in queries() if n.startswith("op")}
    assert set(oracle_sql()) <= set(queries()) and Q.THRESHOLD == 0.3
