"""From raw documents to token ids: quality, lines, near copies, mix, tokens.

Each stage reads the table that the one before wrote. All stages but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, ngram_join, quality_classifier, sentencepiece
from graphloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    weights = quality_classifier.fitted(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, weights, name="_gl_score")
    return scored.filter(F.col("_gl_score") >= quality_classifier.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; n_chars follows the text."""
    return line_dedup.dedup_lines(docs, counts=("_gl_lines", "_gl_dropped")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken, shuffled inside their shards."""
    mixed = mixing.mixed(docs, names=("_gl_shard", "_gl_key")).repartition("_gl_shard").sortWithinPartitions("_gl_shard", "_gl_key")
    return mixed.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the text that they decode to."""
    return sentencepiece.report(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources", mix), ("SentencePiece", tokens)]

#: The classifier and the tokeniser aren't expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
