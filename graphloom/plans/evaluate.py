"""Detection quality against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def scores(tp: Column, fn: Column, fp: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), 4)}


def matched(truth: DataFrame, found: DataFrame, keys: list[str], truth_order: str, found_order: str) -> DataFrame:
    """keys, outcome (tp, fn, fp), with the rows' own columns: one to one, in order, per key.

    Truth with a null key can't match and is a fn.
    """
    nul = F.lit(False)
    for k in keys:
        nul = nul | F.col(k).isNull()
    a = truth.filter(~nul).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(truth_order)))
    b = found.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(found_order)))
    met = a.withColumn("_t", F.lit(True)).join(b.withColumn("_f", F.lit(True)), [*keys, "_i"], "full_outer")
    out = met.withColumn("outcome", F.when(F.col("_t") & F.col("_f"), "tp").when(F.col("_t"), "fn").otherwise("fp")).drop("_i", "_t", "_f")
    return out.unionByName(truth.filter(nul).withColumn("outcome", F.lit("fn")), allowMissingColumns=True)


def confirmed(matches: DataFrame, patched: DataFrame, keys: list[str]) -> DataFrame:
    """True positives that the patched version no longer shows."""
    return matches.filter("outcome = 'tp'").join(patched.select(*keys).distinct(), keys, "left_anti")


def confusion(matches: DataFrame, by: str) -> DataFrame:
    """tp, fn, fp and scores per group."""
    counts = matches.groupBy(by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fn", "fp")))
    return counts.withColumns(scores(F.col("tp"), F.col("fn"), F.col("fp")))


def confusion_rollup(matches: DataFrame, by: str) -> DataFrame:
    """The same with a total row (null group)."""
    counts = matches.rollup(by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fn", "fp")))
    return counts.withColumns(scores(F.col("tp"), F.col("fn"), F.col("fp")))


def verdicts(rows: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    """One row: total (errors too, which are nulls), tp, tn, fp, fn, accuracy, precision, recall, f1."""
    t, p = expected == 1, predicted == 1
    c = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(expected.isNull() | predicted.isNull()).alias("errors"),
    )
    return c.withColumn("accuracy", F.round(ratio(F.col("tp") + F.col("tn"), F.col("total")), 4)).withColumns(scores(F.col("tp"), F.col("fn"), F.col("fp")))


def summed(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))
