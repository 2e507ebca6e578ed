"""Comparing predictions with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f1(label: Column, predicted: Column) -> Column:
    """An aggregate: 2 tp / (2 tp + fp + fn), 0 without any positive."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tp, wrong = n((label == 1) & predicted), n((label == 1) != predicted)
    return F.when(2 * tp + wrong == 0, 0.0).otherwise(2 * tp / F.nullif(2 * tp + wrong, F.lit(0)))


def label_stats(labels: DataFrame) -> DataFrame:
    """Positives, negatives and the share of positives."""
    return labels.agg(F.sum("label").alias("npos"), F.sum(1 - F.col("label")).alias("nneg"), F.avg("label").alias("ratio"))


def scored(labels: DataFrame, predicted: DataFrame, queries: int) -> DataFrame:
    """qid and f1 of each of the queries 0 .. queries - 1, from predicted (qid, vid) and labels (vid, label): only hits are
    joined, misses follow from the count of positives. A query without any hit scores 0."""
    spark = labels.sparkSession
    hits = predicted.distinct().join(labels, "vid").groupBy("qid").agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"))
    every = F.broadcast(spark.range(queries).select(F.col("id").cast("int").alias("qid")))  # as many rows as programs
    pos = labels.agg(F.sum("label").alias("pos"))
    joined = every.join(hits, "qid", "left").crossJoin(F.broadcast(pos))  # one row
    return joined.select("qid", F.coalesce(2 * F.col("tp") / F.nullif(F.col("n") + F.col("pos"), F.lit(0)), F.lit(0.0)).alias("f1"))


def spread(scores: DataFrame, by: str = "step", score: str = "f1") -> DataFrame:
    """Exact median and quartiles of scores."""
    at = lambda p: F.percentile(score, F.lit(p))
    return scores.groupBy(by).agg(at(0.5).alias("median"), at(0.25).alias("low"), at(0.75).alias("high"))


def disagreement(predicted: DataFrame, queries: int) -> DataFrame:
    """vid and 2 p (1 - p), p being the share of queries that predict it; predicted: (qid, vid)."""
    return predicted.distinct().groupBy("vid").agg((F.count(F.lit(1)) / queries).alias("p")).select("vid", (2 * F.col("p") * (1 - F.col("p"))).alias("gini"))
