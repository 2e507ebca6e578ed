"""Interval algebra: relations (vid, i, j) of half-open frame intervals in which something holds.

An absent row is no match. With a column `score` the same operators are quantitative: a conjunction takes the least
score, a sequence the best over its cuts of the least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmenta.operators.lineage import saved


def unit(frames: DataFrame) -> DataFrame:
    """(vid, fid) to one-frame intervals."""
    return frames.select("vid", F.col("fid").alias("i"), (F.col("fid") + 1).alias("j"), *[c for c in frames.columns if c == "score"]).distinct()


def _scored(a: DataFrame, b: DataFrame) -> bool:
    return "score" in a.columns and "score" in b.columns


def conjunction(a: DataFrame, b: DataFrame) -> DataFrame:
    if not _scored(a, b):
        return a.select("vid", "i", "j").join(b.select("vid", "i", "j"), ["vid", "i", "j"]).distinct()
    met = a.join(b.withColumnRenamed("score", "other"), ["vid", "i", "j"])
    return met.select("vid", "i", "j", F.least("score", "other").alias("score"))


def sequence(a: DataFrame, b: DataFrame, gap: bool = False) -> DataFrame:
    """b right after a, or with a gap of any length between."""
    left = a.withColumnsRenamed({"j": "m", "score": "first"})
    right = b.withColumnsRenamed({"i": "n", "score": "second"})
    met = left.join(right, "vid").filter(F.col("m") <= F.col("n")) if gap else left.join(right.withColumnRenamed("n", "m"), ["vid", "m"])
    if not _scored(a, b):
        return met.select("vid", "i", "j").distinct()
    return met.groupBy("vid", "i", "j").agg(F.max(F.least("first", "second")).alias("score"))


def kleene_of_units(units: DataFrame) -> DataFrame:
    """One or more repetitions of one-frame intervals: all parts of each run, without recursion."""
    run = F.col("i") - F.row_number().over(Window.partitionBy("vid").orderBy("i"))
    runs = units.withColumn("run", run).groupBy("vid", "run").agg(F.min("i").alias("low"), F.max("j").alias("high"))
    starts = runs.withColumn("i", F.explode(F.sequence("low", F.col("high") - 1)))
    return starts.select("vid", "i", F.explode(F.sequence(F.col("i") + 1, "high")).alias("j"))


def kleene(a: DataFrame) -> DataFrame:
    """One or more adjacent repetitions: the relation is joined with itself until nothing new comes, so rounds grow with
    the logarithm of the longest chain."""
    known = saved(a.select("vid", "i", "j").distinct())
    n = known.count()
    while True:
        wider = saved(known.union(sequence(known, known)).distinct())
        if (m := wider.count()) == n:
            return wider
        known, n = wider, m


def min_length(a: DataFrame, least: int) -> DataFrame:
    return a.filter(F.col("j") - F.col("i") >= least)


def occurs(a: DataFrame) -> DataFrame:
    """Segments with any interval; with scores, the best of each."""
    if "score" in a.columns:
        return a.groupBy("vid").agg(F.max("score").alias("score"))
    return a.select("vid").distinct()
