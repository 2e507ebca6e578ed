"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names. Where it is unset, a single-machine session
    (tests, a laptop) gets a temporary folder; a cluster must name one, as executors have to share it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()
