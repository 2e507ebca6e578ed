"""The corpus pipeline: documents pass through operators of segmenta.llm, each stage over all that the last one kept.

language     documents with a letter whose language is identified stay
lines        later copies of lines and near copies of long lines go; every document stays
near         of each group of documents whose 5-word shingles are similar to 0.8 the one with the least id stays
mixing       documents are taken as their source's target asks, up to twice
encoding     texts become SentencePiece ids, checked by decoding

A stage's input is a stored table, so its rows can be numbered again in the same order. run() leaves its intermediate tables in
the shared folder, as the result is lazy and reads the last of them; drop_intermediate() removes them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from segmenta.llm import langid, line_dedup, mixing, pieces, simhash
from segmenta.llm.common import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs, stored=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, stored=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, stored=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mixing", mixed), ("encoding", encoding)]
#: Hashed n-gram scores, fingerprints and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
FOLDER = "pipeline-"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{FOLDER}{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


def drop_intermediate(spark: SparkSession) -> int:
    """Remove the intermediate tables of all runs in the shared folder; how many runs had left some. Results that have not
    been written by then can no longer be read."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith(FOLDER)]
    return sum(fs.delete(p, True) for p in left)
