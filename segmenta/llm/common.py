"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the controls 9 to 13, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch. Texts may be long, so batches hold few of them.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds at once; a session setting, as Spark has no other."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a single-machine session (tests, a laptop) gets a
    temporary folder; a cluster must name one, as a machine's own folder is lost with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that docs does not have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame, stored: bool) -> tuple[DataFrame, str]:
    """docs with a row number, and that column's name. stored: docs is a plain read of stored files, whose rows come out
    with the same numbers each time; any other plan is saved first, as it need not give its rows in the same order."""
    name = free_name(docs, "__uid")
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    return (rows if stored else saved(rows)), name


def small(saved_df: DataFrame, most: int) -> DataFrame:
    """A saved table, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(saved_df) if saved_df.count() <= most else saved_df


#: Rows of side tables up to which they are broadcast, rows of a key from which it is dealt out, and tasks it is dealt to.
FEW, HOT, SALTS = 1 << 17, 1 << 12, 64


def dealt_join(rows: DataFrame, of: DataFrame, key: str, by: str, counts: DataFrame) -> DataFrame:
    """rows joined with of, which has one row a key. Keys with over HOT rows, by counts (key, n), are dealt to SALTS tasks
    by the column `by`; there are at most rows / HOT such keys."""
    hot = small(saved(counts.filter(F.col("n") > HOT).select(key, F.lit(SALTS).alias("__salts"))), FEW)
    salt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    left = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__salts")
    right = of.join(hot, key, "left").withColumn("__salt", each).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
